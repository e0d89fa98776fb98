"""Readers of text, record and table files, and deterministic writers. Bad input becomes rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import unescaped
from lexloom.operators.ordering import ranked
from lexloom.operators.records import english_page


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """filename, raw_text, status, reason: one row per text file, in UTF-8 with unreadable bytes left out.

    Empty files, and files with nothing readable, are rows with OCR_FAIL; no file stops the batch.
    """
    found = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = found.select(name.alias("filename"), _decoded(F.col("content")).alias("raw_text"))
    ok = F.length(F.regexp_replace("raw_text", r"\s", "")) > 0
    read = df.select("filename", "raw_text", F.when(ok, "TEXT").otherwise("OCR_FAIL").alias("status"), F.when(ok, "").otherwise("no readable text").alias("reason"))
    # the reader passes over files without a byte; the listing, which the driver holds anyway, has them
    listed = spark.createDataFrame([(unquote(f.rsplit("/", 1)[1]),) for f in found.inputFiles()], "filename string")
    empty = listed.join(found.select(name.alias("filename")), "filename", "left_anti")
    return read.unionByName(empty.select("filename", F.lit("").alias("raw_text"), F.lit("OCR_FAIL").alias("status"), F.lit("empty file").alias("reason")))


def _decoded(content: Column) -> Column:
    """Bytes as UTF-8, what is not UTF-8 left out; a byte order mark too."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, "\ufffd", ""), "^\ufeff", "")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """filename and the SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.sha2("content", 256).alias("sha256"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """filename, line_no from 1, line; each file is one row before its lines are numbered, as logs and gold files are small each."""
    whole = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), _decoded(F.col("content")).alias("t"))
    return whole.select("filename", F.posexplode(F.split("t", "\r?\n")).alias("i", "line")).select("filename", (F.col("i") + 1).alias("line_no"), "line")


def paired_texts(spark: SparkSession, left: str, right: str) -> DataFrame:
    """stem, left_text, right_text of files with the same stem in two folders."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    a = whole_texts(spark, left).select(stem.alias("stem"), F.col("raw_text").alias("left_text"))
    return a.join(whole_texts(spark, right).select(stem.alias("stem"), F.col("raw_text").alias("right_text")), "stem")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, required: list[str], domains: dict[str, list[str]] | None = None) -> DataFrame:
    """Strict record reader: filename, line_no, line (text), the fields, and problem (null if the record is valid).

    Blank lines and lines that start with # or // are skipped, but counted in line_no. Unknown fields, missing required fields
    and values outside their domain are told in `problem`.
    """
    lines = numbered_lines(spark, path).where(~F.col("line").rlike(r"^\s*(#|//|$)"))
    keys = F.json_object_keys("line")
    known = F.array(*[F.lit(f.name) for f in schema])
    df = lines.select("filename", "line_no", "line", F.from_json("line", schema).alias("r"), keys.alias("k"))
    problems = [
        F.when(F.col("k").isNull(), F.lit("not a JSON object")),
        F.when(F.size(F.array_except("k", known)) > 0, F.concat(F.lit("unknown field: "), F.array_join(F.array_except("k", known), ", "))),
        *[F.when(F.col(f"r.{c}").isNull(), F.lit(f"missing field: {c}")) for c in required],
        *[F.when(~F.col(f"r.{c}").isin(v), F.concat(F.lit(f"bad value of {c}: "), F.col(f"r.{c}"))) for c, v in (domains or {}).items()],
    ]
    return df.select("filename", "line_no", "line", "r.*", F.coalesce(*problems).alias("problem"))


def valid_records(records: DataFrame) -> DataFrame:
    """The records, if none has a problem; otherwise an error that names the first ten by file and line."""
    bad = records.where(F.col("problem").isNotNull()).select("filename", "line_no", "problem").orderBy("filename", "line_no").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r['filename']}:{r['line_no']}: {r['problem']}" for r in bad))
    return records.drop("problem")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def gold_sets(spark: SparkSession, folder: str, specs: dict[str, tuple[T.StructType, list[str], dict[str, list[str]]]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The sets that a folder holds as <name>.jsonl, validated, and the reason for each that is missing or bad."""
    loaded, missing = {}, {}
    for name, (schema, required, domains) in specs.items():
        path = f"{folder}/{name}.jsonl"
        if not exists(spark, path):
            missing[name] = "no such file"
            continue
        try:
            loaded[name] = valid_records(json_lines(spark, path, schema, required, domains))
        except ValueError as e:
            missing[name] = str(e)
    return loaded, missing


def append_unseen(spark: SparkSession, log: str, batch: DataFrame, key: str) -> int:
    """Rows of the batch whose key the log (JSON lines) has not yet, appended in order of the key; of equal keys the row that is least as JSON; returns how many."""
    row = F.struct(*batch.columns)
    first = batch.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    if exists(spark, log):
        first = first.join(spark.read.schema(batch.schema).json(log).select(key), key, "left_anti")
    new = first.select(*batch.columns).sort(key).checkpoint()
    n = new.count()
    if n:
        new.write.mode("append").json(log)
    return n


def english_articles(spark: SparkSession, path: str) -> DataFrame:
    """filename, page_no, page: the pages (between form feeds) of text files that are mostly in ASCII letters."""
    pages = whole_texts(spark, path).select("filename", F.posexplode(F.split("raw_text", "\f")).alias("i", "page"))
    return pages.where(english_page(F.col("page"))).select("filename", (F.col("i") + 1).alias("page_no"), "page")


def html_rows(html: Column) -> Column:
    """Cells of each table row as arrays, character references resolved, white space collapsed, rows without any text dropped."""
    html = unescaped(F.replace(html, F.lit("&lt;"), F.lit("&amp;lt;")))
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))))
    return F.filter(cells, lambda r: F.exists(r, lambda c: F.length(c) > 0))


def csv_sheet(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rater sheet, with or without a byte order mark, with a flag for rows whose required cells are all filled."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)
    full = F.lit(True)
    for c in required:
        full = full & (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    return df.withColumn("complete", full)


def write_json_lines(df: DataFrame, path: str, key: str, required: list[str] = ()) -> None:
    """Records with sorted fields, ordered by key within contiguous key ranges; nothing is written if a required field is null somewhere."""
    for c in required:
        if not df.where(F.col(c).isNull()).isEmpty():
            raise ValueError(f"missing field: {c}")
    df.select(*sorted(df.columns)).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_frozen(df: DataFrame, path: str, force: bool = False) -> None:
    """A split that must not change: refuses to overwrite, unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def reload(df: DataFrame, path: str) -> None:
    """Replace a table by new content, which may have been read from it."""
    df.checkpoint().write.mode("overwrite").parquet(path)


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as parquet (zstd) and CSV side by side, and a manifest (table, n) written last, so that its presence means all is there."""
    spark, counts = next(iter(tables.values())).sparkSession, []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/parquet/{name}")
        df.write.mode("overwrite").option("header", True).csv(f"{path}/csv/{name}")
        counts.append((name, spark.read.parquet(f"{path}/parquet/{name}").count()))
    manifest = spark.createDataFrame(counts, "table string, n long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def blind_sheets(rows: DataFrame, key: str, hidden: list[str], path: str) -> None:
    """A rater's sheet without the hidden columns, and the answer key with them, as two CSV tables."""
    rows.drop(*hidden).write.mode("overwrite").option("header", True).csv(f"{path}/sheet")
    rows.select(key, *hidden).write.mode("overwrite").option("header", True).csv(f"{path}/key")


def indexed_view(rows: DataFrame, key: str) -> DataFrame:
    """rows with index, their place from 1 in order of the key: what people edit; `from_view` brings the edits back."""
    return ranked(rows, F.col(key), name="index").withColumn("index", F.col("index") + 1)


def from_view(rows: DataFrame, view: DataFrame, key: str, column: str) -> DataFrame:
    """rows with a column replaced by the view's where its index and key still belong together; a view of other rows is an error."""
    own = indexed_view(rows.select(key), key).withColumnRenamed(key, "__key")
    if not view.join(own, "index", "left").where(~F.col(key).eqNullSafe(F.col("__key"))).isEmpty():
        raise ValueError("the view's index does not belong to these rows")
    new = view.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def in_batches(rows: DataFrame, key: str, batches: int, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over rows dealt into batches by a hash of the key, each written by itself; a run that comes back skips those that are there.

    The rows are written once, in a folder for each batch, so that a batch reads its own rows only.
    """
    spark, dealt = rows.sparkSession, f"{path}/input"
    if not exists(spark, f"{dealt}/_SUCCESS"):
        rows.withColumn("__batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")).write.mode("overwrite").partitionBy("__batch").parquet(dealt)
    kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__batch", T.IntegerType())])).parquet(dealt)
    for i in range(batches):
        target = f"{path}/batch={i}"
        if not exists(spark, f"{target}/_SUCCESS"):
            work(kept.where(F.col("__batch") == i).drop("__batch")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(*[f"{path}/batch={i}" for i in range(batches)])


def report_markdown(metrics: DataFrame, title: str) -> str:
    """A report's table from metric rows (section, name, value, status, n, reason), by section and name; what was not measured says why.

    For the rows of a report, some for each section, not for data.
    """
    cell = F.when(F.col("value").isNotNull(), F.format_number("value", 4)).otherwise(F.concat(F.lit("_unavailable_ ("), "reason", F.lit(")")))
    lines, last = [f"# {title}"], None
    for r in metrics.select("section", "name", cell.alias("cell"), "n").orderBy("section", "name").toLocalIterator():
        if r["section"] != last:
            lines += ["", f"## {r['section']}", "", "| metric | value | n |", "|---|---|---|"]
            last = r["section"]
        lines.append(f"| {r['name']} | {r['cell']} | {r['n']} |")
    return "\n".join(lines) + "\n"


def write_report(metrics: DataFrame, path: str, title: str) -> None:
    """The rows as JSON and the Markdown as text, side by side."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    spark = metrics.sparkSession
    spark.createDataFrame([(report_markdown(metrics, title),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def save_scaler(spark: SparkSession, path: str, slope: float, offset: float, threshold: float) -> None:
    spark.createDataFrame([(slope, offset, threshold)], "slope double, offset double, threshold double").coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> tuple[float, float, float]:
    """Slope, offset and threshold; the identity with one half where nothing was saved."""
    return tuple(spark.read.parquet(path).first()) if exists(spark, path) else (1.0, 0.0, 0.5)
