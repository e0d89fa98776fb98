"""Readers and writers: nothing stops a batch, nothing is half written, nothing is overwritten by mistake."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators import registry as R
from lexloom.operators.scope import Scope, requested, searchable
from lexloom.sources import files
from lexloom.sources.paged import PagedReader, PagedSource, with_retry

SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("label", T.StringType())])


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfgood text")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x80")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    got = {r["filename"]: (r["raw_text"], r["status"], r["reason"]) for r in files.whole_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("good text", "TEXT", "") and got["d.txt"][:2] == ("caf\u00e9  end", "TEXT")
    assert got["b.txt"][1:] == ("OCR_FAIL", "no readable text") and got["c.txt"][1:] == ("OCR_FAIL", "empty file")
    sums = {r["filename"]: r["sha256"] for r in files.checksums(spark, str(tmp_path)).collect()}
    assert sums["b.txt"] == hashlib.sha256(b"\xff\xfe\x80").hexdigest()


def test_errors_name_file_and_line(spark, tmp_path):
    path = tmp_path / "gold"
    path.mkdir()
    (path / "oos.jsonl").write_text('# head\n\n{"item_id": "1", "label": "yes"}\n{"item_id": "2", "label": "maybe"}\n{"label": "yes"}\nno json\n{"item_id": "3", "label": "yes", "x": 1}\n')
    (path / "ok.jsonl").write_text('{"item_id": "1", "label": "yes"}\n// end\n')
    rows = {r["line_no"]: r["problem"] for r in files.json_lines(spark, f"{path}/oos.jsonl", SCHEMA, ["item_id"], {"label": ["yes", "no"]}).collect()}
    assert rows == {3: None, 4: "bad value of label: maybe", 5: "missing field: item_id", 6: "not a JSON object", 7: "unknown field: x"}
    spec = (SCHEMA, ["item_id"], {"label": ["yes", "no"]})
    loaded, missing = files.gold_sets(spark, str(path), {"oos": spec, "ok": spec, "absent": spec})
    assert set(loaded) == {"ok"} and missing["absent"] == "no such file" and missing["oos"].startswith("oos.jsonl:4: bad value") and "oos.jsonl:7" in missing["oos"]


def test_logs_take_unseen_rows_only(spark, tmp_path):
    log = f"{tmp_path}/log"
    twice = spark.createDataFrame([("k", 3), ("k", 1), ("k", 2)], "annotation_id string, n int").repartition(3)
    assert files.append_unseen(spark, f"{tmp_path}/twice", twice, "annotation_id") == 1 and spark.read.json(f"{tmp_path}/twice").first()["n"] == 1
    first = spark.createDataFrame([("b", 1), ("a", 1), ("a", 1)], "annotation_id string, n int")
    assert files.append_unseen(spark, log, first, "annotation_id") == 2
    assert files.append_unseen(spark, log, spark.createDataFrame([("a", 9), ("c", 2)], "annotation_id string, n int"), "annotation_id") == 1
    assert files.append_unseen(spark, log, first, "annotation_id") == 0
    assert sorted(tuple(r) for r in spark.read.json(log).select("annotation_id", "n").collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "y"), (1, "x"), (3, None)], "k int, v string")
    with pytest.raises(ValueError, match="missing field: v"):
        files.write_json_lines(df, f"{tmp_path}/j", "k", ["v"])
    assert not (tmp_path / "j").exists()
    files.write_json_lines(df, f"{tmp_path}/j", "k", ["k"])
    files.write_frozen(df, f"{tmp_path}/f")
    with pytest.raises(Exception, match="already exists"):
        files.write_frozen(df, f"{tmp_path}/f")
    files.write_frozen(df.limit(1), f"{tmp_path}/f", force=True)
    files.reload(spark.read.parquet(f"{tmp_path}/f").unionByName(df), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 4
    manifest = files.export({"one": df, "two": df.limit(2)}, f"{tmp_path}/e")
    assert {r["table"]: r["n"] for r in manifest.collect()} == {"one": 3, "two": 2} == {r["table"]: r["n"] for r in spark.read.json(f"{tmp_path}/e/manifest").collect()}
    assert spark.read.option("header", True).csv(f"{tmp_path}/e/csv/one").count() == 3
    files.blind_sheets(df, "k", ["v"], f"{tmp_path}/b")
    assert spark.read.option("header", True).csv(f"{tmp_path}/b/sheet").columns == ["k"] and spark.read.option("header", True).csv(f"{tmp_path}/b/key").columns == ["k", "v"]


def test_batches_come_back(spark, tmp_path):
    rows, calls = spark.range(100).withColumnRenamed("id", "k"), []

    def work(some):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return some.withColumn("twice", F.col("k") * 2)

    with pytest.raises(RuntimeError):
        files.in_batches(rows, "k", 4, f"{tmp_path}/w", work)
    got = files.in_batches(rows, "k", 4, f"{tmp_path}/w", work)
    assert len(calls) == 5 and got.count() == 100 and got.where("twice <> 2 * k").isEmpty()


def test_edits_by_index(spark):
    rows = spark.createDataFrame([("p3", "c"), ("p1", "a"), ("p2", "b")], "page string, text string")
    view = files.indexed_view(rows, "page")
    assert [(r["index"], r["page"]) for r in view.orderBy("index").collect()] == [(1, "p1"), (2, "p2"), (3, "p3")]
    edited = view.withColumn("text", F.when(F.col("index") == 2, "B").otherwise(F.col("text")))
    assert {r["page"]: r["text"] for r in files.from_view(rows, edited, "page", "text").collect()} == {"p1": "a", "p2": "B", "p3": "c"}
    with pytest.raises(ValueError):
        files.from_view(rows.where("page <> 'p1'"), edited, "page", "text")


def test_report_and_scaler(spark, tmp_path):
    m = spark.createDataFrame([("b", "mrr", 0.5, "ok", 4, ""), ("a", "kappa", None, "unavailable", 0, "fewer_than_two_raters")], "section string, name string, value double, status string, n long, reason string")
    text = files.report_markdown(m, "Run")
    assert text.index("## a") < text.index("## b") and "| mrr | 0.5000 | 4 |" in text and "_unavailable_ (fewer_than_two_raters)" in text
    files.write_report(m, f"{tmp_path}/r", "Run")
    assert spark.read.json(f"{tmp_path}/r/json").count() == 2 and spark.read.text(f"{tmp_path}/r/markdown").count() > 5
    assert files.load_scaler(spark, f"{tmp_path}/s") == (1.0, 0.0, 0.5)
    files.save_scaler(spark, f"{tmp_path}/s", 2.0, -1.0, 0.65)
    assert files.load_scaler(spark, f"{tmp_path}/s") == (2.0, -1.0, 0.65)


def test_sheets_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes(b"\xef\xbb\xbfid,verdict\n1,correct\n2,\n")
    got = {r["id"]: r["complete"] for r in files.csv_sheet(spark, f"{tmp_path}/s.csv", "id string, verdict string", ["id", "verdict"]).collect()}
    assert got == {"1": True, "2": False}


def test_english_pages(spark, tmp_path):
    hindi = "\u0927\u093e\u0930\u093e " * 30
    (tmp_path / "a.txt").write_text("Article one of the Constitution says what the name of the country is.\f" + hindi + "\fshort", encoding="utf-8")
    assert [(r["filename"], r["page_no"]) for r in files.english_articles(spark, str(tmp_path)).collect()] == [("a.txt", 1)]


def test_registry_tables_round_trip(spark, tmp_path):
    tables = {"statutes": R.statutes(spark), "sections": R.sections(spark).withColumn("heading", F.lit(None).cast("string")).select("section_id", "statute_id", "kind", "number", "heading", "in_force_from", "in_force_to", "status"), "supersession": R.supersession(spark)}
    files.export(tables, f"{tmp_path}/r")
    for form in ("parquet", "csv"):
        st, se, su = R.read_registry(spark, f"{tmp_path}/r/{form}", form)
        m = spark.createDataFrame([("Section 420 IPC", "2025-01-01")], "raw string, d string").withColumn("as_of", F.to_date("d"))
        got = R.check(R.resolve(m, "raw", se, st), "as_of", se, st, su).first()
        assert (got["status"], got["note"]) == ("superseded", "repealed 2024-07-01; see BNS 318")
    assert R.registry_problems(*tables.values()).isEmpty()
    assert [tuple(r) for r in R.registry_problems(tables["statutes"].where("statute_id <> 'ni-1881'"), *list(tables.values())[1:]).collect()] == [("section_without_statute", "ni-1881-s138")]


def test_scope(spark):
    for bad in (((), "o"), ((1,), "")):
        with pytest.raises(ValueError):
            Scope(*bad)
    scope = Scope([1, 2], "o")
    assert scope.contains(1) and not scope.contains(3)
    df = spark.createDataFrame([(1, "o"), (1, "other"), (3, "o")], "doc_id long, owner_id string")
    assert [tuple(r) for r in scope.rows(df).collect()] == [(1, "o")]
    ids = spark.createDataFrame([([1, 9], [1, 2]), ([9], [1, 2]), (None, [1, 2])], "a array<int>, b array<int>").select(requested(F.col("a"), F.col("b")))
    assert [r[0] for r in ids.collect()] == [[1], [1, 2], [1, 2]]
    chunks = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False), (4, None, False)], "k int, o string, bm25_indexed boolean")
    assert sorted(r["k"] for r in searchable(chunks, "o").collect()) == [1, 3, 4]


def flaky_page(page):
    """Two rows on each of three pages; the first try of page 1 fails."""
    mark = os.environ["FLAKY_MARK"]
    if page == 1 and not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("busy")
    return [{"id": f"{page}-{i}", "extra": 1} for i in range(2)] if page < 3 else []


def test_pages_are_tried_again(tmp_path, monkeypatch):
    calls = []

    def once_busy():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert with_retry(once_busy, pause=0.0) == "ok" and len(calls) == 3
    monkeypatch.setenv("FLAKY_MARK", f"{tmp_path}/one")
    with pytest.raises(OSError):
        with_retry(lambda: flaky_page(1), attempts=1)
    monkeypatch.setenv("FLAKY_MARK", f"{tmp_path}/two")
    reader = PagedReader({"fetch": f"{__name__}:flaky_page", "pages": "5", "pause": "0"}, T.StructType([T.StructField("id", T.StringType())]))
    assert [row for p in reader.partitions() for row in reader.read(p)] == [(f"{p}-{i}",) for p in range(3) for i in range(2)]


def test_page_source_in_spark(spark):
    spark.dataSource.register(PagedSource)
    got = spark.read.format("pages").option("fetch", "calendar:_page_of_nothing").option("pages", 0).schema("id string").load()
    assert got.count() == 0


def test_documents_without_split_are_an_error(spark):
    from lexloom.operators.corpus import with_split

    rows, none = spark.createDataFrame([(1,), (2,)], "d int"), spark.createDataFrame([], "d int")
    splits = spark.createDataFrame([(1, "train")], "d int, split string")
    assert [tuple(r) for r in with_split(rows, splits, rows.where("d = 2"), "d").collect()] == [(1, "train")]
    with pytest.raises(Exception, match="no split for 2"):
        with_split(rows, splits, none, "d").collect()
