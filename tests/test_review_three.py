"""What the third review found, each on a few rows."""

from collections import Counter

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.llm import langid
from lexloom.plans import catalog


def test_sentences_keep_their_digits(spark):
    """The place of a sentence is not trimmed off it."""
    df = spark.createDataFrame([("Zero. One. 28.68 Two. 3. 41 four",)], "t string")
    assert df.select(T.sentences(F.col("t"))).first()[0] == ["Zero.", "One.", "28.68 Two.", "3.", "41 four"]
    assert df.select(T.fragments(F.col("t"))).first()[0] == ["Zero.", "One.", "28.68 Two.", "3.", "41 four"]


def test_only_whole_character_references_are_resolved(spark):
    """A page that is cut inside a reference keeps what is left of it."""
    df = spark.createDataFrame([("<p>a &amp; b &amp;lt; &#65;&#x42; &eacute; &copyright; c &am</p>d&ampd &amp",)], "t string")
    assert df.select(T.html_text(F.col("t"))).first()[0] == "a & b &lt; AB é &copyright; c &am\nd&ampd &amp"


def test_lines_that_begin_with_an_address_are_text(spark, tmp_path):
    """A network address at a line's start is no header date, so texts that differ in such a line are no copies; a date still is."""
    texts = ["same\n28.68.191.238 one two three four five six", "same\n70.32.29.134 seven eight nine ten", "same\n12.03.1998 listed", "same"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("exact_duplicates") == [(0, 0, 1), (1, 1, 1), (2, 2, 2), (3, 2, 2)]
    assert run("shingle_count") == [(0, 7), (1, 5), (2, 1), (3, 1)]


def test_kappa_of_one_label_reads_all_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in catalog.QUERIES["kappa_single_label"](spark, str(tmp_path)).select("n", "kappa", "kappa_of_one_label").collect()] == [(3, None, 1.0)]


def test_spans_of_marked_texts(spark):
    """Places are the same whether a text holds the mark that parts matches from gaps or not."""
    df = spark.createDataFrame([("12 a 345",), (f"12{T.MARK}a 345",), ("none",), ("",), (None,), ("7",)], "t string")
    got = [r[0] and [tuple(s) for s in r[0]] for r in df.select(T.match_spans(F.col("t"), r"\d+")).collect()]
    assert got == [[(0, 2, "12"), (5, 8, "345")]] * 2 + [[], [], None, [(0, 1, "7")]]


def test_work_on_a_small_file_is_dealt(spark, tmp_path):
    """A table of narrow columns is one file; the entities and citations of its rows are many tasks."""
    spark.range(64).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("ner_all_labels", "resolve_citation", "check_citation_asof", "existence_status"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(16)" in plan, name


def test_a_long_batch_does_not_fill_the_cache(monkeypatch):
    """The words that a worker remembers are bounded between the texts of a batch, and scores do not depend on it."""
    texts = [" ".join(f"{a}{b}{c}{d}" for c in "abcdefgh" for d in "abcdefgh") for a in "xyzw" for b in "klmn"]
    model = langid.LanguageModel({"x": Counter(langid.pieces(texts[0])), "y": Counter(langid.pieces(texts[5]))})
    whole, n = model.totals(texts)
    model.cache = {}
    monkeypatch.setattr(langid, "CACHE_WORDS", 100)
    cut, m = model.totals(texts)
    assert len(model.cache) <= 164 and (n == m).all() and (whole == cut).all()
