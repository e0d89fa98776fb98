"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import exact_dedup, langid, lm_scoring, mixing, packing, quality_classifier, quality_rules, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "row", "h", "bucket", "size", "shard", "fp", "keep_id", "host", "line", "n", "rate", "part", "tie", "accepted", "__own", "__id", "__sha", "__row", "__text", "__copy", "__of", "__rate", "__key", "__fp", "__keep", "__host", "__content", "__gone", "norm", "owner", "hot", "chain", "n_rows"]


def rows():
    words = "the quick brown fox jumps over a lazy dog near river banks while seven small birds sing".split()
    plain = [" ".join(words[(i * j) % len(words)] for j in range(1, 60)) for i in range(1, 12)]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate(plain)]
    out += [(20, None, "en", "s0", None), (21, "", None, None, 0), (22, " \n\t ", "en", "s1", 4), (None, "no id here", "en", "s2", 9), (None, None, None, None, None)]
    out += [(23, plain[0].upper(), "en", "s0", 1), (24, plain[0], "en", "s0", 1), (24, plain[0], "en", "s0", 1)]  # a tie in text, a repeated row
    out += [(25, "word " * 60_000, "en", "s1", 300_000), (26, "x" * 200_000, "en", "s1", 200_000), (27, "\U0001f600 ### 12345 ... ² ½ Ⅷ", "en", "s2", 17), (28, "né à la mère", "fr", "s2", 12)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASH]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(20, 1, None), (None, 1, 1), (21, None, 0)], "doc_id long, quality int, toxic int")


def fitted_quality(docs, labels):
    model = quality_classifier.QualityModel()
    model.fit(quality_classifier.labelled_sample(docs, labels, "quality", F.lit(True)))
    return model


def fitted_toxicity(docs, labels):
    model = toxicity.ToxicityModel()
    model.fit(quality_classifier.labelled_sample(docs, labels, "toxic", F.lit(True)))
    return model


PER_ROW = {
    "langid": lambda d, lab: langid.identify(d, langid.fit(d), ["doc_id"]),
    "sharding": lambda d, lab: sharding.shard_by_bytes(d, 8),
    "exact": lambda d, lab: exact_dedup.find_groups(d),
    "mixing": lambda d, lab: mixing.mix(d),
    "quality": lambda d, lab: quality_classifier.score_quality(d, fitted_quality(d, lab), ["doc_id"]),
    "simhash": lambda d, lab: simhash.find_groups(d),
    "lm": lambda d, lab: lm_scoring.score_texts(d, F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))),
    "toxicity": lambda d, lab: toxicity.score_toxicity(d, fitted_toxicity(d, lab), ["doc_id"]),
    "rules": lambda d, lab: quality_rules.apply_rules(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_once(name, docs, labels):
    got = PER_ROW[name](docs, labels).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(name, spark, docs, labels):
    assert PER_ROW[name](docs.limit(0), labels.limit(0)).collect() == []


def test_packing_edges(docs):
    got = packing.pack(docs, group_rows=7).collect()
    whole = {}
    for r in got:
        whole[r["doc_id"]] = whole.get(r["doc_id"], 0) + r["tokens"]
    assert whole[20] == whole[21] == 1 and whole[25] == 60_001 and whole[None] == 4 + 1
    assert packing.pack(docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, stage):
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, docs, "")
    if stage < 4:
        assert got.columns == docs.columns
        assert {r["doc_id"] for r in got.select("doc_id").collect()} <= {r[0] for r in rows()}
    assert f(spark, docs.limit(0), "").collect() == []


def test_repeated_rows_leave_one(spark, docs):
    kept = [r["doc_id"] for r in exact_dedup.deduplicate(docs).select("doc_id").collect()]
    assert kept.count(24) == 1 and 0 not in kept and 23 not in kept
    kept = [r["doc_id"] for r in simhash.deduplicate(docs).select("doc_id").collect()]
    assert kept.count(0) == 1 and kept.count(24) == 0


def test_simhash_stage_keeps_one_row_of_each_group(spark):
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(80))
    plain = [(1, words("a"), "x"), (None, words("a"), "x"), (None, words("b"), "x"), (None, words("c"), "x"), (None, words("c"), "y")]  # null ids linked to an id, alone, and in a group of their own
    plain += [(5, words("d"), "x"), (5, words("e"), "x"), (4, words("e"), "x"), (6, words("f"), "x"), (6, words("g"), "x"), (7, words("h"), "x"), (7, words("h"), "y")]  # repeated ids
    for rows in (plain, plain[::-1], [r for r in plain if r[0] != 1]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit("extra").alias("fp")).repartition(3)
        kept = simhash.deduplicate(docs)
        assert kept.columns == docs.columns
        want = {}
        for d, t, _ in rows:
            want[t] = min((x for x in (want.get(t), d) if x is not None), default=None)
        assert sorted((r["text"], r["doc_id"] or 0) for r in kept.collect()) == sorted((t, d or 0) for t, d in want.items())


def test_rules_give_texts_without_frequent_lines(spark):
    own = lambda i: " ".join(f"{chr(0x4E00 + i)}x{j}" for j in range(60))
    rows = [(None if i % 5 == 0 else i // 2, f"Shared {i:02} line\n\n{own(i)}\n  another  SHARED line\nlast", "a") for i in range(30)]
    rows += [(100, f"shared 01 line\n{own(100)}", "b"), (101, "short\nlast", "a"), (102, f"shared 07 line\n{own(102)}\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit("extra").alias("content")).repartition(3)
    got = quality_rules.clean(docs)
    assert got.columns == docs.columns
    want = [(d, f"\n{own(i)}", s) for i, (d, _, s) in enumerate(rows[:30])] + [rows[30], rows[32]]
    key = lambda r: (r[1], r[0] or -1)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=key) == sorted(want, key=key)
    lost = {r["removed_chars"] for r in quality_rules.apply_rules(docs).where("kept AND removed_lines = 3").collect()}
    assert lost == {len("Shared 00 line" + "  another  SHARED line" + "last")}


def test_quality_reads_long_tokens_to_their_end():
    head, good, bad = (lambda n: "#1a" * n), "ab" * 40, "{}Q7;" * 16
    model = quality_classifier.QualityModel()
    model.fit((head(100 + i // 2) + (good if i % 2 else bad), i % 2) for i in range(400))
    scores = model.score([head(400) + good, head(400) + bad])  # tokens that training has not seen
    assert scores[0] > 0.9 and scores[1] < 0.1
    assert quality_classifier.pieces(["x" * 70, "y"]) == ["x" * 32, "x" * 32, "x" * 6, "y"]


def test_letters_are_letters():
    assert langid.pieces("² ½ Ⅷ ① ٣ 7 _") == [] and langid.pieces("AB²c né Ⅷx हिन्दी") == ["ab", "c", "né", "x", "हिन्दी"]
    assert langid.pieces("x" * 70 + "1" + "y") == langid.pieces("x" * 70 + "²" + "y") == ["x" * 64, "x" * 6, "y"]


def test_packing_keeps_large_ids_beside_null(spark):
    big = (1 << 53) + 1
    got = packing.pack(spark.createDataFrame([(big, "a b"), (None, "c"), (big + 2, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["tokens"]) for r in got) == [(0, 2), (big, 3), (big + 2, 1)]


def test_equal_ids_follow_by_size_across_partitions(spark):
    docs = spark.createDataFrame([(7, "x" * ((31 * i) % 97)) for i in range(97)], "doc_id long, text string").repartition(4)
    got = sorted(sharding.shard_by_bytes(docs, 8, partitions=5).collect(), key=lambda r: r["prefix_bytes"])
    assert [r["size"] for r in got] == list(range(1, 98))


def test_null_and_letterless_texts_are_unknown(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs), ["doc_id"]).collect() if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == "und" and not got[i]["accepted"] and got[i]["score"] == 0 for i in (20, 21, 22, 27))


def test_short_texts_are_known_though_some_long_ones_are_mixed():
    """Long texts in two languages are no reason to doubt a short text in one."""
    rng = random.Random(11)
    say = {"a": lambda n: " ".join(rng.choice(["bada", "koda", "mida", "bako"]) for _ in range(n)), "z": lambda n: " ".join(rng.choice(["zuxe", "wyxe", "vexu", "xuwy"]) for _ in range(n))}
    words = {x: Counter(langid.pieces(f(4000))) for x, f in say.items()}
    model = langid.LanguageModel(words)
    texts = [(say[x](rng.randint(3, 60)), x) for x in "az" * 150]
    texts += [(f"{say['a'](200)} {say['z'](200)}", rng.choice("az")) for _ in range(12)]
    model.calibrate([t for t, _ in texts], [x for _, x in texts])
    lang, score, _, ok = model.predict([say["a"](4), say["z"](4), f"{say['a'](300)} {say['z'](300)}", "", None])
    assert lang == ["a", "z", lang[2], "und", "und"] and ok[0] and ok[1] and min(score[:2]) > 0.9 > score[2] and not ok[3:].any()


def test_mixing_of_equal_ids(spark):
    """Three hundred equal rows are taken as often as their target says; so are rows that share an id but not the text, and reruns agree."""
    same = [(7, "one two three four five", "en", "a", 23)] * 300 + [(None, f"word {i} of many", "en", "b", 9) for i in range(400)] + [(i, "x y", "en", "c", 3) for i in range(400)]
    frame = spark.createDataFrame(same, SCHEMA).repartition(4)
    taken = {r["source"]: (r["taken"], r["target"]) for r in mixing.mix(frame).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) < 0.12 * target for t, target in taken.values()), taken
    first, again = (Counter(tuple(r) for r in mixing.emit(frame).collect()) for _ in range(2))
    assert first == again
    words = Counter()
    for row, n in first.items():
        words[row[3]] += n * len(row[1].split(" "))
    assert dict(words) == {s: t for s, (t, _) in taken.items()}


def test_every_language_is_learned(spark):
    """Three hundred values of lang, each with its own letters."""
    rows = [(k * 10 + i, (chr(0x4E00 + 7 * k) + chr(0x4E01 + 7 * k) + " ") * 40, f"l{k}", "s", 1) for k in range(300) for i in range(6)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert len(model.langs) == 300
    got = model.predict([r[1] for r in rows[::6]])[0]
    assert got == [r[2] for r in rows[::6]]
