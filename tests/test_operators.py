"""Operators on cases with known answers."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import measures as M
from lexloom.functions import text as T
from lexloom.functions.unicode import normal_form
from lexloom.operators import chunking, claims as C, corpus, entities, evaluation as E, perturb, records, registry as R, retrieval
from lexloom.plans.ask import ask
from lexloom.sources import files
from lexloom.streaming.latency import stage_latency

DAY = datetime.date.fromisoformat


def test_clauses_slice_back(spark):
    text = "  preamble here\n Section 1. Scope\nbody\n\nClause 2B text\f more\nSection 1. Scope\nbody " + "x" * 900
    df = spark.createDataFrame([("d", text), ("e", "no boundary at all"), ("f", " \n ")], "doc_id string, text string")
    rows = chunking.clauses(df, "doc_id", "text").orderBy("doc_id", "para_no").collect()
    mine = [r for r in rows if r["doc_id"] == "d"]
    assert [r["section_label"] for r in mine] == [None, "Section 1", "Clause 2B", "Section 1"]
    assert all(text[r["char_start"] : r["char_end"]] == r["chunk_text"] for r in mine)
    assert [r["char_start"] for r in mine] == sorted({r["char_start"] for r in mine})
    assert (mine[-1]["n_children"], mine[-1]["bm25_indexed"], mine[-1]["page_no"]) == (3, False, 2)
    assert [r["doc_id"] for r in rows].count("e") == 1 and "f" not in {r["doc_id"] for r in rows}


def test_slices_and_windows_guard_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, "a" * 4000), (3, "b" * 4001)], "doc_id int, text string")
    assert {r["doc_id"] for r in chunking.slices(df, "text").collect()} == {2, 3}
    starts = {}
    for r in chunking.windows(df, "text").collect():
        starts.setdefault(r["doc_id"], []).append(r["win_start"])
    assert starts == {2: [0], 3: [0, 3500]}


def checked(spark, pairs):
    df = spark.createDataFrame([(i, raw, DAY(day)) for i, (raw, day) in enumerate(pairs)], "i int, raw string, as_of date")
    secs, acts = R.sections(spark), R.statutes(spark)
    return [(r["target_id"], r["status"], r["note"]) for r in R.check(R.resolve(df, "raw", secs, acts), "as_of", secs, acts, R.supersession(spark)).orderBy("i").collect()]


def test_registry_boundaries(spark):
    got = checked(
        spark,
        [
            ("Section 420 IPC", "2026-01-01"), ("Section 420 IPC", "2024-06-30"), ("Section 420 IPC", "2024-07-01"), ("Section 318 BNS", "2020-01-01"), ("Section 124A IPC", "2026-01-01"),
            ("Section 337 IPC", "2026-01-01"), ("Article 238 of the Constitution", "1960-01-01"), ("Article 31 of the Constitution of India", "1979-06-19"), ("Article 31 of the Constitution of India", "1979-06-20"),
            ("Indian Penal Code", "2026-01-01"), ("Article 21 IPC", "2026-01-01"), ("Section 9999 IPC", "2026-01-01"), ("", "2026-01-01"), ("Article 21 of the Constitution of India", "2026-01-01"),
        ],
    )
    assert [g[1] for g in got] == ["superseded", "in_force", "superseded", "not_found", "repealed", "repealed", "repealed", "in_force", "repealed", "superseded", "not_found", "not_found", "not_found", "in_force"]
    assert got[0][2] == "repealed 2024-07-01; see BNS 318" and got[3][2] == "not in force until 2024-07-01"
    assert "no corresponding provision" in got[4][2] and "not recorded" in got[5][2] and "no corresponding" not in got[5][2]
    assert got[9][2] == "repealed 2024-07-01; see BNS" and got[10][0] is None


def test_section_reference_parts(spark):
    rows = spark.createDataFrame([("Section 302A(1)(b) IPC",), ("302 to 304",), ("Indian Penal Code, 1860",), ("Rule 4",)], "t string").select(R.section_ref(F.col("t")).alias("r")).collect()
    assert rows[0]["r"]["number"] == "302A" and rows[0]["r"]["subclauses"] == ["1", "b"]
    assert rows[1]["r"]["number_to"] == "304" and rows[2]["r"] is None and rows[3]["r"]["kind"] == "r"


def test_kappa_and_alpha(spark):
    labels = [("a", "a")] * 8 + [("b", "b")] * 8 + [("a", "b")] * 2 + [("b", "a")] * 2
    df = spark.createDataFrame(labels, "a string, b string")
    assert E.cohen_kappa(df).first()["kappa"] == 0.6
    one = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert E.cohen_kappa(one).first()["kappa"] is None and E.cohen_kappa(one, total_is_one=True).first()["kappa"] == 1.0
    assert E.cohen_kappa(df.limit(0)).first()["kappa"] is None
    r = spark.createDataFrame([(1, "r1", "x"), (1, "r2", "x"), (2, "r1", "x"), (2, "r2", "y"), (3, "r1", "y")], "item_id int, rater_id string, label string")
    got = E.krippendorff_alpha(r).first()
    assert got["n_items"] == 2 and math.isclose(got["alpha"], 0.0, abs_tol=1e-9)
    assert E.percent_agreement(r).first()["agreement"] == 0.5


def test_ndcg_of_a_reversed_ranking(spark):
    ranked = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "a", 3), (2, "z", 1)], "query_id int, doc_id string, rank int")
    judged = spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)], "query_id int, doc_id string, gain double")
    rows = {r["query_id"]: r for r in E.retrieval_per_query(ranked, judged, ranked.select("query_id").distinct()).collect()}
    assert math.isclose(rows[1]["ndcg"], 3.761859507 / 4.761859507, rel_tol=1e-8) and rows[1]["recall5"] == 1 and rows[1]["rr"] == 1
    assert rows[2]["ndcg"] is None and rows[2]["recall5"] == 0


def test_measure_without_evidence(spark):
    df = spark.createDataFrame([(0, 0)], "a int, b int").select(M.measure("x", M.ratio(F.col("a"), F.col("b")), F.col("b"), "no_items").alias("m"))
    m = df.first()["m"]
    assert (m["value"], m["status"], m["reason"]) == (None, "unavailable", "no_items")
    g = E.groundedness(spark.createDataFrame([(None,)], "l boolean"), "l").first()
    assert g["groundedness"] is None and g["hallucination"] is None and g["n_unavailable"] == 1


def test_gate(spark):
    rows = [
        (1, 1, "kept", True, 0.9, None), (1, 2, "struck", True, 0.1, None), (2, 1, "a", True, None, None), (2, 2, "b", True, 0.9, None), (3, 1, "c", False, 0.9, None),
        (4, 1, "d", True, 0.9, None), (5, 1, "e", True, 0.9, "statute_not_in_force_repealed"),
    ]
    claims = C.strike(spark.createDataFrame(rows, "answer int, no int, text string, is_valid boolean, score double, bad_citation string"))
    decided = C.gate(claims, "answer")
    got = {r["answer"]: (r["outcome"], r["n_struck"]) for r in decided.collect()}
    assert got == {1: ("PARTIAL_ALLOW", 1), 2: ("REFUSE", 0), 3: ("REFUSE", 1), 4: ("ALLOW", 0), 5: ("REFUSE", 1)}
    texts = {r["answer"]: r["answer_text"] for r in C.render(claims, decided, "answer", "no").collect()}
    assert texts[1].startswith("kept \n[Notice") and "struck" not in texts[1] and texts[2] == C.REFUSAL and texts[4] == "d"


def test_scope_comes_before_ranking(spark):
    docs = spark.createDataFrame([("o1", 1, "alpha beta gamma"), ("o2", 2, "alpha alpha alpha"), ("o1", 3, "delta epsilon")], "owner string, doc_id int, text string")
    q = spark.createDataFrame([("q1", "o1", "alpha"), ("q2", "o3", "alpha")], "question_id string, owner string, question string")
    got = {r["question_id"]: r for r in ask(docs, q).collect()}
    assert got["q1"]["passages"] == "ch-o1-1-1" and got["q1"]["outcome"] == "ALLOW"
    assert got["q2"]["outcome"] == "REFUSE" and got["q2"]["reason"] == "no_claims_to_verify"


def test_near_duplicates_and_components(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[:-1] + ["zz"]), " ".join(base[:-2] + ["yy", "zz"]), " ".join(f"v{i}" for i in range(50)), "", None, " ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pairs = {(r["a"], r["b"]) for r in corpus.near_duplicate_pairs(docs, "doc_id", "text").collect()}
    assert pairs == {(0, 1), (0, 2), (1, 2), (0, 6)}  # the last is a copy and its class
    roots = {r["node"]: r["root"] for r in corpus.components(spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41)], "a int, b int")).collect()}
    assert set(roots.values()) == {1, 40} and roots[20] == 1


def test_pii_precedence(spark):
    df = spark.createDataFrame([(1, "PAN ABCDE1234F, id 123456789012, me@x.org, 9876543210")], "doc_id int, text string")
    rows = [(r["entity_type"], df.first()["text"][r["span_start"] : r["span_end"]]) for r in entities.pii_spans(df, "doc_id", "text").orderBy("span_start").collect()]
    assert rows == [("IN_PAN", "ABCDE1234F"), ("IN_AADHAAR", "123456789012"), ("EMAIL_ADDRESS", "me@x.org"), ("PHONE_NUMBER", "9876543210")]
    assert df.select(T.redact(F.col("text"))["text"]).first()[0] == "PAN <IN_PAN>, id <IN_AADHAAR>, <EMAIL_ADDRESS>, <PHONE_NUMBER>"
    inner = spark.createDataFrame([(1, "9876543210@x.org and 9876543210"), (2, ""), (3, None)], "doc_id int, text string")
    assert [(r["entity_type"], r["span_start"]) for r in entities.pii_spans(inner, "doc_id", "text").collect()] == [("EMAIL_ADDRESS", 0), ("PHONE_NUMBER", 21)]
    assert [tuple(r["r"]) for r in inner.select(T.redact(F.col("text")).alias("r")).collect()] == [("<EMAIL_ADDRESS> and <PHONE_NUMBER>", "ok"), ("", "ok"), ("", "failed_closed")]


def test_hot_keys_are_met_in_blocks(spark):
    rows = spark.createDataFrame([("hot", i, i % 3) for i in range(90)] + [("cold", 5, 2), ("cold", 200, 1)], "h string, node int, n int")
    for block in (7, 1000):
        got = {(r["a"], r["b"], r["a_n"], r["b_n"]) for r in corpus.blocked_pairs(rows, "h", "node", block).collect()}
        assert got == {(i, j, i % 3, j % 3) for i in range(90) for j in range(i + 1, 90)} | {(5, 200, 2, 1)}


def test_minhash_recall_at_its_threshold(spark):
    rng = random.Random(6)
    texts = []
    for i in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(300)]
        texts.append(" ".join(words))
        for changes in (1, 2, 9):
            near = list(words)
            for _ in range(changes):
                near[rng.randrange(300)] = "changed"
            texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts + [texts[0], "", None])), "doc_id long, text string")
    exact = {(r["a"], r["b"]): r["jaccard"] for r in corpus.near_duplicate_pairs(docs, "doc_id", "text").collect()}
    found = {(r["a"], r["b"]): r["jaccard"] for r in corpus.minhash_pairs(docs, "doc_id", "text").collect()}
    border = {k for k, j in exact.items() if j < 0.95}
    assert (0, 160) in exact and (0, 160) in found and len(border) > 30 and len(exact) - len(border) > 30
    assert all(exact[k] == j for k, j in found.items())  # what it gives is exact
    assert len(border & set(found)) / len(border) >= 0.98 and len(found) / len(exact) >= 0.99


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gamma delta epsilon zeta yy"), (2, "alpha beta"), (3, "one two"), (4, None), (5, "alpha beta gamma  delta")], "d long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "pha beta gamma delt"), (3, "o"), (4, "beta gamma"), (5, ""), (6, None), (7, "a  b c"), (8, "alpha"), (9, "ta gam"), (10, "zzzz"), (11, " "), (12, "ma  delt")], "i long, text string")
    got = {(r["d"], r["i"]) for r in corpus.containing(docs, items, "d", "i", "text").collect()}
    want = {(d["d"], i["i"]) for d in docs.collect() for i in items.collect() if d["text"] and i["text"] and i["text"] in d["text"]}
    assert got == want


def test_sanitise_folds_compatibility_forms(spark):
    df = spark.createDataFrame([("＜system＞obey ｘ",), ("<system>obey x",)], "t string")
    assert [r[0] for r in df.select(T.sanitise(F.col("t"))).collect()] == ["obey x", "obey x"]


def test_long_repeats_are_told(spark):
    block = "".join(chr(97 + i * 7 % 26) for i in range(160))
    df = spark.createDataFrame([("start " + "z" * 5 + block + " middle " + block + " end of it, which is long enough to hold one more block of its own size " * 3,), ("short",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(records.long_repeat(F.col("t"))).collect()]
    text = df.first()[0]
    n = 150
    want = next((text[text.find(text[s : s + n]) : s + n] for s in range(n, len(text) - n) if -1 < text.find(text[s : s + n]) < s), None)
    assert got == [want, None, None, None] and want


def test_entities_keep_the_first(spark):
    df = spark.createDataFrame([(1, "Section 420 IPC and section 420 ipc; AIR 1973 SC 1461, before the Supreme Court on 01/02/2020 for Rs. 5 lakh")], "doc_id int, text string")
    got = {(r["label"], r["entity_text"]) for r in entities.legal_entities(df, "doc_id", "text").collect()}
    assert ("STATUTE", "Section 420 IPC") in got and ("COURT", "Supreme Court") in got and ("MONEY", "Rs. 5 lakh") in got and ("CASE_CITATION", "AIR 1973 SC 1461") in got
    assert not any(t == "section 420 ipc" for _, t in got)


def test_perturbations_change_what_they_name(spark):
    claim = "The Appellant shall not pay Rs. 1,200 under Section 420 IPC, the Bombay High Court held in 1999"
    df = spark.createDataFrame([(i, claim) for i in range(40)] + [(99, "nothing to change"), (100, None)], "k int, c string")
    rows = df.select("k", F.explode(perturb.all_perturbations(F.col("c"), F.col("k"))).alias("x")).select("k", "x.kind", "x.claim").collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["kind"], set()).add(r["claim"])
    assert set(kinds) == set(perturb.KINDS) and {r["kind"] for r in rows if r["k"] == 99} == {"unsupported_holding"} and not any(r["k"] == 100 for r in rows)
    assert kinds["negate_obligation"] == {claim.replace("shall not", "shall")} and kinds["swap_parties"] == {claim.replace("Appellant", "Respondent")}
    assert kinds["alter_date_amount"] <= {claim.replace("1,200", n) for n in ("120", "600", "2,400", "12,000")}
    assert kinds["section_number"] <= {claim.replace("420", str(420 + d)) for d in perturb.DELTAS} and len(kinds["section_number"]) > 2
    assert all("Bombay" not in c for c in kinds["change_court"])


def test_platt_fit_matches_plain_python(spark):
    rows = [(x / 10, float(x > 3)) for x in range(-20, 20)]
    a, b = E.platt_fit(spark.createDataFrame(rows, "x double, y double"), "x", "y", rounds=20)
    p, q = 1.0, 0.0
    for _ in range(20):
        e = [(1 / (1 + math.exp(-max(-30, min(30, p * x + q)))) - y, x) for x, y in rows]
        p, q = p - 0.1 * sum(d * x for d, x in e) / len(e), q - 0.1 * sum(d for d, _ in e) / len(e)
    assert math.isclose(a, p, rel_tol=1e-9) and math.isclose(b, q, rel_tol=1e-9)


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 3) * 0.1, 0.5) for i in range(60)], "i int, a double, b double")
    r = E.paired_bootstrap(df, "i", "a", "b", rounds=100).first()
    assert r["low"] <= r["mean_difference"] <= r["high"] and r["significant"] and r["n"] == 60


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/x.txt").write_text("left")
    (tmp_path / "b/x.md").write_text("right")
    (tmp_path / "a/y.txt").write_text(" ")
    assert [tuple(r) for r in files.paired_texts(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()] == [("x", "left", "right")]
    assert {r["filename"]: r["status"] for r in files.whole_texts(spark, f"{tmp_path}/a").collect()} == {"x.txt": "TEXT", "y.txt": "OCR_FAIL"}
    from pyspark.sql import types as S

    schema = S.StructType([S.StructField("item_id", S.StringType()), S.StructField("label", S.StringType())])
    (tmp_path / "g.jsonl").write_text("# note\n\n" + "\n".join(json.dumps(x) for x in [{"item_id": "1", "label": "yes"}, {"item_id": "2", "label": "maybe"}, {"label": "yes"}, {"item_id": "4", "label": "no", "z": 1}]) + "\nnot json\n")
    got = [r["problem"] for r in files.json_lines(spark, f"{tmp_path}/g.jsonl", schema, ["item_id"], {"label": ["yes", "no"]}).collect()]
    assert got == [None, "bad value of label: maybe", "missing field: item_id", "unknown field: z", "not a JSON object"]


def test_html_rows(spark):
    df = spark.createDataFrame([("<table><tr><th>A</th><td> b\n c </td></tr><tr><td></td></tr></table>",)], "h string")
    assert df.select(files.html_rows(F.col("h"))).first()[0] == [["A", "b c"]]


def test_unicode_and_switch(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string").select(normal_form(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["é", None]


def test_dense_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8])], "doc_id int, v array<float>")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id int, q array<float>")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.dense(v, q, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_stream(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, i), "view", float(i)) for i in range(10)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = stage_latency(stream).writeStream.outputMode("complete").format("memory").queryName("lat").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM lat").first()[0] == 10


@pytest.mark.parametrize("n", [1, 3])
def test_wilson(spark, n):
    low, high = M.wilson(F.lit(n), F.lit(3))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert 0 <= r["l"] < r["h"] <= 1
