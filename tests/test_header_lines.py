"""Header lines go, the rest of a legal text stays, in every query over normalised documents."""

from lexloom.plans import catalog


def test_header_phrase_drops_its_line_only(spark, tmp_path):
    body = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    texts = [body("a") + "\nMr Rao for the appellants\n" + body("b"), body("a") + "\nAIR 1973 SC 12\n" + body("b"), "as in 3 SCR 12 held\n" + body("c"), None]
    texts += [body("d") + "\nfor the respondent\n" + body("e"), body("d") + " " + body("e") + " more"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(run("exact_duplicates")) == [(0, 0, 2), (1, 0, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1)]
    assert sorted(run("shingle_count")) == [(0, 76), (1, 76), (2, 36), (3, 0), (4, 76), (5, 77)]
    assert sorted(run("near_duplicate_pairs")) == [(0, 1, 1.0), (4, 5, round(76 / 77, 6))]
