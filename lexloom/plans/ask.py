"""The read path as one job for a batch of questions: scope, retrieve, small to big, claim, verify, gate, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import text as T
from lexloom.operators import chunking, claims as C, registry as R, retrieval, scope as S
from lexloom.plans.text_queries import F4_SQL
from lexloom.sources.scratch import Scratch
from lexloom.sources.tables import table


def claim(text: Column, passage_ids: Column, citations: Column | None = None) -> Column:
    """A claim as generators give it: struct(text, passage_ids, citations)."""
    none = F.array().cast("array<string>")
    return F.struct(text.alias("text"), passage_ids.alias("passage_ids"), (none if citations is None else citations).alias("citations"))


def one_claim(question: Column, passages: Column) -> Column:
    """The stub of a generator: one claim that cites all passages."""
    ids = F.transform(passages, lambda p: p["id"])
    return F.array(claim(F.concat(F.lit("Supported by passages "), F.array_join(ids, ", ")), ids))


def passages_of(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, passages: the best parents of each question as structs (id, text, clean), best first; clean has no injections."""
    parents = chunks.select(F.col("chunk_id").alias("child"), F.coalesce("parent_chunk_id", "chunk_id").alias("parent_id"))
    top = chunking.small_to_big(ranked.join(parents, F.col("doc_id") == F.col("child")).select("question_id", "parent_id", "rank"), "question_id", "parent_id", "rank")
    shown = top.join(chunks.select(F.col("chunk_id").alias("parent_id"), F.col("chunk_text").alias("text")), "parent_id").withColumn("clean", T.sanitise(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("parent_rank", F.col("parent_id").alias("id"), "text", "clean")))
    return shown.groupBy("question_id").agg(F.transform(rows, lambda p: F.struct(p["id"].alias("id"), p["text"].alias("text"), p["clean"].alias("clean"))).alias("passages"))


def verified(made: DataFrame, verifier: Callable[[Column, Column], Column]) -> DataFrame:
    """made (question_id, passages, claims) as one row per claim with ids, is_valid, structure, score (null: unavailable)."""
    rows = made.select("question_id", "passages", F.posexplode("claims").alias("claim_id", "c")).select("question_id", "passages", "claim_id", "c.text", "c.passage_ids", "c.citations")
    known = F.transform("passages", lambda p: p["id"])
    # a passage goes by its id or its place; what names none stays as it is, for the structural check to find
    ids = F.transform("passage_ids", lambda x: F.coalesce(F.get(C.resolve_passages(F.array(x), known), F.lit(0)), x))
    rows = rows.withColumn("ids", ids).withColumn("structure", C.structural(F.col("ids"), known))
    texts = F.transform("ids", lambda i: F.get(F.filter("passages", lambda p: p["id"] == i), F.lit(0))["text"])
    rows = rows.withColumn("premise", F.array_join(F.filter(texts, lambda t: t.isNotNull()), " "))
    raw = C.scored(verifier(F.col("text"), F.col("premise")).cast("double"))["value"]
    rows = rows.withColumn("raw", raw).withColumn("entailment", C.entailment(F.col("raw"), F.col("ids"), F.col("premise")))
    return rows.select("question_id", "claim_id", "text", "citations", F.col("structure.is_valid").alias("is_valid"), F.col("structure.reason").alias("structure"), F.when(F.col("entailment.status") == "ok", F.col("raw")).alias("score"))


def bad_citations(claims: DataFrame, registry: tuple[DataFrame, DataFrame, DataFrame], as_of: Column) -> DataFrame:
    """question_id, claim_id, bad_citation, why: the first citation of a claim that names nothing in force on the day.

    Each distinct citation is resolved and checked once. registry: statutes, sections, supersession.
    """
    acts, sections, successions = registry
    cited = claims.select("question_id", "claim_id", F.posexplode("citations").alias("place", "raw"))
    names = R.resolve(cited.select("raw").distinct().withColumn("as_of", as_of), "raw", sections, acts)
    checked = R.check(names, "as_of", sections, acts, successions).where((F.col("status") != "in_force") | F.col("target_id").isNull())
    unknown = F.col("target_id").isNull()
    reason = F.when(unknown, "unresolved_statutory_citation").otherwise(F.concat(F.lit("statute_not_in_force_"), "status"))
    why = F.when(unknown, F.concat(F.lit("Cited authority '"), "raw", F.lit("' was not found in statutory registry"))).otherwise(
        F.concat(F.lit("Cited provision '"), "raw", F.lit("' is not in force as of "), F.col("as_of").cast("string"), F.when(F.col("note").isNull(), "").otherwise(F.concat(F.lit(" ("), "note", F.lit(")"))))
    )
    found = cited.join(checked.select("raw", reason.alias("bad_citation"), why.alias("why")), "raw")
    first = found.groupBy("question_id", "claim_id").agg(F.min_by(F.struct("bad_citation", "why"), "place").alias("b"))
    return first.select("question_id", "claim_id", "b.bad_citation", "b.why")


def ask(
    documents: DataFrame, questions: DataFrame, encoder: Callable[[Column], Column] | None = None, reranker: Callable[[Column, Column], Column] | None = None,
    generator: Callable[[Column, Column], Column] = one_claim, verifier: Callable[[Column, Column], Column] = lambda claim, premise: F.lit(1.0),
    registry: tuple[DataFrame, DataFrame, DataFrame] | None = None, as_of: str | None = None,
) -> DataFrame:
    """question_id, outcome, reason, passages, n_passages, n_claims, n_struck, struck, answer_text, pii_redacted, prompt, generator_tokens, estimated_usd, disclaimer.

    documents (owner, doc_id, text) are cut into clauses and their slices; a question (question_id, owner, question) searches its
    owner's slices only and is shown the clauses around the best. Four places take any column function, a pandas function around a
    model as well: encoder (text to unit vector; with it the search is hybrid, without it BM25 alone), reranker (question, slice to
    score), generator (question, array of (id, text), sanitised, to an array of claim()s) and verifier (claim text, premise text to a
    score; null means unavailable and refuses the answer). The defaults are deterministic stubs. registry is statutes, sections
    and supersession, by default the built-in one, and as_of the day on which citations have to be in force, by default today.

    Claims are checked for their passages, for entailment by these, and for their citations, in this order; the first failing check
    strikes the claim. prompt is what a generator may be given: the clean passages behind the notice, fenced. The answer is redacted.
    A question whose scope holds no matching slice has no claim and is refused.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "ask")
    chunks = scratch.save(chunking.clause_chunks(documents, ["owner", "doc_id"], "text").select("owner", "chunk_id", "parent_chunk_id", "chunk_text", "bm25_indexed"), "chunks")
    slices = S.searchable(chunks, "owner")
    if encoder:
        ranked = retrieval.hybrid(slices, questions, "chunk_id", "chunk_text", "question_id", "question", "owner", encoder)
    else:
        ranked = retrieval.bm25(slices, questions, "chunk_id", "chunk_text", "question_id", "question", owner="owner")
    ranked = scratch.save(ranked, "ranked")  # a few rows for each question; by their measured size Spark picks the joins with all chunks
    if reranker:
        texts = ranked.join(slices.select(F.col("chunk_id").alias("doc_id"), F.col("chunk_text").alias("text")), "doc_id").join(questions.select(F.col("question_id").alias("query_id"), "question"), "query_id")
        ranked = retrieval.rerank(texts, reranker(F.col("question"), F.col("text")), config.RETRIEVE_TOP_K, config.RERANK_FLOOR).withColumn("rank", F.col("rerank_rank"))
    shown = passages_of(ranked.select(F.col("query_id").alias("question_id"), "doc_id", "rank"), chunks).join(questions.select("question_id", "question"), "question_id")
    clean = F.transform("passages", lambda p: F.struct(p["id"].alias("id"), p["clean"].alias("text")))
    # one answer has a handful of passages and claims; they are written once, so that no generator runs twice
    made = shown.select("question_id", "question", "passages", C.fence(clean).alias("prompt"), generator(F.col("question"), clean).alias("claims")).checkpoint()
    scratch.drop()

    checked = verified(made, verifier).checkpoint()
    law = registry or (R.statutes(spark), R.sections(spark), R.supersession(spark))
    bad = bad_citations(checked, law, F.lit(as_of).cast("date") if as_of else F.current_date())
    struck = C.strike(checked.join(bad, ["question_id", "claim_id"], "left"))
    notice = F.when(F.col("component") == "structural", F.concat(F.lit("Claim lacks valid document citation ("), "structure", F.lit(")"))).when(F.col("component") == "entailment", "Claim assertion is not factually entailed by the cited passage")
    struck = struck.withColumn("notice", F.when(F.col("component").isNotNull(), F.coalesce(notice, "why")))
    decided = C.gate(struck, "question_id")
    answers = C.render(struck, decided, "question_id", "claim_id", "notice")
    reasons = struck.where("component IS NOT NULL").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "component", "struck_reason"))), lambda c: F.concat(c["component"], F.lit(": "), c["struck_reason"])), "; ").alias("struck"))
    chars = lambda rows, name: F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + F.length(x[name]))
    tokens = F.floor((F.length("question") + chars("passages", "text") + chars("claims", "text")) / config.CHARS_PER_TOKEN)
    cost = made.select("question_id", "prompt", F.transform("passages", lambda p: p["id"]).alias("ids"), tokens.alias("tokens"))
    out = questions.select("question_id")
    for part in (cost, decided, answers, reasons):
        out = out.join(part, "question_id", "left")
    answer = T.redact(F.coalesce("answer_text", F.lit(C.REFUSAL)))["text"]
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "question_id",
        F.coalesce("outcome", F.lit("REFUSE")).alias("outcome"),
        F.coalesce("reason", F.lit("no_claims_to_verify")).alias("reason"),
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("passages"),
        long(F.size("ids")).alias("n_passages"),
        long(F.col("n_claims")).alias("n_claims"),
        long(F.col("n_struck")).alias("n_struck"),
        F.coalesce("struck", F.lit("")).alias("struck"),
        answer.alias("answer_text"),
        (answer != F.coalesce("answer_text", F.lit(C.REFUSAL))).alias("pii_redacted"),
        F.coalesce("prompt", C.fence(F.array().cast("array<struct<id:string,text:string>>"))).alias("prompt"),
        long(F.col("tokens")).alias("generator_tokens"),
        F.round(long(F.col("tokens")) * config.USD_PER_TOKEN, 6).alias("estimated_usd"),
        F.lit(C.DISCLAIMER).alias("disclaimer"),
    )


def owners_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Judgment-like documents, one question per owner (the first eight tokens of its lowest document), and one that nothing matches."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), "doc_id", F.expr(F4_SQL).alias("text"), F.col("text").alias("plain"))
    first = docs.groupBy("owner").agg(F.min_by("plain", "doc_id").alias("t"))
    asked = first.select(F.col("owner").alias("question_id"), "owner", F.array_join(F.slice(T.tokens(F.col("t")), 1, 8), " ").alias("question"))
    none = first.where("owner = 'src1'").select(F.lit("none").alias("question_id"), "owner", F.lit("zzzzqqqq").alias("question"))
    return docs.drop("plain"), asked.unionByName(none)


def three_claims(question: Column, passages: Column) -> Column:
    """A generator for checks: one claim from all passages, one with a mail address and a sound citation, one with a fault that the question's length picks."""
    ids = F.transform(passages, lambda p: p["id"])
    kind = F.length(question) % 3
    cited = F.when(kind == 1, F.array(F.lit("Section 420 IPC"))).when(kind == 2, F.array(F.lit("Section 27 of the Indian Contract Act, 1872"), F.lit("Section 9999 IPC"))).otherwise(F.array().cast("array<string>"))
    return F.array(
        claim(F.concat(F.lit("Supported by passages "), F.array_join(ids, ", ")), ids),
        claim(F.lit("Write to a.b@post.example about it."), F.array(F.lit("p1")), F.array(F.lit("Section 27 of the Indian Contract Act, 1872"))),
        claim(F.lit("A third claim."), F.when(kind == 0, F.array(F.lit("1"), F.lit("zz"))).otherwise(F.slice(ids, 1, 1)), cited),
    )


def unsure(text: Column, premise: Column) -> Column:
    """A verifier for checks, which every fifth length of a premise fails."""
    return F.when(F.length(premise) % 5 == 0, 0.25).otherwise(0.75)


COLUMNS = ["question_id", "outcome", "reason", "passages", "n_passages", "n_claims", "n_struck", "struck", "answer_text", "pii_redacted", "md5(prompt) AS prompt_md5", "generator_tokens", "estimated_usd"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(*owners_questions(spark, sf_dir), generator=three_claims, verifier=unsure, as_of="2026-01-01").selectExpr(*COLUMNS)


def ask_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions with a dense leg, a reranker that prefers longer slices, and a verifier that is down for some premises."""
    down = lambda text, premise: F.when(F.length(premise) % 7 != 0, unsure(text, premise))
    found = ask(*owners_questions(spark, sf_dir), retrieval.letter_vector, lambda question, text: F.length(text) / 100.0, three_claims, down, as_of="2026-01-01")
    return found.selectExpr(*COLUMNS)


_B = r"(?im)^\s*(Section\s+\d+[A-Za-z]?|Clause\s+\d+[A-Za-z]?|\d+\.|\(\d+\)|WHEREAS|NOW THEREFORE|IN WITNESS)"
#: Questions, clauses with their slices (ch), and the searched slices (c), which may be searched if they are 400 characters at most.
_CHUNKS_SQL = rf"""WITH t AS (SELECT source AS owner, doc_id, {F4_SQL} AS t FROM documents),
f0 AS (SELECT source AS owner, arg_min(text, doc_id) AS t FROM documents GROUP BY source),
q0 AS (SELECT owner AS question_id, owner, array_to_string(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+')[1:8], ' ') AS t FROM f0 UNION ALL SELECT 'none', 'src1', 'zzzzqqqq' FROM f0 WHERE owner = 'src1'),
q AS (SELECT question_id, owner, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+')) AS term FROM q0),
bm AS (SELECT owner, doc_id, t, regexp_extract_all(t, '{_B}', 0) AS m, regexp_extract_all(t, '{_B}', 1) AS g, string_split_regex(t, '{_B}') AS gap FROM t),
bf AS (SELECT owner, doc_id, t, sum(length(gap[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(m[i]) AS pos FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM bm)),
bz AS (SELECT owner, doc_id, t, pos FROM bf UNION ALL SELECT t.owner, t.doc_id, t.t, 0 FROM t LEFT JOIN (SELECT doc_id, min(pos) AS a FROM bf GROUP BY doc_id) x ON t.doc_id = x.doc_id WHERE coalesce(x.a, 1) > 0),
bp AS (SELECT owner, doc_id, pos, substr(t, pos::BIGINT + 1, (coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(t)) - pos)::BIGINT) AS piece FROM bz),
bc AS (SELECT owner, doc_id, pos, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') AS body FROM bp),
bn AS (SELECT owner, body, 'ch-' || owner || '-' || doc_id || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS id FROM bc WHERE length(body) > 0),
ch AS (SELECT owner, id, id AS parent, body FROM bn WHERE length(body) <= 400 UNION ALL SELECT owner, id || '-' || i, id, substr(body, 400 * i + 1, 400) FROM (SELECT *, unnest(range(0, ceil(length(body) / 400::DOUBLE)::BIGINT)) AS i FROM bn WHERE length(body) > 400)),
c AS (SELECT owner, id, parent, body, lower(body) AS t, length(body) AS n, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+') AS w FROM ch),
qt AS (SELECT question_id, owner, term, count(*) AS qtf FROM q GROUP BY ALL),
s AS (SELECT owner, count(*) AS n, avg(len(w)) AS avgdl FROM c GROUP BY owner),
p AS (SELECT owner, id, dl, term, count(*) AS tf FROM (SELECT owner, id, len(w) AS dl, unnest(w) AS term FROM c) GROUP BY ALL),
r AS (SELECT owner, term, avgdl, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM (SELECT owner, term, count(*) AS df FROM p GROUP BY ALL) JOIN s USING (owner)),
m AS (SELECT owner, avg(raw) AS mean FROM r GROUP BY owner),
i AS (SELECT owner, term, avgdl, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM r JOIN m USING (owner)),
x AS (SELECT question_id, id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN i USING (owner, term) JOIN p USING (owner, term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM x)"""
_LETTERS = "list_transform(['a', 'e', 'i', 'n', 'r', 's', 't'], lambda c: (length({0}) - length(replace({0}, c, '')))::DOUBLE)"
_UNIT = "list_transform({0}, lambda x: CASE WHEN list_dot_product({0}, {0}) > 0 THEN x / sqrt(list_dot_product({0}, {0})) ELSE 0 END)"
_FUSED_SQL = f""",
sp AS (SELECT question_id, id, rank FROM k WHERE rank <= 20),
cv AS (SELECT owner, id, {_LETTERS.format("t")} AS v FROM c), qv AS (SELECT question_id, owner, {_LETTERS.format("t")} AS v FROM q0),
cu AS (SELECT owner, id, {_UNIT.format("v")} AS v FROM cv), qu AS (SELECT question_id, owner, {_UNIT.format("v")} AS v FROM qv),
ds AS (SELECT question_id, id, round(list_dot_product(cu.v, qu.v), 6) AS score FROM cu JOIN qu USING (owner)),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= 20),
fu AS (SELECT question_id, id, round(sum(1::DOUBLE / (60 + rank - 1)), 9) AS score FROM (SELECT question_id, id, rank FROM sp UNION ALL SELECT question_id, id, rank FROM dn) GROUP BY ALL),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS r FROM fu) WHERE r <= 20),
rk AS (SELECT fr.question_id, fr.id, row_number() OVER (PARTITION BY question_id ORDER BY c.n DESC, r) AS rank FROM fr JOIN c USING (id))"""
_SANITISED = r"regexp_replace(body, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{200b}-\x{200f}\x{feff}]', '', 'g')"
_ANSWERS_SQL = """,
b AS (SELECT question_id, parent, rank, row_number() OVER (PARTITION BY question_id, parent ORDER BY rank) AS n FROM rk JOIN c USING (id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS pr FROM b WHERE n = 1),
a AS (SELECT question_id, count(*) AS n, list(parent ORDER BY pr) AS ids, string_agg(body, ' ' ORDER BY pr) AS premise, arg_min(body, pr) AS first, sum(length(body)) AS chars,
  string_agg('<document_chunk id="' || parent || '">' || chr(10) || {clean} || chr(10) || '</document_chunk>', chr(10) ORDER BY pr) AS fenced FROM tp JOIN bn ON bn.id = tp.parent WHERE pr <= 5 GROUP BY question_id),
cl AS (SELECT q0.question_id, length(q0.t) % 3 AS kind, k AS claim_id, CASE k WHEN 0 THEN 'Supported by passages ' || array_to_string(ids, ', ') WHEN 1 THEN 'Write to a.b@post.example about it.' ELSE 'A third claim.' END AS text,
  length(CASE k WHEN 0 THEN premise ELSE first END) AS len FROM a JOIN q0 USING (question_id), range(0, 3) x(k)),
jd AS (SELECT *, {score} AS score, claim_id < 2 OR kind > 0 AS valid, CASE WHEN claim_id = 2 AND kind = 1 THEN 'statute_not_in_force_superseded' WHEN claim_id = 2 AND kind = 2 THEN 'unresolved_statutory_citation' END AS bad FROM cl),
st AS (SELECT *, CASE WHEN NOT valid THEN 'structural' WHEN score < 0.5 THEN 'entailment' WHEN score IS NOT NULL AND bad IS NOT NULL THEN 'registry' WHEN bad IS NOT NULL THEN 'registry' END AS component FROM jd),
sr AS (SELECT *, CASE component WHEN 'structural' THEN 'failed_structural_grounding' WHEN 'entailment' THEN 'not_entailed_by_passage' WHEN 'registry' THEN bad END AS why,
  CASE component WHEN 'structural' THEN 'Claim lacks valid document citation (invalid_passage_ids: zz)' WHEN 'entailment' THEN 'Claim assertion is not factually entailed by the cited passage'
    WHEN 'registry' THEN CASE kind WHEN 1 THEN 'Cited provision ''Section 420 IPC'' is not in force as of 2026-01-01 (repealed 2024-07-01; see BNS 318)' ELSE 'Cited authority ''Section 9999 IPC'' was not found in statutory registry' END END AS notice FROM st),
d AS (SELECT question_id, count(*) AS n_claims, count(component) AS n_struck, bool_or(score IS NULL) AS down, sum(length(text)) AS chars, string_agg(component || ': ' || why, '; ' ORDER BY claim_id) AS struck,
  string_agg(CASE WHEN component IS NULL THEN text END, ' ' ORDER BY claim_id) AS body, array_to_string(list_sort(list_distinct(list(notice))), '; ') AS notices FROM sr GROUP BY question_id),
o AS (SELECT q0.question_id, q0.t AS question, a.*, d.* EXCLUDE (question_id, chars), d.chars AS said, CASE WHEN d.n_claims IS NULL OR down OR n_struck = n_claims THEN 'REFUSE' WHEN n_struck > 0 THEN 'PARTIAL_ALLOW' ELSE 'ALLOW' END AS outcome,
  CASE WHEN d.n_claims IS NULL THEN 'no_claims_to_verify' WHEN down THEN 'safety_component_unavailable: entailment' WHEN n_struck = n_claims THEN 'all_claims_struck_by_verification' WHEN n_struck > 0 THEN 'partial_claims_verified' ELSE 'all_claims_verified' END AS reason
  FROM q0 LEFT JOIN a USING (question_id) LEFT JOIN d USING (question_id)),
an AS (SELECT *, CASE outcome WHEN 'REFUSE' THEN '{refusal}' WHEN 'PARTIAL_ALLOW' THEN body || ' ' || chr(10) || '[Notice: Certain assertions were omitted because: ' || notices || ']' ELSE body END AS answer,
  CASE WHEN n IS NULL THEN 0 ELSE (length(question) + chars + said) // 4 END::BIGINT AS tokens FROM o)
SELECT question_id, outcome, reason, coalesce(array_to_string(ids, ','), '') AS passages, coalesce(n, 0)::BIGINT AS n_passages, coalesce(n_claims, 0)::BIGINT AS n_claims, CASE WHEN down THEN 0 ELSE coalesce(n_struck, 0) END::BIGINT AS n_struck, coalesce(struck, '') AS struck,
  replace(answer, 'a.b@post.example', '<EMAIL_ADDRESS>') AS answer_text, contains(answer, 'a.b@post.example') AS pii_redacted,
  md5(CASE WHEN n IS NULL THEN '' ELSE {preamble} || chr(10) END || '<untrusted_document_content>' || chr(10) || CASE WHEN n IS NULL THEN '' ELSE fenced || chr(10) END || '</untrusted_document_content>') AS prompt_md5,
  tokens AS generator_tokens, round(tokens * 2e-7::DOUBLE, 6) AS estimated_usd FROM an"""


def _answers_sql(score: str) -> str:
    preamble = "'" + C.PREAMBLE.replace("\n", "' || chr(10) || '") + "'"
    return _ANSWERS_SQL.replace("{clean}", _SANITISED).replace("{score}", score).replace("{refusal}", C.REFUSAL).replace("{preamble}", preamble)


FLAGSHIP_SQL = _CHUNKS_SQL + ",\nrk AS (SELECT question_id, id, rank FROM k WHERE rank <= 20)" + _answers_sql("CASE WHEN len % 5 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END")
HYBRID_SQL = _CHUNKS_SQL + _FUSED_SQL + _answers_sql("CASE WHEN len % 7 = 0 THEN NULL WHEN len % 5 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END")
