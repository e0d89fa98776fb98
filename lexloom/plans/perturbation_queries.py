"""Queries over perturbed claims and source pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import perturb as P
from lexloom.operators.corpus import hash_split
from lexloom.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: A claim from the columns of part; which of its clauses stand in it follows from the key.
CLAIM = """'The ' || CASE p_partkey % 4 WHEN 0 THEN 'Appellant' WHEN 1 THEN 'LANDLORD' WHEN 2 THEN 'assessee' ELSE 'bank' END || ' came before the ' || CASE p_partkey % 5 WHEN 0 THEN 'Bombay High Court' WHEN 1 THEN 'supreme court' WHEN 2 THEN 'Privy Council' ELSE 'bench' END
 || CASE WHEN p_size % 3 = 0 THEN ' under Section ' || p_size || 'A and s. ' || (p_partkey % 700 + 1) ELSE '' END || CASE p_partkey % 7 WHEN 0 THEN ' of the Indian Penal Code' WHEN 1 THEN ' of the CrPC' WHEN 2 THEN ' of the BNS' WHEN 3 THEN ' of the bharatiya nagarik suraksha sanhita' ELSE '' END
 || CASE p_size % 4 WHEN 0 THEN ' for Rs. ' || (p_partkey % 90) || ',' || (100 + p_partkey % 900) WHEN 1 THEN ' in ' || (1900 + p_partkey % 120) || ' and ' || (1850 + p_size) WHEN 2 THEN ' on the ' || (p_partkey % 31 + 1) || 'th' ELSE '' END
 || CASE p_size % 6 WHEN 0 THEN '; the tenant shall not pay' WHEN 1 THEN '; the respondent must wait' WHEN 2 THEN ' and the heir is entitled to rent' WHEN 3 THEN '; it cannot stand' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '. ' ELSE '' END"""
_CLAIMS = f"c AS (SELECT p_partkey AS k, {CLAIM} AS c FROM part)"


def _number(kind: str) -> str:
    return f"('0x' || substr(md5('42:' || k || ':{kind}'), 1, 8))::BIGINT"


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in values) + "]"


def _pick(values, kind: str) -> str:
    return f"({_list(values)})[{_number(kind)} % {len(values)} + 1]"


def _put(at: str, to: str, m: str = "m", gap: str = "g") -> str:
    """The text between and around the matches m with the one at a place replaced."""
    return f"array_to_string(list_transform(range(1, len({gap}) + 1), lambda i: {gap}[i] || CASE WHEN i > len({m}) THEN '' WHEN i = {at} THEN {to} ELSE {m}[i] END), '')"


def _matches(pattern: str, m: str = "m", gap: str = "g") -> str:
    return f"regexp_extract_all(c, '{pattern}') AS {m}, string_split_regex(c, '{pattern}') AS {gap}"


def _claims(spark, sf_dir):
    # part is one file of narrow rows, with much work on each
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("k"), F.expr(CLAIM).alias("c"))


def _run(spark, sf_dir, kind: str):
    return _claims(spark, sf_dir).select("k", P.PERTURBERS[kind](F.col("c"), F.col("k")).alias("perturbed"))


_SECTION_SQL = f"""s0 AS (SELECT *, {_matches(P.SECTION)} FROM c), s1 AS (SELECT *, {_number('section_number')} % greatest(len(m), 1) + 1 AS pos FROM s0),
s2 AS (SELECT *, regexp_extract(m[pos], '{P.SECTION}', 2)::INT AS n FROM s1 WHERE len(m) > 0), s3 AS (SELECT *, list_filter({_list(P.DELTAS)}, lambda d: n + d > 0) AS ds FROM s2),
section_number AS (SELECT c.k, x.p FROM c LEFT JOIN (SELECT k, {_put('pos', f"regexp_extract(m[pos], '{P.SECTION}', 1) || ' ' || (n + ds[{_number('section_delta')} % len(ds) + 1]) || regexp_extract(m[pos], '{P.SECTION}', 3)")} AS p FROM s3) x USING (k))"""


@query(f"WITH {_CLAIMS}, {_SECTION_SQL} SELECT k, p AS perturbed FROM section_number")
def perturb_section_number(spark, sf_dir):
    return _run(spark, sf_dir, "section_number")


_SWAP_SQL = (
    "ipc_bns_swap AS (SELECT k, CASE "
    + " ".join(f"WHEN regexp_matches(c, '{P.quoted(name)}') THEN regexp_replace(c, '{P.quoted(name)}', {_pick(others, 'ipc_bns_swap')})" for names, others in P.SWAPS for name in names)
    + " END AS p FROM c)"
)


@query(f"WITH {_CLAIMS}, {_SWAP_SQL} SELECT k, p AS perturbed FROM ipc_bns_swap")
def perturb_ipc_bns_swap(spark, sf_dir):
    return _run(spark, sf_dir, "ipc_bns_swap")


_NEGATE_SQL = "negate_obligation AS (SELECT k, CASE " + " ".join(f"WHEN regexp_matches(c, '(?i){p}') THEN regexp_replace(c, '(?i){p}', '{to}')" for p, to in P.NEGATIONS) + " END AS p FROM c)"


@query(f"WITH {_CLAIMS}, {_NEGATE_SQL} SELECT k, p AS perturbed FROM negate_obligation")
def negate_claims(spark, sf_dir):
    return _run(spark, sf_dir, "negate_obligation")


def _swapped(a: str, b: str) -> str:
    """Words and all else alternate; each word of the pair becomes the other in its own case."""
    word = f"(?i)\\b(?:{a}|{b})\\b"
    other = f"CASE WHEN lower(m) = '{a}' THEN '{b}' ELSE '{a}' END"
    cased = f"CASE WHEN m = upper(m) THEN upper({other}) WHEN substr(m, 1, 1) = upper(substr(m, 1, 1)) THEN upper(substr({other}, 1, 1)) || substr({other}, 2) ELSE {other} END"
    return f"(SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(ms) THEN '' ELSE list_transform([ms[i]], lambda m: {cased})[1] END), '') FROM (SELECT regexp_extract_all(c, '{word}') AS ms, string_split_regex(c, '{word}') AS g))"


_PARTY_SQL = (
    "f AS (SELECT k, c, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(c, '(?i)\\b({a}|{b})\\b') THEN {i} END" for i, (a, b) in enumerate(P.PARTIES)) + "], lambda x: x IS NOT NULL) AS fits FROM c), "
    + f"ch AS (SELECT *, fits[{_number('swap_parties')} % greatest(len(fits), 1) + 1] AS pair FROM f), "
    + "swap_parties AS (SELECT k, nullif(CASE pair " + " ".join(f"WHEN {i} THEN {_swapped(a, b)}" for i, (a, b) in enumerate(P.PARTIES)) + " END, c) AS p FROM ch)"
)


@query(f"WITH {_CLAIMS}, {_PARTY_SQL} SELECT k, p AS perturbed FROM swap_parties")
def perturb_swap_parties(spark, sf_dir):
    return _run(spark, sf_dir, "swap_parties")


_DATE_SQL = f"""d0 AS (SELECT *, {_matches(P.AMOUNT, 'am', 'ag')}, {_matches(P.YEAR, 'ym', 'yg')}, {_matches(P.DAY, 'dm', 'dg')} FROM c),
d1 AS (SELECT *, {_number('amount')} % greatest(len(am), 1) + 1 AS ai, {_number('year')} % greatest(len(ym), 1) + 1 AS yi, {_number('day')} % greatest(len(dm), 1) + 1 AS di FROM d0),
d2 AS (SELECT *, regexp_extract(am[ai], '{P.AMOUNT}', 1) AS digits, replace(regexp_extract(am[ai], '{P.AMOUNT}', 1), ',', '') AS v, regexp_extract(dm[di], '{P.DAY}', 1) AS dd FROM d1),
d3 AS (SELECT *, TRY_CAST(v AS BIGINT) AS value, TRY_CAST(dd AS INT) % 28 + 1 AS nd FROM d2),
alter_date_amount AS (SELECT k, CASE WHEN value > 0 THEN {_put('ai', f"left(am[ai], length(am[ai]) - length(digits)) || format('{{:,}}', greatest(1, floor(value * {_pick(P.FACTORS, 'factor')})::BIGINT))", 'am', 'ag')}
  WHEN len(ym) > 0 THEN {_put('yi', f"(ym[yi]::INT + {_pick(P.YEAR_DELTAS, 'year_delta')})::VARCHAR", 'ym', 'yg')}
  WHEN len(dm) > 0 THEN {_put('di', "nd || CASE CASE WHEN nd < 20 THEN nd ELSE nd % 10 END WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END", 'dm', 'dg')} END AS p FROM d3)"""


@query(f"WITH {_CLAIMS}, {_DATE_SQL} SELECT k, p AS perturbed FROM alter_date_amount")
def perturb_date_amount(spark, sf_dir):
    return _run(spark, sf_dir, "alter_date_amount")


_COURT_SQL = (
    "change_court AS (SELECT k, CASE "
    + " ".join(f"WHEN regexp_matches(c, '{P.quoted(x)}') THEN regexp_replace(c, '{P.quoted(x)}', {_pick([o for o in P.COURTS if o != x], 'change_court')})" for x in sorted(P.COURTS, key=len)[::-1])
    + " END AS p FROM c)"
)


@query(f"WITH {_CLAIMS}, {_COURT_SQL} SELECT k, p AS perturbed FROM change_court")
def perturb_court(spark, sf_dir):
    return _run(spark, sf_dir, "change_court")


_HOLDING_SQL = f"unsupported_holding AS (SELECT k, regexp_replace(c, '\\s+$', '') || CASE WHEN regexp_matches(regexp_replace(c, '\\s+$', ''), '[.;:]$') THEN ' ' ELSE '. ' END || {_pick(P.HOLDINGS, 'unsupported_holding')} AS p FROM c)"


@query(f"WITH {_CLAIMS}, {_HOLDING_SQL} SELECT k, p AS perturbed FROM unsupported_holding")
def perturb_holding(spark, sf_dir):
    return _run(spark, sf_dir, "unsupported_holding")


_ALL_SQL = ", ".join((_CLAIMS, _SECTION_SQL, _SWAP_SQL, _NEGATE_SQL, _PARTY_SQL, _DATE_SQL, _COURT_SQL, _HOLDING_SQL))
_KINDS_SQL = "kinds AS (" + " UNION ALL ".join(f"SELECT {x}.k, {i} AS i, '{x}' AS kind, p, c FROM {x} JOIN c USING (k) WHERE p <> c" for i, x in enumerate(P.KINDS)) + ")"


@query(f"WITH {_ALL_SQL}, {_KINDS_SQL} SELECT k, kind, p AS claim FROM kinds")
def perturb_claims(spark, sf_dir):
    """Every kind that applies to each claim."""
    return _claims(spark, sf_dir).select("k", F.explode(P.all_perturbations(F.col("c"), F.col("k"))).alias("x")).select("k", "x.kind", "x.claim")


_DECK_SQL = _ALL_SQL.replace("SELECT p_partkey AS k, ", "SELECT p_partkey || ':0' AS k, ")


@query(f"""WITH {_DECK_SQL}, {_KINDS_SQL}, a AS (SELECT k, any_value(c) AS c, list(struct_pack(kind := kind, p := p) ORDER BY i) AS a, string_agg(kind, ',' ORDER BY i) AS sig FROM kinds GROUP BY k),
t AS (SELECT *, a[(row_number() OVER (PARTITION BY sig ORDER BY k) - 1) % len(a) + 1] AS x FROM a)
SELECT k || '-pos' AS pair_id, 'none' AS kind, 'entailed' AS label, c AS claim FROM t UNION ALL SELECT k || '-neg', x.kind, 'not_entailed', x.p FROM t""")
def perturbation_set(spark, sf_dir):
    """A positive and a perturbed row for each claim, each class dealing its kinds in turn."""
    return P.contrastive(_pairs(spark, sf_dir), "k", balance=False).select("pair_id", "kind", "label", "claim")


def _pairs(spark, sf_dir):
    return _claims(spark, sf_dir).select("k", F.lit(0).alias("claim_no"), F.col("c").alias("claim"), F.lit("").alias("passage"), F.lit(1.0).alias("overlap"))


#: The most loaded kinds by the claims that only they can take, then the most loaded of the others, and so on.
@query(f"""WITH RECURSIVE {_ALL_SQL}, {_KINDS_SQL}, b_class AS (SELECT m, count(*) AS n FROM (SELECT k, sum(1 << i)::BIGINT AS m FROM kinds GROUP BY k) GROUP BY m),
b_within AS (SELECT s, coalesce(sum(n), 0)::BIGINT AS own FROM range(0, {2 ** len(P.KINDS)}) t(s) LEFT JOIN b_class ON m & s = m GROUP BY s),
b_more AS MATERIALIZED (SELECT a.s AS c, b.s, u.own - a.own AS g, bit_count(b.s)::BIGINT AS z FROM b_within a JOIN b_within b ON a.s & b.s = 0 AND b.s > 0 JOIN b_within u ON u.s = a.s | b.s),
b_level AS (SELECT 0::BIGINT AS c, 0::BIGINT AS z, 0::BIGINT AS top, 0::BIGINT AS r UNION ALL SELECT c | s, z, top, g - (top - 1) * z FROM (
  SELECT *, row_number() OVER (ORDER BY g - (top - 1) * z DESC, z) AS o FROM (SELECT b_more.*, max((b_more.g + b_more.z - 1) // b_more.z) OVER () AS top FROM b_level JOIN b_more ON b_more.c = b_level.c)) WHERE o = 1),
b_kind AS (SELECT top - (i >= r)::BIGINT AS n FROM b_level, unnest(range(z)) t(i)) SELECT row_number() OVER (ORDER BY n DESC) AS place, n FROM b_kind""")
def perturbation_manifest(spark, sf_dir):
    """How many claims the kinds got when balanced over all classes, from the largest count down; kinds that apply nowhere have none."""
    got = P.contrastive(_pairs(spark, sf_dir), "k").where("kind <> 'none'").groupBy("kind").agg(F.count("*").alias("n"))
    all_kinds = spark.createDataFrame([(k,) for k in P.KINDS], "kind string").join(got, "kind", "left").select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return all_kinds.select(F.row_number().over(Window.orderBy(F.desc("n"))).cast("bigint").alias("place"), "n")  # one row for each kind


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_FRAGMENTS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '([.;:])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0)"
_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z]{{3,}}')), lambda w: NOT list_contains(" + _STOP + ", w))"


@query(f"SELECT conv_id, turn, len(f) AS n_fragments, md5(array_to_string(f, '|')) AS fragments_md5 FROM (SELECT conv_id, turn, {_FRAGMENTS.format('text')} AS f FROM conversations)")
def fragment_split(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.fragments(F.col("text")).alias("f"))
    return f.select("conv_id", "turn", F.size("f").cast("bigint").alias("n_fragments"), F.md5(F.array_join("f", "|")).alias("fragments_md5"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({_CONTENT.format('text')}), ' ') AS words FROM conversations")
def content_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.content_words(F.col("text"))), " ").alias("words"))


@query("SELECT conv_id, turn FROM conversations WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) BETWEEN 8 AND 60")
def claim_length_band(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.size(T.words(F.col("text"))).between(8, 60)).select("conv_id", "turn")


# a judgment is a conversation's whole text, its summary that of the next conversation and its own last turn
_PAIRS_SQL = f"""j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS t, max_by(text, (turn, text)) AS l FROM conversations GROUP BY conv_id),
d AS (SELECT j.conv_id, {_FRAGMENTS.format('j.t')} AS js, {_FRAGMENTS.format("(j.l || '; ' || coalesce(n.t, ''))")} AS ss FROM j LEFT JOIN j n ON n.conv_id = j.conv_id + 1),
s AS (SELECT conv_id, i, js[i + 1] AS s, {_CONTENT.format('js[i + 1]')} AS w FROM (SELECT *, unnest(range(0, len(js))) AS i FROM d)),
cl AS (SELECT conv_id, claim_no, ss[claim_no + 1] AS claim FROM (SELECT *, unnest(range(0, len(ss))) AS claim_no FROM d WHERE len(js) > 0)),
cw AS (SELECT *, {_CONTENT.format('claim')} AS c FROM cl WHERE len(list_filter(string_split_regex(claim, '\\s+'), lambda x: x <> '')) BETWEEN 8 AND 60),
h AS (SELECT cw.*, s.i, len(list_intersect(cw.c, s.w)) AS hits FROM cw JOIN s USING (conv_id) WHERE len(c) > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, claim_no ORDER BY hits DESC, i) AS r FROM h) WHERE r = 1 AND hits > 0),
p AS (SELECT b.conv_id, b.claim_no, b.claim, b.c, string_agg(s.s, ' ' ORDER BY s.i) AS passage FROM b JOIN s ON s.conv_id = b.conv_id AND s.i BETWEEN greatest(b.i - 1, 0) AND greatest(b.i - 1, 0) + 2 GROUP BY ALL),
o AS (SELECT *, len(list_intersect(c, {_CONTENT.format('passage')}))::DOUBLE / len(c) AS overlap FROM p),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY claim_no) AS n FROM o WHERE overlap >= 0.35::DOUBLE) WHERE n <= 3)"""


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, claim_no::BIGINT AS claim_no, claim, md5(passage) AS passage_md5, round(overlap, 4) AS overlap FROM pairs")
def source_pairs(spark, sf_dir):
    """Claims of a summary with the best window of three sentences of its judgment."""
    got = P.source_pairs(_judgments(spark, sf_dir), "conv_id", "judgment", "summary")
    return got.select("conv_id", F.col("claim_no").cast("bigint"), "claim", F.md5("passage").alias("passage_md5"), "overlap")


def _judgments(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    j = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("x"))
    j = j.select("conv_id", F.array_join(F.transform("x", lambda t: t["text"]), "\n").alias("t"), F.get(F.reverse("x"), F.lit(0))["text"].alias("l"))
    after = j.select((F.col("conv_id") - 1).alias("conv_id"), F.col("t").alias("n"))
    return j.join(after, "conv_id", "left").select("conv_id", F.col("t").alias("judgment"), F.concat("l", F.lit("; "), F.coalesce("n", F.lit(""))).alias("summary"))


@query("""WITH s AS (SELECT conv_id, ('0x' || substr(sha256('42:' || conv_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM conversations GROUP BY conv_id)
SELECT count(*) FILTER (u < 0.8::DOUBLE) AS n_used, count(*) FILTER (u >= 0.8::DOUBLE) AS n_skipped, count(*) FILTER (u >= 0.8::DOUBLE + 0.1::DOUBLE) AS n_test_only FROM s""")
def train_split_filter(spark, sf_dir):
    """Source documents that may feed the perturbation set (train), those that may not, and those of the test split alone."""
    s = hash_split(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id")
    return s.agg(F.count_if(F.col("split") == "train").alias("n_used"), F.count_if(F.col("split") != "train").alias("n_skipped"), F.count_if(F.col("split") == "test").alias("n_test_only"))
