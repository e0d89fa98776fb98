r"""Conversation structure repair, with DataFrame functions only.

A conversation is well formed if the first letters of its roles read `(s?(ua)+)?`: a system turn at most at the
start, then user and assistant in turn, the assistant last. Window functions flag each turn as blank, duplicate
or truncated; the flagged turns are collected in order as small structs (a letter and a fault, never a text), and
aggregate() folds them into four (cost, audit) structs, one for each state of the pattern: at the start (0), after
the system turn (1), after a user turn (2), after an assistant turn (3). Every step takes the least struct of each
state, so equal costs are settled by the ASCII order of the audits.

Long conversations are folded in blocks of BLOCK turns: a block's fold starts from each of the four states and
gives sixteen structs, whose (min, +) product over the blocks is the fold of the whole. So no group holds more than
BLOCK turns, and a conversation with a third of all rows is folded by as many tasks as it has blocks; only the
sixteen structs of its blocks meet. The audit is then dealt back to the turns: its letters are K (keep), R (rerole),
D (delete), I (insert an empty turn). `repair` gives the repaired turns, `measure` the counts and the audit of each
conversation; `digest` hashes a repaired conversation, which as one string has to fit in one row (2 GB).

Edge cases: null role, text or id count as one space in the damage and the rules; the id itself stays null and is a
conversation of its own. Null turns come first. Rows with equal turns are ordered by role, text and the place in
their own copies. Roles count by their first letter, as they stand; a role without a letter fits nowhere. A
conversation that has lost all its rows is kept with zeros and an empty audit. An empty table gives no rows. Only
the four named columns are read; extra columns with any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

#: Turns of one block of the fold.
BLOCK = 256
#: Cost of keeping, reroling, deleting, inserting, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\v\f\r"
#: More than any real cost; states that cannot be reached have it.
FAR = 1 << 60


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of each row; null roles and texts as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """What is left of turns() after a fault that the CRC-32 of `conv:turn` picks for each row; copy numbers the repeats.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 makes its role user.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def flag(rows: DataFrame) -> DataFrame:
    """Each row with its place in the conversation, its first fault and whether it may not follow the row before."""
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    by_turn = Window.partitionBy("conv").orderBy(*order)
    letter = F.substring("role", 1, 1)
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    flagged = rows.withColumns({
        "at": F.row_number().over(by_turn) - 1,
        "again": F.row_number().over(Window.partitionBy("conv", F.xxhash64("role", "text"), "role", "text").orderBy(*order)) > 1,
        "before": F.lag(letter).over(by_turn),
    })
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", letter).isin("su", "ua", "au")
    return flagged.select("conv", "at", "turn", "role", "text", fault.alias("fault"), letter.alias("letter"), illegal.alias("illegal"))


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _after(state: Column, cost: int | Column, letters: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letters)))


def _inserted(s: list[Column]) -> Column:
    """The states after any insertions: at most one round of them can pay."""
    return F.array(
        s[0],
        s[1],
        F.least(s[2], _after(s[0], INSERT, "I"), _after(s[1], INSERT, "I"), _after(s[3], INSERT, "I")),
        F.least(s[3], _after(s[2], INSERT, "I"), _after(s[0], 2 * INSERT, "II"), _after(s[1], 2 * INSERT, "II")),
    )


def _step(states: Column, turn: Column) -> Column:
    """The four states after one more turn and the insertions behind it."""
    s = [states[i] for i in range(4)]
    stay = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    forced = turn["fault"].isin("blank", "duplicate")
    never = F.lit(FAR)
    keep = lambda letter: F.when(forced | (turn["letter"] != letter), never).otherwise(stay)
    rerole = F.when(forced, never).otherwise(REROLE + stay)
    user, assistant = keep("u"), keep("a")
    to_user = [x for i in (0, 1, 3) for x in (_after(s[i], user, "K"), _after(s[i], rerole, "R"))]
    moved = [
        _after(s[0], DELETE, "D"),
        F.least(_after(s[1], DELETE, "D"), _after(s[0], keep("s"), "K")),
        F.least(_after(s[2], DELETE, "D"), *to_user),
        F.least(_after(s[3], DELETE, "D"), _after(s[2], assistant, "K"), _after(s[2], rerole, "R")),
    ]
    return F.transform(F.array(F.array(*moved)), lambda m: _inserted([m[i] for i in range(4)]))[0]


def _from(state: Column) -> Column:
    """The four states of a fold that begins in one of them."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: _state(F.when(j == state, 0).otherwise(F.lit(FAR)), F.lit("")))


def _product(whole: Column, block: Column) -> Column:
    """Four states, then a block's four times four: the least of each end over all states between."""
    end = lambda j: F.array_min(F.transform(whole, lambda s, i: _state(s["cost"] + block[i][j]["cost"], F.concat(s["audit"], block[i][j]["audit"]))))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), end)


def audits(flagged: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, cost, audit: the cheapest edits of each conversation."""
    blocks = flagged.groupBy("conv", F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "letter", "fault"))).alias("turns"))
    ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate("turns", _from(i), _step))
    folded = blocks.select("conv", F.struct("block", ends.alias("ends")).alias("part"))
    whole = F.aggregate(F.sort_array(F.collect_list("part")), F.transform(F.array(_from(F.lit(0))), lambda s: _inserted([s[i] for i in range(4)]))[0], lambda acc, x: _product(acc, x["ends"]))
    best = folded.groupBy("conv").agg(whole.alias("states"))
    done = F.least(F.col("states")[0], F.col("states")[3])
    return best.select("conv", done["cost"].alias("cost"), done["audit"].alias("audit"))


def edited(flagged: DataFrame, audit: DataFrame) -> DataFrame:
    """The repaired turns: conv, at (null behind the last turn), role, text, edit, in order of at and place."""
    # the letters of each turn are its insertions and then its own edit; what follows the last turn are insertions only
    steps = audit.select("conv", F.posexplode(F.regexp_extract_all(F.concat("audit", F.lit("$")), F.lit("I*[KRD$]"), F.lit(0))).alias("at", "step"))
    rows = flagged.select(F.col("conv").alias("of"), F.col("at").alias("row"), "role", "text", "letter")
    # a kept system turn takes no part in the alternation of user and assistant
    joined = steps.join(rows, F.col("conv").eqNullSafe(F.col("of")) & (F.col("at") == F.col("row")), "left")
    made = F.length(F.regexp_replace("step", r"[D$]", "")) - F.when(F.col("step").endswith("K") & (F.col("letter") == "s"), 1).otherwise(0)
    before = F.coalesce(F.sum(made).over(Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = joined.withColumn("before", before)
    turn = lambda x, i: F.struct(
        i.alias("place"),
        F.when(x == "K", F.col("role")).when((F.col("before") + i) % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(x == "I", "").otherwise(F.col("text")).alias("text"),
        x.alias("edit"),
    )
    letters = F.regexp_extract_all("step", F.lit("[IKR]"), F.lit(0))
    return placed.select("conv", "at", F.explode(F.transform(letters, turn)).alias("t")).select("conv", "at", "t.place", "t.role", "t.text", "t.edit")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, row by row: conv, at, place (both give the order), role, text, edit."""
    flagged = Scratch(rows.sparkSession, "repair").save(flag(turns(rows, conv, turn, role, text)), "flagged")
    return edited(flagged, audits(flagged))


def measure(flagged: DataFrame, audit: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = flagged.groupBy("conv").agg(gaps.alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal"))
    return counts.join(audit.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).drop("of")


def digest(repaired: DataFrame) -> DataFrame:
    """conv, SHA-256 of the repaired `role:text` lines."""
    line = F.struct("at", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")
    return repaired.groupBy("conv").agg(F.sha2(joined.cast("binary"), 256).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "repair")
    rows = turns(conversations(spark, sf_dir))
    flagged = scratch.save(flag(damage(rows)), "flagged")
    audit = scratch.save(audits(flagged), "audits")
    found = measure(flagged, audit).join(digest(edited(flagged, audit)).withColumnRenamed("conv", "hashed"), F.col("conv").eqNullSafe(F.col("hashed")), "left").drop("hashed")
    names = rows.select("conv").distinct().withColumnRenamed("conv", "conv_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return names.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


OP12_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(0, 256) r(i))
), base AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), keyed AS (
  SELECT b.* EXCLUDE (k), xor(list_reduce([4294967295] || list_transform(range(1, octet_length(k) + 1), lambda i: ('0x' || substr(hex(k), 2 * i - 1, 2))::BIGINT),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 20 AS fault FROM base b, poly
), damaged AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed
), flagged AS (
  SELECT *, row_number() OVER w - 1 AS pos, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    lag(substr(role, 1, 1)) OVER w AS before, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, substr(role, 1, 1) AS letter
  FROM damaged WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au') AS illegal FROM flagged
), counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM judged GROUP BY conv
), fold AS (
  -- paths: the state, cost, audit and text of every way that is still the least of its state
  SELECT conv, 0::BIGINT AS pos, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counted
  UNION ALL
  SELECT conv, pos, s, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv, s ORDER BY cost, audit) AS best FROM (
      SELECT e.conv, e.pos + 1 AS pos, e.s, e.cost, e.audit, e.lines FROM (
        SELECT p.conv, p.pos, CASE x.op WHEN 'D' THEN p.s WHEN 'S' THEN 1 WHEN 'K' THEN CASE WHEN p.s = 2 THEN 3 ELSE 2 END ELSE CASE WHEN p.s = 2 THEN 3 ELSE 2 END END AS s,
          p.cost + CASE x.op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN x.op <> 'D' AND j.fault = 't' THEN 1 ELSE 0 END AS cost,
          p.audit || CASE x.op WHEN 'S' THEN 'K' ELSE x.op END AS audit,
          CASE x.op WHEN 'D' THEN p.lines WHEN 'R' THEN list_append(p.lines, CASE WHEN p.s = 2 THEN 'assistant:' ELSE 'user:' END || j.text) ELSE list_append(p.lines, j.role || ':' || j.text) END AS lines
        FROM (
          SELECT conv, pos, s, cost, audit, lines FROM fold
          UNION ALL SELECT conv, pos, CASE WHEN s = 2 THEN 3 ELSE 2 END, cost + 2, audit || 'I', list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) FROM fold
          UNION ALL SELECT conv, pos, CASE WHEN s = 2 THEN 2 ELSE 3 END, cost + 4, audit || 'II', lines || CASE WHEN s = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END FROM fold
        ) p JOIN judged j ON p.conv IS NOT DISTINCT FROM j.conv AND p.pos = j.pos, (VALUES ('D'), ('K'), ('R'), ('S')) x(op)
        WHERE x.op = 'D' OR (j.fault NOT IN ('b', 'd') AND (x.op = 'R' OR (x.op = 'K' AND j.letter = CASE WHEN p.s = 2 THEN 'a' ELSE 'u' END) OR (x.op = 'S' AND p.s = 0 AND j.letter = 's')))
      ) e
    )
  ) WHERE best = 1
), ended AS (
  SELECT f.conv, f.cost + x.more AS cost, f.audit || x.letters AS audit, f.lines || x.added AS lines,
    row_number() OVER (PARTITION BY f.conv ORDER BY f.cost + x.more, f.audit || x.letters) AS best
  FROM fold f JOIN counted c ON f.conv IS NOT DISTINCT FROM c.conv AND f.pos = c.n
  JOIN (VALUES (0, 0, '', []::VARCHAR[]), (3, 0, '', []), (2, 2, 'I', ['assistant:']), (1, 4, 'II', ['user:', 'assistant:'])) x(s, more, letters, added) ON f.s = x.s
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv AND e.best = 1
"""
