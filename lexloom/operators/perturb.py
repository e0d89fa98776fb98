"""Claims made wrong in one known way, for testing a verifier: seven kinds, source pairs, and the contrastive data set.

Where the kind leaves a choice (which number, which court), the first digits of md5(seed:id:kind) make it, so reruns and
other engines agree. A kind that does not apply gives null; nothing is faked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom import config
from lexloom.functions import text as T
from lexloom.operators.ordering import ranked_within

#: The kinds in the order in which they are tried.
KINDS = ("section_number", "ipc_bns_swap", "negate_obligation", "swap_parties", "alter_date_amount", "change_court", "unsupported_holding")
#: Fixed value: a cited section.
SECTION = r"(?i)\b(section|sections|s\.|ss\.)\s*(\d+)([A-Za-z]?)\b"
#: How far a section number moves.
DELTAS = (-100, -11, -3, -1, 1, 3, 11, 100)
#: Names of the old and the new codes.
IPC_NAMES = ("Indian Penal Code", "I.P.C.", "IPC", "Penal Code")
BNS_NAMES = ("Bharatiya Nyaya Sanhita", "BNS")
CRPC_NAMES = ("Code of Criminal Procedure", "Cr.P.C.", "CrPC")
BNSS_NAMES = ("Bharatiya Nagarik Suraksha Sanhita", "BNSS")
SWAPS = ((IPC_NAMES, BNS_NAMES), (CRPC_NAMES, BNSS_NAMES), (BNS_NAMES, IPC_NAMES), (BNSS_NAMES, CRPC_NAMES))
#: Duties and what reverses them; removals of a negation come before insertions.
NEGATIONS = (
    (r"\bshall not\b", "shall"),
    (r"\bmust not\b", "must"),
    (r"\bcannot\b", "can"),
    (r"\bis not entitled\b", "is entitled"),
    (r"\bwas not entitled\b", "was entitled"),
    (r"\bshall\b", "shall not"),
    (r"\bmust\b", "must not"),
    (r"\bis entitled\b", "is not entitled"),
    (r"\bwas entitled\b", "was not entitled"),
    (r"\bis liable\b", "is not liable"),
    (r"\bwas liable\b", "was not liable"),
    (r"\bis barred\b", "is not barred"),
)
#: Parties that face each other.
PARTIES = (
    ("appellant", "respondent"), ("plaintiff", "defendant"),
    ("petitioner", "respondent"), ("appellants", "respondents"),
    ("plaintiffs", "defendants"), ("assessee", "revenue"),
    ("accused", "complainant"), ("landlord", "tenant"),
)
#: Years, amounts and days of the month, and how far they move.
YEAR, AMOUNT, DAY = r"\b(1[89]\d{2}|20[0-4]\d)\b", r"(?i)\b(?:Rs\.?|rupees)\s*([\d,]+)", r"(?i)\b(\d{1,2})(st|nd|rd|th)\b"
FACTORS, YEAR_DELTAS = (0.1, 0.5, 2.0, 10.0), (-17, -9, -5, -2, 2, 5, 9, 17)
#: Courts.
COURTS = (
    "Supreme Court", "High Court", "Bombay High Court", "Calcutta High Court",
    "Madras High Court", "Delhi High Court", "Allahabad High Court",
    "District Court", "Privy Council", "Sessions Court",
)
#: Holdings that no passage establishes.
HOLDINGS = (
    "The Court further held that the limitation period stood extended by two years.",
    "It was also held that the burden of proof lay entirely on the respondent.",
    "The Court additionally ruled that no appeal shall lie against this finding.",
    "It was further observed that the impugned order was void ab initio.",
    "The Court also held that costs were awarded against the appellant throughout.",
    "It was additionally held that the statutory notice requirement stood waived.",
)


def number_of(key: Column, kind: str, seed: int = 42) -> Column:
    """A whole number from the first eight digits of md5(seed:key:kind)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{kind}"))), 1, 8), 16, 10).cast("bigint")


def pick(choices: Column, key: Column, kind: str, seed: int = 42) -> Column:
    """One element of an array; null for an empty one."""
    return T.let(choices, lambda c: F.when(F.size(c) > 0, F.get(c, F.pmod(number_of(key, kind, seed), F.size(c)).cast("int"))))


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _put(claim: Column, span: Column, to: Column) -> Column:
    return F.concat(F.substring(claim, F.lit(1), span["start"]), to, F.substring(claim, span["end"] + 1, F.length(claim)))


def replace_first(text: Column, pattern: str, to: Column) -> Column:
    """The first match replaced by a value."""
    return T.let(F.get(T.match_spans(text, pattern), F.lit(0)), lambda span: _put(text, span, to))


def quoted(name: str) -> str:
    return "(?i)" + "".join("\\" + c if c == "." else c for c in name)


def section_number(claim: Column, key: Column) -> Column:
    """One of the cited section numbers moved by one of the deltas that leave it positive."""
    def move(span: Column) -> Column:
        part = lambda i: F.regexp_extract(span["value"], SECTION, i)
        moved = T.let(part(2).try_cast("int"), lambda n: n + pick(F.filter(_lits(DELTAS), lambda d: n + d > 0), key, "section_delta"))
        return _put(claim, span, F.concat(part(1), F.lit(" "), moved.cast("string"), part(3)))

    return T.let(pick(T.match_spans(claim, SECTION), key, "section_number"), move)


def ipc_bns_swap(claim: Column, key: Column) -> Column:
    """The first code's name found replaced by one of its counterpart's, the section numbers left as they are."""
    out = F.lit(None).cast("string")
    for names, others in reversed(SWAPS):
        to = pick(_lits(others), key, "ipc_bns_swap")
        for name in reversed(names):
            out = F.when(claim.rlike(quoted(name)), replace_first(claim, quoted(name), to)).otherwise(out)
    return out


def negate_obligation(claim: Column, key: Column | None = None) -> Column:
    """The first rule that fits, applied once."""
    out = F.lit(None).cast("string")
    for pattern, to in reversed(NEGATIONS):
        out = F.when(claim.rlike("(?i)" + pattern), replace_first(claim, "(?i)" + pattern, F.lit(to))).otherwise(out)
    return out


def swap_parties(claim: Column, key: Column) -> Column:
    """Both words of one pair of parties exchanged throughout, each keeping its upper or lower case."""
    fits = F.filter(F.array(*[F.when(claim.rlike(rf"(?i)\b({a}|{b})\b"), F.lit(i)) for i, (a, b) in enumerate(PARTIES)]), lambda i: i.isNotNull())

    def swapped(chosen: Column) -> Column:
        a, b = (F.get(F.array(*[F.lit(p[i]) for p in PARTIES]), chosen) for i in (0, 1))
        out = claim
        for form in (F.upper, F.initcap, F.lower):
            out = T.let(F.array(out, form(a), form(b)), _exchange)
        return out

    return T.let(F.when(F.size(fits) > 0, T.let(pick(fits, key, "swap_parties"), swapped)), lambda out: F.when(out != claim, out))


def _exchange(x: Column) -> Column:
    """The second and the third of three strings exchanged in the first, through a mark that no text has."""
    word = lambda i: F.concat(F.lit(r"\b"), x[i], F.lit(r"\b"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x[0], word(1), F.lit("\x01")), word(2), x[1]), F.lit("\x01"), x[2])


def alter_date_amount(claim: Column, key: Column) -> Column:
    """An amount multiplied, else a year moved, else a day of the month put to the next."""
    def multiplied(span: Column) -> Column:
        digits = F.regexp_extract(span["value"], AMOUNT, 1)
        value = F.regexp_replace(digits, ",", "").try_cast("bigint")
        new = F.format_number(F.greatest(F.lit(1), F.floor(value * pick(_lits(FACTORS), key, "factor"))).cast("bigint"), 0)
        return F.when(value > 0, _put(claim, F.struct((span["end"] - F.length(digits)).alias("start"), span["end"].alias("end")), new))

    def moved(span: Column) -> Column:
        return _put(claim, span, (span["value"].try_cast("int") + pick(_lits(YEAR_DELTAS), key, "year_delta")).cast("string"))

    def next_day(span: Column) -> Column:
        def named(d: Column) -> Column:
            last = F.when(d < 20, d).otherwise(d % 10)
            return F.concat(d.cast("string"), F.when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))

        return _put(claim, span, T.let(F.regexp_extract(span["value"], DAY, 1).try_cast("int") % 28 + 1, named))

    with_digits = F.filter(T.match_spans(claim, AMOUNT), lambda s: F.regexp_extract(s["value"], AMOUNT, 1).rlike("[0-9]"))
    return F.coalesce(
        T.let(pick(with_digits, key, "amount"), multiplied), T.let(pick(T.match_spans(claim, YEAR), key, "year"), moved), T.let(pick(T.match_spans(claim, DAY), key, "day"), next_day)
    )


def change_court(claim: Column, key: Column) -> Column:
    """The longest court named replaced by another one, once."""
    out = F.lit(None).cast("string")
    for court in sorted(COURTS, key=len):  # the longest is tested first
        other = pick(_lits([c for c in COURTS if c != court]), key, "change_court")
        out = F.when(claim.rlike(quoted(court)), replace_first(claim, quoted(court), other)).otherwise(out)
    return out


def unsupported_holding(claim: Column, key: Column) -> Column:
    """A holding appended; the only kind that always applies."""
    body = F.regexp_replace(claim, r"\s+$", "")
    return F.concat(body, F.when(body.rlike(r"[.;:]$"), " ").otherwise(". "), pick(_lits(HOLDINGS), key, "unsupported_holding"))


PERTURBERS = {"section_number": section_number, "ipc_bns_swap": ipc_bns_swap, "negate_obligation": negate_obligation, "swap_parties": swap_parties, "alter_date_amount": alter_date_amount, "change_court": change_court, "unsupported_holding": unsupported_holding}


def all_perturbations(claim: Column, key: Column) -> Column:
    """struct(kind, claim) of every kind that applies and changes the claim, in the order of KINDS."""
    made = F.array(*[F.struct(F.lit(k).alias("kind"), PERTURBERS[k](claim, key).alias("claim")) for k in KINDS])
    return F.filter(made, lambda x: x["claim"].isNotNull() & (x["claim"] != claim))


def source_pairs(docs: DataFrame, key: str, judgment: str, summary: str, least: float = config.CLAIM_OVERLAP, most: int = 3, window: int = config.CLAIM_WINDOW, words: tuple[int, int] = config.CLAIM_WORDS) -> DataFrame:
    """key, claim_no, claim, passage, overlap: each sentence of the summary with the window around the judgment's sentence that shares most of its content words.

    Claims have 8 to 60 words; the first sentence wins a tie; pairs below the least overlap are left out, and the first `most` of a document stay.
    """
    content = lambda t: T.content_words(t)
    d = docs.select(key, T.fragments(F.col(judgment)).alias("__j"), T.fragments(F.col(summary)).alias("__s")).where(F.size("__j") > 0)
    d = d.withColumn("__w", F.transform("__j", content))
    c = d.select(key, "__j", "__w", F.posexplode("__s").alias("claim_no", "claim"))
    c = c.where(F.size(T.words(F.col("claim"))).between(*words)).withColumn("__c", content(F.col("claim"))).where(F.size("__c") > 0)
    hits = F.transform("__w", lambda w: F.size(F.array_intersect(w, F.col("__c"))))
    c = c.withColumn("__h", hits).withColumn("__best", F.array_max("__h")).where("__best > 0")
    at = F.greatest(F.array_position("__h", F.col("__best")).cast("int") - 1 - window // 2, F.lit(0))
    c = c.withColumn("passage", F.array_join(F.slice("__j", at + 1, F.lit(window)), " "))
    share = F.size(F.array_intersect("__c", content(F.col("passage")))) / F.size("__c")
    c = c.withColumn("overlap", share).where(F.col("overlap") >= least)
    order = Window.partitionBy(key).orderBy("claim_no")
    return c.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).select(key, "claim_no", "claim", "passage", F.round("overlap", 4).alias("overlap"))


def balanced(classes: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[int]]:
    """How many rows of each class (the kinds that apply to them: at most 127 classes) get each of its kinds, so that the kinds' sums are as equal as can be.

    Rows go from a kind to one with at least two fewer, over other kinds where no class holds both, until no such way is left; then no
    other dealing has a smaller largest sum, nor, that being equal, a smaller next one.
    """
    dealt = {c: {k: n // len(c) + (i < n % len(c)) for i, k in enumerate(c)} for c, n in sorted(classes.items()) if c}
    while True:
        load = {k: sum(d.get(k, 0) for d in dealt.values()) for k in KINDS}
        ways: list[list[tuple[tuple[str, ...], str, str]]] = []
        for start in KINDS:
            way: dict[str, list] = {start: []}
            queue = [start]
            for a in queue:
                for c, d in dealt.items():
                    for b in c if d.get(a) else ():
                        if b not in way:
                            way[b] = [*way[a], (c, a, b)]
                            queue.append(b)
            ways += [w for b, w in way.items() if load[start] - load[b] > 1]
        if not ways:
            return {c: list(d.values()) for c, d in dealt.items()}
        w = max(ways, key=lambda w: load[w[0][1]] - load[w[-1][2]])
        n = min((load[w[0][1]] - load[w[-1][2]]) // 2, *[dealt[c][a] for c, a, _ in w])
        for c, a, b in w:
            dealt[c][a] -= n
            dealt[c][b] += n


def contrastive(pairs: DataFrame, key: str, balance: bool = True) -> DataFrame:
    """For each pair a positive row and a perturbed one: pair_id, key, kind, label, passage, claim, original_claim, overlap.

    The pairs to which the same kinds apply are a class, of which there are at most 127. Their counts decide how many rows of each class
    get each kind (`balanced`), and places in order of a hash of the ids which; no task has to see the others' choices. Without
    balance a class deals its kinds in turn, in order of the ids. Pairs to which no kind applies are left out.
    """
    own = F.concat_ws(":", F.col(key).cast("string"), F.col("claim_no").cast("string"))
    p = pairs.withColumn("__id", own)
    p = p.withColumn("__a", all_perturbations(F.col("claim"), F.col("__id"))).checkpoint().where(F.size("__a") > 0)  # made once, though read more than once
    p = p.withColumn("__kinds", F.array_join(F.transform("__a", lambda x: x["kind"]), ","))
    if balance:
        shares = balanced({tuple(r[0].split(",")): r[1] for r in p.groupBy("__kinds").count().collect()})
        ends = pairs.sparkSession.createDataFrame([(",".join(c), [sum(n[: i + 1]) for i in range(len(n))]) for c, n in shares.items()], "__kinds string, __ends array<bigint>")
        p = ranked_within(p, "__kinds", F.xxhash64("__id"), F.col("__id"), name="__turn").join(F.broadcast(ends), "__kinds")
        p = p.withColumn("__at", F.size(F.filter("__ends", lambda e: e <= F.col("__turn"))))
    else:
        p = ranked_within(p, "__kinds", F.col("__id"), name="__turn").withColumn("__at", (F.col("__turn") % F.size("__a")).cast("int"))
    p = p.withColumn("__x", F.get("__a", F.col("__at")))
    base = [F.col(key), "passage"]
    rest = [F.col("claim").alias("original_claim"), "overlap"]
    pos = p.select(F.concat("__id", F.lit("-pos")).alias("pair_id"), *base, F.lit("none").alias("kind"), F.lit("entailed").alias("label"), "claim", *rest)
    neg = p.select(F.concat("__id", F.lit("-neg")).alias("pair_id"), *base, F.col("__x.kind").alias("kind"), F.lit("not_entailed").alias("label"), F.col("__x.claim").alias("claim"), *rest)
    return pos.unionByName(neg)
