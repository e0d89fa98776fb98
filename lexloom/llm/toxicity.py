"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns each token into a symbol with a weight: insult, threat, target (a person
spoken of), object (a person who can be acted on), first person, intent, negation, reported speech,
break (a comma or colon), close (a mark beside a closing quote), other. Sequential transducers then rewrite
the symbols of a sentence, each for one thing: those that read from right to left mark insults and threats
with a target after them or with a report after their quote, the others read from left to right and mark
targets before an insult, an object put before an intended threat, intent, the first person, denial and
report. All but the reports stop at a break or close: those are clauses. A report also counts for what follows
a mark at most REACH symbols after it, up to the end of the sentence or quote ("he said: ..."), and for the quote
before it. An arc has an output symbol and a weight; the grammar is their composition, in which each reads
what the one before it writes and weights multiply, made as its states are met. Its last member accepts
marked insults and threats and weighs the match: bare, aimed, intended. A clause scores the sum of its
matches, so a denied or reported insult counts for little and a word of threat with nobody to suffer it for
nothing, unless labelled rows show it to be toxic by itself.

The lexicon holds function words, insults and threats of four languages. A clause is read in the language whose
function words prevail in it, the whole text's decide a tie, and without any the four are read as one;
words of the other languages mean nothing there, but insults are insults in all. Words and stems (prefixes of 4
to 6 letters) that labelled rows show to stand in toxic texts far more often than in others, whatever
their language, join the insults with their log-odds as weight. A logistic curve, fitted on the same
sample, turns a document's sum and density into a probability. Lexicon and curve are fitted on a bounded
sample of labelled rows: the max_rows first by a hash of their id. Near copies share the weight of one row.

Edge cases: null and empty texts have no clause and score as a text without matches. Without
labelled rows the curve is a fixed prior. Repeated rows are scored one by one; an empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import documents, held_out, share
from lexloom.llm.quality_classifier import labelled_sample

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
QUOTES = "\"\u201c\u201d\u00bb"  # those that close; one of them is the German closing and the English opening mark
SYMBOL = re.compile(rf"[^\W\d_]+(?:'[^\W\d_]+)*|[.,!?][{QUOTES}]|[{QUOTES}],|[.,;!?:\n]")

OTHER, INSULT, THREAT, TARGET, OBJECT, FIRST, INTENT, NEGATION, REPORT, BREAK, CLOSE, END = range(12)
KINDS = 16  # symbols are a kind plus marks
AIMED, FRONTED, MEANT, OWN, TOLD = 16, 32, 64, 128, 256
MARKS = (BREAK, CLOSE)

#: Words of each kind in English, French, German and Spanish. Articles that are pronouns too are left out.
INSULTS = (
    "idiot moron stupid dumb loser scum trash pathetic worthless disgusting imbecile fool bastard jerk vermin filth degenerate",
    "imbécile crétin connard salaud abruti débile ordure idiote",
    "idiot idiotin dummkopf dummköpfe trottel arschloch arschlöcher abschaum wertlos versager",
    "idiota imbécil estúpido estúpida escoria basura inútil",
)
THREATS = (
    "kill hurt destroy stab shoot strangle beat burn crush murder smash",
    "tuer tuerai tue frapper frapperai détruire étrangler écraser",
    "töten töte umbringen schlagen schlage zerstören erwürgen",
    "matar mataré golpear golpearé destruir destruiré aplastar",
)
TARGETS = (
    "your you're yours he she they their these those people everyone",
    "tu ton ta tes votre vos ils elles ceux",
    "dein deine euer eure er diese leute",
    "tu tus su sus ellos ellas esos gente",
)
OBJECTS = ("you yourself u him her them myself", "toi te vous eux lui", "du dich dir euch ihn ihnen", "tú te ti usted ustedes vosotros")
FIRSTS = ("i i'm i'll i'd we we'll we're me us", "je nous on moi", "ich wir mich", "yo nosotros voy vamos")
INTENTS = ("will gonna shall should must i'll we'll going", "vais allons dois veux", "werde werden muss will", "voy vamos debo quiero")
NEGATIONS = (
    "not no never isn't aren't don't doesn't didn't won't wasn't weren't cannot can't without nobody nor",
    "pas jamais sans ni aucun",
    "nicht kein keine nie niemals ohne",
    "no nunca jamás sin ningún",
)
REPORTS = (
    "said says say claimed claims wrote writes called calls quoted quote reported reports alleged accused according",
    "dit disait écrit selon déclaré accusé",
    "sagte sagt schrieb laut behauptet behauptete",
    "dijo dice escribió según afirmó acusado",
)

#: Other words that tell the language of a clause, and the endings of plurals.
HINTS = (
    "the a an of to and is are was this that it in on for with be as at by from",
    "le la les un une des du de a à et est êtes sont dans pour avec sur ce cette que qui c'est",
    "der die das ein eine und ist bist seid sind in im den dem für mit auf von zu es",
    "el la los las un una de a y es eres son en para con por que del al",
)
PLURALS = (("s", "es"), ("s",), ("e", "en", "nen", "n"), ("s", "es"))
LANGUAGES = len(HINTS)

#: What each kind of match is worth, times the word's weight, and what denial and report leave of it.
BARE, INSULTED, THREATENED, HINTED = 1.0, 1.6, 2.0, 0.4
UNMEANT, BEFORE = 0.5, 0.5
DENIED, REPORTED = 0.2, 0.35
SEED_WEIGHT, CACHE_WORDS, REACH = 2.5, 500_000, 4
ENDS = ".;!?\n"


def inflected(word: str) -> set[str]:
    """An English verb with its regular endings."""
    stem = word[:-1] if word.endswith("e") else word
    return {word, word + "s", stem + "ed", stem + "ing", stem + stem[-1] + "ed", stem + stem[-1] + "ing"}


class Transducer:
    """Sequential: step gives the next state, the symbol written and the weight of the arc."""

    start: object = 0

    def step(self, state, symbol: int) -> tuple[object, int, float]:
        raise NotImplementedError


class Near(Transducer):
    """Marks, or weighs, symbols of some kinds that stand in a clause at most reach symbols after one of the triggers (None: anywhere after it)."""

    def __init__(self, triggers: tuple[int, ...], kinds: tuple[int, ...], reach: int | None, mark: int = 0, weight: float = 1.0):
        self.triggers, self.kinds, self.reach, self.mark, self.weight = triggers, kinds, reach, mark, weight

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        kind = symbol % KINDS
        hit = state > 0 and kind in self.kinds
        if kind in MARKS:
            return 0, symbol, 1.0
        after = 1 if kind in self.triggers else state if self.reach is None else state + 1 if 0 < state < self.reach else 0
        return after, symbol | self.mark if hit else symbol, self.weight if hit else 1.0


class Fronted(Transducer):
    """Marks a threat after an object and, later than that, an intent: you I will ..."""

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        kind = symbol % KINDS
        if kind in MARKS:
            return 0, symbol, 1.0
        after = 1 if kind == OBJECT else 2 if kind == INTENT and state else state
        return after, symbol | FRONTED if kind == THREAT and state == 2 else symbol, 1.0


class Told(Transducer):
    """Reports. The state: symbols since one in this clause (0: none), and whether one from beyond a mark still holds.

    Forward, what follows a report in its clause or is carried over a mark, and what bears the mark, is weighed; backward
    only a close carries it over, and insults and threats are marked. A close ends what was carried to it.
    """

    start = (0, False)

    def __init__(self, forward: bool):
        self.forward = forward

    def step(self, state: tuple[int, bool], symbol: int) -> tuple[tuple[int, bool], int, float]:
        (since, held), kind = state, symbol % KINDS
        if kind == CLOSE:
            return (0, 0 < since <= REACH), symbol, 1.0
        if kind == BREAK:
            return (0, held or self.forward and 0 < since <= REACH), symbol, 1.0
        after = (1 if kind == REPORT else min(since + 1, REACH + 1) if since else 0, held)
        if kind not in HITS:
            return after, symbol, 1.0
        if not self.forward:
            return after, symbol | TOLD if held else symbol, 1.0
        return after, symbol, REPORTED if since or held or symbol & TOLD else 1.0


class Match(Transducer):
    """Accepts insults and threats; the weight is what the match is worth, 0 for all other symbols.

    A threat that nothing aims is written as an insult: its word's own weight counts.
    """

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        kind = symbol % KINDS
        if kind == INSULT:
            return 0, INSULT, INSULTED if symbol & AIMED else BARE
        if kind != THREAT:
            return 0, OTHER, 0.0
        meant = 1.0 if symbol & MEANT else UNMEANT
        if symbol & AIMED:
            return 0, THREAT, THREATENED * meant
        if symbol & FRONTED:
            return 0, THREAT, THREATENED * BEFORE * meant
        if symbol & MEANT and symbol & OWN:
            return 0, THREAT, HINTED
        return 0, INSULT, BARE


class Composition(Transducer):
    """Each part reads what the part before it writes; weights multiply. Arcs are made when first met."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = tuple(p.start for p in parts)
        self.arcs: dict[tuple, tuple[tuple, int, float]] = {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int, float]:
        key = (state, symbol)
        if key not in self.arcs:
            after, weight = [], 1.0
            for part, s in zip(self.parts, state):
                s, symbol, w = part.step(s, symbol)
                after.append(s)
                weight *= w
            self.arcs[key] = (tuple(after), symbol, weight)
        return self.arcs[key]


PERSONS, HITS = (TARGET, OBJECT), (INSULT, THREAT)


class Grammar:
    """The right-to-left pass, then the composition of all that reads from left to right."""

    def __init__(self) -> None:
        self.back = Composition(Near(PERSONS, (INSULT,), REACH, AIMED), Near(PERSONS, (THREAT,), None, AIMED), Told(forward=False))
        self.forth = Composition(
            Near(PERSONS, (INSULT,), REACH, AIMED),
            Fronted(),
            Near((INTENT,), (THREAT,), REACH, MEANT),
            Near((FIRST,), (THREAT,), REACH + 2, OWN),
            Near((NEGATION,), HITS, REACH, weight=DENIED),
            Told(forward=True),
            Match(),
        )

    def sentence(self, kinds: list[int]) -> list[tuple[int, int, float]]:
        """(place, INSULT or THREAT, weight) of each match among the symbols of one sentence."""
        state, marked = self.back.start, list(kinds)
        for i in range(len(kinds) - 1, -1, -1):
            state, marked[i], _ = self.back.step(state, kinds[i])
        state, out = self.forth.start, []
        for i, symbol in enumerate(marked):
            state, kind, weight = self.forth.step(state, symbol)
            if weight:
                out.append((i, kind, weight))
        return out


def near_copy_keys(words: list[str]) -> tuple[int, int]:
    """Two minima over hashed five-word windows; texts that share one count as copies in the sample."""
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    h = np.fromiter((xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 3) for g in grams), np.uint64, len(grams))
    return int(h.min()), int((h * np.uint64(0x9E3779B97F4A7C15)).min())


def folded(text: str | None) -> str:
    """Lower case, one kind of apostrophe."""
    return (text or "").lower().replace("\u2019", "'")


class ToxicityModel:
    """fixed and stems: insults of any language with their weights; words: kind and weight by word for each language, then for all as one.

    A threat's weight counts if it is aimed or meant, alone what bare says.
    """

    def __init__(self) -> None:
        self.fixed: dict[str, float] = {}
        self.bare: dict[str, float] = {}
        self.words: list[dict[str, tuple[int, float]]] = [{} for _ in range(LANGUAGES)]
        self.speaks: dict[str, tuple[int, ...]] = {}  # the languages that a function word speaks for
        for kind, lists in ((TARGET, TARGETS), (OBJECT, OBJECTS), (FIRST, FIRSTS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (OTHER, HINTS), (THREAT, THREATS), (INSULT, INSULTS)):
            for i, names in enumerate(lists):
                for w in names.split():
                    if kind == INSULT:
                        self.fixed |= {x: SEED_WEIGHT for x in (w, *(w + e for e in PLURALS[i]))}
                        continue
                    if kind != OTHER:
                        forms = inflected(w) if kind == THREAT and i == 0 else {w}
                        self.words[i] |= {x: (kind, SEED_WEIGHT if kind == THREAT else 0.0) for x in forms}
                    if kind != THREAT and i not in self.speaks.get(w, ()):
                        self.speaks[w] = (*self.speaks.get(w, ()), i)
        self.words.append({x: k for d in self.words for x, k in d.items()})
        self.stems: dict[str, float] = {}
        self.curve = np.array([-3.0, 2.0, 0.0])
        self.grammar = Grammar()
        self.cache: dict[str, tuple[tuple[tuple[int, float], ...], float, tuple[int, ...]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def symbols(self, word: str) -> tuple[tuple[tuple[int, float], ...], float, tuple[int, ...]]:
        """Kind and weight in each language and in all as one, the largest weight, the languages that the word speaks for."""
        if word in self.fixed:
            each = ((INSULT, self.fixed[word]),) * (LANGUAGES + 1)
        elif word in self.words[-1]:
            each = tuple(d.get(word, (OTHER, 0.0)) for d in self.words)
        else:
            stem = next((word[:n] for n in (6, 5, 4) if len(word) > n and word[:n] in self.stems), None)
            each = ((INSULT, self.stems[stem]) if stem else (OTHER, 0.0),) * (LANGUAGES + 1)
        return each, max(w for _, w in each), self.speaks.get(word, ())

    def clauses(self, low: str) -> Iterator[tuple[int, int, float]]:
        """Number of the first and the last token of each clause with matches, and its score; of a folded text."""
        cache, tokens = self.cache, SYMBOL.findall(low)
        counts, spoken = Counter(tokens), [0] * LANGUAGES
        for t in counts.keys() & self.speaks.keys():
            for i in self.speaks[t]:
                spoken[i] += counts[t]

        def read(first: int, end: int) -> Iterator[tuple[int, int, float]]:
            kinds, weights, cuts = [], [], [first]
            for at in range(first, end + 1):
                if at < end and tokens[at] in cache:
                    continue
                here = Counter(i for t in tokens[cuts[-1] : at] for i in cache[t][2])
                lang = max(range(LANGUAGES), key=lambda i: (here[i], spoken[i], -i)) if any(spoken) else LANGUAGES
                for t in tokens[cuts[-1] : at]:
                    kind, weight = cache[t][0][lang]
                    kinds.append(kind)
                    weights.append(weight)
                if at < end:
                    kinds.append(BREAK if tokens[at] in ",:" else CLOSE)
                    weights.append(0.0)
                cuts.append(at + 1)
            scores: dict[int, float] = {}
            for i, kind, w in self.grammar.sentence(kinds) if any(weights) else ():
                c = bisect_right(cuts, first + i) - 1
                scores[c] = scores.get(c, 0.0) + w * (weights[i] if kind == kinds[i] else self.bare.get(tokens[first + i], 0.0))
            yield from ((cuts[c], cuts[c + 1] - 2, score) for c, score in scores.items() if score)

        first, some = 0, False
        for at, token in enumerate(tokens):
            known = cache.get(token)
            if known is not None:
                some = some or known[1] > 0
            elif token in ENDS:
                if some:
                    yield from read(first, at)
                first, some = at + 1, False
        if some:
            yield from read(first, len(tokens))

    def learn_words(self, low: str) -> tuple[int, bool]:
        """Number of words, and whether any of them can match; all are in the cache afterwards."""
        words = WORD.findall(low)
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        names = set(words)
        for w in names.difference(self.cache):
            self.cache[w] = self.symbols(w)
        return len(words), any(self.cache[w][1] for w in names)

    def measure(self, text: str | None) -> tuple[float, float]:
        """Logarithm of the clause scores' sum, and their sum for a hundred words."""
        low = folded(text)
        n, some = self.learn_words(low)
        total = sum(score for _, _, score in self.clauses(low)) if some else 0.0
        return math.log1p(total), 100 * total / max(n, 1)

    def matched(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and score of each clause that matches, as places in the lower-cased text."""
        low = folded(text)
        if not self.learn_words(low)[1]:
            return []
        spans = [m.span() for m in SYMBOL.finditer(low)]
        return [(spans[a][0], spans[b][1], score) for a, b, score in self.clauses(low)]

    def fit(self, rows: Iterator[tuple[str | None, int]], min_share: float = 0.02, min_docs: int = 5, least: float = 2.0) -> None:
        """Words, stems and curve from (text, label) rows, near copies weighing as one.

        A word or stem is learned if at least min_docs toxic rows, and min_share of them, have it, and its log-odds reach least. Smaller
        values learn more words, rarer and less sure ones; none leaves out rows, and all texts are scored whole.
        """
        sample, keys = [], []
        for text, label in rows:
            words = WORD.findall(folded(text))
            sample.append((text, label, set(words)))
            keys.append(near_copy_keys(words) if words else (0, 0))
        copies = [Counter(k[j] for k in keys) for j in (0, 1)]
        share_of = np.array([1.0 / max(copies[0][a], copies[1][b]) for a, b in keys])
        toxic, clean, sizes = Counter(), Counter(), [0.0, 0.0]
        for (_, label, words), part in zip(sample, share_of):
            sizes[label > 0] += part
            into = toxic if label > 0 else clean
            for x in words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}:
                into[x] += part
        if not all(sizes):
            return

        def odds(x: str) -> float:
            return math.log((toxic[x] + 0.5) / (sizes[1] + 1)) - math.log((clean[x] + 0.5) / (sizes[0] + 1))

        strong = {x for x, n in toxic.items() if n >= max(min_docs, min_share * sizes[1]) and odds(x) >= least}
        covered: Counter = Counter()  # of a stem: the most that one longer stem or one word accounts for
        for x, n in toxic.items():
            name = x.rstrip("*")
            for k in (4, 5, 6):
                if len(name) > k:
                    covered[name[:k] + "*"] = max(covered[name[:k] + "*"], n)
        for x in sorted(strong):
            if not x.endswith("*"):
                kinds = {d[x][0] for d in self.words if x in d} if x not in self.fixed else set()
                if not kinds:
                    self.fixed[x] = odds(x)
                elif THREAT in kinds:
                    self.bare[x] = odds(x)
            elif covered[x] < 0.7 * toxic[x]:
                self.stems[x[:-1]] = odds(x)
        self.cache = {}
        x = np.array([[1.0, *self.measure(t)] for t, _, _ in sample])
        y = np.array([float(label > 0) for _, label, _ in sample])
        prior, w = np.array([-3.0, 2.0, 0.0]), self.curve.copy()
        for _ in range(50):  # Newton steps, held near the prior; more matches never lower the score
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ ((p - y) * share_of) + 0.1 * (w - prior)
            w = w - np.linalg.solve((x * (p * (1 - p) * share_of)[:, None]).T @ x + 0.1 * np.eye(3), grad)
            w[1:] = np.maximum(w[1:], 0.0)
        self.curve = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([[1.0, *self.measure(t)] for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, columns: list[Column | str], text: str = "text") -> DataFrame:
    """The given columns, then score and predicted."""
    shared = share(docs.sparkSession, model)
    out = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared().score(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    return out.mapInArrow(run, schema)


def matched_clauses(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per matched clause: doc_id, clause_start, clause_end (places in the lower-cased text), weight."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in shared().matched(t)]
            at, start, end, weight = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(weight, pa.float64())], ["doc_id", "clause_start", "clause_end", "weight"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, clause_start long, clause_end long, weight double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = ToxicityModel()
    model.fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", ~held_out(F.col("doc_id"), 5, 0), max_rows=8000))
    return score_toxicity(docs, model, ["doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out")])
