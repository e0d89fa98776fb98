"""Language identification with interpolated Kneser-Ney character models.

One model per language over the letters of a word between word boundaries; runs of over 64 letters
are cut into pieces of 64. All orders of all languages share sorted arrays of 64-bit n-gram hashes:
the payload of a gram is its interpolated log-probability in every language, that of a context its
log back-off weight. A text's cross-entropy in a language is the mean over its letters and word
ends; the lowest wins. A posterior, with a temperature and a span of certainty fitted on labelled rows
kept from training, is the score. A text is rejected if its cross-entropy lies outside what that calibration part
shows for the language, if the posterior is below what all but one in a thousand of its correctly
named rows reach (one half at most), or if it has no letter.

The models are fitted on a bounded sample of labelled rows: at most max_rows rows for each language,
whole texts, about max_chars letters in all, and at most max_langs languages. Everything that is scored is scored whole.

Edge cases: a null text, or one without a letter, gets `und`, score 0 and is rejected; so does every
text if no row is labelled. Ties go to the first language by code point. Repeated rows and equal
ids are scored one by one; an empty table gives no rows. Extra columns are not read; `keep_known`
passes them on.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import documents, held_out, share

#: A letter, and up to 63 more with the combining marks that stand on them.
PIECE = regex.compile(r"\p{L}[\p{L}\p{M}]{0,63}")
#: The same for texts without marks and without digits that are not decimal (as in squares and fractions), several times as fast.
PLAIN_PIECE = re.compile(r"[^\W\d_]{1,64}")
START, END = "\x02", "\x03"
PRIME = np.uint64(0x100000001B3)
#: Words whose scores a worker remembers before it starts anew; only a cache.
CACHE_WORDS = 200_000
#: The same for words times languages.
CACHE_CELLS = 16_000_000


def pieces(text: str) -> list[str]:
    """Runs of letters in lower case; a digit of any kind is no letter, a combining mark stays with its letter."""
    low = text.lower()
    plain = low.isascii() or not any(c > "\x7f" and unicodedata.category(c)[0] in "MN" for c in set(low))
    return (PLAIN_PIECE if plain else PIECE).findall(low)


def _mix(h: np.ndarray, order: int) -> np.ndarray:
    h = (h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_hashes(grams: list[str], order: int) -> np.ndarray:
    c = _codes("".join(grams)).reshape(-1, order)
    h = np.zeros(len(c), np.uint64)
    for j in range(order):
        h = h * PRIME + c[:, j]
    return _mix(h, order)


class KneserNey:
    """Counts of one language: p(order, gram) is interpolated down to a uniform distribution."""

    def __init__(self, words: Counter, order: int, alphabet: int):
        raw: list[Counter] = [Counter() for _ in range(order + 1)]
        for word, n in words.items():
            s = START + word + END
            for i in range(1, len(s)):
                for k in range(1, min(order, i + 1) + 1):
                    raw[k][s[i - k + 1 : i + 1]] += n
        self.counts: list[Counter] = [Counter() for _ in range(order + 1)]
        for k in range(1, order + 1):
            if k == order:
                self.counts[k] = raw[k]
                continue
            for gram in raw[k + 1]:
                self.counts[k][gram[1:]] += 1  # distinct continuations to the left
            for gram, n in raw[k].items():
                if gram[0] == START:  # nothing stands to the left of a word's start
                    self.counts[k][gram] = n
        self.discount, self.total, self.kinds = [0.0] * (order + 1), [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for k in range(1, order + 1):
            n1, n2 = (sum(1 for n in self.counts[k].values() if n == m) for m in (1, 2))
            self.discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for gram, n in self.counts[k].items():
                self.total[k][gram[:-1]] += n
                self.kinds[k][gram[:-1]] += 1
        self.uniform = 1.0 / alphabet

    def backoff(self, k: int, context: str) -> float:
        total = self.total[k].get(context, 0)
        return self.discount[k] * self.kinds[k][context] / total if total else 1.0

    def p(self, k: int, gram: str) -> float:
        if k == 0:
            return self.uniform
        total, lower = self.total[k].get(gram[:-1], 0), self.p(k - 1, gram[1:])
        if not total:
            return lower
        return max(self.counts[k].get(gram, 0) - self.discount[k], 0) / total + self.backoff(k, gram[:-1]) * lower


class LanguageModel:
    """The models of all languages in sorted hash arrays."""

    def __init__(self, words: dict[str, Counter], order: int = 5):
        self.langs, self.order = sorted(words), order
        alphabet = len({c for w in words.values() for x in w for c in x}) + 2  # the end and one unknown
        models = [KneserNey(words[x], order, alphabet) for x in self.langs]
        self.grams, self.contexts = [], []
        self.floor = np.full(len(self.langs), math.log(1.0 / alphabet), np.float32)
        for k in range(1, order + 1):
            for table, keys, width, value in (
                (self.grams, {g for m in models for g in m.counts[k]}, k, lambda m, g, k=k: m.p(k, g)),
                (self.contexts, {g for m in models for g in m.total[k]}, k - 1, lambda m, g, k=k: m.backoff(k, g)),
            ):
                names = sorted(keys)
                h = _gram_hashes(names, width) if width else np.zeros(len(names), np.uint64)
                pay = np.log(np.array([[value(m, g) for m in models] for g in names], np.float64).reshape(len(names), len(models))).astype(np.float32)
                at = np.argsort(h)
                table.append((h[at], pay[at]))
        self.span = math.inf  # symbols beyond which more of them hardly add to the certainty
        self.temperature, self.mean, self.scale, self.reach = 1.0, np.zeros(len(self.langs)), np.ones(len(self.langs)), np.full(len(self.langs), np.inf)
        self.least = 0.0  # posterior of an accepted text
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rows": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word with its end, in each language."""
        text = "".join([START + w + END for w in words])
        c = _codes(text)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(length) - length
        at = np.arange(len(c)) - np.repeat(first, length)
        hashes, h, power = [], np.zeros(len(c), np.uint64), np.uint64(1)
        for k in range(self.order):  # h of the k + 1 symbols that end here, the last with power 0
            shifted = np.zeros(len(c), np.uint64)
            shifted[k:] = c[: len(c) - k]
            h = h + shifted * power
            power = np.uint64(int(power) * int(PRIME) & 0xFFFFFFFFFFFFFFFF)
            hashes.append(h)
        out = np.zeros((len(c), len(self.langs)), np.float32)
        todo = np.flatnonzero(at > 0)
        for k in range(self.order, 0, -1):
            fit = at[todo] >= k - 1
            here = todo[fit]
            keys, pay = self.grams[k - 1]
            want = _mix(hashes[k - 1][here], k)
            pos = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[pos] == want
            out[here[hit]] += pay[pos[hit]]
            miss = here[~hit]
            keys, pay = self.contexts[k - 1]
            if k > 1:
                want = _mix(hashes[k - 2][miss - 1], k - 1)
                pos = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[pos] == want
                out[miss[hit]] += pay[pos[hit]]
            elif len(keys):
                out[miss] += pay[0]
            todo = np.concatenate((todo[~fit], miss))
        out[todo] += self.floor
        return np.add.reduceat(out, first, axis=0)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text in each language, and its number of predicted symbols."""
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        limit = min(CACHE_WORDS, max(1, CACHE_CELLS // max(1, len(self.langs))))
        for i, text in enumerate(texts):
            if not self.cache or len(self.cache) > limit:  # between texts, so that no batch of many long ones fills a worker
                self.cache, self.rows = {}, np.zeros((0, len(self.langs)), np.float32)
            words = pieces(text) if text else []
            if not words:
                continue
            new = [w for w in dict.fromkeys(words) if w not in self.cache]
            if new:
                self.cache.update(zip(new, range(len(self.rows_used()), len(self.rows_used()) + len(new))))
                self.add_rows(self.word_scores(new))
            which = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
            for a in range(0, len(which), 1 << 16):
                sums[i] += self.rows[which[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
            n[i] = sum(map(len, words)) + len(words)
        return sums, n

    def rows_used(self) -> range:
        return range(len(self.cache))

    def add_rows(self, rows: np.ndarray) -> None:
        used = len(self.cache) - len(rows)
        if len(self.rows) < used + len(rows):
            grown = np.zeros((max(2 * len(self.rows), used + len(rows), 1024), len(self.langs)), np.float32)
            grown[:used] = self.rows[:used]
            self.rows = grown
        self.rows[used : used + len(rows)] = rows

    def posterior(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """From the cross-entropies, as if a text had n / (1 + n / span) symbols: a long text in two languages is not sure of either."""
        z = self.temperature * (sums - sums.max(axis=1, keepdims=True)) / (1 + n / self.span)[:, None]
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def calibrate(self, texts: list[str], langs: list[str], margin: float = 1.5) -> None:
        """Temperature and span by likelihood over a grid; the reach of each language's cross-entropy."""
        sums, n = self.totals(texts)
        y = np.array([self.langs.index(x) if x in self.langs else -1 for x in langs], np.int64)
        ok = (n > 0) & (y >= 0)
        sums, n, y = sums[ok], n[ok], y[ok]
        if not len(y):
            return
        best = (math.inf, 1.0, math.inf)
        for span in (math.inf, 1024.0, 256.0, 64.0, 16.0):
            for t in np.geomspace(0.001, 10.0, 41):
                self.temperature, self.span = float(t), span
                loss = -np.log(np.maximum(self.posterior(sums, n)[np.arange(len(y)), y], 1e-12)).mean()
                if loss < best[0] - 1e-9:
                    best = (loss, float(t), span)
        _, self.temperature, self.span = best
        sure = self.posterior(sums, n)
        right = sure.argmax(axis=1) == y
        if right.any():
            self.least = min(0.5, float(np.quantile(sure.max(axis=1)[right], 0.001)))
        h = -sums / n[:, None]
        for j in range(len(self.langs)):
            own = h[y == j, j]
            if len(own) > 1:
                self.mean[j], self.scale[j] = own.mean(), own.std() + 1e-6
                # short texts vary more: distances are measured in units that shrink with the length
                self.reach[j] = margin * max(3.0, np.abs((own - self.mean[j]) / self.unit(j, n[y == j])).max())

    def unit(self, j: int, n: np.ndarray) -> np.ndarray:
        return self.scale[j] + 1.0 / np.sqrt(n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy in bits per symbol, and whether the text is accepted."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
        sums, n = self.totals(texts)
        best, some = sums.argmax(axis=1), n > 0
        score = np.where(some, self.posterior(sums, n)[np.arange(len(texts)), best], 0.0)
        h = np.where(some, -sums[np.arange(len(texts)), best] / np.maximum(n, 1), np.nan)
        far = np.array([(h[i] - self.mean[j]) / self.unit(j, max(n[i], 1)) > self.reach[j] if some[i] else True for i, j in enumerate(best)], bool)
        return [self.langs[j] if s else "und" for j, s in zip(best, some)], score, h / math.log(2), some & ~far & (score >= self.least)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 5, max_rows: int = 1500, max_chars: int = 4_000_000, max_langs: int = 65_536) -> LanguageModel:
    """Fit on a bounded sample of labelled: for each language the rows first by a hash of their id.

    One row in five of the sample is kept from training and calibrates temperature and rejection. Each value of lang that
    is not null is a language of its own, as it stands; the more there are, the fewer rows each of them has, since max_chars
    is shared. max_langs only bounds what the driver holds: above it the most frequent are learned.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    kinds = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    counts = {r["lang"]: r["count"] for r in kinds.collect()}
    if not counts:
        return LanguageModel({})
    place = F.pmod(F.col("h"), F.lit(1_000_003))
    # one row for each language, at most max_langs
    shares = labelled.sparkSession.createDataFrame([(x, min(1.0, 1.3 * max_rows / n + 0.001)) for x, n in counts.items()], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").where(place < F.col("share") * 1_000_003).select("lang", "text", place.alias("o"), "h")
    by = Window.partitionBy("lang").orderBy("o", "h", F.xxhash64("text"))
    upto = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    sample = near.withColumn("n", F.row_number().over(by)).withColumn("before", F.coalesce(upto, F.lit(0))).where((F.col("n") <= max_rows) & (F.col("before") <= max_chars // len(counts)))
    words: dict[str, Counter] = {}
    kept: list[tuple[str, str]] = []
    for r in sample.select("lang", "text", "h").orderBy("lang", "n").toLocalIterator():
        if r["h"] % 5:
            words.setdefault(r["lang"], Counter()).update(pieces(r["text"]))
        else:
            kept.append((r["text"], r["lang"]))
    model = LanguageModel({x: w for x, w in words.items() if w}, order)
    if model.langs:
        model.calibrate([t for t, _ in kept], [x for _, x in kept])
    return model


def identify(docs: DataFrame, model: LanguageModel, columns: list[Column | str], text: str = "text") -> DataFrame:
    """The given columns of docs, then lang_pred, score, bits (per symbol), accepted."""
    shared = share(docs.sparkSession, model)
    out = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]) + ", lang_pred string, score double, bits double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, bits, ok = shared().predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64(), from_pandas=True), pa.array(ok)], [*batch.schema.names[:-1], "lang_pred", "score", "bits", "accepted"])

    return out.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, all columns as they are."""
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared().predict(batch.column(at).to_pylist())[3]))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(F.col(key), 5, 0))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(training_rows(docs)), ["doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out")])
