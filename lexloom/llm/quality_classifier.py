"""Text quality by random-indexing word vectors and a two-layer network.

A text is a stream of words: the letters of each token (a long one in pieces), its shape (runs of upper case, lower case,
digits and punctuation), and markers for a token or a line that stands there again. A word's index
vector is sparse, ternary and derived from a hash; its context vector adds up the index vectors of
its neighbours in the training texts; the word vector joins both. Vectors are pooled over a whole
document, letters and shapes apart, and a two-layer network gives a logit, which a temperature fitted
on rows kept from training turns into a probability.

The classifier, word vectors included, is fitted on a bounded sample of labelled rows: the max_rows
first by a hash of their id. Its size is bounded too: of the words in at least min_docs texts of the sample the
max_words in the most texts have vectors, all others share the zero vector. Everything that is scored is scored whole.

Edge cases: null and empty texts have zero vectors and get the network's answer for them. Without
labelled rows every score is one half. Labels of an id count once for each of its rows; null labels
are left out. Repeated rows are scored one by one; an empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import documents, held_out, share

DIM, HIDDEN, WINDOW = 48, 24, 2
CACHE_TOKENS = 400_000
#: A token of more characters is read in consecutive pieces of so many.
PIECE = 32


def pieces(tokens: list[str]) -> list[str]:
    """The tokens, long ones cut into pieces, so that a vocabulary can know them and no character is passed over."""
    if max(map(len, tokens), default=0) <= PIECE:
        return tokens
    return [t[a : a + PIECE] for t in tokens for a in range(0, len(t), PIECE)]


def shape(token: str) -> str:
    """Runs by class; a run of one punctuation mark keeps up to two of them."""
    out = []
    for ch in token:
        if ch.isalpha():
            c = "A" if ch.isupper() else "a"
        elif ch.isdigit():
            c = "0"
        else:
            c = ch
        if c in "Aa0" and out[-1:] == [c] or c not in "Aa0" and out[-2:] == [c, c]:
            continue
        out.append(c)
    return "".join(out)


def index_vector(word: str, dim: int = DIM, nonzero: int = 6) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7))
    v = np.zeros(dim, np.float32)
    v[rng.choice(dim, nonzero, replace=False)] = rng.choice([-1.0, 1.0], nonzero)
    return v / np.sqrt(nonzero)


class Vocabulary:
    """Tokens as pairs (letters, shape) of word numbers; number 0 is any other word."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.open = True
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def number(self, word: str) -> int:
        if self.open:
            return self.numbers.setdefault(word, len(self.numbers))
        return self.numbers.get(word, 0)

    def token(self, token: str) -> int:
        letters = "".join(ch for ch in token.lower() if ch.isalpha())
        return self.number(letters) << 32 | self.number("shape " + shape(token)) if letters else self.number("shape " + shape(token))

    def stream(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the letters, and of shapes and markers, in order."""
        tokens = pieces((text or "").split())
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.cache) > CACHE_TOKENS:
            self.cache = {}
        cache = self.cache
        for t in set(tokens).difference(cache):
            cache[t] = self.token(t)
        both = np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
        letters, shapes = both >> 32, both & 0xFFFFFFFF
        again = np.flatnonzero(both[1:] == both[:-1]) + 1
        lines = [x for x in text.split("\n") if x.strip()]
        old = len(lines) - len(set(lines))
        marks = [self.number("<token again>")] * len(again) + [self.number("<line>")] * (len(lines) - old) + [self.number("<line again>")] * old
        return letters, np.concatenate((shapes, np.array(marks, np.int64)))


class QualityModel:
    def __init__(self) -> None:
        self.words, self.ready, self.temperature = Vocabulary(), False, 1.0

    def features(self, streams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(streams), 2 * DIM + 2), np.float32)
        for i, (letters, shapes) in enumerate(streams):
            for k, ids in enumerate((letters, shapes)):
                if len(ids):
                    total = np.zeros(DIM, np.float64)
                    for a in range(0, len(ids), 1 << 15):
                        total += self.vectors[ids[a : a + (1 << 15)]].sum(axis=0)
                    out[i, k * DIM : (k + 1) * DIM] = total / len(ids)
            if len(letters):
                out[i, -2:] = np.log1p(len(letters)) / 10, float((letters == 0).mean())
        return out

    def fit(self, rows: Iterator[tuple[str | None, int]], min_docs: int = 3, max_words: int = 20_000, epochs: int = 150) -> None:
        raw, y = [], []
        for text, label in rows:
            raw.append(self.words.stream(text))
            y.append(label)
        if len(set(y)) < 2:
            return
        seen: Counter = Counter()
        for letters, shapes in raw:
            seen.update(np.unique(np.concatenate((letters, shapes))).tolist())
        names = {n: w for w, n in self.words.numbers.items()}
        kept = sorted((n for n, c in seen.items() if n and c >= min_docs), key=lambda n: (-seen[n], names[n]))[:max_words]
        renumber = np.zeros(len(names), np.int64)
        renumber[kept] = np.arange(1, len(kept) + 1)
        self.words.numbers = {names[n]: i + 1 for i, n in enumerate(kept)}
        self.words.open, self.words.cache = False, {}
        streams = [(renumber[a], renumber[b]) for a, b in raw]
        index = np.stack([np.zeros(DIM, np.float32), *[index_vector(names[n]) for n in kept]])
        context = np.zeros_like(index)
        size = len(index)
        pairs: list[np.ndarray] = []
        for letters, shapes in streams:
            n = len(letters)
            mixed = np.stack((letters, shapes[:n]), axis=1).reshape(-1)
            for o in range(1, 2 * WINDOW + 1):
                pairs.append(mixed[:-o] * size + mixed[o:])
        for a in range(0, len(pairs), 4000):
            got, times = np.unique(np.concatenate(pairs[a : a + 4000]), return_counts=True)
            left, right = got // size, got % size
            ok = (left > 0) & (right > 0)
            left, right, times = left[ok], right[ok], times[ok].astype(np.float32)[:, None]
            for b in range(0, len(left), 1 << 18):
                s = slice(b, b + (1 << 18))
                np.add.at(context, left[s], index[right[s]] * times[s])
                np.add.at(context, right[s], index[left[s]] * times[s])
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = (index + context / np.maximum(norm, 1e-9)).astype(np.float32)
        x, y = self.features(streams), np.array(y, np.float64)
        kept_out = np.arange(len(y)) % 5 == 4
        self.center, self.spread = x[~kept_out].mean(axis=0), x[~kept_out].std(axis=0) + 1e-4
        self.train((x[~kept_out] - self.center) / self.spread, y[~kept_out], epochs)
        self.ready = True
        if kept_out.any():
            z, t = self.logits(x[kept_out]), y[kept_out]
            loss = lambda tau: np.logaddexp(0, -np.where(t > 0, z, -z) / tau).mean()
            self.temperature = float(min(np.geomspace(0.3, 8, 60), key=loss))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, decay: float = 1e-3) -> None:
        rng = np.random.default_rng(7)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), 256):
                b = order[a : a + 256]
                h = np.tanh(x[b] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[b]) / len(b)
                back = np.outer(e, p[2]) * (1 - h * h)
                grads = [x[b].T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], e.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = p

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh((x - self.center) / self.spread @ p[0] + p[1]) @ p[2] + p[3]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.ready:
            return np.full(len(texts), 0.5)
        z = self.logits(self.features([self.words.stream(t) for t in texts])) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, training: Column, key: str = "doc_id", text: str = "text", max_rows: int = 4000) -> Iterator[tuple[str | None, int]]:
    """(text, label) of at most max_rows labelled training rows, the first by a hash of their id, in that order."""
    order = F.xxhash64(F.col(key).cast("string"))
    chosen = labels.where(training & F.col(target).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(target).cast("int").alias("__y"), order.alias("__o")).orderBy("__o", "__id").limit(max_rows)
    found = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col("__id"))  # max_rows rows
    n = 0
    for r in found.orderBy("__o", "__id", F.xxhash64("__text")).select("__text", "__y").toLocalIterator():
        if n == max_rows:  # an id that repeats
            break
        n += 1
        yield r["__text"], r["__y"]


def score_quality(docs: DataFrame, model: QualityModel, columns: list[Column | str], text: str = "text") -> DataFrame:
    """The given columns, then score and predicted."""
    shared = share(docs.sparkSession, model)
    out = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared().score(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    return out.mapInArrow(run, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = QualityModel()
    model.fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~held_out(F.col("doc_id"), 3, 1)))
    return score_quality(docs, model, ["doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out")])
