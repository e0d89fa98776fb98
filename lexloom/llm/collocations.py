r"""Phrase collocation mining: counts of frequent phrases by slot of a minimal perfect hash.

Lower-cased texts (A-Z) are split into pieces at [.,;:!?] and line ends and into words at spaces and tabs. Phrases
of up to max_words words are counted per language, level by level. A phrase of m words can only be frequent if its
first and its last m - 1 words are (Apriori), so a phrase is a pair of what the level before has numbered: the number
of its first m - 1 words and the number of its last word, together one exact 64-bit key. For each level

1. tasks hash the keys of such phrases into buckets and bincount them; a bucket that stays below the threshold holds
   no frequent phrase (at most MAX_BUCKETS bits, which tasks get as a bitmap);
2. the distinct keys left, arrays that are united in two rounds, are the candidates; they fall by hash into chunks of at most about CHUNK keys, each with a
   minimal perfect hash of its own that stores its keys, so that a key that is no candidate is recognised;
3. tasks bincount the slots of their keys; the partial arrays are summed in two rounds, first within fans, then whole;
4. slots above the threshold are the frequent phrases; the tokens are numbered anew for the next level.

A cut of a phrase reads the counts of its parts from the slots of the levels below; scores are integers of 38 digits.

What travels to tasks is bounded: one bitmap, and one chunk at a time (a task opens the next only after the last);
words meet their numbers through chunks of the frequent vocabulary in the same way. The driver holds one chunk at a
time. More data means more chunks, never larger ones. Tokens, candidates and counts are tables in the shared folder.

Edge cases: a null text is empty; a null language is `und`, together with rows that say so. Rows with equal ids and
repeated rows count each. A text without a word, and an empty table, give no phrases. Very long texts are read in one
piece of their bytes. Only text and language are read; extra columns with any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, share

#: Keys of one chunk, entries of one block of counts, tokens that a task gathers before it counts, buckets at most.
CHUNK, BLOCK, GATHER, MAX_BUCKETS = 1 << 20, 1 << 16, 1 << 19, 1 << 28
#: Tokens of one stored row, so that a batch of ten thousand rows is small too.
ROW = 256
SLICE = 2 << 20
FAN = 32
COUNTS = "block long, slots binary, counts binary"
KEYS = "block long, keys binary, suffixes binary"


def byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Each byte in lower case, and its class: 0 in a word, 1 between words, 2 between pieces."""
    low, kind = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    kind[[0x20, 0x09]] = 1
    kind[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
    return low, kind


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, and for each word whether a piece begins with it."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or bounds[0] == bounds[-1]:
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    low, kind = byte_classes()
    kinds = kind[raw]
    inside = kinds == 0
    first = np.zeros(len(raw) + 1, bool)
    first[bounds[:-1] - bounds[0]] = True
    first = first[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    breaks = np.cumsum((kinds == 2) | first, dtype=np.int64)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = breaks[1:] != breaks[:-1]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[raw[inside]])), new


def by_language(batches) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) with at most SLICE bytes of texts, or one text."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by("lang").combine_chunks()
        if not len(table):
            continue
        langs, texts = table.column("lang").chunk(0), table.column("text").chunk(0)
        codes = pc.dictionary_encode(langs).indices.to_numpy()
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        start, total = 0, 0
        for i in range(len(codes)):
            if i > start and (codes[i] != codes[start] or total + sizes[i] > SLICE):
                yield langs[start].as_py(), texts.slice(start, i - start)
                start, total = i, 0
            total += sizes[i]
        yield langs[start].as_py(), texts.slice(start)


def mix(keys: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a multiplicative hash, over uint64."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash over distinct int64 keys, which it stores by slot.

    Each round hashes the keys that are left into twice as many bits; bits that one key alone has stay set. A key's
    slot is the number of set bits before its own, over all rounds.
    """

    def __init__(self, keys: np.ndarray):
        self.rounds: list[tuple[int, int]] = []  # size and first bit of each round
        left, seed, bits = np.unique(keys.astype(np.int64)), 0, []
        at = 0
        while len(left):
            size = max(64, 2 * len(left))
            place = self._place(left, seed, size)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(alone)
            self.rounds.append((size, at))
            at, left, seed = at + size, left[~alone[place]], seed + 1
        flat = np.concatenate([*bits, np.zeros(-at % 64, bool)]) if bits else np.zeros(64, bool)
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.zeros(int(self.before[-1]), np.int64)
        all_keys = np.unique(keys.astype(np.int64))
        self.keys[self._slots(all_keys)] = all_keys

    @staticmethod
    def _place(keys: np.ndarray, seed: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (size, first) in enumerate(self.rounds):
            place = first + self._place(keys[left], seed, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[place[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        keys = np.ascontiguousarray(keys, np.int64)
        found = self._slots(keys)
        at = np.flatnonzero(found >= 0)
        found[at[self.keys[found[at]] != keys[at]]] = -1
        return found


def numbered(keys: np.ndarray, chunks: list, spread: np.ndarray) -> np.ndarray:
    """The number of each key in its chunk's table, -1 without one; chunks are getters of (hash, numbers by slot)."""
    out = np.full(len(keys), -1, np.int64)
    for c, chunk in enumerate(chunks):
        mine = np.flatnonzero(spread % len(chunks) == c) if len(chunks) > 1 else slice(None)
        hashed, numbers = chunk()
        if len(numbers):
            slots = hashed.slots(keys[mine])
            out[mine] = np.where(slots >= 0, numbers[slots], -1)
    return out


def spread_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(40)).astype(np.int64)


def partial_counts(values: np.ndarray) -> Iterator[dict]:
    """One row for each block of values that occurs: the slots in it and how often each."""
    values = np.sort(values)
    blocks = values >> 16
    cuts = np.flatnonzero(np.diff(blocks)) + 1
    for part in np.split(values, cuts) if len(values) else []:
        counts = np.bincount(part & (BLOCK - 1), minlength=BLOCK)
        slots = np.flatnonzero(counts)
        yield {"block": int(part[0] >> 16), "slots": slots.astype(np.uint16).tobytes(), "counts": counts[slots].astype(np.int64).tobytes()}


def tree(parts: DataFrame, merge, schema: str) -> DataFrame:
    """One row per block, merged from its rows: first within FAN fans of each block, then over the fans."""
    fans = parts.withColumn("fan", F.pmod(F.xxhash64(*parts.columns), F.lit(FAN)))
    return fans.groupBy("block", "fan").applyInPandas(merge, schema).groupBy("block").applyInPandas(merge, schema)


def tree_sum(parts: DataFrame) -> DataFrame:
    """The arrays of each block added up."""

    def add(key, frame):
        total = np.zeros(BLOCK, np.int64)
        for slots, counts in zip(frame["slots"], frame["counts"], strict=True):
            total[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.int64)
        slots = np.flatnonzero(total)
        return pd.DataFrame({"block": [key[0]], "slots": [slots.astype(np.uint16).tobytes()], "counts": [total[slots].tobytes()]})

    return tree(parts, add, COUNTS)


def tree_union(parts: DataFrame) -> DataFrame:
    """The distinct keys of each block, each with its suffix."""

    def unite(key, frame):
        keys, first = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in frame["keys"]]), return_index=True)
        suffixes = np.concatenate([np.frombuffer(x, np.int64) for x in frame["suffixes"]])[first]
        return pd.DataFrame({"block": [key[0]], "keys": [keys.tobytes()], "suffixes": [suffixes.tobytes()]})

    return tree(parts, unite, KEYS)


def level_keys(numbers: np.ndarray, words: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the phrases of m words whose first and last m - 1 words are numbered."""
    if len(numbers) < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    return at, numbers[at].astype(np.int64) << 32 | words[at + m - 1].astype(np.int64)


def compact(numbers: np.ndarray, words: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the tokens of numbered phrases of m words, a break between the runs."""
    covered = np.zeros(len(numbers) + m, bool)
    for k in range(m):
        covered[k : k + len(numbers)] |= numbers >= 0
    covered = covered[: len(numbers)]
    keep = covered.copy()
    keep[1:] |= covered[:-1]
    words = np.where(covered, words, -1)
    return numbers[keep], words[keep]


def token_rows(pieces: Iterator[tuple[np.ndarray, np.ndarray]], m: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 with the tokens (numbers of phrases of m words, words), rows of kind 1 with the bucket counts of m + 1 words."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])
    gathered, held, out = [], 0, []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal gathered, held, out
        numbers, words = (np.concatenate(x).astype(np.int32) for x in zip(*out, strict=True))
        # rows end at breaks, which no phrase crosses
        ends = np.flatnonzero(words < 0) + 1
        cuts = np.unique(np.append(ends[np.searchsorted(ends, np.arange(ROW, len(numbers), ROW))], len(numbers)))
        offsets = pa.py_buffer((np.append(0, cuts) * 4).astype(np.int32))
        columns = [pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(x)]) for x in (numbers, words)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cuts), np.int32)), pa.array(np.zeros(len(cuts), np.int64)), *columns], schema=schema)
        hashed = (mix(np.concatenate(gathered)) % np.uint64(buckets)).astype(np.int64)
        for row in partial_counts(hashed):
            yield pa.RecordBatch.from_pylist([{"kind": 1, **row}], schema)
        gathered, held, out = [], 0, []

    for numbers, words in pieces:
        numbers, words = compact(numbers, words, m)
        if not len(numbers):
            continue
        out.append((np.append(numbers, -1), np.append(words, -1)))
        gathered.append(level_keys(numbers, words, m + 1)[1])
        held += len(numbers)
        if held >= GATHER:
            yield from flush()
    if out:
        yield from flush()


def opened(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, words) of stored rows of tokens, some thousand rows at once: they end at breaks, so they can stand in one array."""
    for batch in batches:
        for at in range(0, batch.num_rows, GATHER // ROW):
            part = batch.slice(at, GATHER // ROW)
            yield tuple(_joined(part.column(i)) for i in (0, 1))


def _joined(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.int32)


def _chunks(table: DataFrame, size: int, build) -> list:
    """Getters of the built chunks of a table with a column spread; the driver holds the rows of one chunk at a time."""
    n, first, out = max(1, -(-table.count() // size)), 0, []
    for c in range(n):
        rows = table.where(F.col("spread") % n == c).toArrow()
        out.append(share(table.sparkSession, build(rows, first)))
        first += len(rows)
    return out


def _hashed(rows: pa.Table, first: int) -> tuple[PerfectHash, np.ndarray]:
    """A chunk of phrases: with numbers of their own, or else numbered by slot."""
    keys = rows.column("key").to_numpy()
    hashed = PerfectHash(keys)
    numbers = first + np.arange(len(keys), dtype=np.int64)
    if "number" in rows.column_names:
        numbers[hashed.slots(keys)] = rows.column("number").to_numpy()
    return hashed, numbers


def _word_keys(langs, phrases) -> pa.Array:
    """Language and word in one string; no word holds a line end."""
    joined = pc.binary_join_element_wise(langs.cast(pa.large_string()), phrases.cast(pa.large_string()), pa.scalar("\n", pa.large_string()))
    return joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined


def _vocabulary(rows: pa.Table, first: int) -> tuple[pa.Array, int]:
    """A chunk of words: their keys in order, and the number of the first."""
    return pa.array(sorted(_word_keys(rows.column("lang"), rows.column("phrase")).to_pylist()), pa.large_string()), first


def word_numbers(keys: pa.Array, chunks: list) -> np.ndarray:
    out = np.full(len(keys), -1, np.int64)
    for chunk in chunks:
        words, first = chunk()
        at = pc.index_in(keys, value_set=words).fill_null(-1).to_numpy()
        out = np.where(at >= 0, first + at, out)
    return out


def _counted_words(rows: DataFrame) -> DataFrame:
    def count(batches):
        for lang, texts in by_language(batches):
            coded = tokens(texts)[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), coded.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return rows.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_tokens(rows: DataFrame, chunks: list, buckets: int) -> DataFrame:
    def read(batches):
        for lang, texts in by_language(batches):
            words, new = tokens(texts)
            coded = words.dictionary_encode()
            numbers = word_numbers(_word_keys(pa.array([lang] * len(coded.dictionary), pa.string()), coded.dictionary), chunks)[coded.indices.to_numpy()]
            out = np.full(len(words) + int(new.sum()), -1, np.int64)  # a break before each piece
            out[np.arange(len(words)) + np.cumsum(new)] = numbers
            yield out, out

    return rows.mapInArrow(lambda batches: token_rows(read(batches), 1, buckets), "kind int, " + COUNTS)


def _next_tokens(table: DataFrame, chunks: list, m: int, buckets: int) -> DataFrame:
    def read(batches):
        for numbers, words in opened(batches):
            at, keys = level_keys(numbers, words, m)
            out = np.full(len(numbers), -1, np.int64)
            out[at] = numbered(keys, chunks, spread_of(keys))
            yield out, words

    return table.mapInArrow(lambda batches: token_rows(read(batches), m, buckets), "kind int, " + COUNTS)


def _bitmap(counts: DataFrame, min_count: int, buckets: int) -> np.ndarray:
    """Packed bits of the buckets that reach the threshold."""

    def pack(batches):
        for frame in batches:
            frame["bits"] = [np.packbits(np.bincount(np.frombuffer(s, np.uint16)[np.frombuffer(c, np.int64) >= min_count], minlength=BLOCK) > 0, bitorder="little").tobytes() for s, c in zip(frame["slots"], frame["counts"], strict=True)]
            yield frame[["block", "bits"]]

    out = np.zeros(buckets // 8, np.uint8)
    for row in tree_sum(counts).mapInPandas(pack, "block long, bits binary").toLocalIterator():
        out[row["block"] * BLOCK // 8 :][: BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _candidates(table: DataFrame, bitmap: np.ndarray, m: int, buckets: int) -> DataFrame:
    """key, suffix (number of the last m - 1 words), spread of each phrase that can be frequent."""
    passing = share(table.sparkSession, bitmap)

    blocks = max(8, buckets >> 18)
    schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("suffixes", pa.binary())])

    def find(batches):
        for numbers, words in opened(batches):
            at, keys = level_keys(numbers, words, m)
            bucket = mix(keys) % np.uint64(buckets)
            able = (passing()[(bucket >> np.uint64(3)).astype(np.int64)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1 == 1
            keys, first = np.unique(keys[able], return_index=True)
            suffixes, block = numbers[at[able][first] + 1].astype(np.int64), spread_of(keys) % blocks
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows = [{"block": int(block[part[0]]), "keys": keys[part].tobytes(), "suffixes": suffixes[part].tobytes()} for part in np.split(order, cuts[1:]) if len(part)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    def unfold(batches):
        for batch in batches:
            for keys, suffixes in zip(batch.column(1), batch.column(2), strict=True):
                keys = np.frombuffer(keys.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.frombuffer(suffixes.as_buffer(), np.int64)), pa.array(spread_of(keys))], ["key", "suffix", "spread"])

    return tree_union(table.mapInArrow(find, KEYS)).mapInArrow(unfold, "key long, suffix long, spread long")


def _slot_counts(table: DataFrame, chunks: list, m: int) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        for numbers, words in opened(batches):
            keys = level_keys(numbers, words, m)[1]
            found = numbered(keys, chunks, spread_of(keys))
            for row in partial_counts(found[found >= 0]):
                yield pa.RecordBatch.from_pylist([row], schema)

    return table.mapInArrow(count, COUNTS)


def _frequent(candidates: DataFrame, counts: DataFrame, chunks: list, min_count: int) -> DataFrame:
    """number, key, suffix, spread, n of the candidates whose slot reaches the threshold."""

    def unfold(batches):
        for batch in batches:
            for block, slots, n in zip(*batch.columns, strict=True):
                n = np.frombuffer(n.as_buffer(), np.int64)
                at = np.frombuffer(slots.as_buffer(), np.uint16)[n >= min_count].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((block.as_py() << 16) + at), pa.array(n[n >= min_count])], ["number", "n"])

    def number(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(numbered(keys, chunks, spread_of(keys))), *batch.columns], ["number", "key", "suffix", "spread"])

    found = counts.mapInArrow(unfold, "number long, n long")
    return candidates.select("key", "suffix", "spread").mapInArrow(number, "number long, key long, suffix long, spread long").join(found, "number")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, max_words: int = 5, chunk: int = CHUNK, max_buckets: int = MAX_BUCKETS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, total) and one table for each length: number, lang, phrase, last, n, prefix, suffix, firsts, rests.

    prefix and suffix are the numbers of the phrase without its last and its first word in the table before; firsts
    and rests hold the counts of the parts when it is cut after 1, 2, ... words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = scratch.save(_counted_words(rows), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    n_words = counted.agg(F.sum("n")).first()[0] or 0
    buckets = min(max_buckets, max(BLOCK, 1 << int(n_words // 16).bit_length()))
    words = scratch.save(counted.where(F.col("n") >= min_count).withColumn("spread", F.pmod(F.xxhash64("lang", "phrase"), F.lit(1 << 20))), "vocabulary")
    chunks = _chunks(words, chunk, _vocabulary)

    def number(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_numbers(_word_keys(b.column(0), b.column(1)), chunks)), *b.columns], ["number", "lang", "phrase", "n"])

    none = F.array().cast("array<bigint>")
    first = words.select("lang", "phrase", "n").mapInArrow(number, "number long, lang string, phrase string, n long")
    levels = [scratch.save(first.select("number", "lang", "phrase", F.col("phrase").alias("last"), "n", F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"), none.alias("firsts"), none.alias("rests")), "level1")]
    made = scratch.save(_word_tokens(rows, chunks, buckets), "tokens1")
    for m in range(2, max_words + 1):
        table = made.where("kind = 0").select("slots", "counts")
        bitmap = _bitmap(made.where("kind = 1").drop("kind"), min_count, buckets)
        candidates = scratch.save(_candidates(table, bitmap, m, buckets), f"candidates{m}")
        chunks = _chunks(candidates, chunk, _hashed)
        found = scratch.save(_frequent(candidates, tree_sum(_slot_counts(table, chunks, m)), chunks, min_count), f"frequent{m}")
        part = lambda side: levels[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in ("number", "lang", "phrase", "last", "n", "firsts", "rests")])  # noqa: B023, E731
        joined = found.withColumn("prefix", F.shiftright("key", 32)).join(part("p"), F.col("prefix") == F.col("p_number")).join(part("s"), F.col("suffix") == F.col("s_number"))
        level = joined.select(
            "number",
            F.col("p_lang").alias("lang"),
            F.concat("p_phrase", F.lit(" "), "s_last").alias("phrase"),
            F.col("s_last").alias("last"),
            *["n", "prefix", "suffix"],
            F.concat("p_firsts", F.array("p_n")).alias("firsts"),
            F.concat(F.array("s_n"), "s_rests").alias("rests"),
        )
        levels.append(scratch.save(level, f"level{m}"))
        if m < max_words:
            made = scratch.save(_next_tokens(table, _chunks(found, chunk, _hashed), m, buckets), f"tokens{m}")
    return totals, levels


def collocations(docs: DataFrame, top: int = 2000, inside_percent: int = 100, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language (see frequent_phrases for the options).

    a, l, r are the counts of the phrase and of the parts of its weakest cut, n the words of the language, score is
    floor(1000 * a * n / (l * r)). A phrase inside a longer one with inside_percent of its count is left out: between
    the two every length has a phrase that is as frequent as the longer one, so one word more decides.
    """
    totals, levels = frequent_phrases(docs, **options)
    parts = []
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            around = longer.select(F.explode(F.array("prefix", "suffix")).alias("of"), F.col("n").alias("longer")).groupBy("of").agg(F.max("longer").alias("longer"))
            level = level.join(around, F.col("number") == F.col("of"), "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("n")))
        parts.append(level.select("lang", "phrase", F.col("n").alias("a"), "firsts", "rests"))
    phrases = parts[0]
    for part in parts[1:]:
        phrases = phrases.unionByName(part)
    phrases = phrases.join(totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    cut = F.expr(f"array_min(transform(firsts, (l, i) -> named_struct('score', ({wide('1000 * a')} * {wide('total')}) div ({wide('l')} * {wide('rests[i]')}), 'k', i, 'l', l, 'r', rests[i])))")
    scored = phrases.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within 64 parts of a language, so that no task ranks all phrases of a frequent one
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, piece AS t FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT lang, piece, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT lang, piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces)
), runs AS (
  SELECT lang, [w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p] AS r FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)
), grams AS MATERIALIZED (
  SELECT lang, m, array_to_string(r[1:m], ' ') AS phrase, count(*) AS f FROM runs, range(1, 6) x(m) WHERE r[m] IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM grams WHERE m = 1 GROUP BY lang
), frequent AS MATERIALIZED (
  SELECT * FROM grams WHERE f >= 100
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM frequent WHERE m > 1
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:m], ' ') AS q FROM candidates c, range(1, 5) x(k) WHERE k < c.m
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score, k
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = c.p AND l.m = c.k JOIN frequent r ON r.lang = c.lang AND r.phrase = c.q AND r.m = c.m - c.k JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM candidates o WHERE o.lang = s.lang AND o.m > s.m AND 100 * o.a >= 100 * s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
