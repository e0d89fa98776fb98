"""Variable-capacity best-fit packing of documents into training sequences.

Lengths (words plus one end token by default) longer than the largest permitted capacity are cut
into full pieces and a rest. Documents, ranked by id, form groups of group_rows that are packed
independently, so no task holds more than one group and results do not depend on the cluster.

Within a group pieces go from long to short into the open bin with the least room that still holds
them. If none does, a new bin of the permitted size with the least cost per token that it can
still expect is opened; a bin of capacity c costs c + c * c / attention_scale (projections grow with the
tokens, attention with their square). The sizes are optimised jointly: the group is packed once with
each permitted size as the largest that is opened without need, every bin is cut down to the
smallest permitted size that holds its contents, and the cheapest whole packing is kept.

Edge cases: null and empty texts are one end token. Repeated rows and equal ids are packed each for
themselves. Null ids come first. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, documents, shuffle_partitions, word_count

CAPACITIES = (512, 1024, 2048, 4096)
ATTENTION_SCALE = 8192


def bin_cost(capacity: int, scale: int = ATTENTION_SCALE) -> float:
    return capacity + capacity * capacity / scale


def _pack_with(pieces: list[int], capacities: tuple[int, ...], largest: int, scale: int) -> tuple[float, list[int], list[int]]:
    """Cost, each piece's bin and each bin's contents; pieces fall in length."""
    rooms: dict[int, list[int]] = {}  # free tokens -> open bins
    free = 0  # bit r is set if a bin has r tokens free
    fill: list[int] = []
    size: list[int] = []
    where: list[int] = []
    rest = sum(pieces)
    choice = {}
    for piece in pieces:
        found = free >> piece
        if found:
            room = piece + (found & -found).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                free ^= 1 << room
        else:
            if rest >= capacities[-1]:  # any size can still be filled: the answer depends on the piece only
                c = choice.get(piece)
                if c is None:
                    c = choice[piece] = min((c for c in capacities if c >= piece and (c <= largest or c == next(x for x in capacities if x >= piece))), key=lambda c: (bin_cost(c, scale) / c, c))
            else:
                c = min((c for c in capacities if c >= piece and (c <= largest or c == next(x for x in capacities if x >= piece))), key=lambda c: (bin_cost(c, scale) / min(c, rest), c))
            b, room = len(fill), c
            fill.append(0)
            size.append(c)
        where.append(b)
        fill[b] += piece
        room -= piece
        rest -= piece
        if room:
            rooms.setdefault(room, []).append(b)
            free |= 1 << room
    return sum(bin_cost(next(c for c in capacities if c >= n), scale) for n in fill), where, fill


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, scale: int = ATTENTION_SCALE) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start in it, tokens, bin, the bin's final capacity, place in the bin) for each piece."""
    top = capacities[-1]
    pieces = [(n, i, start) for i, whole in enumerate(lengths) for start in range(0, max(whole, 1), top) if (n := min(top, whole - start)) > 0]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    tokens = [p[0] for p in pieces]
    _, where, fill = min((_pack_with(tokens, capacities, c, scale) for c in capacities), key=lambda x: x[0])
    final = [next(c for c in capacities if c >= n) for n in fill]
    at = [0] * len(fill)
    out = []
    for (n, i, start), b in zip(pieces, where):
        out.append((i, start, n, b, final[b], at[b]))
        at[b] += n
    return out


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, scale: int = ATTENTION_SCALE, group_rows: int = 20_000, length: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece_start, tokens, pack_group, bin_id, capacity, bin_offset.

    length names a column with token counts; without it a text's words plus one end token count.
    """
    spark = docs.sparkSession
    capacities = tuple(sorted(capacities))
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(1)), F.lit(1)) if length else word_count(F.col(text)) + 1
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("tie"))
    scratch, order = Scratch(spark, "pack"), ["doc_id", "n", "tie"]
    # written once: range partitioning reads its input twice, and texts are to be read once only
    ranged = scratch.save(narrow, "narrow").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # partition and place in it
    placed = scratch.save(ranged.select("doc_id", "n", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("local")), "ranked")
    scratch.drop("narrow")
    # one row per partition
    before = placed.groupBy("part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = placed.join(F.broadcast(before), "part").select("doc_id", "n", (F.col("before") + F.col("local")).alias("rank"))
    grouped = ranked.withColumn("pack_group", F.floor(F.col("rank") / group_rows))

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("rank")
        group = rows["pack_group"][0].as_py()
        i, start, tokens, bins, capacity, offset = zip(*pack_lengths(rows["n"].to_pylist(), capacities, scale))
        return pa.table(
            {
                "doc_id": rows["doc_id"].take(pa.array(i, pa.int64())),  # stays Arrow: null ids do not turn the others into floats
                "piece_start": pa.array(start, pa.int64()),
                "tokens": pa.array(tokens, pa.int32()),
                "pack_group": pa.array([group] * len(i), pa.int64()),
                "bin_id": pa.array([group * (1 << 32) + b for b in bins], pa.int64()),
                "capacity": pa.array(capacity, pa.int32()),
                "bin_offset": pa.array(offset, pa.int32()),
            }
        )

    return grouped.groupBy("pack_group").applyInArrow(run, "doc_id long, piece_start long, tokens int, pack_group long, bin_id long, capacity int, bin_offset int")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
