"""Filling containers of fixed capacity (problem 9): best-two-fit over a histogram of sizes.

How well items fit depends on their sizes only, so the plan is made on the number
of items per size: at most ``capacity`` numbers, whatever the corpus. A container
is filled greedily with the largest sizes that still fit; then its smallest item
gives way to the two unpacked items that fill the widened gap most tightly, if
they fill it better. The pattern is repeated as often as all its sizes last, so
the plan has few patterns. Items then find their container by their rank among the
items of their size, which is made of per-bucket counts and ranks inside buckets,
so no task ever sees all items of a frequent size.

Defined cases: an item over the capacity is cut into full pieces and one rest, and
only such an item is cut; an item of size zero takes no space and goes to a
container by the hash of its key (to container 0 when there is none); null sizes
count as zero; repeated keys are separate items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadframe.llm.tokenize import TOKENIZER_DIR, count_tokens
from roadframe.session import materialize

CAPACITY = 2048
#: Items per rank bucket that are aimed at.
BUCKET_ITEMS = 100_000


def _largest(free: int, limit: int) -> int:
    """Largest size with unpacked items not above ``limit`` (0 if none); ``free`` has one bit per size."""
    return (free & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and free & ((1 << (limit + 1)) - 1) else 0


def _take(counts: list[int], free: int, size: int) -> int:
    counts[size] -= 1
    return free & ~(1 << size) if counts[size] == 0 else free


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, {size: items})``: containers that together hold every item of sizes 1 to ``capacity``."""
    counts = [0] * (capacity + 1)
    for size, number in histogram.items():
        counts[size] = number
    free = sum(1 << s for s in range(1, capacity + 1) if counts[s])
    plan: list[tuple[int, dict[int, int]]] = []
    while free:
        now, left, gap, items = counts.copy(), free, capacity, []
        while (size := _largest(left, gap)):
            items.append(size)
            left = _take(now, left, size)
            gap -= size
        if gap and len(items) > 1:
            pair = _best_two(now, left, gap + items[-1])
            if pair and sum(pair) > items[-1]:
                out = items.pop()
                now[out] += 1
                for size in pair:
                    now[size] -= 1
                items += pair
        pattern: dict[int, int] = {}
        for size in items:
            pattern[size] = pattern.get(size, 0) + 1
        repeats = min(counts[s] // k for s, k in pattern.items())
        for size, k in pattern.items():
            counts[size] -= repeats * k
            if not counts[size]:
                free &= ~(1 << size)
        plan.append((repeats, pattern))
    return plan


def _best_two(counts: list[int], free: int, gap: int) -> list[int] | None:
    """The two unpacked items with the largest sum within ``gap``."""
    best: list[int] | None = None
    first = _largest(free, gap - 1)
    while first and (best is None or 2 * first > sum(best)):
        rest = free if counts[first] > 1 else free & ~(1 << first)
        second = _largest(rest, min(gap - first, first))
        if second and (best is None or first + second > sum(best)):
            best = [first, second]
            if first + second == gap:
                break
        first = _largest(free, first - 1)
    return best


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``(key, piece, start, size)``: items over the capacity cut; pieces count from 0."""
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint")
    last = F.floor(F.greatest(F.col("_n") - 1, F.lit(0)) / capacity)
    cut = items.select(F.col(key), n.alias("_n")).select(key, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    return cut.select(key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"),
                      F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, start, size, container_id)`` of every item."""
    cut = pieces(items, key, size, capacity)
    cut = materialize(cut, "pieces")
    total = cut.count()
    buckets = max(16, total // BUCKET_ITEMS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    tally = materialize(cut.where("size > 0").groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("c")), "tally")
    histogram = {r["size"]: r["c"] for r in tally.groupBy("size").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows

    plan = plan_patterns(histogram, capacity)
    base, used = 0, dict.fromkeys(histogram, 0)
    spans: list[tuple[int, int, int, int]] = []  # size, first rank, items per container, first container
    for repeats, pattern in plan:
        for s, k in pattern.items():
            spans.append((s, used[s], k, base))
            used[s] += repeats * k
        base += repeats
    containers = base
    spans.sort()
    table = np.array(spans, np.int64).reshape(-1, 4)
    shared = items.sparkSession.sparkContext.broadcast(table)  # patterns x sizes in them: bounded by the capacity, not the corpus

    offset = F.sum("c").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tally.select("size", "bucket", F.coalesce(offset, F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(key, "piece")) - 1
    ranked = cut.where("size > 0").withColumn("_r", local).join(offsets, ["size", "bucket"]).select(
        key, "piece", "start", "size", (F.col("_r") + F.col("offset")).alias("rank"))
    stop = 1 << 40  # size and rank in one sortable number

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = shared.value
        firsts = spans[:, 0] * stop + spans[:, 1]
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "rank"))
            at = np.searchsorted(firsts, sizes * stop + ranks, side="right") - 1
            where = spans[at, 3] + (ranks - spans[at, 1]) // spans[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "piece", "start", "size")), pa.array(where)],
                                             names=[key, "piece", "start", "size", "container_id"])

    kind = items.schema[key].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"{key} {kind}, piece int, start bigint, size int, container_id bigint")
    nothing = cut.where("size = 0").select(key, "piece", "start", "size", F.pmod(F.xxhash64(key), F.lit(max(containers, 1))).alias("container_id"))
    return placed.unionByName(nothing)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, directory: str = TOKENIZER_DIR) -> DataFrame:
    """Documents, sized in tokens, put into containers."""
    return pack(count_tokens(documents, directory=directory), "doc_id", "n_tokens", capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, pieces, tokens, and the share of the space that is filled."""
    per = packed.groupBy("container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"),
                   F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"))
