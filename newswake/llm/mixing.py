"""Mixing sources to target weights by Pfair scheduling.

A source's documents are numbered and cut into blocks of `block` documents. With weight w, a share
of one, block j (from 0) of a source is released at slot floor(j / w) and due by slot
ceil((j + 1) / w): one block every 1/w slots. Earliest deadline first over the released blocks
meets all deadlines, because the weights sum to one; so after any number of slots each source that
has not run out is less than one block away from its target. Weights are taken as they are, as
whole numbers of any size, so the bound does not depend on the number of slots.

The schedule has one entry a block. It is computed in one pass that holds one block a source, by a
task that hands its entries on as it goes: 1/64 of the number of documents.

A source that has run out leaves slots empty, and the others keep their proportions. All documents are kept, each once; a document's place is its slot, then its rank in
the block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newswake.llm.ranks import numbered
from newswake.llm.tables import rows, stored, unpacked

BLOCK = 64
PERIOD = 1000
BROADCAST_SLOTS = 100_000
POWER = 0.5
RESULTS = ["mix_block", "mix_slot", "mix_rank"]


def shares(weights: dict, period: int = PERIOD) -> tuple[dict, int]:
    """Whole shares of a period for weights of any scale, by largest remainders. Every source with
    a positive weight has one share at least; the period grows to hold them."""
    given = {s: float(w) for s, w in weights.items() if w and w > 0}
    if not given:
        return {}, 0
    period = max(period, 2 * len(given))
    total = sum(given.values())
    exact = {s: w / total * period for s, w in given.items()}
    whole = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(given, key=lambda s: (whole[s] - exact[s], str(s)))
    for s in order[:max(0, period - sum(whole.values()))]:
        whole[s] += 1
    return whole, sum(whole.values())


def schedule(whole: dict, period: int) -> list[tuple]:
    """(source, turn, slot) of one period, earliest deadline first among the released blocks."""
    release: dict[int, list] = {}
    for s, k in whole.items():
        for j in range(k):
            release.setdefault(j * period // k, []).append((-(-(j + 1) * period // k), str(s), s, j))
    ready: list = []
    out = []
    for slot in range(period):
        for item in release.get(slot, ()):
            heapq.heappush(ready, item[:2] + (item[3], item[2]))
        deadline, _, j, s = heapq.heappop(ready)
        assert slot < deadline, "a block missed its deadline"
        out.append((s, j, slot))
    return out


def exact_shares(weights: dict) -> tuple[dict, int]:
    """The positive weights as whole numbers, without rounding, and their sum."""
    given = {s: Fraction(w) for s, w in weights.items() if w and w > 0}
    common = math.lcm(*[w.denominator for w in given.values()])
    whole = {s: int(w * common) for s, w in given.items()}
    least = math.gcd(*whole.values()) or 1
    whole = {s: w // least for s, w in whole.items()}
    return whole, sum(whole.values())


def turns(whole: dict, period: int, blocks: dict) -> Iterator[tuple]:
    """(source, block, slot) of all blocks, earliest deadline first among the released ones; one
    block a source is held. Slots in which no block is released stay empty."""
    coming = [(0, str(s), s, 0) for s in whole if blocks.get(s)]
    heapq.heapify(coming)
    ready: list = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            _, name, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * period // whole[s]), name, j, s))
        deadline, name, j, s = heapq.heappop(ready)
        assert slot < deadline, "a block missed its deadline"
        yield s, j, slot
        if j + 1 < blocks[s]:
            heapq.heappush(coming, ((j + 1) * period // whole[s], name, s, j + 1))
        slot += 1


def places(spark, whole: dict, period: int, blocks: dict) -> DataFrame:
    """source, mix_block, mix_slot of all blocks."""
    def run(batches):
        for _ in batches:
            held = []
            for turn in turns(whole, period, blocks):
                held.append(turn)
                if len(held) == BROADCAST_SLOTS:
                    yield pd.DataFrame(held, columns=["source", "mix_block", "mix_slot"])
                    held = []
            yield pd.DataFrame(held, columns=["source", "mix_block", "mix_slot"]).astype(
                {"source": object, "mix_block": "int64", "mix_slot": "int64"})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "source string, mix_block long, mix_slot long")


def target_weights(docs: DataFrame, source: str = "source", power: float = POWER) -> dict:
    """Weights of all sources: their number of documents to a power below 1, which lifts the small
    ones. One row a source goes to the driver."""
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).count()
    return {r["s"]: r["count"] ** power for r in sizes.collect()}


def mix(docs: DataFrame, source: str = "source", weights: dict | None = None, block: int = BLOCK,
        period: int | None = None) -> DataFrame:
    """Every row with mix_block (of its source), mix_slot and mix_rank (in the block).

    Order by mix_slot, mix_rank for the mixed stream. A null source counts as "". A source that
    `weights` lacks, or gives nothing, has no target and no slot: it gets the share of the lightest
    one. Weights are exact; only a given `period` rounds them to whole shares of so many slots. Within a source the order is that of a hash of the row, so a block is not one site's or
    day's; repeated rows get places of their own. An empty table gives an empty result. Given
    columns named as the results are replaced.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    narrow = stored(rows(docs, source=name, spread=F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]),
                         at=F.monotonically_increasing_id()))
    found = target_weights(narrow, power=POWER)
    if weights is not None:
        least = min([w for w in weights.values() if w and w > 0], default=1.0)
        found = {s: weights.get(s) or least for s in found}
    whole, period = exact_shares(found) if period is None else shares(found, period)
    order = numbered(narrow.select("source", "spread", "at"), F.col("source"), F.col("spread"), F.col("at"))
    sizes = order.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    blocks = {r["source"]: -(-r["n"] // block) for r in sizes.select("source", "n").collect()}
    slots = stored(places(spark, whole, period, blocks))
    # one row a source, and one a block: tables of checked size are broadcast, larger ones are not
    few = F.broadcast if len(blocks) <= BROADCAST_SLOTS else (lambda table: table)
    small = F.broadcast if sum(blocks.values()) <= BROADCAST_SLOTS else (lambda table: table)
    begun = order.join(few(sizes.select("source", "first")), "source")
    inside = F.col("rank") - F.col("first")
    placed = begun.select("at", "source", (inside % block).alias("mix_rank"), F.floor(inside / block).alias("mix_block")).join(
        small(slots), ["source", "mix_block"]).select("at", "mix_block", "mix_slot", "mix_rank")
    return unpacked(narrow.join(placed, "at"), RESULTS)


def mixed_order(docs: DataFrame, source: str = "source", weights: dict | None = None,
                block: int = BLOCK) -> DataFrame:
    """The rows with their own columns, range-partitioned and sorted into the mixed stream."""
    packed = mix(rows(docs, **{source: F.col(source)}), source, weights, block)
    return (packed.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank")
            .select("row.*"))
