"""Best-fit packing of pieces into sequences, in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so the pieces, range-sorted by length, are runs: one
run a length, with the ranks of its pieces. Sequences with the same gap are runs as well. A round
sweeps the length runs and gap runs in ascending order: each gap takes the longest open piece that
fits it (its predecessor; seen from the pieces, they get their smallest free successor). Where more
pieces ask for a gap than there are sequences, the ranks decide: the first ones win, the others
stay for wider gaps. All sequences of all gaps are served at once, one piece each; then the gaps
are updated and the next round begins. When no piece fits a gap, as many sequences as the rest
needs at least are opened for its longest pieces.

Rows are handled by Spark only: pieces are range-sorted and numbered (`ranks.numbered`), and each
looks up its place in the runs matched, in blocks of ranks. The driver sees runs: at most one count
a length, and their matches, whatever the number of pieces.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newswake.llm.ranks import numbered
from newswake.llm.tables import stored
from newswake.llm.tokens import groups, rank_encoder, vocabulary

CAPACITY = 2048
END = 0
BLOCK = 1 << 16


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n tokens: whole ones, after a first one that may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, s + capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None,
           capacity: int = CAPACITY, place: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document, and
    its whole number `place` if that is named.

    Ids are those of the byte-level BPE without special tokens around them, then one END; a special
    string inside a text is its one id. A null text counts as empty and gives one piece of END."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    key_type = docs.schema[doc_id].dataType.simpleString()

    def encode(batches):
        encoder = rank_encoder(path)
        for batch in batches:
            at = 0
            for group in groups(batch["text"].tolist(), 1 << 21):
                out, places = [], []
                for i, (key, t) in enumerate(zip(batch["doc_id"].iloc[at:at + len(group)], group), at):
                    ids = np.append(encoder.encode_to_numpy(t, allowed_special="all"), END).astype("<u4")
                    out += [(key, i, s, e - s, ids[s:e].tobytes())
                            for i, (s, e) in enumerate(cut_points(len(ids), capacity))]
                    if place is not None:
                        places += [batch["place"].iloc[i]] * (len(out) - len(places))
                at += len(group)
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])
                frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64") if key_type in (
                    "bigint", "int", "smallint", "tinyint") else frame["doc_id"]
                yield frame if place is None else frame.assign(place=pd.array(places, dtype="Int64"))

    given = docs.select(F.col(doc_id).alias("doc_id"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                        *([F.col(place).cast("long").alias("place")] if place else []))
    found = given.mapInPandas(encode, f"doc_id {key_type}, piece int, start long, length long, ids binary"
                              + (", place long" if place else ""))
    return found.withColumnRenamed("place", place) if place else found


def sweep(items: list, gaps: list) -> tuple[list, list, list]:
    """One round over runs in ascending order: (matches, items left, gaps left).

    items: (length, first rank, end rank). gaps: (gap, first sequence, end sequence).
    matches: (first rank, end rank, first sequence, gap, length)."""
    matches, left_gaps, stack, i = [], [], [], 0
    for gap, first, end in gaps:
        while i < len(items) and items[i][0] <= gap:
            stack.append(items[i])
            i += 1
        while first < end and stack:
            length, lo, hi = stack.pop()
            k = min(hi - lo, end - first)
            matches.append((lo, lo + k, first, gap, length))
            first += k
            if lo + k < hi:
                stack.append((length, lo + k, hi))
        if first < end:
            left_gaps.append((gap, first, end))
    return matches, stack + items[i:], left_gaps


def plan(lengths: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs of pieces (length, first rank, end rank) to placed runs (first rank, end rank,
    first sequence, offset): rank r goes to first sequence + (r - first rank), at the offset."""
    items, gaps, placed, opened = sorted(lengths), [], [], 0
    while items:
        matches, items, gaps = sweep(items, gaps)
        if not matches:
            total = sum(s * (hi - lo) for s, lo, hi in items)
            fresh = -(-total // capacity)
            gaps.append((capacity, opened, opened + fresh))
            opened += fresh
            matches, items, gaps = sweep(items, gaps)
        for lo, hi, sequence, gap, length in matches:
            placed.append((lo, hi, sequence, capacity - gap))
            if gap > length:
                gaps.append((gap - length, sequence, sequence + hi - lo))
        gaps = merged(gaps)
        if items:  # gaps smaller than the shortest open piece stay as they are for good
            gaps = gaps[bisect_left(gaps, (items[0][0],)):]
    return placed


def merged(gaps: list) -> list:
    """In ascending order, neighbouring runs of sequences with the same gap as one."""
    out: list = []
    for g in sorted(gaps):
        if out and out[-1][0] == g[0] and out[-1][2] == g[1]:
            out[-1] = (g[0], out[-1][1], g[2])
        else:
            out.append(g)
    return out


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY,
         place: str | None = None) -> DataFrame:
    """Every row with sequence_id and offset: sequences of at most `capacity`, gapless from 0.

    Lengths must lie in 1..capacity. Equal rows get places of their own; the order among rows of
    equal length is arbitrary but fixed once stored. With a column `place` of whole numbers it decides
    among rows of equal length, and sequences are numbered by the least place in them. An empty table gives an empty result. Given
    columns named as the results are replaced.
    """
    own = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    spark = items.sparkSession
    # a unique last key, so that a length shared by many rows is spread over ranges
    spread = F.xxhash64(F.monotonically_increasing_id(), F.spark_partition_id())
    keyed = stored(items.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
                                F.col(length).cast("long").alias("length"), spread.alias("spread"),
                                *([F.col(place).cast("long").alias("place")] if place else [])))
    ordered = numbered(keyed, F.col("length"), *([F.col("place")] if place else []), F.col("spread"))
    runs, first = [], 0
    for r in ordered.groupBy("length").count().orderBy("length").collect():  # <= capacity rows
        if r["length"] is None or not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece has length {r['length']}; the capacity is {capacity}")
        runs.append((r["length"], first, first + r["count"]))
        first += r["count"]
    placed = sorted(plan(runs, capacity))
    lows = pd.DataFrame(placed, columns=["lo", "hi", "sequence", "at"]).astype("int64")
    blocks = lows.assign(block=[np.arange(lo // BLOCK, (hi - 1) // BLOCK + 1)
                                for lo, hi in zip(lows["lo"], lows["hi"])]).explode("block")
    table = spark.createDataFrame(blocks.astype("int64"),
                                  "lo long, hi long, sequence long, at long, block long")

    def look_up(rows: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        places = places.sort_values("lo")
        i = np.searchsorted(places["lo"].to_numpy(), rows["rank"].to_numpy(), "right") - 1
        lo = places["lo"].to_numpy()[i]
        return pd.DataFrame({"rank": rows["rank"].to_numpy(),
                             "sequence_id": places["sequence"].to_numpy()[i] + rows["rank"].to_numpy() - lo,
                             "offset": places["at"].to_numpy()[i]})

    narrow = ordered.select("rank", F.floor(F.col("rank") / BLOCK).alias("block"))
    found = narrow.groupBy("block").cogroup(table.groupBy("block")).applyInPandas(
        look_up, "rank long, sequence_id long, offset long")
    packed = ordered.join(found, "rank")
    if place:
        packed = stored(packed)
        begin = packed.groupBy("sequence_id").agg(F.min("place").alias("begin"))
        renamed = numbered(begin, F.col("begin"), F.col("sequence_id")).select(
            "sequence_id", F.col("rank").alias("renamed"))
        packed = packed.join(renamed, "sequence_id").withColumn("sequence_id", F.col("renamed"))
    return packed.select("row.*", "sequence_id", "offset")
