"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments of 22, 21 and 21. Of three errors in all, the two
segments with fewest have one at most each. So for some two segments both fingerprints are within
one bit: the nearest codeword of either one's segment is among the codewords around the other's.
For each two segments (S, T) a fingerprint is filed as `left` under (around S, nearest T) and as
`right` under (nearest S, around T), a dozen keys of 24 bits; any link then meets as left and right.
What meets is verified bit by bit, so keys cost time at most.

Equal fingerprints are one node, so copies never meet each other. A key with very many fingerprints
is dealt out over a grid of cells of at most CELL on either side, and a cell gives a spanning forest
of its links rather than all of them when it is large: the same components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from newswake.llm.components import components
from newswake.llm.golay import around, nearest
from newswake.llm.phrases import mixed
from newswake.llm.tables import rows, stored, text_of, unpacked

SEGMENTS = ((0, 22), (22, 21), (43, 21))
BITS = 3
SEED = 42
CELL = 4096
DENSE = 16  # from so many pairs on a cell gives a forest
RUN = 1 << 15
BANDS = 24
BAND_WIDTH = 5
PIVOTS = 8
LEVELS = 64
SKETCH = 1024  # bits


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # lowers A-Z only, splits at [\x20\x09-\x0D]
    if len(words) < shingle:
        cut = [words] if words else []
    else:
        cut = zip(*[words[i:] for i in range(shingle)])
    return np.array([xxh64_intdigest(b" ".join(s), SEED) for s in cut], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), RUN):
        ones += np.unpackbits(h[i:i + RUN].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(shingle: int):
    @F.pandas_udf("long")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([majority(shingle_hashes(t, shingle)) for t in texts], dtype="int64")
    return of_texts


def fingerprints(shingle: int, prints: int, once: bool = False):
    """Several fingerprints of a text, from independent mixtures of the hashes of its shingles; with
    `once` a shingle that is repeated counts once."""
    @F.pandas_udf("array<long>")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        odd = np.random.default_rng(SEED).integers(1, 1 << 62, prints, dtype=np.uint64) * np.uint64(2)
        for texts in batches:
            hashes = [different(t, shingle) if once else shingle_hashes(t, shingle) for t in texts]
            yield pd.Series([[majority(mixed(h ^ o)) for o in odd] for h in hashes])
    return of_texts


def filed(batches):
    """(no, fp) to (key, fp). The key ends in the side, 0 for left; fingerprints of one number only
    meet each other."""
    for batch in batches:
        no = batch["no"].to_numpy().astype(np.int64)
        fp = batch["fp"].to_numpy().view(np.uint64)
        parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
        near = [nearest(p).astype(np.int64) for p in parts]
        wide = [around(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
        for pair, (s, t) in enumerate(((0, 1), (0, 2), (1, 2))):
            for side, (row, index) in enumerate((wide[s], wide[t])):
                index = index.astype(np.int64)
                key = (index << 12 | near[t][row]) if side == 0 else (near[s][row] << 12 | index)
                key = key | pair << 24 | no[row] << 26
                yield pd.DataFrame({"key": key << 1 | side, "fp": batch["fp"].to_numpy()[row]})


def forest(left: np.ndarray, right: np.ndarray, most: int) -> tuple[list, list]:
    """A spanning forest of the links between left and right fingerprints, closest links first: at
    any number of bits up to `most` it has the components of all links of so many bits."""
    nodes = np.unique(np.concatenate([left, right]))
    label = np.arange(len(nodes))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    bits = np.empty((len(left), len(right)), np.uint8)
    for i in range(0, len(left), 256):
        bits[i:i + 256] = np.bitwise_count(left[i:i + 256, None] ^ right[None, :])
    a, b = [], []
    for distance in range(1, most + 1):
        if (label == label[0]).all():
            break
        for i in np.flatnonzero((bits == distance).any(1)):
            own = label[at_left[i]]
            near = at_right[bits[i] == distance]
            others, first = np.unique(label[near], return_index=True)
            fresh = others != own
            if fresh.any():
                a += [nodes[at_left[i]]] * int(fresh.sum())
                b += nodes[near[first[fresh]]].tolist()
                label[np.isin(label, others[fresh])] = own
    return a, b


def links_of(batches, most: int):
    """Rows (key, cell, fp), in the order of key without its side, cell, key, to links (no, a, b)."""
    held = None
    for batch in batches:
        now = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key, cell = now["key"].to_numpy() >> 1, now["cell"].to_numpy()
        new = np.ones(len(now), bool)
        new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        starts = np.flatnonzero(new)
        held = now.iloc[starts[-1]:]  # the last cell may go on: at most two sides of CELL
        yield from cells(now.iloc[:starts[-1]], starts[:-1], most)
    if held is not None:
        yield from cells(held, np.array([0]), most)


def cells(rows: pd.DataFrame, starts: np.ndarray, most: int):
    if not len(starts):
        return
    fp, key = rows["fp"].to_numpy().view(np.uint64), rows["key"].to_numpy()
    no = key >> 27
    ends = np.append(starts[1:], len(rows))
    rights = np.add.reduceat(key & 1, starts)
    lefts = ends - starts - rights
    middle = starts + lefts
    a, b, numbers = [], [], []
    pairs = lefts * rights
    for i in np.flatnonzero(pairs > DENSE):
        x, y = forest(fp[starts[i]:middle[i]], fp[middle[i]:ends[i]], most)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
        numbers.append(np.full(len(x), no[starts[i]]))
    small = np.flatnonzero((pairs > 0) & (pairs <= DENSE))
    step = max(1, (1 << 21) // DENSE)
    for s in range(0, len(small), step):
        g = small[s:s + step]
        cell = np.repeat(np.arange(len(g)), pairs[g])
        inside = np.arange(len(cell)) - np.repeat(np.cumsum(pairs[g]) - pairs[g], pairs[g])
        x = fp[starts[g][cell] + inside // rights[g][cell]]
        y = fp[middle[g][cell] + inside % rights[g][cell]]
        linked = (x != y) & (np.bitwise_count(x ^ y) <= most)
        a.append(x[linked])
        b.append(y[linked])
        numbers.append(no[starts[g][cell[linked]]])
    if a and sum(map(len, a)):
        x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pd.DataFrame({"no": np.concatenate(numbers), "a": np.minimum(x, y),
                            "b": np.maximum(x, y)}).drop_duplicates()


def links(fps: DataFrame, most: int = BITS) -> DataFrame:
    """Links (no, a, b), a < b, between different fingerprints (no, fp) of one number that differ in
    `most` bits or fewer: up to 3 enough of them to have the components of all, beyond that those
    that two segments with one error at most give away."""
    keyed = fps.mapInPandas(filed, "key long, fp long")
    pair = F.shiftright("key", 1)
    crowded = stored(keyed.groupBy(pair.alias("pair")).count().filter(F.col("count") > CELL)
                     .select("pair", F.ceil(F.col("count") / CELL).cast("int").alias("cells")))
    if crowded.isEmpty():
        dealt = keyed.withColumn("cell", F.lit(0).cast("long"))
    else:
        grid = keyed.withColumn("pair", pair).join(crowded, "pair", "left").withColumn(
            "cells", F.coalesce("cells", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("long")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
        left = F.col("key").bitwiseAND(1) == 0
        dealt = grid.select("key", "fp", own.alias("own"), other.alias("other")).withColumn(
            "cell", F.when(left, F.shiftleft("own", 20) + F.col("other"))
            .otherwise(F.shiftleft("other", 20) + F.col("own")))
    dealt = (dealt.select("key", "cell", "fp").repartition(pair, "cell")
             .sortWithinPartitions(pair, "cell", "key", "fp"))
    return dealt.mapInPandas(lambda b: links_of(b, most), "no long, a long, b long").distinct()


def groups(prints: DataFrame, most: int = BITS) -> DataFrame:
    """fp, component_id of (fp, id): the smallest id reachable over links, null ids aside."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("own")))
    one = nodes.select(F.lit(0).cast("long").alias("no"), "fp")
    root = components(links(one, most)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    shingle: int = 3, most: int = BITS) -> DataFrame:
    """Every row with fingerprint (16 hex digits) and component_id.

    Texts are lower-cased in A-Z, cut into words [^\\x20\\x09-\\x0D]+ and shingles of `shingle`
    words; a text with fewer is one shingle; a null text or one without words has fingerprint 0 and
    is linked like any other. Repeated rows share a component; a component of null ids only has a
    null id. An empty table gives an empty result. Given columns named as the results are replaced.
    """
    printed = stored(rows(docs, id=F.col(doc_id), text=text_of(text))
                     .select("row", "id", fingerprint(shingle)("text").alias("fp")))
    found = printed.join(groups(printed.select("fp", "id"), most), "fp").select(
        "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return unpacked(found, ["fingerprint", "component_id"])


def different(text: str, words: int) -> np.ndarray:
    """The hashes of the different shingles of a text, in ascending order."""
    return np.unique(shingle_hashes(text, words))


def shingle_set(words: int):
    @F.pandas_udf("array<long>")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([different(t, words).view(np.int64) for t in texts], dtype=object)
    return of_texts


def sketch(h: np.ndarray) -> np.ndarray:
    """For each of SKETCH parts of the hashes whether their number is odd, as bits of signed 64-bit
    numbers. Sketches differ in no more bits than their sets differ in hashes."""
    odd = np.bincount((mixed(h ^ np.uint64(SEED)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def band_keys(words: int, bands: int = BANDS, width: int = BAND_WIDTH):
    """How many different shingles a text has, a key for each band of their least hashes, and their sketch. Two texts
    of Jaccard similarity s share a band with probability s ** width."""
    @F.pandas_udf("size int, bands array<long>, sketch array<long>")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odd = np.random.default_rng(SEED).integers(1, 1 << 62, bands * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

        def keys(text):
            h, least = different(text, words), np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(h), RUN >> 3):
                least = np.minimum(least, np.multiply.outer(odd, h[i:i + (RUN >> 3)]).min(axis=1))
            key = np.arange(1, bands + 1, dtype=np.uint64)
            for column in least.reshape(bands, width).T:
                key = mixed(key ^ column)
            return len(h), key.view(np.int64), sketch(h)

        for texts in batches:
            yield pd.DataFrame([keys(t) for t in texts], columns=["size", "bands", "sketch"])
    return of_texts


def comparable(x: str, y: str, least: float):
    """Whether sets of these sizes can have a Jaccard similarity of `least`."""
    return F.least(x, y) >= least * F.greatest(x, y)


def may_be_alike(least: float):
    """The same of members x and y with their numbers of shingles that no other text has: these are
    in no intersection, so at most the smaller rest is."""
    most = F.least(F.col("size_x") - F.col("alone_x"), F.col("size_y") - F.col("alone_y"))
    return most >= least * (F.col("size_x") + F.col("size_y") - most)


def sketches_allow(least: float):
    """The same by the sketches of x and y. A similarity of `least` leaves a difference of at most
    (1 - least) / (1 + least) of both sizes, and sketches differ in no more bits than that."""
    bits = F.lit(0)
    for i in range(SKETCH // 64):
        bits = bits + F.bit_count(F.col("sketch_x")[i].bitwiseXOR(F.col("sketch_y")[i]))
    return bits * (1 + least) <= (F.col("size_x") + F.col("size_y")) * (1 - least) + 1e-6


def alike(x: str, y: str, least: float):
    both = F.size(F.array_intersect(x, y))
    return both >= least * (F.size(x) + F.size(y) - both)


def joined(members: DataFrame, sure: DataFrame, tested, similarity: float, pivots: int = PIVOTS) -> DataFrame:
    """node, root of the components of all links among the members (cell, at, size, alone, sketch) of each cell,
    and among the pairs `sure` (x, y); `tested` gives the links (a, b) of a table of pairs. Members whose
    sizes, without shingles of their own (`alone`), or sketches rule out the similarity are no pair.

    Pairs within a component are not tested, all others of a cell are. Each round takes more of the
    members of a cell as pivots, those with fewest shingles of their own first and otherwise by a
    hash, and tests each against what is not in its component: a group is joined by its most central
    members, and later pivots meet only what was left out. A cell is done
    when all its members are in one component or all have been pivots."""
    level = F.least(F.floor(F.col("alone") * LEVELS / F.greatest("size", F.lit(1)) / (1 - similarity)), F.lit(LEVELS - 1))
    members = members.withColumn("level", level)
    steps = members.groupBy("cell", "level").agg(F.count("*").alias("many"))  # at most LEVELS a cell
    before = F.sum("many").over(Window.partitionBy("cell").orderBy("level")) - F.col("many")
    sizes = steps.select("cell", "level", "many", before.alias("before"),
                         F.sum("many").over(Window.partitionBy("cell")).alias("n")).filter("n > 1")
    within = F.pmod(F.xxhash64("at", F.lit(SEED)), F.lit(1 << 30)) / F.lit(1 << 30)
    left = stored(members.join(sizes, ["cell", "level"]).select(
        "cell", "at", "size", "alone", "sketch", "n", (F.col("before") + within * F.col("many")).alias("place")))
    place = F.col("place")
    links, low, high = tested(sure), 0, pivots
    named = ["at", "size", "alone", "sketch", "root", "main"]
    root = None
    while True:
        if root is None:
            now = left.withColumn("root", F.col("at"))
        else:
            now = left.join(root, left["at"] == root["node"], "left").select(
                "cell", "at", "size", "alone", "sketch", "n", "place", F.coalesce("root", "at").alias("root"))
        counts = now.groupBy("cell", "root").count()
        main = counts.groupBy("cell").agg(F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("parts"))
        now = stored(now.join(main.filter("parts > 1").select("cell", F.col("most.root").alias("main")), "cell"))
        pivot = now.filter((place >= low) & (place < high)).select(
            "cell", *[F.col(c).alias("x" if c == "at" else f"{c}_x") for c in named])
        other = now.select("cell", *[F.col(c).alias("y" if c == "at" else f"{c}_y") for c in named])
        # one of a pair is outside the main component of the cell, so its own pairs are never listed
        met = (pivot.filter("root_x <> main_x").join(other, "cell")
               .unionByName(pivot.filter("root_x = main_x").join(other.filter("root_y <> main_y"), "cell")))
        pairs = met.filter("root_x <> root_y").filter(may_be_alike(similarity) & sketches_allow(similarity)).select(
            F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        fresh = stored(links.unionByName(tested(pairs)) if root is None else tested(pairs))
        if root is None or not fresh.isEmpty():
            known = fresh if root is None else fresh.unionByName(
                root.select(F.col("node").alias("a"), F.col("root").alias("b")))
            root = components(known)
            root = stored(root.unionByName(root.select(F.col("root").alias("node"), "root")).distinct())
        left = now.filter(F.col("n") > high).select("cell", "at", "size", "alone", "sketch", "n", "place")
        if left.isEmpty():
            return root
        low, high = high, high * 4


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5,
                similarity: float = 0.8, shingle: int = 2, most: int = BITS) -> DataFrame:
    """The rows with their own columns, one of each group of near-duplicates: the smallest id, null
    ids last.

    Groups are the components of links between texts whose sets of shingles of `words` words have a
    Jaccard similarity of `similarity` or more. Candidates are texts whose SimHash fingerprints, of
    different shorter shingles, are linked or equal, and texts that share one of BANDS bands of
    least hashes; sign bits alone miss many pairs near the threshold, the bands find all but
    (1 - 0.8 ** BAND_WIDTH) ** BANDS, 7 in 100,000, of the pairs at 0.8. Texts with a fingerprint or
    a band in common are all compared unless they are in one component already (`joined`), their
    sizes or sketches rule the similarity out, or one has so many shingles that no other candidate
    has that it cannot be like any; so no link between two of them is lost. Texts that share bands
    but are not alike are compared with each other, which for a large group of them grows with its
    square. Null texts count as empty and equal each other. An empty table gives an empty result.
    """
    whole = text_of(text)
    base = stored(rows(docs, id=F.col(doc_id), at=F.monotonically_increasing_id(), text=whole)
                  .withColumn("fp", fingerprints(shingle, 1, once=True)("text")[0])
                  .withColumn("b", band_keys(words)("text")).select("*", "b.*").drop("b", "text"))
    nodes = stored(base.groupBy("fp").agg(F.min(F.struct("at", "size")).alias("first")).select("fp", "first.*"))
    linked = links(nodes.select(F.lit(0).cast("long").alias("no"), "fp"), most)
    first = lambda c: nodes.select(F.col("fp").alias(c), F.col("at").alias(f"at_{c}"), F.col("size").alias(f"size_{c}"))
    across = linked.join(first("a"), "a").join(first("b"), "b").filter(comparable("size_a", "size_b", similarity))
    across = stored(across.select(F.least("at_a", "at_b").alias("x"), F.greatest("at_a", "at_b").alias("y"))
                    .filter("x <> y").distinct())
    cells = stored(base.select(F.xxhash64("fp").alias("cell"), "at", "size").unionByName(
        base.select(F.explode("bands").alias("cell"), "at", "size")))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    members = cells.join(shared, "cell")
    # only the sets of candidates are moved; whether their ids are broadcast is left to the size of the table
    paired = stored(across.select(F.explode(F.array("x", "y")).alias("at")).union(members.select("at")).distinct())
    sets = stored(base.join(paired, "at", "left_semi").select(
        "at", shingle_set(words)(text_of(f"row.`{text}`")).alias("set")))

    # shingles of one candidate only: with too many of these a text is like no other
    alone = (sets.select("at", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("at").alias("at"))
             .filter("n = 1").groupBy("at").agg(F.count("*").alias("alone")))
    able = stored(members.join(alone, "at", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
                  .filter(F.col("size") - F.col("alone") >= similarity * F.col("size"))
                  .join(base.select("at", "sketch"), "at"))

    def tested(pairs: DataFrame) -> DataFrame:
        compared = (pairs.join(sets.withColumnRenamed("at", "x").withColumnRenamed("set", "left"), "x")
                    .join(sets.withColumnRenamed("at", "y").withColumnRenamed("set", "right"), "y"))
        return compared.filter(alike("left", "right", similarity)).select(
            F.col("x").alias("a"), F.col("y").alias("b"))

    member = joined(able, across, tested, similarity).withColumnRenamed("node", "at")
    known = member.join(base.select("at", "id"), "at")
    best = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "at")).alias("best"))
    dropped = stored(known.join(best, "root").filter("at <> best.at").select("at"))
    return base.join(dropped, "at", "left_anti").select("row.*")
