"""Exact dedup by two-pass Bloom filtering.

Pass one counts the filter cells of all text hashes and keeps those that two rows or more have
set. Pass two tests every row against these cells: a row with a cell that is not set twice has a
hash of its own and passes straight through. Only the others, the possibly repeated, are written
out, grouped by their full SHA-256 and resolved; false positives come out as groups of one.

The filter is blocked: the cells of a hash lie in one 64-bit word, so one look-up by word number
tests them all. It has at most `filter_words` words whatever the input (2**17 words of 16 bytes,
two MB, by default), which bounds what is broadcast. With more rows than bits it lets more rows
through to the exact step; raise the parameter then.

Groups are reduced by `min` and `count` before their shuffle, so a group with a third of all rows
costs one row a task; its rows meet the group's result in a join whose large side may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.tables import SPACES, rows, stored, text_of, unpacked

RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]
FILTER_WORDS = 1 << 17
CELLS = 3


def normal_form(text: Column) -> Column:
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def word_and_cells(key: Column, filter_words: int) -> tuple[Column, Column]:
    """The filter word of a 64-bit hash, and its cells in that word (six bits of the hash each)."""
    cells = [F.shiftrightunsigned(key, 40 + 6 * i).bitwiseAND(63).cast("int") for i in range(CELLS)]
    return F.pmod(key, F.lit(filter_words)).cast("int"), F.array_distinct(F.array(*cells))


def repeated_words(keys: DataFrame, filter_words: int) -> DataFrame:
    """word, twice: the bits that two hashes or more set, for words that have such bits."""
    word, cells = word_and_cells(F.col("key"), filter_words)
    counted = (keys.select(word.alias("word"), F.explode(cells).alias("cell"))
               .groupBy("word", "cell").agg(F.count("*").alias("n")))
    bit = F.expr("shiftleft(1L, cell)")
    return counted.filter("n > 1").groupBy("word").agg(F.bit_or(bit).alias("twice"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                filter_words: int = FILTER_WORDS) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; a null text counts as
    empty, and empty texts are one group. Of a group stays the row with most code points in its
    text, then the smallest id, null ids last, then (rows alike in all these) any one. keep_id is
    the id of that row, null if it has none. An empty table gives an empty result. Given columns
    named as the results are replaced by them.
    """
    whole = text_of(text)
    hashed = rows(docs, id=F.col(doc_id), n=F.length(whole),
                  sha=F.sha2(normal_form(whole).cast("binary"), 256))
    hashed = hashed.withColumn("key", F.xxhash64("sha"))
    word, cells = word_and_cells(F.col("key"), filter_words)
    mask = F.aggregate(cells, F.lit(0).cast("long"),
                       lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))
    # at most filter_words rows, so its size is bounded by a parameter
    repeated = F.broadcast(stored(repeated_words(hashed.select("key"), filter_words)))
    tested = hashed.withColumns({"word": word, "mask": mask}).join(repeated, "word", "left")
    maybe = F.coalesce(F.col("twice").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))

    candidates = stored(tested.filter(maybe).select(
        "row", "id", "n", "sha", F.monotonically_increasing_id().alias("at")))
    rank = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"),
                    F.col("id").alias("id"), F.col("at").alias("at"))
    # stored, so that the join below has shuffles of its own and may split those of a large group
    groups = stored(candidates.groupBy("sha").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")))
    resolved = candidates.join(groups, "sha").select(
        "row", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("at") == F.col("best.at")).alias("kept"), F.col("sha").alias("text_sha256"))
    single = tested.filter(~maybe).select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return unpacked(single.unionByName(resolved), RESULTS)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with their own columns."""
    found = rows(docs, **{text: F.col(text), doc_id: F.col(doc_id)})
    kept = exact_dedup(found, text, doc_id).filter("kept")
    return kept.select("row.*")
