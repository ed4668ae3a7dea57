"""Token counts, with overlap resynchronisation for huge texts.

A text of at most `chunk` letters is encoded whole. A longer one becomes chunks of `chunk` letters,
each reaching `overlap` letters into the next, which any tasks may encode. Two neighbours are
spliced at the first place in their overlap where both begin a new word of the pre-tokenizer.

Why that place is safe: the pre-tokenizer scans forward and looks ahead only, so from a common word
start on both scans see the same text and split it alike, and merges stay inside words. The left
chunk's scan is the true one there by induction (the first chunk starts with the text), as long as
its own end is too far to matter; so the last `MARGIN` letters of a chunk, which a special token or
a run of spaces may cross, are not used unless the chunk ends with the text.

Where the overlap has no common word start, alignment has failed, and the text goes to the next
round with chunks and overlaps `WIDEN` times as large. A round whose chunk holds the text encodes it
whole, so the rounds end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.tables import rows, stored, text_of, unpacked
from newswake.llm.tokens import counts, tokenizer, vocabulary

CHUNK = 1 << 15
OVERLAP = 1 << 9
MARGIN = 32
WIDEN = 8
VOCABULARY = "byte_bpe_50k.json"


def token_count(path: str):
    """Arrow UDF: tokens of whole texts, which must not be null."""
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counts(path, texts.tolist()), dtype="int64")
    return count


def cut(batches, chunk: int, overlap: int):
    """(sha, text) to chunks: sha, part, first letter, last of the text or not, its letters."""
    for batch in batches:
        for sha, text in zip(batch["sha"], batch["text"]):
            # a chunk shorter than its overlap would end inside its predecessor
            starts = range(0, max(1, len(text) - overlap), chunk)
            for part, start in enumerate(starts):
                end = len(text) if part == len(starts) - 1 else start + chunk + overlap
                yield pd.DataFrame({"sha": [sha], "part": [part], "start": [start],
                                    "last": [part == len(starts) - 1], "letters": [text[start:end]]})


def encode_chunks(batches, path: str, chunk: int, overlap: int):
    """Per chunk its token count, and the word starts in the overlaps with the tokens before them.

    Positions are letters from the start of the later chunk of a pair: `head` of this chunk,
    `tail` of it as seen by the next one."""
    t = tokenizer(path)
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            e = t.encode(r.letters, add_special_tokens=False)
            words, offsets = e.word_ids, e.offsets
            head, tail = ([], []), ([], [])
            sure = len(r.letters) if r.last else len(r.letters) - MARGIN
            for i, (start, _) in enumerate(offsets):
                if i and words[i] is not None and words[i] == words[i - 1]:
                    continue
                if r.part and start < overlap:
                    head[0].append(start)
                    head[1].append(i)
                if not r.last and chunk <= start < sure:
                    tail[0].append(start - chunk)
                    tail[1].append(i)
            out.append((r.sha, r.part, r.last, len(e), *head, *tail))
        yield pd.DataFrame(out, columns=["sha", "part", "last", "n", "head_at", "head_n",
                                         "tail_at", "tail_n"])


def spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """sha, n_tokens (null where a pair of chunks has no common word start)."""
    pieces = (texts.mapInPandas(lambda b: cut(b, chunk, overlap),
                                "sha string, part long, start long, last boolean, letters string")
              .dropDuplicates(["sha", "part"]))  # copies of a huge text are encoded once
    encoded = pieces.mapInPandas(
        lambda b: encode_chunks(b, path, chunk, overlap),
        "sha string, part long, last boolean, n long, head_at array<long>, head_n array<long>, "
        "tail_at array<long>, tail_n array<long>")
    encoded = stored(encoded)
    left = encoded.select("sha", (F.col("part") + 1).alias("part"), "tail_at", "tail_n")
    # in the order of the left chunk; the first, or null
    meet = F.get(F.array_intersect("tail_at", "head_at"), F.lit(0))

    def before(at: str, n: str) -> Column:
        return F.get(F.col(n), (F.array_position(at, meet) - 1).cast("int"))

    # a chunk adds its tokens up to the splice with the next, less those before its own splice
    pairs = encoded.drop("tail_at", "tail_n").join(left, ["sha", "part"], "left").select(
        "sha", F.when(F.col("last"), F.col("n")).otherwise(0).alias("end"),
        F.when(F.col("part") == 0, 0).otherwise(before("tail_at", "tail_n")
                                                - before("head_at", "head_n")).alias("more"))
    total = pairs.groupBy("sha").agg(F.sum("end").alias("end"), F.sum("more").alias("more"),
                                     F.max(F.col("more").isNull()).alias("failed"))
    return total.select("sha", F.when(~F.col("failed"), F.col("end") + F.col("more")).alias("n_tokens"))


def huge_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """sha, n_tokens of every different text (sha, text)."""
    found, open_texts = None, texts
    while True:
        counted = stored(spliced(open_texts, path, chunk, overlap))
        done = counted.filter("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = counted.filter("n_tokens is null").select("sha")
        if failed.isEmpty():
            return found
        open_texts = open_texts.join(failed, "sha", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None,
                 limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    No begin, end or added special tokens; a special string inside a text is one token, as the
    library has it. A null text counts as empty: no bytes, no tokens. Repeated rows are counted
    each; an empty table gives an empty result. Given columns named as the results are replaced.
    `chunk` must be larger than `overlap`, and `overlap` than MARGIN.
    """
    if not chunk > overlap > MARGIN:
        raise ValueError("chunk > overlap > MARGIN is needed")
    path = path or vocabulary(VOCABULARY)
    whole = text_of(text)
    both = rows(docs, text=whole, letters=F.length(whole))
    short = both.filter(F.col("letters") <= chunk).withColumn("n_tokens", token_count(path)("text"))
    large = both.filter(F.col("letters") > chunk).withColumn("sha", F.sha2("text", 256))
    known = huge_counts(large.select("sha", "text"), path, chunk, overlap)
    large = large.join(known, "sha")
    every = short.select("row", "text", "n_tokens").unionByName(large.select("row", "text", "n_tokens"))
    out = every.select("row", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens",
                       (F.col("n_tokens") > limit).alias("over_limit"))
    return unpacked(out, ["n_bytes", "n_tokens", "over_limit"])
