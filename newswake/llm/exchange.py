"""Batches of texts that ask about keys of the whole corpus, and the answers.

Statistics over all documents (how often a word pair occurs, which document has a passage first)
are looked up for far more places than there are different keys. So documents are packed into
batches of a few MB, and a batch asks once for each of its different keys, with what it knows of
them itself; keys go to buckets by their high bits, a bucket combines all batches and answers each
in the order it asked. A key that a third of all documents have costs one entry a batch.

Batches lie compressed in a table that is bucketed by batch number on shared storage, so that
joining them with their answers moves the answers and never the texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newswake.llm.tables import shared_dir, stored

BATCH_BYTES = 4 << 20
BATCH_ROWS = 1 << 15
BUCKET_BYTES = 16 << 20
NULL_ID = (1 << 63) - 1
REQUEST = "bucket int, batch long, keys binary, a binary, b binary"
BATCH = "batch long, ids array<long>, flags array<int>, lengths array<long>, texts binary"


@dataclass
class Batches:
    """rows: BATCH rows. bucket_bits: so many high bits of a key choose its bucket."""
    rows: DataFrame
    bucket_bits: int


def packed(frames, target: int):
    """(id, flag, text) rows to batches. Ids are unique by task and place in it."""
    import zstandard
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, flags, texts, size = [], [], [], 0

    def row():
        raw = b"".join(texts)
        return pd.DataFrame({"batch": [number], "ids": [ids], "flags": [flags],
                             "lengths": [[len(t) for t in texts]],
                             "texts": [zstandard.compress(raw, 3)]})

    for frame in frames:
        for i, f, t in zip(frame["id"].tolist(), frame["flag"].tolist(), frame["text"]):
            t = t.encode()
            if texts and (size + len(t) > target or len(texts) >= BATCH_ROWS):
                yield row()
                number += 1
                ids, flags, texts, size = [], [], [], 0
            ids.append(i)
            flags.append(f)
            texts.append(t)
            size += len(t)
    if texts:
        yield row()


def batches(docs: DataFrame, target: int = BATCH_BYTES, bucket: int = BUCKET_BYTES) -> Batches:
    """Of rows (id long, flag int, text string) without nulls; flags are the caller's.

    A task holds one batch of about `target` bytes, or the keys of about `bucket` bytes of texts. A
    pair of batch and bucket is a row, so both should grow with the memory of the workers."""
    spark = docs.sparkSession
    made = docs.mapInPandas(lambda frames: packed(frames, target), BATCH)
    name = f"newswake_batches_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (made.repartition(parts, "batch").write.format("parquet").option("path", path)
     .bucketBy(parts, "batch").saveAsTable(name))
    table = spark.table(name)
    size = table.agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)"))).first()[0] or 0
    return Batches(table, max(3, (size // bucket).bit_length()))


@dataclass
class Opened:
    """A batch in a task: the bytes of its documents one after another, at starts..ends."""
    batch: int
    ids: np.ndarray
    flags: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def opened(row) -> Opened:
    import zstandard

    lengths = np.asarray(row.lengths, np.int64)
    ends = np.cumsum(lengths)
    raw = zstandard.decompress(row.texts) if len(row.texts) else b""
    return Opened(row.batch, np.asarray(row.ids, np.int64), np.asarray(row.flags, np.int32),
                  ends - lengths, ends, np.frombuffer(raw, np.uint8))


def planes(values: np.ndarray) -> bytes:
    """Compressed, with the bytes of equal weight together: those of small numbers are all empty."""
    import zstandard

    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(raw.tobytes(), 1)


def unplanes(raw: bytes, kind) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


def requests(batch: int, keys: np.ndarray, bits: int, bucket_bits: int, a=None, b=None):
    """REQUEST rows of ascending different keys of `bits` bits, with up to two facts of each."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(bits - bucket_bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for s, e in zip(at, np.append(at[1:], len(keys))):
        rows.append((int(bucket[s]), batch, planes(np.diff(keys[s:e], prepend=np.uint64(0))),
                     planes(a[s:e]) if a is not None else b"", planes(b[s:e]) if b is not None else b""))
    yield pd.DataFrame(rows, columns=["bucket", "batch", "keys", "a", "b"])


def keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


TOTALS = -1


def answers(asked: DataFrame, combine, total: bool = False) -> DataFrame:
    """batch, answers (by bucket) of requests. combine(requests of a bucket) gives a list with the
    answer bytes of each, and with `total` one more that is filed under the batch TOTALS. Stored, as
    more than one step reads them."""
    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        to = frame["batch"].tolist() + [TOTALS] * total
        return pd.DataFrame({"batch": to, "bucket": int(frame["bucket"].iloc[0]), "answer": combine(frame)})

    given = asked.groupBy("bucket").applyInPandas(answer, "batch long, bucket int, answer binary")
    return stored(given.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers")))


def with_answers(rows: DataFrame, *found: DataFrame) -> DataFrame:
    """Batches with their answers as columns answers0, answers1, ..; null for a batch without."""
    for i, a in enumerate(found):
        rows = rows.join(a.withColumnRenamed("answers", f"answers{i}"), "batch", "left")
    return rows


def answer_parts(given) -> list[bytes]:
    return [] if given is None else [x["answer"] for x in given]
