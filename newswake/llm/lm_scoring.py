"""Language-model scores by deleted interpolation.

The probability of a token w after v mixes maximum-likelihood estimates of three orders,

    P(w | v) = l2 c(v w) / c(v)  +  l1 c(w) / N  +  l0 / (V + 1),

with weights that depend on how often the context v was seen (buckets of powers of two). The weights
come from deleted counts: a part of the training documents is held back, estimates are made from the
rest, and expectation-maximisation fits the weights of each bucket to the part held back. The final
estimates use the counts of all training documents.

Counts are gathered over all documents by questions of batches (`exchange`): each batch of a few MB
adds its counts of words and pairs and gets back the sums for its own keys, so counts grow with the
corpus and stay distributed, and a word that is everywhere costs one entry a batch. Words and pairs
are 56-bit hashes. For the weights, a batch turns its held-back tokens into a table over (bucket,
estimate of order two, estimate of order one) on a fixed grid of 1/20 decades; only this table, which
the grid bounds, reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newswake.llm.exchange import (BUCKET_BYTES, NULL_ID, REQUEST, TOTALS, Opened, answer_parts, answers, batches, keys_of,
                                   opened, planes, requests, unplanes, with_answers)
from newswake.llm.phrases import Hashed, mixed
from newswake.llm.tables import text_of

U = np.uint64
BITS = 56
END, BEGIN = U(0x51), U(0x52)
HELD_OUT, KEPT, DELETED = 0, 1, 2
STEPS = 20  # of the grid, per decade
NONE = -(1 << 20)
BUCKETS = 40
EM_ROUNDS = 40

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Tokens:
    """The tokens of a batch: words and an end a document, with the place of each in its keys."""

    def __init__(self, batch: Opened):
        self.batch = batch
        data = LOWER[batch.data]
        word = ~SPACE[data]
        head = word.copy()
        head[1:] &= ~word[:-1]
        tail = word.copy()
        tail[:-1] &= ~word[1:]
        edges = batch.starts[(batch.starts > 0) & (batch.starts < len(data))]
        head[edges] = word[edges]
        tail[edges - 1] = word[edges - 1]
        first, last = np.flatnonzero(head), np.flatnonzero(tail) + 1
        doc = np.searchsorted(batch.ends, first, "right")
        n = np.bincount(doc, minlength=len(batch.ids)) + 1
        self.sizes = n
        self.doc = np.repeat(np.arange(len(n)), n)
        end = np.cumsum(n) - 1
        self.token = np.empty(int(n.sum()), np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[end] = False
        self.token[inner] = hashes(data, first, last) >> U(64 - BITS)
        self.token[end] = END
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[end - n + 1] = BEGIN
        pair = mixed(before * U(0xC2B2AE3D27D4EB4F) + self.token) >> U(64 - BITS)
        self.flag = batch.flags[self.doc]
        self.keys, place = np.unique(np.concatenate([self.token, pair, np.array([BEGIN])]),
                                     return_inverse=True)
        self.word_at, self.pair_at = place[:len(pair)], place[len(pair):2 * len(pair)]
        self.begin_at = place[-1]
        self.context_at = np.empty_like(self.word_at)
        self.context_at[1:] = self.word_at[:-1]
        self.context_at[end - n + 1] = self.begin_at

    def ask(self, bucket_bits: int):
        """Counts in the kept and the deleted part of the training documents. A document adds one
        BEGIN, which is a context and no token."""
        counts = []
        for part in (KEPT, DELETED):
            own = self.flag == part
            c = np.bincount(self.word_at[own], minlength=len(self.keys))
            c += np.bincount(self.pair_at[own], minlength=len(self.keys))
            c[self.begin_at] += int((self.batch.flags == part).sum())
            counts.append(c.astype(np.uint32))
        # the lowest bit of the key tells words from pairs
        words = np.zeros(len(self.keys), np.uint64)
        words[self.word_at] = 1
        words[self.begin_at] = 0
        yield from requests(self.batch.batch, self.keys << U(1) | words, BITS + 1, bucket_bits, *counts)

    def known(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the kept part and of all training documents, per key."""
        both = [unplanes(p, np.uint64) for p in parts]
        kept = np.concatenate([x[:len(x) // 2] for x in both]).astype(np.float64)
        every = np.concatenate([x[len(x) // 2:] for x in both]).astype(np.float64)
        return kept, every

    def estimates(self, counts: np.ndarray, total: float):
        """(bucket, order two, order one) of each token; 0 where nothing was seen."""
        context = counts[self.context_at]
        two = np.divide(counts[self.pair_at], context, out=np.zeros(len(context)), where=context > 0)
        one = counts[self.word_at] / total if total else np.zeros(len(context))
        return bucket_of(context), two, one


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """Of the words at first..last, some thousands at a time."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(first), most):
        f, e = first[i:i + most], last[i:i + most]
        out.append(Hashed(data[f[0]:e[-1]]).stretches(f - f[0], e - f[0]))
    return np.concatenate(out)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)


def sums(frame: pd.DataFrame):
    """Requests of a bucket: keys asked for by each, different keys, their places, their counts."""
    keys = [keys_of(k) for k in frame["keys"]]
    sizes = [len(k) for k in keys]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    parts = []
    for column in ("a", "b"):
        total, at = np.zeros(len(every), np.uint64), 0
        for n, raw in zip(sizes, frame[column]):
            total[place[at:at + n]] += unplanes(raw, np.uint32)  # keys of one request differ
            at += n
        parts.append(total)
    return sizes, every, place, parts[0], parts[0] + parts[1]


def combine_counts(frame: pd.DataFrame) -> list[bytes]:
    """Of each key the counts of the kept and of all training documents; in total, tokens and
    different tokens of either."""
    sizes, keys, place, kept, every = sums(frame)
    out, at = [], 0
    for n in sizes:
        own = place[at:at + n]
        out.append(planes(np.concatenate([kept[own], every[own]])))
        at += n
    word = (keys & U(1)).astype(bool)
    total = [kept[word].sum(), (kept[word] > 0).sum(), every[word].sum(), (every[word] > 0).sum()]
    return [*out, np.array(total, np.float64).tobytes()]


def grid(x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), NONE, np.int64)
    seen = x > 0
    out[seen] = np.round(STEPS * np.log10(x[seen]))
    return out


def weights(table: pd.DataFrame, v: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (order two, one, zero) by bucket, from held-back tokens on the grid.

    A bucket without held-back tokens takes the weights of the one below. In bucket 0, contexts
    never seen, order two has none. The uniform part keeps a little weight everywhere."""
    out = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    out[0] = (0.0, 0.8, 0.2)
    for b in range(BUCKETS):
        rows = table[table["bucket"] == b]
        if not len(rows):
            if b > 1:
                out[b] = out[b - 1]
            continue
        f = np.stack([np.where(rows[c] == NONE, 0.0, 10.0 ** (rows[c].clip(lower=-400) / STEPS))
                      for c in ("two", "one")] + [np.full(len(rows), 1 / (v + 1))], 1)
        n = rows["n"].to_numpy(float)
        w = out[b].copy()
        for _ in range(rounds):
            part = f * w
            w = (n[:, None] * part / part.sum(1, keepdims=True)).sum(0) / n.sum()
            w = np.maximum(w, (0.0, 1e-9, 1e-9))
            w /= w.sum()
        out[b] = w
    return out


@dataclass
class Model:
    tokens: float
    words: float
    weights: np.ndarray


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int = 5,
          held_out: int = 1, deleted: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose crc32 of the id as text leaves `held_out` modulo `parts` are scored only; those
    that leave `deleted` are the deleted part, from which the weights are learned. A null id is
    trained on; a null text counts as empty and has one token, the end. base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))), score the log10 probability of the model. Repeated rows are
    scored each; an empty table gives an empty result; of the given columns only the id is returned.
    """
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
    part = (F.when(rest == held_out, HELD_OUT).when(rest == deleted, DELETED).otherwise(KEPT)
            + F.when(F.col(doc_id).isNull(), 4).otherwise(0))
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                        part.cast("int").alias("flag"), text_of(text).alias("text"))
    made = batches(given, bucket=BUCKET_BYTES // 2)
    bits = made.bucket_bits

    def tokens(row) -> tuple[Tokens, np.ndarray]:
        batch = opened(row)
        null = batch.flags >= 4
        batch.flags = batch.flags & 3
        return Tokens(batch), null

    def ask(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield from tokens(row)[0].ask(bits)

    asked = made.rows.mapInPandas(ask, REQUEST)
    counts = answers(asked, combine_counts, total=True)
    with_counts = with_answers(made.rows, counts)
    found = counts.filter(F.col("batch") == TOTALS).first()  # four numbers a bucket
    of_buckets = [np.frombuffer(p) for p in answer_parts(found and found["answers"])]
    n_kept, v_kept, n_all, v_all = np.sum([np.zeros(4), *of_buckets], axis=0)

    def tabulate(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                t, _ = tokens(row)
                kept, _ = t.known(answer_parts(row.answers0))
                own = t.flag == DELETED
                bucket, two, one = (x[own] for x in t.estimates(kept, n_kept))
                rows, n = np.unique(np.stack([bucket, grid(two), grid(one)], 1), axis=0, return_counts=True)
                yield pd.DataFrame({"bucket": rows[:, 0], "two": rows[:, 1], "one": rows[:, 2], "n": n})

    held = with_counts.mapInPandas(tabulate, "bucket long, two long, one long, n long")
    # bounded by the grid
    table = held.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas()
    model = Model(n_all, v_all, weights(table, v_kept))

    def scored(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                t, null = tokens(row)
                _, every = t.known(answer_parts(row.answers0))
                yield scores(t, every, null, model)

    return with_counts.mapInPandas(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")


def scores(t: Tokens, counts: np.ndarray, null: np.ndarray, model: Model) -> pd.DataFrame:
    c = counts[t.word_at]
    base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    bucket, two, one = t.estimates(counts, model.tokens)
    w = model.weights[bucket]
    p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (model.words + 1)
    n = len(t.batch.ids)

    def per_document(x):
        return np.bincount(t.doc, x, n)

    ids = pd.array(t.batch.ids, dtype="Int64")
    ids[null] = pd.NA
    return pd.DataFrame({
        "doc_id": ids, "held_out": t.batch.flags == HELD_OUT, "n_tokens": t.sizes,
        "n_known": per_document(c > 0).astype(np.int64),
        "train_tokens": np.full(n, int(model.tokens)), "base_score": per_document(base),
        "score": per_document(np.log10(p))})

