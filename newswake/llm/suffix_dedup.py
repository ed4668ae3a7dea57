"""Repeated passages by prefix-free parsing.

Wanted for every position: does the string of 50 bytes that starts there also start in a document
with a smaller id? In the suffix order of the corpus, equal strings are neighbours; the order is
never built for the corpus as a whole, but from a dictionary and a parse.

* Parse: rolling-hash triggers cut each document into overlapping phrases (`phrases`). A 50-byte
  string lies in one phrase, at a place that its bytes decide.
* Triggers that only one document has belong to strings of that document alone; their phrases, most
  of a corpus, are done.
* Dictionary: the different phrases left, each with the smallest id of its occurrences (the parse).
  A later occurrence of a phrase repeats all its strings at once. So however often a passage is
  copied, its inner strings are never compared.
* Suffixes of the dictionary: where a trigger has several phrases (edges of passages, edits), the
  suffixes of these phrases are sorted by their first 50 bytes, as hashes, and equal ones combined
  with the smallest id of their phrases. That orders the corpus where the parse leaves it open.

Each step is a question of batches about keys (`exchange`): triggers, phrases, suffixes. Only 64-bit
hashes leave a batch, once a batch and key, so a line that is everywhere is no large group; a batch
learns one or two bits a key and applies the rest to its own documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newswake.llm.exchange import (NULL_ID, REQUEST, Opened, answer_parts, answers, batches, keys_of,
                                   opened, planes, requests, unplanes, with_answers)
from newswake.llm.phrases import SPAN, Hashed, phrases
from newswake.llm.tables import text_of

U = np.uint64
SEGMENT = 1 << 18  # positions hashed at a time; a phrase cut there is one more phrase of its trigger


@dataclass
class Different:
    """Different keys ascending, where each occurrence finds its key, and the least id of each."""
    keys: np.ndarray
    place: np.ndarray
    least: np.ndarray
    most: np.ndarray


def different(keys: np.ndarray, ids: np.ndarray) -> Different:
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], ids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    if not len(k):
        return Different(k, place, d, d)
    return Different(k[at], place, np.minimum.reduceat(d, at), np.maximum.reduceat(d, at))


class Parse:
    """The phrases of a batch and, as answers come in, what is known of them."""

    def __init__(self, batch: Opened, bucket_bits: int):
        self.bits = bucket_bits
        self.batch = batch
        found = [self.of_segment(at, h) for at, h in self.segments()]
        self.first, self.last, trigger, doc, self.phrase = (
            np.concatenate([f[i] for f in found]) for i in range(5))
        self.ids = batch.ids[doc]
        self.trigger = different(trigger >> U(32 - bucket_bits), self.ids)

    def segments(self):
        for at in range(0, max(1, len(self.batch.data)), SEGMENT):
            yield at, Hashed(self.batch.data[at:at + SEGMENT + SPAN - 1])

    def of_segment(self, at: int, h: Hashed):
        b = self.batch
        lo, hi = np.searchsorted(b.ends, at, "right"), np.searchsorted(b.starts, at + SEGMENT)
        first, last, trigger, doc = phrases(h, np.maximum(b.starts[lo:hi] - at, 0),
                                            np.minimum(b.ends[lo:hi] - at, len(h.data)))
        return first + at, last + at, trigger, doc + lo, h.stretches(first, last + SPAN - 1)

    def suffixes(self, positions: np.ndarray) -> np.ndarray:
        """Hashes of the SPAN bytes from ascending positions on."""
        out = [np.zeros(0, np.uint64)]
        for at, h in self.segments():
            own = positions[np.searchsorted(positions, at):np.searchsorted(positions, at + SEGMENT)] - at
            if len(own):
                out.append(h.stretches(own, own + SPAN))
        return np.concatenate(out)

    def ask_triggers(self):
        """With each trigger a check of its phrases: 0 if it has several here. Low bit of b: more
        than one document here."""
        t = self.trigger
        check = (self.phrase & U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        seen = different(t.place.astype(np.uint64), check.astype(np.int64))
        one = np.where(seen.least == seen.most, seen.least, 0).astype(np.uint32)
        yield from requests(self.batch.batch, t.keys, 32 + self.bits, self.bits,
                            one, (t.least != t.most).astype(np.uint8))

    def know_triggers(self, parts: list[bytes]):
        known = bits_of(parts, self.trigger)
        shared = (known & 1).astype(bool)[self.trigger.place]
        self.several = (known & 2).astype(bool)[self.trigger.place][shared]
        self.first, self.last = self.first[shared], self.last[shared]
        self.ids, self.phrase = self.ids[shared], self.phrase[shared]
        self.phrase = different(self.phrase, self.ids)

    def ask_phrases(self):
        yield from ask_least(self.batch.batch, self.phrase, self.bits)

    def know_phrases(self, parts: list[bytes]):
        """Phrases that a smaller id has are repeated; first ones may have repeated suffixes."""
        place = self.phrase.place
        self.repeated = is_later(parts, self.phrase)[place] | (self.ids > self.phrase.least[place])
        open_ = ~self.repeated & self.several
        size = (self.last - self.first)[open_]
        self.suffix_at = np.repeat(self.first[open_] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.suffix_ids = np.repeat(self.ids[open_], size)
        self.suffix = different(self.suffixes(self.suffix_at), self.suffix_ids)

    def ask_suffixes(self):
        yield from ask_least(self.batch.batch, self.suffix, self.bits)

    def removed(self, parts: list[bytes]) -> np.ndarray:
        """Per byte whether it lies in a string that starts in a document with a smaller id."""
        place = self.suffix.place
        later = is_later(parts, self.suffix)[place] | (self.suffix_ids > self.suffix.least[place])
        change = np.zeros(len(self.batch.data) + SPAN + 1, np.int32)
        np.add.at(change, self.first[self.repeated], 1)
        np.add.at(change, self.last[self.repeated] + SPAN - 1, -1)
        np.add.at(change, self.suffix_at[later], 1)
        np.add.at(change, self.suffix_at[later] + SPAN, -1)
        return np.cumsum(change, out=change)[:len(self.batch.data)] > 0


def ask_least(batch: int, found: Different, bucket_bits: int):
    """Keys with the least id of each here, as places in the ids asked with."""
    yield from requests(batch, found.keys, 64, bucket_bits, found.least)


def bits_of(parts: list[bytes], found: Different) -> np.ndarray:
    if not len(found.keys):
        return np.zeros(0, np.uint8)
    return np.concatenate([unplanes(p, np.uint8) for p in parts])


def is_later(parts: list[bytes], found: Different) -> np.ndarray:
    return bits_of(parts, found).astype(bool)


def split(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [planes(x) for x in np.split(values.astype(np.uint8), np.cumsum(sizes)[:-1])]


def groups_of(frame: pd.DataFrame):
    keys = [keys_of(k) for k in frame["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    return [len(k) for k in keys], order, np.flatnonzero(new), place


def combine_triggers(frame: pd.DataFrame) -> list[bytes]:
    """1: in more than one document. 2: with more than one phrase."""
    sizes, order, at, place = groups_of(frame)
    check = np.concatenate([unplanes(a, np.uint32) for a in frame["a"]])[order]
    many = np.concatenate([unplanes(b, np.uint8) for b in frame["b"]])[order]
    times = np.diff(np.append(at, len(order)))
    shared = (times > 1) | (np.maximum.reduceat(many, at) > 0)
    low, high = np.minimum.reduceat(check, at), np.maximum.reduceat(check, at)
    several = (low != high) | (low == 0)
    return split((shared + 2 * (shared & several))[place], sizes)


def combine_least(frame: pd.DataFrame) -> list[bytes]:
    """1: another batch has a smaller id."""
    sizes, order, at, place = groups_of(frame)
    ids = np.concatenate([unplanes(a, np.int64) for a in frame["a"]])
    least = np.minimum.reduceat(ids[order], at)
    return split(least[place] < ids, sizes)


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each maximal removed run of bytes) and kept (the bytes
    that stay) of every document.

    Ids must be whole numbers; null ids count as larger than all others. A null text counts as
    empty. Rows of one id are judged against smaller ids only, never against each other. An empty
    table gives an empty result; of the given columns only the id is returned.
    """
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                        F.col(doc_id).isNull().cast("int").alias("flag"), text_of(text).alias("text"))
    made = batches(given)
    bits = made.bucket_bits

    def parse(row, steps: int) -> Parse:
        p = Parse(opened(row), bits)
        if steps > 0:
            p.know_triggers(answer_parts(row.answers0))
        if steps > 1:
            p.know_phrases(answer_parts(row.answers1))
        return p

    def step(ask, steps: int):
        def run(frames):
            for frame in frames:
                for row in frame.itertuples(index=False):
                    yield from ask(parse(row, steps))
        return run

    def result(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                p = parse(row, 2)
                yield from per_document(p.batch, p.removed(answer_parts(row.answers2)))

    triggers = answers(made.rows.mapInPandas(step(Parse.ask_triggers, 0), REQUEST), combine_triggers)
    asked = with_answers(made.rows, triggers).mapInPandas(step(Parse.ask_phrases, 1), REQUEST)
    of_phrases = answers(asked, combine_least)
    asked = with_answers(made.rows, triggers, of_phrases).mapInPandas(step(Parse.ask_suffixes, 2), REQUEST)
    suffixes = answers(asked, combine_least)
    return with_answers(made.rows, triggers, of_phrases, suffixes).mapInPandas(
        result, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def per_document(batch: Opened, removed: np.ndarray):
    edge = np.zeros(len(removed) + 1, bool)
    edge[batch.starts[batch.ends > batch.starts]] = True
    run = removed.copy()
    run[1:] &= ~removed[:-1] | edge[1:-1]
    first = np.flatnonzero(run)
    stop = removed.copy()
    stop[:-1] &= ~removed[1:] | edge[1:-1]
    last = np.flatnonzero(stop) + 1
    lo, hi = np.searchsorted(first, batch.starts), np.searchsorted(first, batch.ends)
    out = []
    for i, (s, e) in enumerate(zip(batch.starts, batch.ends)):
        spans = [{"start": int(a - s), "end": int(b - s)} for a, b in
                 zip(first[lo[i]:hi[i]], last[lo[i]:hi[i]])] if e > s else []
        kept = batch.data[s:e] if not spans else batch.data[s:e][~removed[s:e]]
        out.append((None if batch.flags[i] else int(batch.ids[i]), int(e - s), spans, kept.tobytes()))
        if len(out) == 512:
            yield documents(out)
            out = []
    if out:
        yield documents(out)


def documents(out: list) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame
