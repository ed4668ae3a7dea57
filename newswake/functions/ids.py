"""Hashes Spark has no expression for, as Arrow batch UDFs: blake2b ids and title simhash."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from newswake.functions.text import WORD


@F.pandas_udf(StringType())
def blake2b_hex(text: pd.Series) -> pd.Series:
    return text.map(
        lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest())


def document_id(oid: Column, aid: Column, canonical: Column, url: Column, title: Column,
                published_iso: Column) -> Column:
    """blake2b-64 hex of `oid:aid` (else canonical URL, URL, title), a bar and the ISO date."""
    filled = lambda c: F.when(c != "", c)
    base = F.coalesce(
        F.when((oid != "") & (aid != ""), F.concat_ws(":", oid, aid)),
        filled(canonical), filled(url), filled(title), F.lit(""))
    return blake2b_hex(F.concat(base, F.lit("|"), F.coalesce(published_iso, F.lit(""))))


@F.pandas_udf(StringType())
def simhash64(text: pd.Series) -> pd.Series:
    """64-bit simhash over the words of a text, each word hashed by blake2b-64; hex text."""
    import numpy as np

    word = re.compile(WORD)
    bits = np.arange(64, dtype=np.uint64)

    def one(t: str | None) -> str:
        words = word.findall((t or "").lower())
        if not words:
            return "0x0"
        digests = b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words)
        hashes = np.frombuffer(digests, dtype=">u8").astype(np.uint64)
        votes = ((hashes[:, None] >> bits) & np.uint64(1)).astype(np.int64).sum(axis=0)
        on = 2 * votes > len(words)
        return hex(int((on.astype(np.uint64) << bits).sum(dtype=np.uint64)))

    return text.map(one)
