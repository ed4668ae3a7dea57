"""Quality classifier: a generalised additive model with pairwise interactions.

The model is a sum of look-up tables, one a feature and one a chosen pair of features, over binned
values. Tables are learned by cyclic boosting: round after round each feature in turn gets a shallow
tree (two levels of cuts over its bins) fitted to the current gradient of the logistic loss, scaled
by a small rate and added to its table. Then pairs are ranked by how much a four-way cut of the two
lowers the loss left over, and the best get tables by the same cycles, one cut a side.

Fitting runs on the driver over at most `most` labelled rows (a parameter; rows are chosen by the
hash of their id). Features and scores are computed where the texts are, in Arrow batches: bins by
binary search, then additions of table entries for the whole batch. All texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.tables import rows, text_of, unpacked

FEATURES = ["words", "word_length", "longest_word", "symbols", "bars", "upper", "exclamations",
            "digits", "points", "other_bytes", "different_words", "stutter", "different_pairs",
            "repeated_lines", "line_words"]
MOST = 20_000
BINS = 32
ROUNDS = 120
RATE = 0.1
PAIRS = 6
LIMIT = 0.7


def features_of(text: str) -> list[float]:
    """The features of a whole text; zeros where it has no words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = c[65:91].sum() + c[97:123].sum()
    inside = len(raw) - c[9:14].sum() - c[32]
    return [
        np.log1p(n), inside / n, np.log1p(max(map(len, words))),
        (c[35] + c[36] + c[37] + c[38] + c[42] + c[60] + c[62]) / n, c[124] / n,
        c[65:91].sum() / max(1, letters), c[33] / n, c[48:58].sum() / inside,
        (c[44] + c[46] + c[58] + c[59] + c[63]) / n, c[128:].sum() / inside,
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines))]


def feature_table(texts) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """edges: of the bins of each feature. tables: ((features), log-odds by bin)."""
    start: float
    edges: list
    tables: list

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.start)
        for over, table in self.tables:
            total += table[tuple(bins[:, i] for i in over)]
        return 1 / (1 + np.exp(-total))


def cut(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values of a shallow tree over ordered bins: the best cut by second-order gain, then each side."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if not depth or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + 1.0) + gr ** 2 / (hr + 1.0)
    gain[(hl < 1.0) | (hr < 1.0)] = -np.inf
    k = int(np.argmax(gain))
    if not gain[k] > g.sum() ** 2 / (h.sum() + 1.0):
        return value
    return np.concatenate([cut(g[:k + 1], h[:k + 1], depth - 1), cut(g[k + 1:], h[k + 1:], depth - 1)])


def cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best four-way cut of a two-way table, one cut a side, and its gain."""
    def quarters(x):
        s = x.cumsum(0).cumsum(1)
        a = s[:-1, :-1]
        top, left = s[:-1, -1:], s[-1:, :-1]
        return a, top - a, left - a, s[-1, -1] - top - left + a
    gs, hs = quarters(g), quarters(h)
    gain = sum(a ** 2 / (b + 1.0) for a, b in zip(gs, hs))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.empty_like(g)
    v = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(gs, hs)]
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE,
        pairs: int = PAIRS) -> Model:
    """Without labelled rows, or with one class only, the score is the smoothed share of class 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Model(start, [np.array([])] * len(FEATURES), [])
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, i], inner)) for i in range(x.shape[1])]
    model = Model(start, edges, [((i,), np.zeros(len(e) + 1)) for i, e in enumerate(edges)])
    bins = model.binned(x)
    total = np.full(len(y), start)

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for (i,), table in model.tables:
            g, h = gradient()
            b = bins[:, i]
            step = rate * cut(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), 2)
            table += step
            total += step[b]

    def two_way(i, j, values):
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        flat = bins[:, i] * shape[1] + bins[:, j]
        return np.bincount(flat, values, shape[0] * shape[1]).reshape(shape)

    g, h = gradient()
    able = [i for i, e in enumerate(edges) if len(e)]
    ranked = sorted(combinations(able, 2),
                    key=lambda p: -cross(two_way(*p, g), two_way(*p, h))[1])[:pairs]
    chosen = [((i, j), np.zeros((len(edges[i]) + 1, len(edges[j]) + 1))) for i, j in ranked]
    for _ in range(rounds // 2):
        for (i, j), table in chosen:
            g, h = gradient()
            step = rate * cross(two_way(i, j, g), two_way(i, j, h))[0]
            table += step
            total += step[bins[:, i], bins[:, j]]
    model.tables += chosen
    return model


def held_out(doc_id: Column, of: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          label: str = "quality", most: int = MOST) -> Model:
    """Fits on at most `most` labelled documents that are not held out, chosen by hash of the id."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    # at most `most` rows of two numbers
    found = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(
        F.broadcast(chosen), "id")

    def measure(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": list(feature_table(b["text"]))})

    id_type = docs.schema[doc_id].dataType.simpleString()
    at = found.mapInPandas(measure, f"id {id_type}, y double, x array<double>")
    # repeated rows of a document would break the bound, so one of each stays
    held = at.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.*").toPandas()
    held = held.sort_values("id")
    x = np.array(held["x"].tolist(), float).reshape(len(held), len(FEATURES))
    return fit(x, held["y"].to_numpy(float))


def classify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id",
             limit: float = LIMIT) -> DataFrame:
    """Every row with held_out, score (0 to 1) and predicted (1 from `limit` on).

    A null text counts as empty; a text without words gets the score of zero features. A null id is
    not held out. An empty table gives an empty result. Given columns named as the results are
    replaced.
    """
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_table(texts)), dtype="float64")

    scored = rows(docs, id=F.col(doc_id), text=text_of(text)).select(
        "row", held_out(F.col("id")).alias("held_out"), score("text").alias("score"))
    return unpacked(scored.withColumn("predicted", (F.col("score") >= limit).cast("int")),
                    ["held_out", "score", "predicted"])
