"""Steps whose time was too large at size: how they are planned, and that their results are whole."""

from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newswake.functions import text as tx
from newswake.llm import simhash as sh
from newswake.operators import companies as co
from newswake.plans import stream_queries as sq
from newswake.streaming import stateful as st


def test_f22_phrases_are_given_on_in_bounded_pieces_and_not_made_by_lambdas(spark):
    rng = random.Random(22)
    texts = [" ".join(rng.choice(["ab", "abc", "삼성", "x1", "q", "ab-c"]) for _ in range(rng.randrange(40))) for _ in range(50)]
    expected = []
    for text in texts:
        words = [w for w in text.replace("-", " ").split() if len(w) > 1]
        runs = [words[i:i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        expected.append(sorted({sep.join(run) for run in runs for sep in ("", " ")}))
    pieces = list(tx._phrase_lists(iter([pd.Series(texts)]), most=1000))
    assert len(pieces) > 5 and all(piece.str.len()[:-1].sum() < 1000 for piece in pieces)
    assert [x.split("|") if x else [] for piece in pieces for x in piece] == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = docs.select("i", tx.keyphrases(F.col("text")).alias("p"), tx.joined_keyphrases(F.col("text")).alias("j"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.orderBy("i").collect()
    assert [r.p for r in rows] == expected and [r.j for r in rows] == ["|".join(e) for e in expected]


def test_f23_throttle_deals_keys_over_buckets_and_files_grow_with_events(spark, tmp_path, monkeypatch):
    rng = random.Random(23)
    made = [(f"k{rng.randrange(40)}", n, n // 200, rng.randrange(0, 40)) for n in range(600)]
    made = [(k, n, batch, 3600 * (1 + 24 * 10 * batch + hour)) for k, n, batch, hour in made] + [(None, 700 + n, 0, 1800 * (n + 1)) for n in range(20)]
    for batch in range(3):
        (spark.createDataFrame([r for r in made if r[2] == batch], "k string, n long, batch int, s long")
         .select("k", "n", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/batch={batch}"))
    schema = "k string, n long, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/batch=*")
    alerts = st.throttled(stream, "k", "n", "at", timedelta(hours=12), "10 days", buckets=5)
    assert "_bucket" in alerts._jdf.queryExecution().analyzed().toString()
    st.append_to(alerts, f"{tmp_path}/found", f"{tmp_path}/state")
    until, last, want = max(s for *_, s in made) - 10 * 86400, {}, set()
    for s, n, k in sorted((s, n, k) for k, n, _, s in made):
        if s <= until and (k not in last or s >= last[k] + 12 * 3600):
            last[k] = s
            want.add((k, n, s))
    found = spark.read.parquet(f"{tmp_path}/found").select("k", "n", F.unix_seconds("at"))
    got = [tuple(r) for r in found.collect()]
    assert len(want) > 100 and set(got) - want == set() and want - set(got) == set() and len(got) == len(want)

    monkeypatch.setattr(sq, "ROWS_A_FILE", 300)
    spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"),
                             F.lit(1.0).alias("value"), F.timestamp_seconds(1704067200 + F.col("id") % 30 * 86400).alias("ts")
                             ).write.parquet(f"{tmp_path}/sf/events.parquet")
    sq.arriving(spark, f"{tmp_path}/sf", f"{tmp_path}/events")
    assert [len(list((tmp_path / "events" / f"batch={n}").glob("*.parquet"))) for n in range(3)] == [2, 2, 2]
    monkeypatch.setattr(sq, "ROWS_A_FILE", 100)
    sq.arriving(spark, f"{tmp_path}/sf", f"{tmp_path}/more")
    counts = [len(list((tmp_path / "more" / f"batch={n}").glob("*.parquet"))) for n in range(3)]
    assert counts[0] > 2 and len(set(counts)) == 1


def test_f24_texts_meet_the_dictionary_once_and_by_hashes_of_their_runs(spark):
    rng = random.Random(24)
    names = sorted({"".join(rng.choice("abA삼İ😀") for _ in range(rng.randrange(1, 13))) for _ in range(60)})
    texts = ["".join(rng.choice([*names, "a", " ", "B"]) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(None if n % 10 == 3 else (1 << 60) + n // 2, t) for n, t in enumerate(texts)], "doc_id long, text string")
    found = co.dictionary_hits(docs, spark.createDataFrame([(n,) for n in names], "alias string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "replace(" not in plan
    want = [(i, n, t.lower().count(n.lower())) for i, t in docs.collect() if t for n in names if n.lower() in t.lower()]
    assert len(want) > 300 and sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_pipeline_sketches_rule_out_no_pair_that_is_alike(spark):
    rng = np.random.default_rng(25)
    base, rows = rng.integers(0, 1 << 64, 400, dtype=np.uint64), []
    for gone in range(0, 160, 4):
        other = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 64, gone // 2, dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        rows.append((gone, len(base), len(other), sh.sketch(base).tolist(), sh.sketch(other).tolist(), both / (len(base) + len(other) - both)))
    pairs = spark.createDataFrame(rows, "i int, size_x int, size_y int, sketch_x array<long>, sketch_y array<long>, j double")
    found = pairs.select("j", sh.sketches_allow(0.8).alias("may")).collect()
    assert all(r.may for r in found if r.j >= 0.8) and not any(r.may for r in found if r.j < 0.7)
