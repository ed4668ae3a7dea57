"""Regression tests for faults of the first round."""

from __future__ import annotations

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from newswake.functions import dates, text as tx
from newswake.operators import companies as co, patterns as pt, prices as pr
from newswake.plans import study
from newswake.sources import writers


def test_repeated_price_days_are_one_day(spark):
    days = [(date(2024, 1, d), c) for d, c in ((2, 100.0), (2, 150.0), (3, 103.0), (4, 110.0), (5, 90.0))]
    df = spark.createDataFrame([("A", d, c, "n") for d, c in days],
                               "stock_code string, trade_date date, close_price double, stock_name string")
    got = pr.anchor_calendar(df, F.lit("2024-01-02").cast("date"), (1,)).filter("event_date = '2024-01-02'").collect()
    assert [r.anchor_price for r in got] == [100.0]
    assert abs(got[0].return_1d - 0.029559) < 1e-6
    path = pr.price_path(df, F.lit("2024-01-01").cast("date"), 3).orderBy("step").collect()
    assert [r.close_price for r in path] == [100.0, 103.0, 110.0]
    same = df.filter("trade_date = '2024-01-02'")
    change = pr.first_last_change(same, F.lit("2024-01-01").cast("date"), F.lit("2024-01-09").cast("date"))
    assert [r.change_pct for r in change.collect()] == [None]


def upserted(spark, path, *batches):
    for rows in batches:
        writers.upsert_table(spark.createDataFrame(rows, "k string, d date, x int"), path, ["k"], "d")
    return sorted((tuple(r) for r in spark.read.parquet(path).select("k", "d", "x").collect()), key=str)


def test_upsert_keeps_rows_without_a_date(spark, tmp_path):
    got = upserted(spark, str(tmp_path / "t"), [("a", None, 1), ("b", None, 2)], [("a", None, 3)])
    assert got == [("a", None, 3), ("b", None, 2)]


def test_upsert_moves_a_key_to_its_new_month(spark, tmp_path):
    jan, feb = date(2024, 1, 31), date(2024, 2, 1)
    assert upserted(spark, str(tmp_path / "alone"), [("a", jan, 1)], [("a", feb, 2)]) == [("a", feb, 2)]
    got = upserted(spark, str(tmp_path / "t"), [("a", jan, 1), ("c", jan, 1), ("b", None, 1)],
                   [("a", feb, 2), ("b", feb, 2)])
    assert got == [("a", feb, 2), ("b", feb, 2), ("c", jan, 1)]


def test_instants_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([("2024-10-31 05:00:00",), ("2024.10.31",), ("2024-1-2",), ("2024-13-01",), ("x",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    found = []
    try:
        for zone in ("UTC", "Asia/Seoul", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            at = dates.published_at(F.col("t"))
            found.append([tuple(r) for r in df.select(F.unix_timestamp(at), dates.seoul_text(at)).collect()])
            midnight = dates.seoul_midnight(F.lit("2024-10-31").cast("date"))
            assert spark.range(1).select(F.unix_timestamp(midnight)).first()[0] == 1730300400
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == found[2]
    assert found[0][:2] == [(1730318400, "2024-10-31 05:00:00"), (1730300400, "2024-10-31 00:00:00")]
    assert [x for x, _ in found[0][3:]] == [None, None]


def test_nothing_is_cut(spark):
    long = "w" * 900
    df = spark.createDataFrame([(long + "a",), (long + "b",)], "t string")
    assert df.select(tx.text_key(F.col("t"))).distinct().count() == 2
    words = " ".join(f"w{i:02d}" for i in range(40))
    assert spark.createDataFrame([(words,)], "t string").select(F.size(tx.keyphrases(F.col("t")))).first()[0] > 32


def test_news_ids_that_share_a_long_start_stay_apart(spark):
    head = "x" * 300
    news = spark.createDataFrame([(head + s, "t", ["co"], ["e.x"], date(2024, 1, 2)) for s in "ab"],
                                 "news_id string, title string, companies array<string>, events array<string>, news_date date")
    rows = news.select("news_id", F.lit("A").alias("stock_code"), F.lit("e").alias("event_code"), "title")
    assert study._first(rows, ["news_id", "stock_code", "event_code"]).count() == 2
    twice = rows.unionByName(rows.withColumn("title", F.lit("s")))
    assert {r.title for r in study._first(twice, ["news_id", "stock_code", "event_code"]).collect()} == {"s"}


def test_patterns_count_all_matches(spark):
    rows = [(f"{i:03d}", ["co"], ["e"], datetime(2024, 1, 1 + i % 28, i % 24), None) for i in range(150)]
    docs = spark.createDataFrame(rows, "id string, companies array<string>, event_codes array<string>, "
                                       "published_at timestamp, trust_outcome string")
    ends = F.lit("2023-12-01").cast("timestamp"), F.lit("2024-12-01").cast("timestamp")
    cases = pt.similar_cases(docs, ["co"], ["e"], *ends)
    assert cases.count() == 150 and pt.mean_similarity(cases).first().n == 150
    assert pt.frequent(cases, "companies").first()["count"] == 150
    assert pt.similar_cases(docs, ["co"], ["e"], *ends, size=10).count() == 10


def test_mean_interval_over_blocks(spark):
    at = [datetime(2024, m, d, h) for m in (1, 2, 5, 11) for d, h in ((1, 0), (3, 5), (3, 5), (20, 23))]
    df = spark.createDataFrame([(t,) for t in at] + [(None,)], "published_at timestamp")
    got = pt.mean_interval(df).first()
    at.sort()
    want = sum((b - a).days for a, b in zip(at, at[1:])) / (len(at) - 1)
    assert (got.n, got.mean_gap) == (len(at), want)
    assert pt.mean_interval(df.limit(0)).count() == 0


def test_both_ways_of_counting_mentions_agree(spark, monkeypatch):
    from newswake.operators import companies as co
    docs = spark.createDataFrame([(1, "a b a"), (2, "bb A b"), (3, None)], "doc_id int, text string")
    names = spark.createDataFrame([("a",), ("a b",), ("b",)], "alias string")
    got = sorted(map(tuple, co.count_mentions(docs, names).collect()))
    monkeypatch.setattr(co, "MAX_DICTIONARY_BYTES", 1)
    assert sorted(map(tuple, co.count_mentions(docs, names).collect())) == got
    assert got == [(1, "a", 2), (1, "a b", 1), (1, "b", 1), (2, "a", 1), (2, "a b", 1), (2, "b", 3)]


def test_files_of_one_folder_in_different_charsets(spark, tmp_path):
    from newswake.sources import readers
    (tmp_path / "a.csv").write_text("이름,n\n삼성,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("이름,n\n" + "plain,0\n" * 50 + "현대,2\n", encoding="cp949")
    got = {r["이름"] for r in readers.delimited(spark, str(tmp_path)).collect()}
    assert got == {"삼성", "plain", "현대"}
    (tmp_path / "c.csv").write_bytes(b"x\n\xff\xff\xff\n")
    try:
        readers.delimited(spark, str(tmp_path))
    except ValueError as e:
        assert "c.csv" in str(e)
    else:
        raise AssertionError("a file in no known charset must be refused")


def test_words_around_json(spark):
    df = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("{broken",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.json_block(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None, None]
    df = spark.createDataFrame([('["A", "B", "A"]',), ("1. A\n- B\n\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.company_list(F.col("t"))).collect()] == [["A", "B"], ["A", "B"], [], []]


def test_large_dictionaries_give_the_same_companies(spark, monkeypatch):
    rng = random.Random(5)
    letters = "ab 가나"
    docs = spark.createDataFrame(
        [(i, "".join(rng.choice(letters) for _ in range(40)), [rng.choice(["ab가", "가나", "x y", " 나a "]), None])
         for i in range(30)] + [(30, None, None), (31, "", []), (None, "ab가 가나", ["가나"])],
        "doc_id long, text string, said array<string>")
    patterns = spark.createDataFrame(
        [("ab", "ab가", 0.8), ("ab가", "ab가", 0.9), ("가나", "가나", 0.9), ("나", "가나", 0.7), ("AB", "BA", 0.8),
         ("나a", "가나", 0.75), ("없음", "x y", 0.6)], "alias string, company string, weight double")
    master = spark.createDataFrame([("ab가", "IT"), ("가나", "금융"), ("x y", None), ("only", "IT")],
                                   "name string, sector string")

    def found():
        spans = sorted(map(str, co.mentions(docs, patterns).collect()))
        facts = sorted(map(str, co.company_facts(docs, patterns, master, provider_col="said").collect()))
        return spans, facts

    small = found()
    monkeypatch.setattr(co, "MAX_DICTIONARY_BYTES", 1)
    assert found() == small
    assert len(small[0]) > 50 and len(small[1]) > 50


def test_repeated_and_missing_ids_do_not_depend_on_the_size_of_the_dictionary(spark, monkeypatch):
    texts = [(1, "ab ab x"), (1, "AB"), (None, "cd cd and cdcd"), (1, "ab ab x"), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    aliases = spark.createDataFrame([("ab",), ("cd",)], "alias string")
    patterns = spark.createDataFrame([("ab", "ab", 0.9), ("cd", "Cdco", 0.8)], "alias string, company string, weight double")
    master = spark.createDataFrame([("ab", "IT"), ("Cdco", None)], "name string, sector string")

    def found():
        return [sorted(map(str, f(docs).collect())) for f in (
            lambda d: co.count_mentions(d, aliases), lambda d: co.mentions(d, patterns),
            lambda d: co.company_facts(d, patterns, master))]

    small = found()
    monkeypatch.setattr(co, "MAX_DICTIONARY_BYTES", 0)
    assert found() == small
    assert small[0].count("Row(doc_id=1, alias='ab', hits=2)") == 2
    assert "Row(doc_id=None, alias='cd', hits=4)" in [r.replace("nan", "None") for r in small[0]]
