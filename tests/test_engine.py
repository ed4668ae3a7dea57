from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newswake.api import Engine
from newswake.operators import patterns as pt, trust as tr
from newswake.operators.labels import starter_registry, rule_labels


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    prices = [(c, day(n), c, round(100.0 + (n * 7 + i * 3) % 11 + (40 if n == 300 else 0), 2))
              for i, c in enumerate(("000001", "000002")) for n in range(320)]
    news = [(f"u{n}", f"t{n}", "갑, 을", "x.y,other", day(n)) for n in range(310)]
    filings = [(f"d{n}", "K1", day(n), "x.y") for n in range(310)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}")
    write(prices, "stock_code string, trade_date date, stock_name string, close_price double", "prices")
    write(news, "news_id string, news_title string, companies string, event_codes string, news_date date", "news")
    write([("갑", "000001"), ("을", "000002")], "company string, stock_code string", "alias_map")
    write([("000001", "K1", "갑", "KRX")], "stock_code string, corp_code string, corp_name string, market string",
          "stock_list")
    write([("r1", "K1", day(299), "공급계약체결", "B", "", "을")], "rcept_no string, corp_code string, "
          "rcept_date date, report_nm string, pblntf_ty string, rm string, counterparty string", "disclosures")
    e = Engine(spark, root)
    e.labelled = spark.createDataFrame(filings, "rcept_no string, corp_code string, event_date date, event_code string")
    return e


def test_histories_scans_and_reads(engine):
    engine.build_news_returns("2024-01-01", "2024-11-05")
    engine.build_news_returns("2024-01-01", "2024-11-05")
    stored = engine.table("news_returns")
    assert stored.count() == stored.select("news_id", "stock_code", "event_code").distinct().count() == 620
    counters = {r.status: r["count"] for r in engine.build_event_history(engine.labelled, "2024-01-01").collect()}
    assert counters == {"saved": 310}
    engine.scan_range("2024-10-20", "2024-10-31", "2024-10-31")
    engine.scan("2024-10-26")
    gaps = engine.table("news_gaps")
    assert gaps.count() == gaps.select("news_id", "stock_code", "event_code", "horizon").distinct().count() > 0
    assert set(r.direction for r in gaps.collect()) <= {"OVER", "UNDER"}
    assert engine.backfill("2024-10-20", "2024-10-31", save=False).count() > 0
    assert engine.scan_recent("2024-10-31", 24 * 12).count() > 0
    top = engine.check_gaps("000001", "2024-10-31", 30).collect()
    assert top and abs(top[0].z_score) == max(abs(r.z_score) for r in top)
    total = {r.kind: r["count"] for r in engine.gap_stats("2024-10-31", 30).collect() if r.kind == "total"}
    assert total["total"] == engine.simple_stats("2024-10-31", 30).head().total_count
    assert engine.list_gaps("2024-10-31", days=30, limit=3).count() <= 3
    assert {r.stock_code for r in engine.check_summary("2024-10-31", 30).collect()} == {"000001", "000002"}


def test_index_search_verify_patterns(spark, engine):
    rows = [(f"삼성 실적 발표 {n}", f"2024.10.{n:02d}", "연합뉴스" if n % 2 else "MBN", "경제",
             f"http://n.com/a?oid=1&aid={n}", "갑", "삼성 실적 개선 발표 기사 본문") for n in range(10, 20)]
    schema = "title string, published_at string, publisher string, category string, url string, stock_name string, body string"
    engine.index(spark.createDataFrame(rows, schema))
    engine.index(spark.createDataFrame(rows[:3], schema))
    assert engine.table("documents").count() == 10
    hits = engine.search("최근 한달 삼성 실적", "2024-10-31", companies=["갑"]).collect()
    assert len(hits) == 10 and hits[0].score >= hits[-1].score > 0
    v = engine.verify_rumor("최근 한달 삼성 실적 발표", "2024-10-31", companies=["갑"], event_phrases=["실적 발표"]).head()
    assert v.exact_n == 10 and v.temporal == 1.0 and v.support == 0.5 and v.level == "HIGH"
    assert len(v.evidence) == 10 and [e.rank for e in v.evidence] == list(range(1, 11))
    v = engine.verify_rumor("최근 한달 삼성 실적 발표", "2024-10-31", companies=["갑"], event_phrases=["실적 발표"],
                            corp_codes=["K1"]).head()
    assert v.disclosure > 0
    both = engine.verify_gaps("최근 한달 삼성 실적 발표", "000001", "2024-10-31", 30, companies=["갑"]).head()
    assert both.gap_signals is not None
    top, found = engine.analyze_patterns("2024-10-31", ["갑"], [], 365, 0.3)
    assert top.count() == 10
    kinds = {r.pattern_type: r for r in found.collect()}
    assert kinds["frequent_company"].frequency == 10 and kinds["recent_spike"].confidence == 1.0


def test_starter_labels(spark):
    df = spark.createDataFrame([("대규모 유상 증자 후 합병",), ("날씨 맑음",)], "t string")
    got = [r.x for r in df.select(rule_labels(F.col("t"), starter_registry()).alias("x")).collect()]
    assert got == [["company.mna_merger", "company.mna_deal"], []]


def test_trust_ladder_steps(spark):
    rows = [(n, 0, n, 1, 0.0, 0.0, 0.0) for n in (1, 2, 3, 5, 10)] + [(0, 2, 2, 0, 0.0, 25.0, 0.0), (0, 0, 3, 0, 0.0, 0.0, 15.0),
            (0, 0, 0, 0, 0.0, 0.0, 0.0), (5, 0, 9, 5, 35.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "e int, p int, r int, u int, es double, ps double, ts double")
    got = [round(x[0], 4) for x in df.select(tr.base_score(*[F.col(c) for c in ("e", "p", "r", "u", "es", "ps", "ts")])).collect()]
    assert got == [0.5, 0.65, 0.75, 0.85, 0.9, 0.38, 0.1, 0.0, 0.95]


def test_quarterly_cases(spark):
    t = [datetime(2024, 1, 1) + timedelta(days=90 * i) for i in range(6)]
    cases = spark.createDataFrame([(x, ["a"], ["e"]) for x in t], "published_at timestamp, companies array<string>, event_codes array<string>")
    got = {r.pattern_type: r.value for r in pt.insights(cases, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got == {"frequent_company": "a", "frequent_event": "e", "quarterly_pattern": "90"}


def test_tickers_companies_of_a_text_and_folders_of_lexicons(spark, engine, tmp_path):
    import json

    from newswake.sources import lexicons as lx

    docs = engine.table("documents").select("companies", "tickers").distinct().collect()
    assert docs and all(list(r.tickers) == ["000001"] for r in docs)
    assert engine.companies_in("anything", ["b", "a", "b"]) == ["b", "a"]
    spark.createDataFrame([("Acme Robotics", "Acme Robotics", 0.9)], "alias string, company string, weight double").write.parquet(
        engine.path("company_patterns"))
    spark.createDataFrame([("Acme Robotics", "IT", "listed")], "name string, sector string, type string").write.parquet(
        engine.path("company_master"))
    text = "Acme Robotics said that Acme Robotics would build a plant"
    assert engine.companies_in(text, ["given"]) == ["given", "Acme Robotics"]
    for name, data in (("1.json", {"signal": {"a": ["x"], "b": ["y"]}}), ("2.json", {"signal": {"b": ["z"]}, "more": {"c": ["w"]}})):
        (tmp_path / name).write_text(json.dumps(data))
    assert lx.keyword_lexicon(spark, str(tmp_path)) == {"signal": {"a": ["x"], "b": ["z"]}, "more": {"c": ["w"]}}
