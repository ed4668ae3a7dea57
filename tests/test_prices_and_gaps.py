import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from newswake.functions.dates import as_date
from newswake.functions.scores import direction, log_return, magnitude
from newswake.operators import expectation as ex, gaps as gp, prices as pr
from newswake.operators.news import explode_news
from newswake.plans import study


def day(n):
    return date(2024, 1, 1) + timedelta(days=n)


@pytest.fixture(scope="module")
def series():
    rng = random.Random(7)
    rows = []
    for code in ("000001", "000002", "00104K"):
        for n in sorted(rng.sample(range(120), 60)):
            rows.append((code, day(n), round(100 + 30 * rng.random(), 2)))
    rows.append(("000009", day(10), 50.0))
    rows += [("000008", day(n), p) for n, p in enumerate([10.0, 0.0, 12.0])]
    return rows


def brute_anchor(series, code, d, pad=None):
    own = sorted((t, p) for c, t, p in series if c == code)
    for i, (t, p) in enumerate(own):
        if t >= d:
            if pad is not None and t > d + timedelta(days=pad):
                return None
            out = []
            for h in (1, 3, 5):
                later = own[i + h] if i + h < len(own) else None
                ok = later and p > 0 and later[1] > 0 and (
                    pad is None or later[0] <= d + timedelta(days=pad))
                out.append(math.log(later[1] / p) if ok else None)
            return t, p, out
    return None


@pytest.mark.parametrize("pad", [None, 5])
def test_anchor_calendar_is_the_forward_as_of_join(spark, series, pad):
    px = spark.createDataFrame(series, "stock_code string, trade_date date, close_price double")
    cal = pr.anchor_calendar(px, as_date("2023-12-20"), pad_days=pad)
    got = {(r.stock_code, r.event_date): r for r in cal.collect()}
    assert len(got) == cal.count()
    for code in ("000001", "000002", "00104K", "000009", "000008"):
        for n in range(-12, 125):
            want = brute_anchor(series, code, day(n), pad)
            row = got.get((code, day(n)))
            if want is None:
                assert row is None
                continue
            assert (row.anchor_date, row.anchor_price) == want[:2]
            for h, r in zip((1, 3, 5), want[2]):
                mine = row[f"return_{h}d"]
                assert (mine is None) == (r is None) and (r is None or abs(mine - r) < 1e-12)


def test_pad_code_keeps_long_codes(spark):
    df = spark.createDataFrame([("5930",), ("00104K",), ("1234567",)], "c string")
    got = [r[0] for r in df.select(pr.pad_code(F.col("c"))).collect()]
    assert got == ["005930", "00104K", "1234567"]


def test_log_return_guards_prices(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(log_return(F.col("a"), F.col("b"))).collect()]
    assert got == [math.log(2.0), None, None, None]


def test_direction_and_magnitude_at_the_edges(spark):
    df = spark.createDataFrame([(3.0,), (2.0,), (-2.0,), (1.0,), (0.5,), (0.0,), (None,)], "z double")
    z = F.col("z")
    got = df.select(direction(z), magnitude(z), magnitude(z, False)).collect()
    assert [tuple(r) for r in got] == [
        ("OVER", "EXTREME", "EXTREME"), ("OVER", "HIGH", "HIGH"), ("UNDER", "HIGH", "HIGH"),
        ("OVER", "MODERATE", "MODERATE"), ("OVER", "LOW", "MODERATE"),
        ("UNDER", "LOW", "MODERATE"), (None, None, None)]


def test_explode_news_drops_other_and_blank_and_keeps_repeats(spark):
    rows = [("a", "A, B ,,A", "x.y,OTHER, ", day(1)), ("b", "A", "other", day(1)), ("c", None, "x", day(1))]
    df = spark.createDataFrame(rows, "news_id string, companies string, event_codes string, news_date date")
    got = sorted((r.news_id, r.company, r.event_code) for r in explode_news(df).collect())
    assert got == [("a", "A", "x.y"), ("a", "A", "x.y"), ("a", "B", "x.y")]


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(3)
    rows = []
    for code, n in (("e.nine", 9), ("e.ten", 10), ("e.forty", 49), ("e.fifty", 50), ("f.hot", 400)):
        for i in range(n):
            r1 = round(rng.gauss(0.01, 0.05), 6)
            rows.append((code, day(i % 100), r1, None if i % 3 else round(r1 * 2, 6), None))
    rows += [("e.flat", day(i), 0.5, None, None) for i in range(60)]
    return rows


SCHEMA = "event_code string, event_date date, return_1d double, return_3d double, return_5d double"


def test_expectation_stats_match_numpy(spark, history):
    import numpy as np
    df = spark.createDataFrame(history, SCHEMA)
    got = {(r.event_code, r.horizon): r for r in
           ex.expectation_stats(df, as_date("2024-12-01"), 365, 10).collect()}
    assert ("e.nine", 1) not in got and ("e.ten", 1) in got
    for (code, h), r in got.items():
        x = np.array([row[2 if h == 1 else 3] for row in history if row[0] == code], dtype=float)
        x = x[~np.isnan(x)]
        assert r.sample_count == len(x) and r.confidence == min(1.0, len(x) / 100)
        for mine, want in ((r.mean, x.mean()), (r.median, np.median(x)), (r.std, x.std(ddof=1)),
                           (r.q25, np.percentile(x, 25)), (r.q75, np.percentile(x, 75))):
            assert mine == pytest.approx(want, abs=1e-9)


def test_rolling_stats_equal_the_stats_of_each_day(spark, history):
    df = spark.createDataFrame(history, SCHEMA)
    rolled = {(r.stat_key, r.day): r for r in
              ex.rolling_event_stats(df, 20, "event_date").collect()}
    for k in (0, 5, 37, 99):
        one = {r.stat_key: r for r in
               ex.event_stats(df, as_date(day(k)), 20, "event_date").collect()}
        for code, r in one.items():
            if (code, day(k)) in rolled:
                got = rolled[(code, day(k))]
                assert got.cnt == r.cnt and got.mean == pytest.approx(r.mean, abs=1e-12)
                assert got["std"] == pytest.approx(r["std"], abs=1e-9)


def test_empirical_percentile_is_strict_and_exact(spark, history):
    df = spark.createDataFrame(history, SCHEMA)
    asked = [("f.hot", 1, v) for v in (-1.0, 0.0, 0.0123456, 1.0)]
    asked += [("f.hot", 1, r[2]) for r in history if r[0] == "f.hot"][:20]
    asked += [("unknown", 1, 0.1), ("e.flat", 1, 0.5), ("e.flat", 1, 0.5000001)]
    sig = spark.createDataFrame(asked, "event_code string, horizon int, actual_return double")
    got = ex.empirical_percentile(sig, df).collect()
    assert len(got) == len(asked)
    for r in got:
        x = [row[2] for row in history if row[0] == r.event_code]
        want = sum(v < r.actual_return for v in x) / len(x) if x else 0.5
        assert r.percentile == pytest.approx(want, abs=1e-12)


def test_history_gate_needs_fifty_samples_and_a_spread(spark, history):
    df = spark.createDataFrame(history, SCHEMA)
    stats = ex.expectation_stats(df, as_date("2024-12-01"), 365, 10, (1,))
    facts = spark.createDataFrame(
        [(f"n{i}", "t", "000001", "A", code, day(3), day(3), 9.9) for i, code in
         enumerate(("e.ten", "e.forty", "e.fifty", "e.flat", "f.hot"))],
        "news_id string, news_title string, stock_code string, stock_name string, event_code string, "
        "news_date date, anchor_date date, return_1d double")
    got = {r.event_code for r in gp.detect_history(facts, stats).collect()}
    assert got == {"e.fifty", "f.hot"}


def test_backfill_is_the_daily_scan_of_each_day(spark, series):
    rng = random.Random(11)
    names = {"A": "000001", "B": "000002", "K": "00104K"}
    news = [(f"n{i}", "t", rng.choice(["A", "B,K", "A,Z"]), rng.choice(["x.a", "x.b,other"]),
             day(rng.randrange(0, 100))) for i in range(400)]
    news_df = spark.createDataFrame(
        news, "news_id string, news_title string, companies string, event_codes string, news_date date")
    alias = spark.createDataFrame(list(names.items()), "company string, stock_code string")
    px = spark.createDataFrame(series, "stock_code string, trade_date date, close_price double")
    stored = study.build_news_returns(news_df, alias, px, day(0), day(99))
    rules = gp.GapRules(z_threshold=1.0)
    pick = lambda df: sorted((r.news_id, r.stock_code, r.event_code, round(r.z_score, 8))
                             for r in df.collect())
    whole = pick(study.backfill(news_df, alias, px, stored, day(40), day(44), rules))
    by_day = []
    for n in range(40, 45):
        by_day += pick(study.scan_simple(news_df, alias, px, stored, day(n), day(n), day(n), rules))
    assert whole == sorted(by_day) and whole


def test_fallback_prefers_history_and_fills_with_simple(spark):
    facts = spark.createDataFrame(
        [("h", "both", 3.0), ("s", "only_simple", 3.0), ("w", "weak_history", 3.0), ("n", "none", 3.0)],
        "news_id string, event_code string, return_1d double").withColumns({
            "news_title": F.lit("t"), "stock_code": F.lit("1"), "stock_name": F.lit("A"),
            "news_date": as_date("2024-01-01"), "date_1d": as_date("2024-01-02")})
    hist = spark.createDataFrame(
        [("both", 1, 0.0, 1.0, 60, 0.6), ("weak_history", 1, 2.9, 1.0, 60, 0.6)],
        "event_code string, horizon int, median double, std double, sample_count long, confidence double")
    simple = spark.createDataFrame(
        [("both", 0.0, 1.0, 20), ("only_simple", 0.0, 1.0, 20), ("weak_history", 0.0, 1.0, 20),
         ("none", 0.0, 1.0, 5)], "stat_key string, mean double, std double, cnt long")
    got = {r.news_id: r.calc_mode for r in gp.detect_with_fallback(facts, hist, simple).collect()}
    assert got == {"h": "HISTORY", "s": "SIMPLE", "w": "SIMPLE"}


def test_stored_counts_equal_the_history(spark, tmp_path):
    import random
    from datetime import date, timedelta

    from newswake.operators import event_store as st, expectation as ex

    rng = random.Random(2)
    rows = [(f"e{rng.randint(0, 3)}", date(2024, 1, 1) + timedelta(days=rng.randint(0, 200)),
             *[None if rng.random() < 0.1 else round(rng.gauss(0, 0.05), 6) for _ in range(3)]) for _ in range(3000)]
    rows += [("e0", None, 0.1, 0.1, 0.1), ("e1", date(2024, 2, 3), None, None, None), ("big", date(2024, 3, 1), 9999.0, -9999.0, 0.0)]
    history = spark.createDataFrame(rows, "event_code string, event_date date, return_1d double, return_3d double, return_5d double")
    path = str(tmp_path / "counts")
    assert st.opened(spark, path) is None
    st.update(history.filter("event_date < '2024-04-10'"), path, "event_date")
    st.update(history, path, "event_date", ["2024-04", "2024-05", "2024-06", "2024-07"])
    store = st.opened(spark, path)
    dated = history.filter("event_date is not null")
    for first, last in (("2024-01-15", "2024-06-20"), ("2024-03-02", "2024-03-09"), (None, "2024-02-29"), ("2024-07-01", None), (None, None)):
        want = dated.filter(f"event_date >= '{first or '2000-01-01'}' and event_date <= '{last or '2100-01-01'}'")
        count = lambda df: sorted(map(tuple, df.select("event_code", "horizon", "ret", "n").collect()))
        assert count(ex.on_grid(store.counts(first, last))) == count(ex.value_counts(ex.unpivot_returns(want)))
    signals = spark.createDataFrame([(i, f"e{i % 5}", 1, x) for i, x in enumerate([0.0, 0.01, -0.049999, 0.05, None, 5.0, -5.0, 0.0123456])],
                                    "i int, event_code string, horizon int, actual_return double")
    got = {r.i: r.percentile for r in ex.percentile_of_counts(signals, store.counts()).collect()}
    for i, code, _, x in signals.collect():
        known = [r[2] for r in rows if r[0] == code and r[1] is not None and r[2] is not None]
        want = 0.5 if x is None or not known else sum(k < x for k in known) / len(known)
        assert abs(got[i] - want) < 1e-12
    plan = store.counts("2024-03-02", "2024-05-09")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(month") == 2 or "month" in plan.split("PartitionFilters")[1]


def test_signals_of_a_percentile_move_without_the_totals_of_their_event(spark):
    rng = random.Random(8)
    values = sorted({round(rng.gauss(0, 0.2), 6) for _ in range(4000)} | {-9999.0, 9999.999999, 0.0})
    history = spark.createDataFrame([("e", v) for v in values for _ in range(1 + int(v * 1e6) % 3)],
                                    "event_code string, return_1d double")
    asked = [float("nan"), None, -1e5, 1e5, -9999.0, 9999.999999, 10.0, -10.0, 0.1, 0.10000001]
    asked += [rng.choice(values) + rng.choice((-1e-7, 0.0, 1e-7)) for _ in range(300)]
    signals = spark.createDataFrame([(i, "e", 1, x) for i, x in enumerate(asked)],
                                    "i int, event_code string, horizon int, actual_return double")
    out = ex.empirical_percentile(signals, history)
    known = [v for v in values for _ in range(1 + int(v * 1e6) % 3)]
    for r in out.collect():
        x = asked[r.i]
        want = 0.5 if x is None or math.isnan(x) else sum(round(v, 6) < x for v in known) / len(known)
        assert r.percentile == pytest.approx(want, abs=1e-12), x
    # one array a bucket, of at most BUCKET values; none of an event's totals
    assert "_totals" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pad", [None, 5])
def test_facts_meet_prices_by_month(spark, series, pad):
    px = spark.createDataFrame(series, "stock_code string, trade_date date, close_price double")
    codes = ("000001", "000002", "00104K", "000009", "000008")
    facts = spark.createDataFrame([(c, day(n), n) for c in codes for n in range(-12, 125)] + [("000001", None, 999)],
                                  "stock_code string, news_date date, n int")
    out = pr.with_anchor(facts, px, as_date("2023-12-20"), pad_days=pad, how="left")
    got = {(r.stock_code, r.n): r for r in out.collect()}
    assert len(got) == facts.count() == out.count()
    for code, n in got:
        want = brute_anchor(series, code, day(n), pad) if n != 999 else None
        row = got[code, n]
        assert (row.anchor_date, row.anchor_price) == (want[:2] if want else (None, None))
        for h, r in zip((1, 3, 5), want[2] if want else (None, None, None)):
            mine = row[f"return_{h}d"]
            assert (mine is None) == (r is None) and (r is None or abs(mine - r) < 1e-12)
    # a price row is repeated for the months its days lie in, not for its days
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(((year(" in plan and "explode(sequence(start" not in plan
