"""Disclosure signals, article tone, relevance to a rumor, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions import words
from newswake.functions.scores import clamp
from newswake.functions.text import company_key, counterparties, has_any, keyword_hits, let, text_array


def first_receipts(disclosures: DataFrame, keys: Sequence[str] = ("corp_code", "rcept_no"),
                   order: str = "source_rank") -> DataFrame:
    """One row per receipt: stored rows before live ones."""
    values = [c for c in disclosures.columns if c not in keys]
    return (disclosures.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("r"))
            .select(*keys, "r.*"))


def union_sources(stored: DataFrame, live: DataFrame) -> DataFrame:
    return first_receipts(stored.withColumn("source_rank", F.lit(0)).unionByName(
        live.withColumn("source_rank", F.lit(1)), allowMissingColumns=True))


def is_contract(report: Column) -> Column:
    return has_any(report, words.CONTRACT)


def contract_parties(report: Column, remark: Column, counterparty: Column) -> Column:
    """The stated counterparty, else the parties found in the report name and remark."""
    stated = F.when(F.coalesce(counterparty, F.lit("")) != "", F.array(counterparty))
    return F.coalesce(stated, counterparties(F.concat_ws(" ", report, remark)))


def company_keys(names: Column) -> Column:
    return F.transform(names, company_key)


def matched_parties(parties: Column, keys: Column) -> Column:
    """Parties whose cleaned name contains, or lies in, a rumor company's cleaned name (`keys`)."""
    near = lambda p, c: p.contains(c) | c.contains(p)
    return F.filter(parties, lambda p: let(
        company_key(p), lambda pk: F.exists(keys, lambda c: near(pk, c))))


def contract_signal(report: Column, remark: Column, counterparty: Column, companies: Column
                    ) -> Column:
    """struct(is_contract, has_counterparty, matched, weight): -40 matched, -15 other party."""
    none = F.array().cast("array<string>")
    contract = is_contract(report)
    stated = F.coalesce(counterparty, F.lit("")) != ""
    kept = F.when(contract, let(company_keys(companies), lambda ks: matched_parties(
        contract_parties(report, remark, counterparty), ks))).otherwise(none)
    return let(kept, lambda m: F.struct(
        contract.alias("is_contract"),
        (contract & (stated | (F.size(m) > 0))).alias("has_counterparty"),
        m.alias("matched"),
        F.when(F.size(m) > 0, -40).when(contract & stated, -15).otherwise(0).alias("weight")))


def profile(report: Column, disclosure_type: Column, remark: Column, counterparty: Column) -> Column:
    """All that a disclosure says by itself, so that it is worked out once per disclosure and not
    once per article it meets."""
    contract = is_contract(report)
    return F.struct(
        contract.alias("contract"), (F.coalesce(counterparty, F.lit("")) != "").alias("stated"),
        F.when(contract, F.transform(contract_parties(report, remark, counterparty), company_key))
        .alias("party_keys"),
        has_any(report, words.DECISION).alias("decision"), has_any(report, words.QUERY).alias("query"),
        has_any(report, words.ANSWER).alias("answer"),
        F.coalesce(disclosure_type.isin(*words.EXCHANGE_TYPES), F.lit(False)).alias("exchange"))


def signals_of(p: Column, keys: Column) -> Column:
    """array<struct(type, weight)> of a disclosure profile against a rumor's company keys.

    A contract with a counterparty answers first, then an exchange filing by its own words; else
    decision, query and answer words add up. Nothing found is one neutral signal.
    """
    def one(kind: str, weight: int) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(weight).alias("weight"))

    near = F.exists(p["party_keys"], lambda a: F.exists(
        keys, lambda c: a.contains(c) | c.contains(a)))
    contract = p["contract"] & (F.size(keys) > 0)
    several = F.array_compact(F.array(
        F.when(p["decision"], one("DECISION", -30)), F.when(p["query"], one("QUERY", 20)),
        F.when(p["answer"], one("ANSWER", -10))))
    return (
        F.when(contract & near, F.array(one("DECISION", -40)))
        .when(contract & p["stated"], F.array(one("DECISION", -15)))
        .when(p["exchange"] & p["query"], F.array(one("QUERY", 20)))
        .when(p["exchange"] & p["decision"], F.array(one("DECISION", -30)))
        .when(p["decision"] | p["query"] | p["answer"], several)
        .otherwise(F.array(one("NEUTRAL", 0))))


def signals(report: Column, disclosure_type: Column, remark: Column, counterparty: Column,
            companies: Column) -> Column:
    """`signals_of` for one disclosure and the companies of one rumor."""
    both = F.struct(profile(report, disclosure_type, remark, counterparty).alias("p"),
                    company_keys(companies).alias("k"))
    return let(both, lambda b: signals_of(b["p"], b["k"]))


def weight_sum(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, s: a + s["weight"])


def article_tone(title: Column, body: Column) -> Column:
    """+20 hedging, -15 confirming, +10 a question mark and +5 `단독` in the title."""
    t = F.coalesce(title, F.lit(""))
    text = F.concat(t, F.lit("\n"), F.coalesce(body, F.lit("")))
    return (F.when(has_any(text, words.HEDGING), 20).otherwise(0)
            + F.when(has_any(text, words.CONFIRM), -15).otherwise(0)
            + F.when(t.contains("?"), 10).otherwise(0)
            + F.when(t.contains("단독"), 5).otherwise(0))


def rumor_probability(adjustment: Column) -> Column:
    return clamp(F.lit(50.0) + adjustment, 0.0, 100.0) / 100.0


def recommendation(probability: Column) -> Column:
    return (F.when(probability >= 0.7, "likely_rumor").when(probability <= 0.3, "likely_confirmed")
            .otherwise("uncertain"))


def window_matches(articles: DataFrame, disclosures: DataFrame, window_days: int = 3,
                   back_only: bool = False) -> DataFrame:
    """Article x disclosure pairs of a company within +-days (or only before the article).

    The pairs meet on (corp_code, week), each disclosure standing in the weeks its window
    touches, so neither a busy company's whole history nor a range scan is joined.
    """
    day = F.unix_date("article_date")
    week = F.floor(day / 7)
    d_day = F.unix_date("rcept_date")
    after = 0 if back_only else window_days
    spread = disclosures.withColumn("_week", F.explode(F.sequence(
        F.floor((d_day - after) / 7), F.floor((d_day + window_days) / 7))))
    near = F.col("article_date").between(F.date_sub("rcept_date", after),
                                         F.date_add("rcept_date", window_days))
    return (articles.withColumn("_week", week).join(spread, ["corp_code", "_week"])
            .filter(near).drop("_week"))


def verify(articles: DataFrame, disclosures: DataFrame, window_days: int = 3) -> DataFrame:
    """Per article: disclosures around it, summed signal and tone points, probability, summary.

    Articles are (article_id, title, body, article_date, corp_code, companies), one row per named
    company; disclosures carry rcept_date. Neither a disclosure nor an article meets the other side
    by itself: alike disclosures of a company and day are one row with a count, as are articles with
    the same company, day and names.
    """
    d = disclosures.select("corp_code", "rcept_date", profile(
        F.col("report_nm"), F.col("pblntf_ty"), F.col("rm"), F.col("counterparty")).alias("p"))
    d = d.groupBy("corp_code", "rcept_date", "p").agg(F.count("*").alias("n"))
    keyed = articles.select("article_id", "article_date", "corp_code",
                            company_keys(F.col("companies")).alias("k"))
    found = signals_of(F.col("p"), F.col("k"))
    summed = let(found, lambda f: F.struct(
        weight_sum(f).alias("w"), F.exists(f, lambda s: s["weight"] != 0).alias("relevant")))
    same = ["article_date", "corp_code", "k"]
    met = window_matches(keyed.select(*same).distinct(), d, window_days).select(
        *same, "n", summed.alias("s"))
    around = met.groupBy(*same).agg(
        F.sum("n").alias("total"), F.sum(F.col("s.w") * F.col("n")).alias("points"),
        F.sum(F.when(F.col("s.relevant"), F.col("n")).otherwise(0)).alias("relevant"))
    points = keyed.join(around, same).groupBy("article_id").agg(
        *[F.sum(c).alias(c) for c in ("total", "points", "relevant")])
    tone = articles.groupBy("article_id").agg(
        F.max(article_tone(F.col("title"), F.col("body"))).alias("tone"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = tone.join(points, "article_id", "left").select(
        "article_id", zero("total").alias("total"), zero("relevant").alias("relevant"),
        (F.col("tone") + zero("points")).alias("adjustment"))
    summary = (F.when(F.col("total") == 0, "none").when(F.col("adjustment") <= -30, "confirmed")
               .when(F.col("adjustment") >= 30, "likely_rumor").otherwise("uncertain"))
    probability = rumor_probability(F.col("adjustment"))
    return (out.withColumn("summary", summary).withColumn("probability", probability)
            .withColumn("recommendation", recommendation(F.col("probability"))))


def text_points(title: Column, body: Column) -> Column:
    """Verdict points of an article's own words, from the base of 50."""
    full = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    hint = F.lit(False)
    for h in words.TITLE_HINTS:
        hint = hint | F.coalesce(title, F.lit("")).contains(h)
    return (F.lit(50)
            + F.when(has_any(full, words.HEDGING), 20).otherwise(0)
            + F.when(has_any(full, words.DENIAL), -30).otherwise(0)
            + F.when(has_any(full, words.CONFIRM) & ~full.contains("조회공시"), -15).otherwise(0)
            + F.when(hint, 10).otherwise(0))


def report_points(report: Column) -> Column:
    return (F.when(has_any(report, words.DECISION), -25).otherwise(0)
            + F.when(has_any(report, words.QUERY), 10).otherwise(0)
            + F.when(has_any(report, words.ANSWER), -10).otherwise(0))


def verdict(score: Column) -> Column:
    return F.when(score >= 70, "rumor").when(score <= 35, "not_rumor").otherwise("uncertain")


def verdicts(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(article_id, score, verdict) from text points and the summed points of its disclosures."""
    return _scored(articles, pairs.groupBy("article_id").agg(
        F.sum(report_points(F.col("report_nm"))).alias("add")))


def verdicts_around(articles: DataFrame, disclosures: DataFrame, window_days: int = 3,
                    back_only: bool = False) -> DataFrame:
    """`verdicts` with the disclosures of an article's company within +-days (or before it).

    The points of a report do not depend on the article, so they are summed by company and day, each
    sum is spread over the days of its window, and articles meet the sums by an equi join.
    """
    after = 0 if back_only else window_days
    daily = disclosures.groupBy("corp_code", "rcept_date").agg(
        F.sum(report_points(F.col("report_nm"))).alias("add"))
    days = F.explode(F.sequence(F.date_sub("rcept_date", after), F.date_add("rcept_date", window_days)))
    by_day = (daily.select("corp_code", days.alias("article_date"), "add")
              .groupBy("corp_code", "article_date").agg(F.sum("add").alias("add")))
    named = articles.select("article_id", "corp_code", "article_date")
    return _scored(articles, named.join(by_day, ["corp_code", "article_date"])
                   .groupBy("article_id").agg(F.sum("add").alias("add")))


def _scored(articles: DataFrame, added: DataFrame) -> DataFrame:
    points = text_points(F.col("title"), F.col("body"))
    return (articles.select("article_id", points.alias("base")).join(added, "article_id", "left")
            .select("article_id", clamp(F.col("base") + F.coalesce("add", F.lit(0)), 0, 100)
                    .cast("int").alias("score"))
            .withColumn("verdict", verdict(F.col("score"))))


# --- relevance of a report to a rumor ------------------------------------------------------

Lexicon = Mapping[str, Mapping[str, Sequence[str]]]


def _shared_word(rumor: Column, report: Column, terms: Sequence[str]) -> Column:
    """Whether one keyword is in both texts."""
    both = F.struct(F.lower(rumor).alias("r"), F.lower(report).alias("d"))
    return let(both, lambda t: F.exists(text_array([w.lower() for w in terms]), lambda k: (
        t["d"].contains(k) & t["r"].contains(k))))


def relevance(report: Column, labels: Column, rumor: Column, phrases: Column,
              lexicon: Lexicon, signal_words: Mapping[str, Sequence[str]]) -> Column:
    """Relevance 0..1 of a report name to a labelled rumor.

    Steps in order, each able to raise or lower the one before: label keywords, category words
    shared by both texts, event phrases, three penalties, denial words, undecided words, and the
    wording of inquiries. `lexicon` is category -> group -> keywords, `signal_words` has rumor,
    denial and undecided lists; both come from files.
    """
    d = F.lower(F.coalesce(report, F.lit("")))
    r = F.lower(F.coalesce(rumor, F.lit("")))
    has = lambda terms: has_any(d, terms)
    hits = lambda terms: F.size(keyword_hits(d, terms))

    score = F.lit(0.0)
    for label, terms in words.LABEL_REPORT_WORDS.items():
        score = F.greatest(score, F.when(F.array_contains(labels, label),
                                         hits(terms) / F.lit(float(len(terms)))).otherwise(0.0))
    for category, (value, strong) in words.STRONG_REPORT_WORDS.items():
        terms = [k for group in lexicon.get(category, {}).values() for k in group]
        score = F.greatest(score, F.when(_shared_word(r, d, terms) & has(strong), value)
                           .otherwise(0.0))
    rumor_words = signal_words.get("rumor", ())
    score = F.greatest(score, F.when(_shared_word(r, d, rumor_words) & d.contains("조회공시"), 0.3)
                       .otherwise(0.0))

    def phrase_value(p: Column) -> Column:
        low = F.lower(p)
        long_words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2)
        found = F.size(F.filter(long_words, lambda w: d.contains(w)))
        part = F.when(F.size(long_words) > 0, found / F.greatest(F.size(long_words), F.lit(1)))
        return F.when(F.length(p) <= 2, 0.0).when(d.contains(low), 0.95).when(
            part > 0.6, part).otherwise(0.0)

    score = F.aggregate(F.transform(phrases, phrase_value), score, lambda a, x: F.greatest(a, x))

    score = score * F.when(
        F.array_contains(labels, "company.earnings_result")
        & has(["자기주식", "자사주", "배당", "주주환원"]), 0.1).otherwise(1.0)
    score = score * F.when(
        F.exists(labels, lambda x: x.contains("mna")) & has(["단일판매", "공급계약"]), 0.3
    ).otherwise(1.0)
    score = score * F.when(
        F.array_contains(labels, "company.capex_expansion") & has(["증자", "사채", "차입"]), 0.5
    ).otherwise(1.0)

    denial = list(signal_words.get("denial", ()))
    inquiry = d.contains("조회공시")
    denied = has(denial)
    # scores are never negative, so raising to a floor is one greatest; naming the score twice in
    # each step would double the expression every time
    floor = lambda s, cond, low: F.greatest(s, F.when(cond, low).otherwise(0.0))
    score = floor(score, denied & inquiry & d.contains("답변"), 0.6)
    score = floor(score, denied & ~(inquiry & d.contains("답변")) & has(["해명", "설명", "반박"]), 0.5)
    score = score * F.when(_shared_word(r, d, denial), 0.5).otherwise(1.0)

    undecided = list(signal_words.get("undecided", ()))
    open_ = has(undecided)
    score = floor(score, open_ & inquiry, 0.5)
    score = floor(score, open_ & ~inquiry, 0.4)
    score = floor(score, has([w for w in words.HIGH_UNCERTAINTY if w in undecided]), 0.6)

    request = inquiry & has(["요구", "요청"])
    reply = inquiry & ~has(["요구", "요청"]) & has(["답변", "회신"])
    yes = has(["사실", "확인", "맞다", "진행"])
    no = has(denial)
    score = floor(score, request, 0.4)
    score = floor(score, reply & yes, 0.7)
    score = floor(score, reply & ~yes & no, 0.3)
    score = floor(score, reply & ~yes & ~no, 0.5)
    return F.when((F.size(labels) > 0) & (d != ""), score).otherwise(0.0)


def relevance_adjustment(graded: DataFrame) -> DataFrame:
    """Per article: -30 for a direct report (>= 0.5), else -10 for a near one (>= 0.2), +20 for an
    open inquiry; with the counts and the reason."""
    rel, name = F.col("relevance"), F.col("report_nm")
    g = graded.groupBy("article_id").agg(
        F.count_if(rel >= 0.5).alias("direct"),
        F.count_if((rel >= 0.2) & (rel < 0.5)).alias("near"),
        F.count_if(rel < 0.2).alias("unrelated"),
        F.count_if(name.contains("조회공시") & name.contains("요구")).alias("inquiries"))
    direct, near, ask = F.col("direct") > 0, F.col("near") > 0, F.col("inquiries") > 0
    points = (F.when(direct, -30).when(near, -10).otherwise(0)
              + F.when(ask, 20).otherwise(0))
    reason = (F.when(direct & ask, "mixed").when(direct, "confirmed")
              .when(near & ask, "uncertain").when(near, "partly_confirmed")
              .when(ask, "inquiry_open").otherwise("unrelated"))
    return g.withColumn("adjustment", points).withColumn("reason", reason)
