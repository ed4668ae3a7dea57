"""Rumor trust: evidence per claim from its search hits.

Claims are (query_id, text, companies, labels, phrases, range_start, range_end); hits are
(query_id, rank, score, title, body, publisher, published_at, companies, event_codes) and come
from a top-20 search, so the rows of one claim are bounded by the search size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions import words
from newswake.functions.scores import clamp
from newswake.functions.text import amounts, let, text_array


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def classify_hits(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with `match`: exact (company and event), partial (either) or none."""
    c = claims.select("query_id", F.col("companies").alias("q_companies"),
                      F.col("labels").alias("q_labels"), F.col("phrases").alias("q_phrases"))
    joined = hits.join(c, "query_id")
    title = _lower(F.col("title"))
    company = F.coalesce(F.arrays_overlap("companies", "q_companies"), F.lit(False))
    label = ((F.col("q_labels") != F.array(F.lit("other")))
             & F.coalesce(F.arrays_overlap("event_codes", "q_labels"), F.lit(False)))
    phrase = F.exists("q_phrases", lambda p: (p != "") & title.contains(F.lower(p)))
    event = label | phrase
    return joined.withColumn(
        "match", F.when(company & event, "exact").when(company | event, "partial").otherwise("none")
    ).drop("q_companies", "q_labels", "q_phrases")


def _match_aggregates() -> list[Column]:
    ordered = lambda kind: F.array_sort(F.collect_list(F.when(
        F.col("match") == kind, F.struct("rank", "publisher", "score"))))
    return [F.count("*").alias("results"), F.min_by("score", "rank").alias("top_score"),
            ordered("exact").alias("exact"), ordered("partial").alias("partial")]


def _with_match_numbers(grouped: DataFrame, *keep: str) -> DataFrame:
    mean = lambda a, n: F.aggregate(
        F.slice(a, 1, n), F.lit(0.0), lambda s, x: s + x["score"]
    ) / F.greatest(F.least(F.size(a), F.lit(n)), F.lit(1))
    names = F.filter(F.transform(F.slice("exact", 1, 10), lambda x: x["publisher"]),
                     lambda p: p.isNotNull() & (p != ""))
    return grouped.select(
        "query_id", "results", "top_score",
        F.size("exact").alias("exact_n"), F.size("partial").alias("partial_n"),
        F.size(F.array_distinct(names)).alias("publishers"),
        mean(F.col("exact"), 5).alias("exact_score"),
        mean(F.col("partial"), 3).alias("partial_score"), *keep)


def match_numbers(classified: DataFrame) -> DataFrame:
    """Per claim: counts, publishers of the first ten exact hits, mean scores of the first hits."""
    return _with_match_numbers(classified.groupBy("query_id").agg(*_match_aggregates()))


def base_score(exact_n: Column, partial_n: Column, results: Column, publishers: Column,
               exact_score: Column, partial_score: Column, top_score: Column,
               steps: tuple[float, float, float] = (30.0, 20.0, 10.0)) -> Column:
    """The trust ladder. `steps` are the score marks of the ranking that made the hits."""
    high, mid, low = steps
    exact = (F.when(exact_n == 1, 0.5).when(exact_n == 2, 0.65).when(exact_n < 5, 0.75)
             .when(exact_n < 10, 0.85).otherwise(0.9))
    diverse = F.when(publishers >= 5, 0.05).otherwise(0.0)
    good = (F.when(exact_score > high, 0.05).when(exact_score > mid, 0.03)
            .when(exact_score > low, 0.02).otherwise(0.0))
    partial = (F.when(partial_n == 1, 0.25).when(partial_n == 2, 0.35).when(partial_n < 5, 0.45)
               .otherwise(0.5))
    fair = F.when(partial_score > mid, 0.03).when(partial_score > low, 0.02).otherwise(0.0)
    general = F.when(top_score > mid, 0.15).when(top_score > low, 0.1).otherwise(0.05)
    return (F.when(exact_n > 0, F.least(F.lit(1.0), exact + diverse + good))
            .when(partial_n > 0, F.least(F.lit(1.0), partial + fair))
            .when(results > 0, general).otherwise(0.0))


def contradictions(hits: DataFrame, keywords: Sequence[str] = tuple(words.CONTRADICTION)
                   ) -> DataFrame:
    """Hits that contradict, with the first keyword of the list found in title and body."""
    text = F.concat_ws(" ", _lower(F.col("title")), _lower(F.col("body")))
    first = let(text, lambda t: F.try_element_at(
        F.filter(text_array(keywords), lambda k: t.contains(k)), F.lit(1)))
    return hits.withColumn("keyword", first).filter(F.col("keyword").isNotNull())


def claim_terms(text: Column, companies: Column, terms: Sequence[str] = tuple(words.CLAIM_TERMS)
                ) -> Column:
    """Companies, amounts and claim words of a text; repeats stay."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(companies, amounts(t), F.filter(text_array(terms), lambda k: t.contains(k)))


def claim_support(claims: DataFrame, hits: DataFrame, terms: Sequence[str] = tuple(words.CLAIM_TERMS),
                  first: int = 10) -> DataFrame:
    """(query_id, claims, supported, support): share of claim terms found in the first hits.

    Supported terms count once, the denominator keeps repeats; 0.5 without any term.
    """
    with_terms = claims.select("query_id", claim_terms(F.col("text"), F.col("companies"), terms)
                               .alias("terms"))
    article = F.concat_ws(" ", _lower(F.col("title")), _lower(F.col("body")))
    found = (
        hits.filter(F.col("rank") <= first).join(with_terms, "query_id")
        .select("query_id", F.array_distinct(let(article, lambda a: F.filter(
            "terms", lambda k: a.contains(F.lower(k))))).alias("found"))
        .groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")))
    return with_terms.join(found, "query_id", "left").select(
        "query_id", F.size("terms").alias("claims"),
        F.coalesce(F.size("found"), F.lit(0)).alias("supported"),
    ).withColumn("support", F.when(F.col("claims") == 0, 0.5)
                 .otherwise(F.col("supported") / F.col("claims")))


def temporal_consistency(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, temporal): share of dated hits inside the claim's range; 0.5 without dated hits."""
    ranges = claims.select("query_id", "range_start", "range_end")
    inside = F.col("published_at").between(F.col("range_start"), F.col("range_end"))
    dated = (hits.filter(F.col("published_at").isNotNull()).join(ranges, "query_id")
             .groupBy("query_id").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n")))
    return ranges.select("query_id").join(dated, "query_id", "left").select(
        "query_id", F.coalesce(F.col("inside") / F.col("n"), F.lit(0.5)).alias("temporal"))


def _numbers_in_one_pass(claims: DataFrame, hits: DataFrame, contradiction_words: Sequence[str],
                         terms: Sequence[str]) -> DataFrame:
    """`match_numbers`, `contradictions`, `claim_support` and `temporal_consistency` together: the
    hits meet the claims once and are aggregated once."""
    asked = claims.select("query_id", claim_terms(F.col("text"), F.col("companies"), terms)
                          .alias("terms"), "range_start", "range_end")
    article = F.concat_ws(" ", _lower(F.col("title")), _lower(F.col("body")))
    marked = classify_hits(claims, hits).join(asked, "query_id").select(
        "query_id", "rank", "score", "publisher", "match", let(article, lambda a: F.struct(
            F.exists(text_array(contradiction_words), lambda k: a.contains(k)).alias("against"),
            F.when(F.col("rank") <= 10, F.filter("terms", lambda k: a.contains(F.lower(k))))
            .alias("found"))).alias("a"),
        F.col("published_at").isNotNull().alias("dated"),
        F.col("published_at").between(F.col("range_start"), F.col("range_end")).alias("inside"))
    extra = marked.groupBy("query_id").agg(
        *_match_aggregates(), F.count_if("a.against").alias("contradictions"),
        F.size(F.array_distinct(F.flatten(F.collect_list("a.found")))).alias("supported"),
        F.count_if(F.col("dated") & F.col("inside")).alias("inside"), F.count_if("dated").alias("dated"))
    return asked.select("query_id", F.size("terms").alias("claims")).join(
        _with_match_numbers(extra, "contradictions", "supported", "inside", "dated"),
        "query_id", "left",
    ).withColumn("support", F.when(F.col("claims") == 0, 0.5).otherwise(
        F.coalesce("supported", F.lit(0)) / F.greatest("claims", F.lit(1)))
    ).withColumn("temporal", F.when(F.col("dated") > 0, F.col("inside") / F.col("dated"))
                 .otherwise(0.5))


def penalties(contradiction_n: Column, support: Column, temporal: Column) -> Column:
    return (F.when(contradiction_n > 0, -0.5).otherwise(0.0)
            + F.when(support < 0.3, -0.2).when(support < 0.5, -0.1).otherwise(0.0)
            + F.when(temporal < 0.2, -0.15).when(temporal < 0.4, -0.05).otherwise(0.0))


def level(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")


def verdicts(claims: DataFrame, hits: DataFrame, disclosure_adjustment: DataFrame | None = None,
             steps: tuple[float, float, float] = (30.0, 20.0, 10.0),
             contradiction_words: Sequence[str] = tuple(words.CONTRADICTION),
             terms: Sequence[str] = tuple(words.CLAIM_TERMS)) -> DataFrame:
    """One row per claim: score, level, the numbers behind them and the reason that decides.

    `disclosure_adjustment` is (query_id, adjustment, evidence): rumor points of the disclosure
    check, which lower trust by a hundredth each, at most by half.
    """
    out = _numbers_in_one_pass(claims, hits, contradiction_words, terms)
    if disclosure_adjustment is not None:
        out = out.join(disclosure_adjustment, "query_id", "left")
    else:
        out = out.withColumn("adjustment", F.lit(None).cast("double")).withColumn(
            "evidence", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({c: zero(c) for c in (
        "results", "top_score", "exact_n", "partial_n", "publishers", "exact_score",
        "partial_score", "contradictions", "evidence")})
    base = base_score(*[F.col(c) for c in (
        "exact_n", "partial_n", "results", "publishers", "exact_score", "partial_score",
        "top_score")], steps=steps)
    fined = F.greatest(F.lit(0.0), base + penalties(
        F.col("contradictions"), F.col("support"), F.col("temporal")))
    by_disclosure = clamp(
        F.lit(0.0) - F.coalesce(F.col("adjustment"), F.lit(0.0)) / 100.0, -0.5, 0.5)
    score = clamp(F.col("fined") + F.col("by_disclosure"), 0.0, 1.0)
    out = out.withColumn("fined", fined).withColumn("by_disclosure", by_disclosure)
    reason = (F.when(F.col("contradictions") > 0, "contradicted")
              .when((F.col("by_disclosure") >= 0.2) & (F.col("evidence") > 0), "disclosed")
              .when((F.col("by_disclosure") <= -0.2) & (F.col("evidence") > 0), "inquiry")
              .when(F.col("temporal") < 0.3, "out_of_time")
              .when((F.col("support") < 0.5) & (F.col("exact_n") > 0), "weak_claims")
              .when(F.col("exact_n") > 0, "exact_matches")
              .when(F.col("partial_n") > 0, "partial_matches")
              .otherwise("no_information"))
    return out.withColumn("score", score).select(
        "query_id", F.round("score", 2).alias("score"), level(F.col("score")).alias("level"),
        reason.alias("reason"), "exact_n", "partial_n", "contradictions", "support", "temporal",
        F.col("by_disclosure").alias("disclosure"))


def evidence(hits: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, evidence): (rank, title, url, published_at) of a claim's exact hits, or of all hits
    if none is exact; all of them or the first `top`. `hits` are classified."""
    exact = F.col("match") == "exact"
    entry = F.struct("rank", "title", "url", "published_at")
    listed = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(exact, entry))).alias("exact"),
        F.array_sort(F.collect_list(entry)).alias("every"))
    found = F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("every"))
    return listed.select("query_id", (found if top is None else F.slice(found, 1, top)).alias("evidence"))


def evaluate(confidence: Column, mean: Column, best: Column, n: Column, exact_n: Column,
             partial_n: Column, digits: int = 1) -> Column:
    """struct(level, points) of the 0..100 evaluator from the mean, best and number of match
    relevances; a search without matches is LOW at 0."""
    has_news = n > 0
    grade = (F.when(~has_news, "LOW")
             .when((confidence >= 0.95) & (exact_n >= 1) & (best >= 0.8), "HIGH")
             .when((confidence >= 0.6) & ((exact_n > 0) | (mean >= 0.5)), "MEDIUM")
             .when((confidence >= 0.3) | (partial_n > 0), "LOW").otherwise("VERY_LOW"))
    points = (confidence * 100 * 0.4 + mean * 100 * 0.3
              + F.least(F.lit(100.0), exact_n * 33.33) * 0.2
              + F.least(F.lit(100.0), n * 20.0) * 0.1)
    return F.struct(grade.alias("level"),
                    F.when(has_news, F.round(points, digits)).otherwise(0.0).alias("points"))
