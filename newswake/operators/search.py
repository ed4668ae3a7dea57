"""Full-text and vector search: postings, BM25, phrases, combined scores, exact cosine top-k.

Two access paths share the formulas. Without an index, `bm25` and `search` read the words of the
texts themselves. With a stored index (`newswake.operators.search_index`) words and counts come from
it, and only documents that can score are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from newswake.functions.text import each, let, text_array, tokens

K1, B = 1.2, 0.75
#: words of a batch of queries that go to every task
BROADCAST_TERMS = 1 << 20


# --- index --------------------------------------------------------------------------------

def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, term, tf): all words of a document stay in one task until they are counted.

    The word counts of a document are complete after the map-side half of the aggregate, so the
    shuffle moves one row per (document, term) and nothing repeats.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    return (
        words.select("doc_id", F.size("w").cast("long").alias("dl"), each(F.col("w")).alias("term"))
        .filter(F.col("term").isNotNull()).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    )


def expand_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query terms plus their synonyms. `synonyms` is (term, synonym), both directions listed."""
    more = terms.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"))
    return terms.select("query_id", "term").unionByName(more).distinct()


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text"
                ) -> DataFrame:
    """Distinct (query_id, term)."""
    return queries.select(F.col(id_col).alias("query_id"),
                          F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avgdl))


def bm25(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         top: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of every query, summed BM25 (OR).

    Only words that some query asks for leave the scan. They are laid out by document, in parts as
    many as the scan has several times over, which also serves the counts per (document, term) and the
    sums per (query, document), so nothing larger moves again. For that the term tables go to the tasks,
    unless the queries have more than BROADCAST_TERMS words: then the size-based decision stands, and hot
    words may meet in one task. Corpus size and mean length come from one scalar subquery.
    """
    given = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda t: t)
    parts = 4 * max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    corpus = docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.struct(
        F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")).alias("s")).scalar()
    n_docs, avgdl = corpus["n"], corpus["avgdl"]
    asked = terms.select("term").distinct()
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w")).select(
        "doc_id", F.size("w").cast("double").alias("dl"), each(F.col("w")).alias("term"))
    hits = (words.join(given(asked), "term").repartition(parts, "doc_id").groupBy("doc_id", "dl", "term")
            .agg(F.count("*").cast("double").alias("tf")))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    weighted = terms.join(df, "term").select("query_id", "term", idf(n_docs, F.col("df"))
                                             .alias("idf"))
    part = F.col("idf") * tf_norm(F.col("tf"), F.col("dl"), avgdl)
    scores = (hits.join(given(weighted), "term").groupBy("query_id", "doc_id")
              .agg(F.round(F.sum(part), 6).alias("score")))
    return top_per_query(scores, top)


def top_per_query(scores: DataFrame, top: int, tie: str = "doc_id") -> DataFrame:
    """Best rows per query. The rank filter is applied before the shuffle as well as after."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return (scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .withColumn("rank", F.col("rank").cast("int")))


# --- phrases ------------------------------------------------------------------------------

def phrase_matches(docs: DataFrame, phrase: str, slop: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, freq): sloppy frequency of a phrase per document, in one scan.

    Each occurrence of the first word takes, for every later word, its nearest position to where
    the phrase wants it; the summed distance d must be within the slop and adds 1 / (1 + d).
    """
    words = phrase_words(phrase)
    freq = phrase_freq(tokens(F.col(text_col)), words, slop)
    return docs.select(F.col(id_col).alias("doc_id"), freq.alias("freq")).filter("freq > 0")


def phrase_words(phrase: str) -> list[str]:
    import re

    from newswake.functions.text import WORD
    return re.findall(WORD, phrase.lower())


def _positions_of(words: Column, term: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w == term, i)), lambda p: p.isNotNull())


def phrase_freq(words: Column, phrase: Sequence[str], slop: int) -> Column:
    if not phrase:
        return F.lit(0.0)
    n = len(phrase)
    if slop == 0:
        starts = let(words, lambda w: F.filter(
            _positions_of(w, phrase[0]), lambda p: F.slice(w, p + 1, n) == text_array(phrase)))
        return F.size(starts).cast("double")
    places = let(words, lambda w: F.struct(*[
        _positions_of(w, t).alias(f"p{k}") for k, t in enumerate(phrase)]))

    def freq(at: Column) -> Column:
        def distance(start: Column) -> Column:
            def nearest_gap(k: int) -> Column:
                gaps = F.transform(at[f"p{k}"], lambda p: F.abs(p - (start + k)))
                return F.coalesce(F.array_min(gaps), F.lit(10**6))

            return sum((nearest_gap(k) for k in range(1, n)), F.lit(0))

        near = F.filter(F.transform(at["p0"], distance), lambda d: d <= slop)
        return F.aggregate(near, F.lit(0.0), lambda a, d: a + 1.0 / (1.0 + d))

    return let(places, freq)


# --- one query against document fields ------------------------------------------------------

@dataclass
class FieldStats:
    """Corpus numbers of one text field for the words of one query."""
    n_docs: Column
    avgdl: Column
    df: Mapping[str, Column] = field(default_factory=dict)


def field_stats(docs: DataFrame, text: Column, words: Sequence[str]) -> DataFrame:
    """One row: n, avgdl and a df_<i> per word."""
    w = tokens(text)
    return docs.select(w.alias("w")).agg(
        F.count_if(F.size("w") > 0).cast("double").alias("n"),
        F.avg(F.when(F.size("w") > 0, F.size("w"))).alias("avgdl"),
        *[F.count_if(F.array_contains(F.col("w"), t)).cast("double").alias(f"df_{i}")
          for i, t in enumerate(words)])


def stats_struct(docs: DataFrame, text: Column, words: Sequence[str]) -> FieldStats:
    """`field_stats` as one scalar subquery that the scoring expressions read."""
    one = field_stats(docs, text, words)
    row = one.select(F.struct(*one.columns).alias("s")).scalar()
    return FieldStats(row["n"], row["avgdl"], {t: row[f"df_{i}"] for i, t in enumerate(words)})


def count_of(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def match_score(words: Column, terms: Sequence[str], stats: FieldStats, operator: str = "or",
                min_share: float = 0.0) -> Column:
    """BM25 of the terms in a token array; 0 unless enough different terms are there.

    `and` wants all terms, `min_share` that share of them rounded down, at least one.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(0.0)
    dl = F.size(words).cast("double")
    total, present = F.lit(0.0), F.lit(0)
    for t in terms:
        tf = count_of(words, t).cast("double")
        total = total + F.when(tf > 0, idf(stats.n_docs, stats.df[t])
                               * tf_norm(tf, dl, stats.avgdl)).otherwise(0.0)
        present = present + (tf > 0).cast("int")
    need = len(terms) if operator == "and" else max(1, int(len(terms) * min_share))
    return F.when(present >= need, total).otherwise(0.0)


def phrase_score(words: Column, phrase: Sequence[str], stats: FieldStats, slop: int = 0) -> Column:
    """BM25 with the sloppy phrase frequency as term frequency and the words' summed idf."""
    if not phrase:
        return F.lit(0.0)
    freq = phrase_freq(words, phrase, slop)
    weight = F.lit(0.0)
    for t in phrase:
        weight = weight + idf(stats.n_docs, stats.df[t])
    return F.when(freq > 0, weight * tf_norm(freq, F.size(words).cast("double"), stats.avgdl)
                  ).otherwise(0.0)


def best_field(scores: Sequence[Column]) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def constant_if(condition: Column, boost: float) -> Column:
    return F.when(condition, F.lit(float(boost))).otherwise(0.0)


def quality_factor(tier: Column, published: Column, confidence: Column, now: Column,
                   scale_days: float = 30.0, decay: float = 0.7) -> Column:
    """tier (0.5 if unknown) + Gaussian decay of the age + 1.5 x event confidence (1 if unknown)."""
    age = F.abs(F.unix_timestamp(now) - F.unix_timestamp(published)) / 86400.0
    gauss = F.exp(F.ln(F.lit(decay)) * F.pow(age / scale_days, F.lit(2.0)))
    return (F.coalesce(tier, F.lit(0.5)) + F.coalesce(gauss, F.lit(1.0))
            + 1.5 * F.coalesce(confidence, F.lit(1.0)))


@dataclass(frozen=True)
class SearchRequest:
    """What a search asks for, after extraction."""
    text: str
    companies: tuple[str, ...] = ()
    event_phrases: tuple[str, ...] = ()
    event_codes: tuple[str, ...] = ()
    event_labels: tuple[str, ...] = ()
    event_keywords: tuple[str, ...] = ()
    synonyms: tuple[tuple[str, str], ...] = ()
    flexible: bool = True


def parse_intent(text: str, synonyms: Sequence[tuple[str, str]], terms: Sequence[str],
                 companies: Sequence[str] = (), limit: int | None = None) -> SearchRequest:
    """Event codes and keywords of a query text by the synonym list and the fixed terms."""
    low = text.lower()
    hits = [(a, c) for a, c in synonyms if a and a in low]
    words = list(dict.fromkeys([a for a, _ in hits] + [t for t in terms if t in text]))[:limit]
    return SearchRequest(text=text, companies=tuple(companies),
                         event_codes=tuple(sorted({c for _, c in hits})),
                         event_keywords=tuple(words), synonyms=tuple(synonyms))


def residual(request: SearchRequest) -> str:
    rest = request.text
    for alias, _ in request.synonyms:
        if alias in request.text.lower():
            rest = rest.replace(alias, " ")
    return " ".join(rest.split())


def _clauses(request: SearchRequest):
    """(kind, field, words, boost, options) of every optional clause of a request.

    The boosts are fixed values of the ranking.
    """
    out = []
    text_words = phrase_words(request.text)
    rest = residual(request)
    if request.event_phrases:
        for phrase in filter(None, request.event_phrases):
            w = phrase_words(phrase)
            out.append(("phrase", "title", w, 3.0, {"slop": 3}))
            if len(phrase.split()) > 1:
                out.append(("match", "title", w, 2.5, {"operator": "and"}))
            out.append(("match", "title", w, 2.0, {"min_share": 0.5}))
            out.append(("match", "body", w, 1.5, {"min_share": 0.3}))
            for company in request.companies:
                out.append(("phrase", "title", phrase_words(f"{company} {phrase}"), 9.0,
                            {"slop": 12}))
    if request.event_codes:
        from newswake.functions.words import EVENT_NAMES
        out.append(("match", "events", text_words, 8.0, {}))
        for code in request.event_codes:
            out.append(("match", "title", phrase_words(EVENT_NAMES.get(code, code)), 6.0, {}))
            out += [("match", "title", phrase_words(a), 5.0, {})
                    for a, c in request.synonyms if c == code]
    elif request.event_keywords and not request.event_phrases:
        for k in request.event_keywords:
            out.append(("match", "title", phrase_words(k), 5.0, {}))
            out.append(("phrase", "title", phrase_words(k), 7.0, {}))
        out.append(("match", "events", text_words, 4.0, {}))
    if rest:
        out.append(("phrase", "title", phrase_words(rest), 4.0, {}))
        out.append(("match", "title", phrase_words(rest), 2.0, {"operator": "and"}))
    if not (request.companies or request.event_codes or request.event_keywords
            or request.event_phrases):
        out.append(("best", None, phrase_words(rest or request.text), 2.0, {}))
    return out


def can_score(docs: DataFrame, request: SearchRequest, with_words: DataFrame) -> DataFrame:
    """Rows with a word of the request (`with_words`: doc_id), a company or an event code of it.

    Ids and name lists are matched first, so the texts of other rows are never moved."""
    codes = [*request.event_codes, *request.event_labels]
    named = F.arrays_overlap(F.col("companies_kw"), text_array([c.lower() for c in request.companies]))
    coded = F.arrays_overlap(F.col("event_codes"), text_array(codes))
    marked = docs.select("id", F.coalesce(named, F.lit(False)).alias("named"),
                         F.coalesce(coded, F.lit(False)).alias("coded"))
    other = marked.filter(F.col("named") | F.col("coded")).select("id")
    return docs.join(other.unionByName(with_words.select(F.col("doc_id").alias("id"))), "id", "left_semi")


def search(docs: DataFrame, request: SearchRequest, now: Column, start: Column, end: Column,
           top: int = 20, index=None) -> DataFrame:
    """Top documents for a request over (id, title, body, events, companies_kw, event_codes, ...),
    published from `start` on and before `end`.

    The date range and the needed columns reach the scan; scoring is one pass over the remaining
    rows and the top-k keeps `top` rows per task. Without an index, two small aggregates over the
    same range give the corpus numbers. With one (`search_index.Index` over the fields title, body
    and events) they are those of all indexed documents, and only rows that can score are read.
    """
    ranged = docs.filter((F.col("published_at") >= start) & (F.col("published_at") < end))
    texts = {"title": F.col("title"), "body": F.col("body"),
             "events": F.concat_ws(" ", F.col("events"))}
    clauses = [c for c in _clauses(request) if c[2]]
    wanted: dict[str, list[str]] = {f: [] for f in texts}
    for _, fld, words, _, _ in clauses:
        for f in ([fld] if fld else list(texts)):
            wanted[f] = list(dict.fromkeys(wanted[f] + words))
    if index is None:
        stats = {f: stats_struct(ranged, texts[f], w) for f, w in wanted.items() if w}
    else:
        stats = {f: index.stats(f, w) for f, w in wanted.items() if w}
        ranged = can_score(ranged, request, index.having_any(wanted))
    arrays = {f: F.col(f"_w_{f}") for f in stats}
    rows = ranged.select("*", *[tokens(texts[f]).alias(f"_w_{f}") for f in stats])

    parts = []
    for kind, fld, words, boost, opts in clauses:
        if kind == "match":
            parts.append(match_score(arrays[fld], words, stats[fld], **opts) * boost)
        elif kind == "phrase":
            parts.append(phrase_score(arrays[fld], words, stats[fld], **opts) * boost)
        else:
            weights = {"title": 3.0, "body": 2.0, "events": 2.0}
            parts.append(best_field([match_score(arrays[f], words, stats[f]) * w
                                     for f, w in weights.items()]) * boost)
    required = F.lit(True)
    lowered = [c.lower() for c in request.companies]
    if lowered:
        named = F.arrays_overlap(F.col("companies_kw"), text_array(lowered))
        if request.flexible:
            parts.append(constant_if(named, 8.0))
        else:
            in_title = F.lit(False)
            for c in lowered:
                for w in phrase_words(c):
                    in_title = in_title | F.array_contains(tokens(F.col("title")), w)
            required = named & in_title
    if request.event_codes:
        parts.append(constant_if(F.arrays_overlap(
            F.col("event_codes"), text_array(request.event_codes)), 10.0))
    if request.event_labels and tuple(request.event_labels) != ("other",):
        parts.append(constant_if(F.arrays_overlap(
            F.col("event_codes"), text_array(request.event_labels)), 5.0))

    total = F.lit(0.0)
    for p in parts:
        total = total + p
    factor = quality_factor(F.col("publisher_tier"), F.col("published_at"), F.col("event_conf"), now)
    base = total if request.flexible or not lowered else total + 1.0
    scored = rows.filter(required).withColumn("score", F.round(base * factor, 6))
    return (scored.filter(F.col("score") > 0).orderBy(F.desc("score"), "id").limit(top)
            .select("id", "score", "title", "body", "publisher",
                    "published_at", "url", "companies", "events", "event_codes", "tickers"))


# --- vectors ------------------------------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: Column, id_col: str, vec_col: str, k: int = 10,
            start: Column | None = None, end: Column | None = None, time_col: str = "published_at"
            ) -> DataFrame:
    """Exact top-k by cosine for one query vector: one scan, k rows kept per task. Rows are those
    from `start` on and before `end`, where given; the range reaches the scan."""
    if start is not None:
        vectors = vectors.filter(F.col(time_col) >= start)
    if end is not None:
        vectors = vectors.filter(F.col(time_col) < end)
    return (vectors.select(id_col, F.round(cosine(F.col(vec_col), query), 6).alias("score"))
            .orderBy(F.desc("score"), id_col).limit(k))
