"""Synonyms at query time: a query as a graph of alternatives, scored over the stored index.

Synonyms come in groups of spellings of one thing, each of one or more words. A query's words are read
from the left; where spellings of groups begin, the longest becomes a segment whose alternatives are
all spellings of its group, any other word is a segment of its own. A segment scores a document by

* its spellings of one word as one word: counts are added, the rarity is that of the most frequent one
* every spelling of several words as a phrase, from positions, with the summed rarity of its words

and the scores of segments and phrases are added. All queries are scored in one go.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from newswake.operators.search import idf, phrase_words, tf_norm, top_per_query
from newswake.operators.search_index import Index, phrase_matches

Spelling = tuple[str, ...]


def segments(words: Sequence[str], groups: Sequence[Sequence[str]]) -> list[list[Spelling]]:
    """The alternatives of each segment, the query's own first."""
    group_of: dict[Spelling, list[Spelling]] = {}
    for group in groups:
        spellings = [s for s in dict.fromkeys(tuple(phrase_words(g)) for g in group) if s]
        for s in spellings:
            group_of[s] = list(dict.fromkeys([*group_of.get(s, [s]), *spellings]))
    longest = max((len(s) for s in group_of), default=1)
    found, at = [], 0
    while at < len(words):
        n = next((n for n in range(min(longest, len(words) - at), 0, -1) if tuple(words[at:at + n]) in group_of), 0)
        own = tuple(words[at:at + max(n, 1)])
        found.append(group_of.get(own, [own]))
        at += len(own)
    return found


def graph_search(index: Index, queries: Mapping[object, str], groups: Sequence[Sequence[str]], field: str,
                 top: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query with its synonyms."""
    spark, one = index.spark, index.numbers[field]
    kind = "string" if any(isinstance(q, str) for q in queries) else "long"
    singles, phrases = [], []
    for query, text in queries.items():
        for n, alternatives in enumerate(segments(phrase_words(text), groups)):
            for m, spelling in enumerate(alternatives):
                if len(spelling) == 1:
                    singles.append((query, n, spelling[0]))
                else:
                    phrases += [(query, n, f"{query}/{n}/{m}", k, w) for k, w in enumerate(spelling)]
    single = spark.createDataFrame(singles, f"query_id {kind}, segment int, term string").distinct()
    phrase = spark.createDataFrame(phrases, f"query_id {kind}, segment int, spelling string, k int, term string")
    n_docs = F.lit(float(one.documents))
    avgdl = F.lit(one.words / one.documents if one.documents else None).cast("double")

    terms = single.select("term").unionByName(phrase.select("term")).distinct()
    hits = index.postings_of(terms, field, gaps=False).select("doc_id", "term", "tf", "dl")
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))

    weight = single.join(df, "term").groupBy("query_id", "segment").agg(idf(n_docs, F.max("df")).alias("weight"))
    as_word = (hits.join(single, "term").groupBy("query_id", "segment", "doc_id")
               .agg(F.sum("tf").cast("double").alias("tf"), F.first("dl").cast("double").alias("dl"))
               .join(weight, ["query_id", "segment"]))

    found = phrase_matches(index, phrase.select(F.col("spelling").alias("query_id"), "k", "term"), field)
    rarity = phrase.join(df, "term").groupBy("spelling").agg(F.sum(idf(n_docs, F.col("df"))).alias("weight"))
    heads = phrase.filter("k = 0").select("query_id", "segment", "spelling", "term").join(
        hits.select("term", "doc_id", "dl"), "term")
    as_phrase = (found.withColumnRenamed("query_id", "spelling").join(heads, ["spelling", "doc_id"])
                 .join(rarity, "spelling"))
    part = F.col("weight") * tf_norm(F.col("tf"), F.col("dl"), avgdl)
    parts = as_word.select("query_id", "doc_id", part.alias("part")).unionByName(as_phrase.select(
        "query_id", "doc_id", (F.col("weight") * tf_norm(F.col("freq"), F.col("dl").cast("double"), avgdl)).alias("part")))
    scores = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top_per_query(scores, top)
