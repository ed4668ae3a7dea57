"""Company names in text: dictionary mentions, votes, validation, refinement, enrichment.

Mentions are long rows (doc_id, company, alias, start, stop, weight). A document's rows are as
many as its mentions; all steps after the scan are aggregates keyed by (doc_id, company), so one
company that fills a third of all documents is spread over them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newswake.functions import words
from newswake.functions.text import each, has_any, long_enough, name_similarity
from newswake.sources.writers import kept

PATTERN_VOTE = 0.45
PROVIDER_VOTE = 0.55
HIGH, MEDIUM_SHARE, LOW = 0.55, 0.7, 0.3


# --- dictionary ---------------------------------------------------------------------------

def suffix_aliases(name: Column) -> Column:
    """Short forms by suffix: 전자 and 홀딩스 drop it, 자동차 drops it and also becomes 차."""
    base = lambda s: F.replace(name, F.lit(s), F.lit(""))
    usable = lambda s: name.contains(s) & (F.length(base(s)) > 1)
    return F.array_distinct(F.array_compact(F.array(
        F.when(usable("전자"), base("전자")),
        F.when(usable("자동차"), base("자동차")),
        F.when(usable("자동차"), F.concat(base("자동차"), F.lit("차"))),
        F.when(usable("홀딩스"), base("홀딩스")))))


def alias_table(master: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(company, alias, ord): the name itself first, then given aliases, then suffix forms."""
    own = master.select(F.col("name").alias("company"), F.col("name").alias("alias"),
                        F.lit(0).alias("ord"))
    by_rule = master.select(
        F.col("name").alias("company"), F.posexplode(suffix_aliases(F.col("name")))
    ).select("company", F.col("col").alias("alias"), (F.col("pos") + 1000).alias("ord"))
    rows = own.unionByName(by_rule)
    if given is not None:
        rows = rows.unionByName(given.select("company", "alias", "ord"))
    return rows.groupBy("company", "alias").agg(F.min("ord").alias("ord"))


def pattern_weights(aliases: DataFrame, master: DataFrame, extra_aliases: int | None = None) -> DataFrame:
    """(alias, company, weight) of the name and its aliases, all of them or the first ones.

    The base weight grows with verified, listed, long and key-sector names; aliases weigh 0.95 of
    it when at least as long as the name, else 0.85.
    """
    rank = Window.partitionBy("company").orderBy((F.col("alias") != F.col("company")).cast("int"),
                                                 "ord", "alias")
    base = (
        F.lit(0.7)
        + F.when(F.col("verified"), 0.1).otherwise(0.0)
        + F.when(F.col("type") == "listed", 0.1).otherwise(0.0)
        + F.when(F.length("company") >= 4, 0.05).otherwise(0.0)
        + F.when(F.col("sector").isin(*words.KEY_SECTORS), 0.05).otherwise(0.0))
    factor = (F.when(F.col("alias") == F.col("company"), 1.0)
              .when(F.length("alias") >= F.length("company"), 0.95).otherwise(0.85))
    if extra_aliases is not None:
        aliases = aliases.withColumn("rank", F.row_number().over(rank)).filter(
            F.col("rank") <= 1 + extra_aliases)
    return (
        aliases
        .join(master.withColumnRenamed("name", "company"), "company")
        .select("alias", "company", (base * factor).alias("weight"))
    )


def similar_names(names: DataFrame, master: DataFrame, threshold: float = 0.9,
                  top: int = 3) -> DataFrame:
    """(name, official, similarity, rank) of the master names like each given name.

    A similarity t needs a Jaccard j of at least (t - 0.3) / 0.7 between the letter sets. Then the
    sets share a letter among the first (1 - j) of each in one fixed order, and their sizes differ
    by a factor of at most 1 / j. The order is rarest letter first, so few names meet on a (letter,
    set size); what meets are different letter sets, and only those that are alike enough are
    replaced by their names. Null names match nothing.
    """
    floor = max(0.0, (threshold - 0.7) / 0.3)
    j = max(0.05, (threshold - 0.3) / 0.7)
    eps = 1e-9

    def lettered(df: DataFrame, col: str) -> DataFrame:
        return df.filter(F.col(col).isNotNull()).select(F.col(col).alias("name")).distinct().select(
            "name", F.array_sort(F.array_distinct(F.split(F.lower("name"), ""))).alias("letters"))

    left, right = lettered(names, "name"), lettered(master, "name")
    sets = {"a": left.select("letters").distinct(), "b": right.select("letters").distinct()}
    # one row a letter of the alphabets in use
    rarity = (sets["a"].unionByName(sets["b"]).select(F.explode("letters").alias("letter"))
              .groupBy("letter").agg(F.count("*").alias("n")))

    def keyed(one: str) -> DataFrame:
        ranked = (sets[one].select("letters", F.explode("letters").alias("letter"))
                  .join(rarity, "letter").groupBy("letters")
                  .agg(F.array_sort(F.collect_list(F.struct("n", "letter"))).alias("l")))
        sized = ranked.select(F.col("letters").alias(one), "l.letter", F.size("letters").alias("size"))
        keep = (F.col("size") - F.ceil(F.col("size") * j - eps) + 1).cast("int")
        return sized.select(one, "size", F.explode(
            F.slice("letter", F.lit(1), F.greatest(keep, F.lit(1)))).alias("letter"))

    b = keyed("b").withColumn("size", F.explode(F.sequence(
        F.ceil(F.col("size") * j - eps).cast("int"), F.floor(F.col("size") / j + eps).cast("int"))))
    common = F.size(F.array_intersect("a", "b"))
    alike = (keyed("a").join(b, ["letter", "size"]).select("a", "b").distinct()
             .filter(common >= (F.size("a") + F.size("b") - common) * j - eps))
    ratio = F.least(F.length("name"), F.length("official")) / F.greatest(
        F.length("name"), F.length("official"))
    scored = (alike.join(left.withColumnRenamed("letters", "a"), "a")
              .join(right.select(F.col("name").alias("official"), F.col("letters").alias("b")), "b")
              .filter(ratio >= floor - eps)
              .select("name", "official", name_similarity(F.col("name"), F.col("official"))
                      .alias("similarity")))
    w = Window.partitionBy("name").orderBy(F.round("similarity", 9).desc(), "official")
    return (scored.filter(F.col("similarity") >= threshold)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top))


def learn_aliases(names: DataFrame, aliases: DataFrame, master: DataFrame,
                  threshold: float = 0.9) -> DataFrame:
    """(alias, official, similarity) for names that are no alias yet but have a close master name."""
    unknown = names.join(aliases.select(F.col("alias").alias("name")), "name", "left_anti")
    return similar_names(unknown, master, threshold, top=1).select(
        F.col("name").alias("alias"), "official", "similarity")


def learning_histogram(learned: DataFrame) -> DataFrame:
    """(band, count) by tenth of similarity."""
    return learned.groupBy((F.floor(F.col("similarity") * 10) / 10).alias("band")).agg(
        F.count("*").alias("count"))


# --- gates --------------------------------------------------------------------------------

def is_analyst_report(text: Column) -> Column:
    """A broker's name and a report word anywhere in the text, the word in any case."""
    broker = F.lit(False)
    for b in words.BROKERS:
        broker = broker | text.contains(b)
    return broker & has_any(text, words.REPORT_WORDS)


def extractable(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.filter(long_enough(F.col(text_col)) & ~is_analyst_report(F.col(text_col)))


# --- mentions -----------------------------------------------------------------------------

MENTION_SCHEMA = "start int, stop int, company string, alias string, weight double"


def _fold(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


Places = dict[str, list[tuple[int, int]]]


class Finder:
    """Where aliases (folded) stand in a folded text: all their places, overlapping ones too, by start.

    A list for all texts is one automaton. The few aliases that may stand in one text are looked up
    one by one, so nothing is built for a text."""

    def __init__(self, aliases: list[str], shared: bool):
        self.aliases, self.automaton = [a for a in dict.fromkeys(aliases) if a], None
        if shared and self.aliases:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for alias in self.aliases:
                self.automaton.add_word(alias, alias)
            self.automaton.make_automaton()

    def places(self, text: str) -> Places:
        found: Places = {}
        if self.automaton is not None:
            for end, alias in self.automaton.iter(text):
                found.setdefault(alias, []).append((end + 1 - len(alias), end + 1))
            return found
        for alias in self.aliases:
            at = text.find(alias)
            while at >= 0:
                found.setdefault(alias, []).append((at, at + len(alias)))
                at = text.find(alias, at + 1)
        return found


def _apart(places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Without those that overlap one before."""
    free = 0
    for start, stop in places:
        if start >= free:
            free = stop
            yield start, stop


class Lexicon:
    """A fixed (alias, company, weight) list and what it finds in a text.

    Letter case is ignored; the alias reported is the text as written.
    """

    def __init__(self, entries: list[tuple[str, str, float]], shared: bool = True):
        self.by_alias: dict[str, list[tuple[str, float]]] = {}
        for alias, company, weight in entries:
            self.by_alias.setdefault(alias.lower(), []).append((company, weight))
        self.finder = Finder(list(self.by_alias), shared)

    def places(self, text: str) -> Places:
        return self.finder.places(_fold(text))

    def spans(self, text: str, places: Places) -> list[tuple]:
        found = [(s, e, company, text[s:e], weight) for alias, every in places.items() for s, e in _apart(every)
                 for company, weight in self.by_alias[alias]]
        found.sort(key=lambda m: (m[0], -m[4], -len(m[2]), m[2], m[3]))
        done: list[tuple] = []
        live: list[tuple] = []
        for m in found:
            # spans come in start order: what ends before this start cannot overlap any more
            done += [k for k in live if k[1] <= m[0]]
            live = [k for k in live if k[1] > m[0]]
            clash = [k for k in live if k[0] < m[1]]
            if not clash:
                live.append(m)
            else:
                best = max([*clash, m], key=lambda m: (m[4], len(m[2]), 1.0 if m[3] == m[2] else 0.8))
                live = [k for k in live if k not in clash] + [best]
        return done + live


#: A dictionary goes to the tasks up to this size; beyond it, every text is given what may stand in it.
MAX_DICTIONARY_BYTES = 32 << 20


def _small_dictionary(rows: DataFrame) -> list | None:
    """The rows of a dictionary if they take at most MAX_DICTIONARY_BYTES, else None."""
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns]
    size = F.lit(16)
    for t in text:
        size = size + t
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.collect() if total <= MAX_DICTIONARY_BYTES else None


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, which ids that repeat or are missing are not."""
    return kept(docs.withColumn("_row", F.monotonically_increasing_id()))


def mentions(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, company, alias, weight) of the resolved dictionary mentions.

    Overlapping spans keep the best by weight, name length and whether the alias is the name itself.
    A dictionary of checked size goes to the tasks; of a larger one every row is given the entries
    that may stand in its text. What is found in a text does not depend on which.
    """
    rows = _small_dictionary(patterns.select("alias", "company", "weight"))
    entries = None if rows is None else sorted((r.alias, r.company, r.weight) for r in rows)
    given = docs.select(id_col, text_col)
    if entries is None:
        given = with_entries(_numbered(given), patterns, text_col)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = None if entries is None else Lexicon(entries)
        for pdf in batches:
            own = [None] * len(pdf) if entries is not None else pdf["entries"]
            out = []
            for i, t, e in zip(pdf[id_col], pdf[text_col], own, strict=True):
                lexicon, text = shared or Lexicon(_own_entries(e), shared=False), t or ""
                out += [(i, *m) for m in lexicon.spans(text, lexicon.places(text))]
            yield pd.DataFrame(
                out, columns=[id_col, "start", "stop", "company", "alias", "weight"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return given.mapInPandas(scan, f"{id_col} {id_type}, {MENTION_SCHEMA}")


def _own_entries(rows) -> list[tuple[str, str, float]]:
    return sorted({(r["alias"], r["company"], r["weight"]) for r in (() if rows is None else rows)})


def with_entries(docs: DataFrame, patterns: DataFrame, text_col: str,
                 provider_col: str | None = None) -> DataFrame:
    """Numbered rows with `entries`: the (alias, company, weight) rows that may stand in a row's text or
    that its provider named. A row's list is bounded by the different runs of its text."""
    met = meetings(docs, patterns, "_row", text_col)
    if provider_col:
        met = met.unionByName(docs.select("_row", each(F.col(provider_col)).alias("alias"))
                              .select("_row", F.trim("alias").alias("alias"))).distinct()
    lists = met.join(patterns.select("alias", "company", "weight"), "alias").groupBy("_row").agg(
        F.collect_list(F.struct("alias", "company", "weight")).alias("entries"))
    return docs.join(lists, "_row", "left")


def count_mentions(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, alias, hits): non-overlapping occurrences of each alias in any letter case, by row.

    A dictionary of checked size goes to the tasks and each text is read once; a larger one is
    joined instead, by the row's number, with the same result.
    """
    rows = _small_dictionary(aliases.select("alias").distinct())
    if rows is None:
        return dictionary_hits(docs, aliases, id_col, text_col)
    by_fold: dict[str, list[str]] = {}
    for r in rows:
        by_fold.setdefault(r.alias.lower(), []).append(r.alias)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(list(by_fold), shared=True)
        for pdf in batches:
            out = [(i, alias, sum(1 for _ in _apart(places)))
                   for i, t in zip(pdf[id_col], pdf[text_col], strict=True)
                   for fold, places in finder.places(_fold(t or "")).items() for alias in by_fold[fold]]
            yield pd.DataFrame(out, columns=[id_col, "alias", "hits"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(
        scan, f"{id_col} {id_type}, alias string, hits long")


HEAD_LETTERS = (8, 4, 2, 1)
RUN_LETTERS = 1 << 20


def _run_keys(text: str, lengths: list[int]) -> np.ndarray:
    """64-bit hashes of the different runs of so many letters (of HEAD_LETTERS) of a text."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    runs, size, found = (np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)) * odd, 1, []
    while True:
        if size in lengths:
            found.append(runs ^ np.uint64(size))
        if size >= max(lengths):
            return np.unique(np.concatenate(found)).view(np.int64)
        left = runs[:max(len(runs) - size, 0)]
        mixed = (left ^ (left >> np.uint64(29))) * odd
        runs, size = mixed + runs[size:], size * 2


def run_keys(text: Column, lengths: Column | list[int]) -> Column:
    """`_run_keys` of texts as they are written. `lengths` are those of all texts, or a column of one
    for each: the key of its first letters."""
    if isinstance(lengths, list):
        @F.pandas_udf(T.ArrayType(T.LongType()))
        def every(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out, letters = [], 0
                for t in texts:  # the keys take up to 8 bytes a letter and length, so few go on at a time
                    out.append(_run_keys(t or "", lengths))
                    letters += len(out[-1])
                    if letters >= RUN_LETTERS:
                        yield pd.Series(out, dtype=object)
                        out, letters = [], 0
                if out:
                    yield pd.Series(out, dtype=object)
        return every(text)

    @F.pandas_udf(T.LongType())
    def head(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([int(_run_keys(t[:n], [n])[0]) for t, n in zip(texts, sizes)], dtype="int64")
    return head(text, lengths)


def meetings(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text"
             ) -> DataFrame:
    """(doc_id, alias) that may go together: the first 8, 4, 2 or 1 letters of the alias, the longest
    it has, are a run of the text in any letter case. Texts are not moved, only hashes of their
    distinct runs, and these only in the lengths that the dictionary needs; a hash that two runs share
    gives a pair more, which is for the caller to compare anyway."""
    size = F.length("low")
    needed = F.lit(None).cast("int")
    for n in reversed(HEAD_LETTERS):
        needed = F.when(size >= n, n).otherwise(needed)
    heads = (aliases.select("alias").distinct().withColumn("low", F.lower("alias"))
             .withColumn("n", needed).filter(F.col("n").isNotNull()))
    lengths = sorted(r.n for r in heads.select("n").distinct().collect()) or [HEAD_LETTERS[0]]
    heads = heads.select("alias", run_keys(F.col("low"), F.col("n")).alias("head"))
    runs = docs.select(id_col, each(run_keys(F.lower(text_col), lengths)).alias("head"))
    return runs.join(heads, "head").select(id_col, "alias")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _occurrences(texts: pd.Series, names: pd.Series) -> pd.Series:
    """How often each of its names stands in a text, without overlaps."""
    return pd.Series([[t.count(n) for n in every] for t, every in zip(texts, names)], dtype=object)


def dictionary_hits(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, alias, hits): non-overlapping occurrences of each alias in any letter case, by row.

    Made of joins, so the dictionary may have any size: only the aliases whose first letters stand in
    a text are counted in it. They meet the text as one list, which is bounded by the different runs
    of the text, so a text is moved and lower-cased once and not once an alias.
    """
    numbered = _numbered(docs.select(id_col, text_col))
    lists = meetings(numbered, aliases, "_row", text_col).groupBy("_row").agg(F.collect_list("alias").alias("aliases"))
    met = numbered.join(lists, "_row").select(
        id_col, "aliases", _occurrences(F.lower(text_col), F.transform("aliases", F.lower)).alias("hits"))
    found = met.select(id_col, F.explode(F.arrays_zip("aliases", "hits")).alias("found"))
    return found.select(id_col, F.col("found.aliases").alias("alias"), F.col("found.hits").alias("hits")).filter("hits > 0")


# --- votes, validation, refinement --------------------------------------------------------

def pattern_votes(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Votes of the dictionary: one per mention, a company named twice votes twice."""
    return found.select(id_col, "company", F.lit("pattern_matching").alias("method"))


def collect_votes(votes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Summed vote weight, methods and number of votes per (document, company)."""
    # counted per method first, so the sum does not depend on the order of the votes
    counted = votes.filter(F.length(F.trim("company")) >= 2).groupBy(id_col, "company").agg(
        F.count_if(F.col("method") == "pattern_matching").alias("by_pattern"),
        F.count_if(F.col("method") == "provider").alias("by_provider"),
        F.count_if(~F.col("method").isin("pattern_matching", "provider")).alias("by_rest"),
        F.count_distinct("method").alias("methods"))
    return counted.select(
        id_col, "company",
        (F.col("by_pattern") * PATTERN_VOTE + F.col("by_provider") * PROVIDER_VOTE
         + F.col("by_rest") * 0.1).alias("score"),
        "methods", (F.col("by_pattern") + F.col("by_provider") + F.col("by_rest")).alias("votes"))


def tier(score: Column, methods: Column, threshold: float = HIGH, min_methods: int = 1) -> Column:
    return (F.when((score >= threshold) & (methods >= min_methods), "high")
            .when((score >= threshold * MEDIUM_SHARE) & (methods >= 1), "medium")
            .when(score >= LOW, "low"))


def obviously_invalid(name: Column) -> Column:
    return ((F.length(name) < 2) | (F.length(name) > 20) | name.isin(*words.NOT_A_COMPANY)
            | name.rlike(r"^\d+$"))


def validation_score(in_master: Column, alias_of_master: Column, similar: Column,
                     context: Column, pattern_weight: Column, name: Column) -> Column:
    """Mean of the scores that apply: dictionary standing, context, pattern and plain sense."""
    standing = (F.when(in_master, 0.9).when(alias_of_master, 0.85).when(similar, 0.6))
    pattern = F.when(pattern_weight.isNotNull(), F.least(pattern_weight + 0.1, F.lit(1.0)))
    sense = F.when(obviously_invalid(name), 0.3).otherwise(0.7)
    scores = F.array_compact(F.array(standing, context, pattern, sense))
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)


def relevance(score: Column, mentions_n: Column, alias_mentions: Column, name: Column,
              first_at: Column, length: Column, listed: Column, in_master: Column) -> Column:
    """0.4 x score, 0.2 x mentions (3 are full), 0.1 x alias mentions (5 are full), 0.15 x how early
    the name stands, and up to 0.15 for a listed and a long name."""
    early = F.when(first_at >= 0, (1.0 - first_at / F.greatest(length, F.lit(1))) * 0.15).otherwise(0.0)
    bonus = F.when(in_master, F.when(listed, 0.075).otherwise(0.0)
                   + F.when(F.length(name) >= 4, 0.075).otherwise(0.0)).otherwise(0.0)
    return (score * 0.4 + F.least(mentions_n / 3.0, F.lit(1.0)) * 0.2
            + F.least(alias_mentions / 5.0, F.lit(1.0)) * 0.1 + early + bonus)


FACTS_SCHEMA = ("company string, votes int, provider_votes int, weight double, name_mentions int, "
                "alias_mentions int, first_at int, length int, in_title boolean, "
                "group_mention boolean, sector_word boolean, named boolean")


LETTERS = re.compile("[가-힣A-Za-z]")
WORD_LETTERS = re.compile("[가-힣A-Za-z0-9]")


def _bounded(text: str, place: tuple[int, int], letters: re.Pattern) -> bool:
    """Whether no such letter touches the place."""
    start, stop = place
    return not (start and letters.match(text[start - 1])) and not (stop < len(text) and letters.match(text[stop]))


def _fact_finder(entries: list[tuple[str, str, float]], weights: dict[str, float],
                 sectors: dict[str, str | None], shared: bool):
    """Function from a text, its title and a provider's names to the rows of `company_facts`. Everything
    about names of the dictionary comes from the places of one pass over the text."""
    lexicon = Lexicon(entries, shared)
    official = {alias: company for alias, company, _ in reversed(entries)}
    aliases: dict[str, list[str]] = {}
    for alias, company, _ in entries:
        if alias != company:
            aliases.setdefault(company, []).append(alias)

    def facts(text: str, title: str, provided: list[str]) -> Iterator[tuple]:
        places = lexicon.places(text)
        votes = Counter(m[2] for m in lexicon.spans(text, places))
        asked = Counter(official.get(p.strip(), p.strip()) for p in provided
                        if p is not None and len(p.strip()) >= 2)
        others = [n for n in asked if n.lower() not in lexicon.by_alias]
        if others:
            places = {**places, **Finder([n.lower() for n in others], shared=False).places(_fold(text))}

        def written(name: str) -> list[tuple[int, int]]:
            """Its places in this letter case."""
            return [p for p in places.get(name.lower(), ()) if text[p[0]:p[1]] == name]

        def count(name: str) -> int:
            return sum(1 for _ in _apart([p for p in written(name) if _bounded(text, p, LETTERS)]))

        for name in votes.keys() | asked.keys():
            of = aliases.get(name, ())
            terms = words.SECTOR_WORDS.get(sectors.get(name) or "", ())
            at = written(name)
            yield (name, votes[name], asked[name], weights.get(name), count(name), sum(map(count, of)),
                   at[0][0] if at else -1, len(text), name in title,
                   name in words.GROUPS and any(name + p in text for p in words.PARTICLES),
                   any(t in text for t in terms),
                   any(_bounded(text, p, WORD_LETTERS) for a in (name, *of) for p in places.get(a.lower(), ())))

    return facts


def _with_abouts(docs: DataFrame, patterns: DataFrame, master: DataFrame, text_col: str,
                 provider_col: str | None) -> DataFrame:
    """`with_entries`, and `abouts`: (company, weight, sector) of every company in them or named by
    the provider; the weight is the greatest of all its aliases."""
    given = with_entries(docs, patterns, text_col, provider_col)
    named = given.select("_row", F.explode(F.col("entries.company")).alias("company"))
    if provider_col:
        named = named.unionByName(docs.select("_row", F.explode(provider_col).alias("company"))
                                  .select("_row", F.trim("company").alias("company")))
    about = patterns.groupBy("company").agg(F.max("weight").alias("weight")).join(
        master.select(F.col("name").alias("company"), "sector"), "company", "full")
    lists = named.distinct().join(about, "company").groupBy("_row").agg(
        F.collect_list(F.struct("company", "weight", "sector")).alias("abouts"))
    return given.join(lists, "_row", "left")


def company_facts(docs: DataFrame, patterns: DataFrame, master: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", title_col: str | None = None,
                  provider_col: str | None = None) -> DataFrame:
    """One row per (row, company) with every number the later steps need from the text.

    Only these small rows go on. Companies come from the dictionary mentions and, if given, from an
    array column of a provider's answers. Dictionaries of checked size go to the tasks and the texts
    are read once where they lie; of larger ones every row is given the entries that concern it, by
    its number. What is found in a text does not depend on which.
    """
    rows = _small_dictionary(patterns.select("alias", "company", "weight"))
    about = _small_dictionary(master.select("name", "sector"))
    given = docs.select(id_col, text_col, *[c for c in (title_col, provider_col) if c])
    small = rows is not None and about is not None
    if small:
        entries = sorted((r.alias, r.company, r.weight) for r in rows)
        sectors = {r.name: r.sector for r in about}
    else:
        entries, sectors = [], {}
        given = _with_abouts(_numbered(given), patterns, master, text_col, provider_col)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict[str, float] = {}
        for _, company, weight in entries:
            weights[company] = max(weight, weights.get(company, 0.0))
        shared = _fact_finder(entries, weights, sectors, shared=True) if small else None

        def own(found, abouts):
            rows = () if abouts is None else abouts
            return _fact_finder(_own_entries(found),
                                {r["company"]: r["weight"] for r in rows if r["weight"] is not None},
                                {r["company"]: r["sector"] for r in rows}, shared=False)

        for pdf in batches:
            none = [None] * len(pdf)
            titles = pdf[title_col] if title_col else none
            answers = pdf[provider_col] if provider_col else none
            finders = ([shared] * len(pdf) if small
                       else map(own, pdf["entries"], pdf["abouts"]))
            out = [(i, *f) for i, text, title, provided, facts in
                   zip(pdf[id_col], pdf[text_col], titles, answers, finders, strict=True)
                   for f in facts(text or "", title or "", [] if provided is None else list(provided))]
            yield pd.DataFrame(out, columns=[id_col, *[c.split()[0] for c in FACTS_SCHEMA.split(", ")]])

    id_type = docs.schema[id_col].dataType.simpleString()
    return given.mapInPandas(scan, f"{id_col} {id_type}, {FACTS_SCHEMA}")


def spellings(docs: DataFrame, patterns: DataFrame, master: DataFrame, provider_col: str,
              like: float = 0.8) -> DataFrame:
    """(name, official, similarity): the most similar master name of each provider's name that is
    neither an alias nor a master name. Names are compared once each, however often they are given."""
    known = patterns.select(F.col("alias").alias("name")).unionByName(master.select("name"))
    names = (docs.select(F.explode(provider_col).alias("name")).select(F.trim("name").alias("name"))
             .filter(F.length("name") >= 2).distinct().join(known, "name", "left_anti"))
    return similar_names(names, master, like, top=1).select("name", "official", "similarity")


def normalised_answers(docs: DataFrame, close: DataFrame, id_col: str, provider_col: str,
                       above: float = 0.9) -> DataFrame:
    """`docs` with the provider's names replaced by the master names they are closer to than `above`."""
    official = close.filter(F.col("similarity") > above).select("name", "official")
    answers = (docs.select(F.col(id_col).alias("_of"), F.explode(provider_col).alias("name"))
               .select("_of", F.trim("name").alias("name")).join(official, "name", "left")
               .groupBy("_of").agg(F.sort_array(F.collect_list(F.coalesce("official", "name")))
                                   .alias("_names")))
    return (docs.join(answers, F.col(id_col).eqNullSafe(F.col("_of")), "left")
            .withColumn(provider_col, F.col("_names")).drop("_of", "_names"))


def extract(docs: DataFrame, patterns: DataFrame, master: DataFrame, id_col: str = "doc_id",
            text_col: str = "text", title_col: str | None = None,
            provider_col: str | None = None) -> DataFrame:
    """Companies of every document with confidence, status and relevance rank. Ids are unique.

    Output: (doc_id, company, status, confidence, relevance, rank). Aliases, and a provider's
    spellings with a similarity above 0.9, become official names before votes are counted, so a
    company stands once; names with one of 0.8 to 0.9 stay and have the standing of a similar name.
    A candidate of the low tier is recovered if it is listed and it or an alias stands in the text.
    """
    texts = extractable(docs, text_col)
    close = None
    if provider_col:
        close = spellings(texts, patterns, master, provider_col)
        texts = normalised_answers(texts, close, id_col, provider_col)
    found = company_facts(texts, patterns, master, id_col, text_col, title_col,
                          provider_col).filter(~F.col("group_mention"))
    about = master.select(F.col("name").alias("company"), "type", F.lit(True).alias("in_master"))
    rows = found.join(about, "company", "left").withColumn(
        "in_master", F.coalesce("in_master", F.lit(False)))
    if close is None:
        rows = rows.withColumn("similar", F.lit(False))
    else:
        rows = rows.join(close.select(F.col("name").alias("company"), F.lit(True).alias("similar")),
                         "company", "left").withColumn("similar", F.coalesce("similar", F.lit(False)))
    name = F.col("company")
    rows = rows.withColumn(
        "score", F.col("votes") * PATTERN_VOTE + F.col("provider_votes") * PROVIDER_VOTE
    ).withColumn("methods", (F.col("votes") > 0).cast("int") + (F.col("provider_votes") > 0).cast("int"))
    context = F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("in_title"), 0.4).otherwise(0.0)
                      + F.least(F.col("name_mentions") * 0.1, F.lit(0.3))
                      + F.when(F.col("sector_word"), 0.05).otherwise(0.0))
    rows = rows.withColumn("vconf", validation_score(
        F.col("in_master"), F.lit(False), F.col("similar"), context,
        F.when(F.col("votes") > 0, F.col("weight")), name))
    level = tier(F.col("score"), F.col("methods"))
    status = (F.when((level == "high") & (F.col("vconf") >= 0.5), "validated")
              .when((level == "medium") & (F.col("vconf") > 0.6), "medium_validated")
              .when((level == "low") & F.col("in_master") & F.col("named"), "recovered_candidate"))
    final = F.when(F.col("status") == "recovered_candidate",
                   F.greatest(F.lit(0.65), (F.col("score") + 0.7) / 2)
                   ).otherwise(F.col("score") * 0.6 + F.col("vconf") * 0.4)
    scored = (
        rows.withColumn("status", status).filter(F.col("status").isNotNull())
        .select(id_col, "company", "status", final.alias("confidence"),
                relevance(F.col("score"), F.col("name_mentions"), F.col("alias_mentions"), name,
                          F.col("first_at"), F.col("length"), F.col("type") == "listed",
                          F.col("in_master")).alias("relevance")))
    w = Window.partitionBy(id_col).orderBy(F.desc("relevance"), "company")
    return scored.withColumn("rank", F.row_number().over(w))


def enrich(companies: DataFrame, master: DataFrame, stock_list: DataFrame) -> DataFrame:
    """Add stock code, corp code, sector and market; the master's stock code goes first."""
    about = master.select(F.col("name").alias("company"), F.col("code").alias("_code"), "sector",
                          "market")
    listed = stock_list.groupBy(F.col("corp_name").alias("company")).agg(
        F.min_by(F.struct("stock_code", "corp_code"), "stock_code").alias("_s"))
    return (companies.join(about, "company", "left").join(listed, "company", "left")
            .withColumn("stock_code", F.coalesce("_code", "_s.stock_code"))
            .withColumn("corp_code", F.col("_s.corp_code")).drop("_code", "_s"))


def names_and_tickers(enriched: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Comma lists of names and codes per document, in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "company", "stock_code")))
    return enriched.groupBy(id_col).agg(ordered.alias("r")).select(
        id_col, F.concat_ws(",", F.col("r.company")).alias("names"),
        F.concat_ws(",", F.array_compact(F.col("r.stock_code"))).alias("tickers"))
