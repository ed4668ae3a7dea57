"""The calls of the service as one object over a folder of tables.

Tables live below one root: news, prices, news_returns, event_returns_history, news_gaps,
stock_list, documents, disclosures, alias_map. Every read returns a DataFrame; only `build_*`,
`scan` and `index` write.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace as changed
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from newswake.functions.dates import as_date, date_context, seoul_midnight
from newswake.functions.words import EVENT_TERMS
from newswake.operators import companies as co, disclosures as ds, documents as dc, event_store as es, gap_reports as rep
from newswake.operators import patterns as pt, prices as pr, search as se, search_index as si
from newswake.operators import trust as tr
from newswake.operators.gaps import GapRules
from newswake.operators.labels import Label, classify, starter_registry
from newswake.operators.upsert import first_per_key
from newswake.plans import study
from newswake.schemas import EVENT_RETURNS_HISTORY, NEWS_GAPS, NEWS_RETURNS, conform
from newswake.sources import writers

GAP_KEYS = ["news_id", "stock_code", "event_code", "horizon"]
GAP_UPDATES = ["z_score", "direction", "magnitude", "calc_mode"]
RETURN_KEYS = ["news_id", "stock_code", "event_code"]
RETURN_UPDATES = ["return_1d", "return_3d", "return_5d"]
HISTORY_KEYS = ["stock_code", "event_date", "event_code"]


@dataclass
class Engine:
    spark: SparkSession
    root: str
    rules: GapRules = GapRules()
    registry: Sequence[Label] = ()
    synonyms: Sequence[tuple[str, str]] = ()
    score_steps: tuple[float, float, float] = (30.0, 20.0, 10.0)
    lexicon: dict = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def summaries(self, name: str) -> study.Summaries:
        """A table of returns and the stored counts of it."""
        return study.Summaries(self.table(name), es.opened(self.spark, self.path(f"{name}_counts")))

    def _count(self, written: DataFrame, name: str, date_col: str) -> None:
        """Bring the stored counts of a table up to the months of the rows just written to it."""
        months = [r.m for r in written.select(writers.month_of(date_col).alias("m")).distinct().collect() if r.m is not None]
        es.update(self.table(name), self.path(f"{name}_counts"), date_col, months)

    # --- histories and scans --------------------------------------------------------------

    def build_news_returns(self, start: str, end: str) -> None:
        rows = study.build_news_returns(self.table("news"), self.table("alias_map"),
                                        self.table("prices"), start, end)
        fresh = writers.kept(conform(rows, NEWS_RETURNS))
        writers.upsert_table(fresh, self.path("news_returns"), RETURN_KEYS, "news_date", RETURN_UPDATES)
        self._count(fresh, "news_returns", "news_date")

    def build_event_history(self, labelled: DataFrame, start: str) -> DataFrame:
        """Write the history of labelled disclosures and return the run counters."""
        outcomes = writers.kept(study.label_outcomes(
            labelled, self.table("stock_list"), self.table("prices"), start))
        stamped = study.build_event_history(outcomes).withColumns(
            {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
        keep_created = [c for c in EVENT_RETURNS_HISTORY.names
                        if c not in (*HISTORY_KEYS, "created_at")]
        writers.upsert_table(conform(stamped, EVENT_RETURNS_HISTORY),
                             self.path("event_returns_history"), HISTORY_KEYS, "event_date",
                             keep_created)
        self._count(stamped, "event_returns_history", "event_date")
        return study.run_counters(outcomes)

    def _save_gaps(self, signals: DataFrame) -> None:
        rest = F.struct(*[c for c in signals.columns if c not in GAP_KEYS])
        rows = first_per_key(signals, GAP_KEYS, rest).withColumn("detected_at", F.current_timestamp())
        writers.upsert_table(conform(rows, NEWS_GAPS), self.path("news_gaps"), GAP_KEYS,
                             "news_date", GAP_UPDATES)

    def scan(self, day: str | date, save: bool = True, z_threshold: float | None = None
             ) -> DataFrame:
        """HISTORY with SIMPLE fallback for the news of one day."""
        return self.scan_range(day, day, day, save, z_threshold)

    def scan_range(self, start: str | date, end: str | date, as_of: str | date, save: bool = True,
                   z_threshold: float | None = None) -> DataFrame:
        rules = self.rules if z_threshold is None else changed(self.rules, z_threshold=z_threshold)
        signals = study.scan_with_fallback(
            self.table("news"), self.table("alias_map"), self.table("prices"),
            self.summaries("event_returns_history"), self.summaries("news_returns"), start, end, as_of, rules)
        if save:
            self._save_gaps(signals)
        return signals

    def backfill(self, start: str | date, end: str | date, save: bool = True) -> DataFrame:
        signals = study.backfill(self.table("news"), self.table("alias_map"), self.table("prices"),
                                 self.table("news_returns"), start, end, self.rules)
        if save:
            self._save_gaps(signals)
        return signals

    def scan_recent(self, as_of: str | date, hours: int = 48, z_threshold: float | None = None
                    ) -> DataFrame:
        rules = self.rules if z_threshold is None else changed(self.rules, z_threshold=z_threshold)
        return study.scan_recent_pooled(
            self.table("news"), self.table("alias_map"), self.table("prices"),
            self.summaries("news_returns"), as_of, hours, rules)

    # --- gap reads ------------------------------------------------------------------------

    def check_gaps(self, stock_code: str, as_of: str | date, days: int = 3) -> DataFrame:
        return rep.check(self.table("news_gaps"), stock_code, as_date(as_of), days)

    def price_change(self, as_of: str | date, days: int, formula: str = "first_last") -> DataFrame:
        end = as_date(as_of)
        since = F.date_sub(end, days)
        if formula == "range":
            return pr.range_change(self.table("prices"), since)
        return pr.first_last_change(self.table("prices"), since, end)

    def check_summary(self, as_of: str | date, days: int = 100) -> DataFrame:
        return rep.check_summary(self.table("news_gaps"), self.price_change(as_of, days),
                                 as_date(as_of), days)

    def list_gaps(self, as_of: str | date, **filters) -> DataFrame:
        return rep.list_gaps(self.table("news_gaps"), as_date(as_of), **filters)

    def gap_stats(self, as_of: str | date, days: int = 7, top_events: int | None = 10) -> DataFrame:
        return rep.stats(self.table("news_gaps"), as_date(as_of), days, top_events)

    def simple_stats(self, as_of: str | date, days: int = 7) -> DataFrame:
        return rep.simple_stats(self.table("news_gaps"), as_date(as_of), days)

    # --- documents, search, trust, patterns -------------------------------------------------

    def index(self, articles: DataFrame) -> None:
        """Build documents from articles, write them by id and index their words; undatable ones
        are left out. The built rows are written first, so both writes read the same ones."""
        usable, _ = dc.quarantine(dc.build(articles, self.synonyms))
        if writers.exists(self.spark, self.path("alias_map")):
            usable = dc.add_tickers(usable, self.table("alias_map"))
        one_each = first_per_key(usable, ["id"], F.struct(*[c for c in usable.columns if c != "id"]))
        writers.replace(one_each, self.path("incoming_documents"))
        incoming = self.table("incoming_documents")
        writers.upsert_table(incoming, self.path("documents"), ["id"], "published_at")
        si.update(incoming, self.path("index"), {
            "title": F.col("title"), "body": F.col("body"), "events": F.concat_ws(" ", "events")})

    def classify(self, titles: DataFrame, title_col: str = "title", top: int | None = 2) -> DataFrame:
        """The first `top` labels of each title, or all of them."""
        registry = self.registry or starter_registry()
        return titles.withColumn("event", classify(F.col(title_col), registry, top=top))

    def _range(self, text: str, as_of: str | date) -> tuple:
        c = date_context(F.lit(text), as_of)
        return seoul_midnight(c["start"]), seoul_midnight(F.date_add(c["end"], 1))

    def companies_in(self, text: str, given: Sequence[str] = ()) -> list[str]:
        """Names given with a request, then those extracted from its text by the dictionary tables
        (company_patterns, company_master), where there are any; each once."""
        if not writers.exists(self.spark, self.path("company_patterns")):
            return list(dict.fromkeys(given))
        one = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        found = co.extract(one, self.table("company_patterns"), self.table("company_master")).orderBy("rank")
        return list(dict.fromkeys([*given, *[r.company for r in found.select("company").collect()]]))

    def search(self, text: str, as_of: str | date, companies: Sequence[str] = (),
               event_phrases: Sequence[str] = (), event_labels: Sequence[str] = (),
               top: int = 20) -> DataFrame:
        request = changed(se.parse_intent(text, self.synonyms, EVENT_TERMS, companies),
                          event_phrases=tuple(event_phrases), event_labels=tuple(event_labels))
        start, end = self._range(text, as_of)
        return se.search(self.table("documents"), request, as_date(as_of).cast("timestamp"),
                         start, end, top, si.opened(self.spark, self.path("index")))

    def verify_rumor(self, text: str, as_of: str | date, companies: Sequence[str] = (),
                     event_phrases: Sequence[str] = (), event_labels: Sequence[str] = ("other",),
                     corp_codes: Sequence[str] = ()) -> DataFrame:
        """One row: trust score, level, reason, the numbers behind them and the articles they rest on.
        Companies are those given and those that the text names."""
        companies = self.companies_in(text, companies)
        start, end = self._range(text, as_of)
        found = self.search(text, as_of, companies, event_phrases, event_labels)
        w = F.row_number().over(se.Window.orderBy(F.desc("score"), "id"))
        hits = found.withColumn("rank", w).withColumn("query_id", F.lit(0))
        texts = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
        claim = self.spark.range(1).select(
            F.lit(0).alias("query_id"), F.lit(text).alias("text"), texts(companies).alias("companies"),
            texts(event_labels).alias("labels"), texts(event_phrases).alias("phrases"),
            start.alias("range_start"), end.alias("range_end"))
        points = self._disclosure_points(text, as_of, companies, corp_codes) if corp_codes else None
        listed = tr.evidence(tr.classify_hits(claim, hits))
        return tr.verdicts(claim, hits, points, self.score_steps).join(listed, "query_id", "left")

    def _disclosure_points(self, text: str, as_of: str | date, companies, corp_codes) -> DataFrame:
        articles = self.spark.range(1).select(
            F.lit(0).alias("article_id"), F.lit(text).alias("title"), F.lit(text).alias("body"),
            as_date(as_of).alias("article_date"),
            F.explode(F.array(*[F.lit(c) for c in corp_codes])).alias("corp_code"),
            F.array(*[F.lit(c) for c in companies]).cast("array<string>").alias("companies"))
        out = ds.verify(articles, self.table("disclosures"), window_days=7)
        return out.select(F.col("article_id").alias("query_id"),
                          F.col("adjustment").cast("double").alias("adjustment"),
                          F.col("relevant").alias("evidence"))

    def verify_gaps(self, text: str, stock_code: str, as_of: str | date, days: int = 3,
                    **claim) -> DataFrame:
        """The rumor verdict beside the strongest gaps of a stock.

        The published service names this call but not its body; the interpretation of direction
        and strength below is ours.
        """
        gaps = self.check_gaps(stock_code, as_of, days).withColumn(
            "interpretation", F.when(F.col("direction") == "OVER", "stronger_than_usual")
            .otherwise("weaker_than_usual")).withColumn(
            "risk_level", F.when(F.col("magnitude") == "EXTREME", "HIGH")
            .when(F.col("magnitude") == "HIGH", "MEDIUM").otherwise("LOW"))
        listed = gaps.agg(F.collect_list(F.struct(*gaps.columns)).alias("gap_signals"))
        verdict = self.verify_rumor(text, as_of, **claim)
        return verdict.withColumn("gap_signals", listed.scalar())

    def analyze_patterns(self, as_of: str | date, companies: Sequence[str], events: Sequence[str],
                         lookback_days: int = 365, min_similarity: float = 0.3
                         ) -> tuple[DataFrame, DataFrame]:
        """(top similar cases, insights)."""
        now = as_date(as_of).cast("timestamp")
        cases = pt.similar_cases(self.table("documents"), companies, events,
                                 now - F.make_dt_interval(days=F.lit(lookback_days)), now,
                                 min_similarity)
        return pt.top_cases(cases), pt.insights(cases, now)
