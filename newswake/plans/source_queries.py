"""Registered queries of sources and sinks: tables are written to the run's shared folder in the form
a source reads, and read back through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newswake.functions import text as tx
from newswake.operators import labels as lb, market as mk
from newswake.plans.catalog import query, r6, run_dir
from newswake.plans.views import documents, news, stock_list, table
from newswake.sources import lexicons as lx, readers as rd, writers as wr
from newswake.streaming import sync


# --- delimited text ---------------------------------------------------------------------------

@query("csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(text) AS text_md5 FROM documents""")
def csv_round_trip(spark, sf):
    """Whole texts with quotes, commas and line breaks through the export and the reader."""
    path = run_dir(spark, "csv")
    wr.export_csv(documents(spark, sf).select("doc_id", "lang", "source", "text"), path)
    read = rd.delimited(spark, path, multi_line=True)
    return read.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("csv_charsets", """
SELECT '회사 ' || c_custkey AS name, c_mktsegment AS segment FROM customer""")
def csv_charsets(spark, sf):
    """A folder whose files have different charsets: each file is read in its own."""
    path = run_dir(spark, "charsets")
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("회사 "), "c_custkey").alias("name"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") % 2).alias("part"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for part, charset in ((0, "UTF-8"), (1, "x-windows-949")):
        (rows.filter(F.col("part") == part).drop("part").write.option("header", True)
         .option("encoding", charset).csv(f"{path}/{part}"))
    return rd.delimited(spark, path).select("name", "segment")


@query("csv_folder", """
SELECT lower(o_orderstatus) AS folder, count(*) AS n FROM orders GROUP BY 1""")
def csv_folder(spark, sf):
    path = run_dir(spark, "folder")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    for status in ("F", "O", "P"):
        wr.export_csv(orders.filter(F.col("o_orderstatus") == status), f"{path}/{status.lower()}")
    name = F.regexp_extract("source_file", r"/([a-z])/[^/]*$", 1)
    return rd.folder(spark, path).groupBy(name.alias("folder")).agg(F.count("*").alias("n"))


@query("listing_file", """
SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS code, c_mktsegment AS sector,
       CASE WHEN c_nationkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market FROM customer
UNION ALL SELECT 'Both Lists', '1', 'json', NULL
UNION ALL SELECT 'Only Second ' || r_regionkey, CAST(r_regionkey AS VARCHAR), 'json', NULL FROM region""")
def listing_file(spark, sf):
    """A listing file, merged with the names that only a nested JSON dictionary has."""
    path = run_dir(spark, "listing")
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("code"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
        F.when(F.col("c_nationkey") % 2 == 0, "KOSPI").otherwise("KOSDAQ").alias("market"))
    short = spark.createDataFrame([(0, "X", "too short", "")], "code long, name string, sector string, market string")
    wr.export_csv(first.unionByName(short), f"{path}/csv")
    second = table(spark, sf, "region").select(
        F.concat(F.lit("Only Second "), "r_regionkey").alias("name"), F.col("r_regionkey").cast("string").alias("code"))
    entries = second.unionByName(spark.createDataFrame([("Both Lists", "1")], "name string, code string"))
    nested = entries.agg(F.map_from_entries(F.collect_list(F.struct("name", F.create_map(
        F.lit("code"), F.col("code"), F.lit("sector"), F.lit("json"))))).alias("companies"))
    nested.select(F.to_json(F.struct(F.create_map(F.lit("all"), F.struct("companies")).alias("categories")))
                  .alias("value")).coalesce(1).write.text(f"{path}/json")
    merged = rd.merge_masters(rd.master_file(spark, f"{path}/csv"), rd.company_json(spark, f"{path}/json"))
    return merged.select("name", "code", "sector", "market")


# --- dictionaries -----------------------------------------------------------------------------

@query("alias_file", """
SELECT s_name AS company, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code FROM supplier
UNION ALL SELECT 'S' || s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') FROM supplier""")
def alias_file(spark, sf):
    path = run_dir(spark, "aliases")
    lists = stock_list(spark, sf).select("corp_name", F.array(
        F.concat(F.lit("S"), F.col("stock_code").cast("int")), F.col("stock_code")).alias("l"))
    (lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("corp_name", "l")))).alias("value"))
     .coalesce(1).write.text(path))
    return lx.alias_map(lx.alias_lists(spark, path), six_digits=True).select("company", "stock_code")


@query("synonym_file", """
SELECT lower(n_name) AS alias, 'region_' || n_regionkey AS code FROM nation
UNION ALL SELECT lower(n_name) || ' state', 'region_' || n_regionkey FROM nation""")
def synonym_file(spark, sf):
    path = run_dir(spark, "synonyms")
    lines = table(spark, sf, "nation").select(F.concat(
        F.col("n_name"), F.lit(" , "), F.col("n_name"), F.lit(" State,=> region_"), "n_regionkey").alias("value"))
    lines.unionByName(spark.createDataFrame([("# a, b => c",), ("no rule",)], "value string")).write.text(path)
    return lx.synonyms(spark, path).select("alias", "code")


@query("learned_aliases", """
WITH known AS (SELECT 'S' || s_suppkey AS alias, s_name AS official, 0.95::DOUBLE AS similarity FROM supplier)
SELECT * FROM known
UNION ALL SELECT 'N' || s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 1 THEN 0.95 ELSE 0.9 END FROM supplier""")
def learned_aliases(spark, sf):
    """Saved, loaded, and merged with new ones: known aliases stay, of repeats the most similar."""
    path = run_dir(spark, "learned")
    s = table(spark, sf, "supplier")
    row = lambda head, score: s.select(
        F.concat(F.lit(head), "s_suppkey").alias("alias"), F.col("s_name").alias("official"),
        score.cast("double").alias("similarity"))
    lx.save_learned(row("S", F.lit(0.95)), path)
    fresh = row("S", F.lit(1.0)).unionByName(row("N", F.lit(0.9))).unionByName(
        row("N", F.when(F.col("s_suppkey") % 2 == 1, 0.95).otherwise(0.5)))
    return lx.merge_learned(lx.load_learned(spark, path), fresh)


@query("json_export", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""")
def json_export(spark, sf):
    path = run_dir(spark, "json")
    wr.save_json(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").json(path)


# --- slices of tables -------------------------------------------------------------------------

NOW = "timestamp'1996-06-01 12:00:00'"


def _touched(spark, sf) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        "o_orderkey", day.alias("created_at"),
        F.when(F.col("o_orderkey") % 3 == 0, day + F.make_dt_interval(days=F.lit(400))).alias("updated_at"))


@query("changed_since", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01 12:00:00'
  OR (o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1996-06-01 12:00:00')""")
def changed_since(spark, sf):
    return rd.changed_since(_touched(spark, sf), F.expr(NOW)).select("o_orderkey")


@query("last_minutes", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01 12:00:00' - INTERVAL 900 MINUTE
  OR (o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '1996-06-01 12:00:00' - INTERVAL 900 MINUTE)""")
def last_minutes(spark, sf):
    return rd.last_minutes(_touched(spark, sf), F.expr(NOW), 900).select("o_orderkey")


@query("rows_by_ids", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def rows_by_ids(spark, sf):
    ids = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return rd.by_ids(table(spark, sf, "orders"), ids, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("table_page", """
SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def table_page(spark, sf):
    return rd.page(table(spark, sf, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 50, 2).select("o_orderkey")


def _articles(spark, sf) -> DataFrame:
    return news(spark, sf).select(F.col("news_id").alias("id"), F.col("news_title").alias("title"),
                                  F.col("news_date").alias("published_at"))


@query("news_where", """
SELECT 'n' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'
ORDER BY o_orderdate DESC, 'n' || o_orderkey LIMIT 200""")
def news_where(spark, sf):
    return mk.news_where(_articles(spark, sf), 200, title="Order 1-URGENT O", publisher=None).select("id")


@query("counts_by", """
SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderkey > 0 GROUP BY 1""")
def counts_by(spark, sf):
    value = F.when(F.col("o_orderkey") > 0, F.col("o_orderpriority"))
    return mk.counts_by(table(spark, sf, "orders").select(value.alias("value")), "value")


@query("returns_of", """
SELECT event_id, value FROM events WHERE user_id = 7 AND ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM events)""")
def returns_of(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "value", F.col("user_id").cast("string").alias("stock_code"), F.col("ts").alias("news_date"))
    first = rows.agg((F.min("news_date") + F.make_dt_interval(days=F.lit(10))).alias("t")).scalar()
    return mk.returns_of(rows, stock_code="7", since=first).select("event_id", "value")


# --- text of queries and replies --------------------------------------------------------------

ALIASES = [("tion", "movement"), ("eaux", "water"), ("nicht", "denial"), ("the", "article")]
TERMS = ["and", "ung", "est"]


@query("query_event_keywords", """
SELECT doc_id, array_to_string(list_concat(
  list_filter(['tion', 'eaux', 'nicht', 'the'], lambda a: contains(lower(text), a)),
  list_filter(['and', 'ung', 'est'], lambda t: contains(text, t))), '|') AS words FROM documents""")
def query_event_keywords(spark, sf):
    return documents(spark, sf).select("doc_id", F.concat_ws(
        "|", lb.query_event_keywords(F.col("text"), ALIASES, TERMS)).alias("words"))


@query("json_block", """
SELECT event_id, event_type AS found, CASE event_id % 4 WHEN 3 THEN NULL ELSE '{"type": "' || event_type || '", "n": {"v": '
  || user_id || '}}' END AS block FROM events""")
def json_block(spark, sf):
    """The JSON object in the middle of a reply's other words."""
    body = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "n": {"v": '), "user_id", F.lit("}}"))
    reply = (F.when(F.col("event_id") % 4 == 0, body)
             .when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
             .when(F.col("event_id") % 4 == 2, F.concat(body, F.lit(" as you asked")))
             .otherwise("no object"))
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("found"), tx.json_block(reply).alias("block"))


@query("company_list", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN '' ELSE c_name || '|' || c_mktsegment END AS names FROM customer""")
def company_list(spark, sf):
    """Names from a reply: a JSON list, a numbered or dotted list, lines; none from an empty one."""
    a, b, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 4
    reply = (F.when(k == 0, F.concat(F.lit('The companies: ["'), a, F.lit('", "'), b, F.lit('"]')))
             .when(k == 1, F.concat(F.lit("1. "), a, F.lit("\n2) "), b, F.lit("\n")))
             .when(k == 2, F.concat(F.lit("- "), a, F.lit("\n\n* "), b)).otherwise(" \n"))
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws("|", tx.company_list(reply)).alias("names"))


# --- streaming --------------------------------------------------------------------------------

@query("stream_sync", """
SELECT event_id AS id, round(value + 1, 6) AS value, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def stream_sync(spark, sf):
    """Changed rows into a table by id: two versions of each row, batches repeated after a failure."""
    from newswake.plans.disclosure_queries import EVENT_SCHEMA
    out = run_dir(spark, "sync")
    stream = sync.article_stream(spark, f"{sf}/events.parquet*", EVENT_SCHEMA)
    versions = stream.select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("day"), F.col("ts").alias("created_at"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("version"), "value")
    changed = versions.select(
        "id", "day", "created_at", (F.col("created_at") + F.make_dt_interval(hours=F.col("version"))).alias("updated_at"),
        (F.col("value") + F.col("version")).alias("value"))

    def write(batch: DataFrame) -> None:
        for _ in range(2):  # as after a failure between the write and the checkpoint
            wr.upsert_table(batch.select("id", "day", "value"), out, ["id"], "day")

    sync.sync_documents(changed, lambda rows: rows, write, f"{out}-state", every=None).awaitTermination()
    stored = spark.read.parquet(out)
    return r6(stored.select("id", "value", F.date_format("day", "yyyy-MM-dd").alias("day")), "value")
