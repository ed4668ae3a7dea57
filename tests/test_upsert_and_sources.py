from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newswake.operators import documents as dc
from newswake.operators.upsert import first_per_key, latest_per_key, upsert
from newswake.sources import lexicons, readers, writers
from newswake.streaming import sync


def test_upsert_updates_only_named_columns(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, x int, y int")
    new = spark.createDataFrame([("b", 9, None), ("c", 3, 30)], "k string, x int, y int")
    got = {tuple(r) for r in upsert(old, new, ["k"], ["y"]).collect()}
    assert got == {("a", 1, 10), ("b", 2, None), ("c", 3, 30)}
    full = {tuple(r) for r in upsert(old, new, ["k"]).collect()}
    assert full == {("a", 1, 10), ("b", 9, None), ("c", 3, 30)}
    again = upsert(upsert(old, new, ["k"], ["y"]), new, ["k"], ["y"])
    assert {tuple(r) for r in again.collect()} == got


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, t int, v string")
    assert {tuple(r) for r in latest_per_key(df, ["k"], F.col("t")).collect()} == {("a", 3, "y"), ("b", 2, "z")}
    assert {tuple(r) for r in first_per_key(df, ["k"], F.col("t")).collect()} == {("a", 1, "x"), ("b", 2, "z")}


def test_upsert_table_rewrites_only_touched_months(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("a", date(2024, 1, 5), 1, 1), ("b", date(2024, 2, 5), 2, 2)]
    writers.upsert_table(spark.createDataFrame(rows, "k string, d date, x int, y int"), path, ["k"], "d", ["x"])
    january = sorted(p.name for p in (tmp_path / "t" / "month=2024-01").glob("*.parquet"))
    more = [("b", date(2024, 2, 5), 7, 7), ("c", date(2024, 3, 1), 3, 3)]
    for _ in range(2):
        writers.upsert_table(spark.createDataFrame(more, "k string, d date, x int, y int"), path, ["k"], "d", ["x"])
    got = {(r.k, r.x, r.y) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 1, 1), ("b", 7, 2), ("c", 3, 3)}
    assert sorted(p.name for p in (tmp_path / "t" / "month=2024-01").glob("*.parquet")) == january


@pytest.mark.parametrize("encoding", ["utf-8", "cp949", "utf-8-sig"])
def test_price_files_in_several_encodings(spark, tmp_path, encoding):
    f = tmp_path / "prices.csv"
    f.write_text("날짜, 종목코드,종목명,종가\n20240102,5930,삼성전자,\"71,200\"\n2024-01-03,00104K,가나,10.5\n",
                 encoding=encoding)
    got = {(r.stock_code, r.trade_date, r.stock_name, float(r.close_price))
           for r in readers.price_file(spark, str(f)).collect()}
    assert got == {("005930", date(2024, 1, 2), "삼성전자", 71200.0), ("00104K", date(2024, 1, 3), "가나", 10.5)}


def test_folder_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,u\nx,1\n")
    (tmp_path / "b.csv").write_text("t,u\ny,2\n")
    got = readers.folder(spark, str(tmp_path))
    assert {(r.t, r.source_file.rsplit("/", 1)[1]) for r in got.collect()} == {("x", "a.csv"), ("y", "b.csv")}
    (tmp_path / "c.tsv").write_text("t\tu\nz\t3\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "c.tsv"), ["u"]).collect()] == [("3",)]


def test_masters_merge_and_flatten(spark, tmp_path):
    (tmp_path / "m.csv").write_text("종목코드,종목명\n005930,삼성전자\n000001,가\n", encoding="utf-8")
    (tmp_path / "c.json").write_text(
        '{"categories": {"x": {"companies": {"카카오": {"sector": "IT", "type": "private"}, "삼성전자": {}}}}}',
        encoding="utf-8")
    both = readers.merge_masters(readers.master_file(spark, str(tmp_path / "m.csv")),
                                 readers.company_json(spark, str(tmp_path / "c.json")))
    assert {(r.name, r.code, r.sector, r.type) for r in both.collect()} == {
        ("삼성전자", "005930", None, "listed"), ("카카오", None, "IT", "private")}


def test_alias_and_synonym_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"삼성전자": ["삼성", "005930", "123"], "무명": ["x"]}', encoding="utf-8")
    got = lexicons.alias_map(lexicons.alias_lists(spark, str(tmp_path / "a.json")))
    assert {tuple(r) for r in got.collect()} == {("삼성전자", "005930"), ("삼성", "005930")}
    (tmp_path / "s.txt").write_text("# c\nCB, 전환사채 => cb_issue\nbad line\n워크아웃=>workout\n", encoding="utf-8")
    assert lexicons.synonym_list(spark, str(tmp_path / "s.txt")) == [
        ("cb", "cb_issue"), ("전환사채", "cb_issue"), ("워크아웃", "workout")]


def test_label_registry_file_with_profile(spark, tmp_path):
    (tmp_path / "l.json").write_text(
        '{"labels": {"a.x": {"fine": true, "priority": 5, "triggers": ["q"]}, "b.y": {"priority": 4, "triggers": []}},'
        ' "profiles": {"p": {"a.x": 1}}}')
    got = lexicons.label_registry(spark, str(tmp_path / "l.json"), "p")
    assert [(x.name, x.priority, x.fine) for x in got] == [("a.x", 1, True), ("b.y", 4, False)]


def test_learned_aliases_round_trip(spark, tmp_path):
    learned = spark.createDataFrame([("a", "A", 0.95), ("a", "B", 0.91), ("b", "B", 0.92)],
                                    "alias string, official string, similarity double")
    known = spark.createDataFrame([("b", "Z", 1.0)], learned.schema)
    merged = lexicons.merge_learned(known, learned)
    lexicons.save_learned(merged, str(tmp_path / "x"))
    assert {tuple(r) for r in lexicons.load_learned(spark, str(tmp_path / "x")).collect()} == {
        ("b", "Z", 1.0), ("a", "A", 0.95)}


def test_changed_rows_and_pages(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [("a", t, t), ("b", t.replace(hour=10), t), ("c", t.replace(hour=1), t.replace(hour=2))]
    df = spark.createDataFrame(rows, "id string, created_at timestamp, updated_at timestamp")
    assert {r.id for r in readers.last_minutes(df, t, 60).collect()} == {"a", "b"}
    assert [r.id for r in readers.page(df, ["id"], 1, 1).collect()] == ["b"]
    assert {r.id for r in readers.by_ids(df, spark.createDataFrame([("c",)], "id string")).collect()} == {"c"}


def test_stream_sync_equals_one_batch(spark, tmp_path):
    schema = "id string, title string, created_at timestamp, updated_at timestamp"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    t = datetime(2024, 1, 1)

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = sync.article_stream(spark, src, spark.createDataFrame([], schema).schema)
        sync.sync_documents(
            stream, lambda b: b.select("id", "title", F.to_date("created_at").alias("d")),
            lambda b: writers.upsert_table(b, out, ["id"], "d"),
            str(tmp_path / "ckpt"), every=None).awaitTermination()

    put([("a", "old", t, t), ("a", "new", t, t.replace(hour=3)), ("b", "x", t, t)])
    run()
    put([("b", "y", t, t.replace(hour=9)), ("c", "z", t.replace(month=2), t.replace(month=2))])
    run()
    run()
    got = {(r.id, r.title) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "new"), ("b", "y"), ("c", "z")}


def test_preprocessed_rows_and_quarantine(spark):
    rows = [("1", "t", "2024.01.02", "['a', \"b\"]", "0.8", "", "[0.5, 1]"), ("2", "", "bad", "", "x", "0.7", "")]
    df = spark.createDataFrame(rows, "id string, title string, published_at string, companies string, "
                                     "publisher_tier string, event_conf string, embedding string")
    docs = dc.from_preprocessed(df)
    a, b = docs.orderBy("id").collect()
    assert a.companies == ["a", "b"] and a.publisher_tier == 0.8 and a.event_conf is None
    assert a.embedding == [0.5, 1.0] and a.published_at == datetime(2024, 1, 1, 15)
    assert b.companies == [] and b.publisher_tier == 0.5 and b.event_conf == 0.7 and b.embedding is None
    good, bad = dc.quarantine(docs)
    assert good.count() == 1 and bad.count() == 1
