"""Stored extraction results: only unseen texts are extracted, by dictionary."""

from newswake.operators import companies as co, extraction_store as xs


def test_only_unseen_texts_reach_python(spark, tmp_path):
    path = str(tmp_path / "store")
    master = spark.createDataFrame([("Acme", "IT", "listed"), ("Bolt", None, "private")], "name string, sector string, type string")
    patterns = spark.createDataFrame([("Acme", "Acme", 0.9), ("Bolt", "Bolt", 0.8)], "alias string, company string, weight double")
    texts = [(1, "Acme opens a plant with Acme engineers today", ["Bolt"]), (2, "nothing of note was said here", []),
             (None, "Acme opens a plant with Acme engineers today", ["Bolt"]), (1, "Bolt and Acme sign a contract", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, asked array<string>")
    rows = lambda df: sorted(map(str, df.collect()))
    first = xs.extract(docs, patterns, master, path, provider_col="asked")
    got = rows(first)
    assert got and sum("doc_id=None" in r for r in got) == 2
    version = xs.dictionary_version(patterns, master)
    assert xs.stored(spark, path, version).count() == 3
    again = xs.extract(docs, patterns, master, path, provider_col="asked")
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert rows(again) == got and "InPandas" not in plan and "Python" not in plan
    want = rows(co.extract(docs.limit(1), patterns, master, provider_col="asked"))
    assert set(want) <= set(got)

    more = patterns.union(spark.createDataFrame([("plant", "Bolt", 0.7)], patterns.schema))
    assert xs.dictionary_version(more, master) != version
    assert xs.dictionary_version(patterns.orderBy("company").repartition(3), master) == version
    assert rows(xs.extract(docs, more, master, path, provider_col="asked")) != got
    xs.expire(spark, path, [version])
    assert xs.stored(spark, path, xs.dictionary_version(more, master)).count() == 0
    assert xs.stored(spark, path, version).count() == 3
    assert xs.extract(docs.limit(0), patterns, master, path).collect() == []
