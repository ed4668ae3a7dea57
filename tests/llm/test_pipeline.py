"""The pipeline's stages on the small table, each judged on its own input."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

import check
import corpus_pipeline
from newswake.llm import mixing, quality_rules, queries
from newswake.llm.tables import stored, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages_keep_rows_of_documents(stages):
    whole = set(map(tuple, stages[0].collect()))
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == COLUMNS
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        assert set(map(tuple, after.collect())) <= whole


def test_rules_reject_what_the_ledger_says(stages):
    kept = quality_rules.verdicts(quality_rules.ledger(stages[0])).filter("kept")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in stages[1].collect()}


def test_exact_and_near_copies_go(stages):
    exact = ["".join(r.text.split()) for r in stages[2].collect()]
    assert len(exact) == len(set(exact)) == len({"".join(r.text.split()) for r in stages[1].collect()})

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [(r.doc_id, shingles(r.text)) for r in stages[2].collect()]
    left = {r.doc_id for r in stages[3].collect()}
    alike = defaultdict(set)
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                alike[a].add(b)
                alike[b].add(a)
    for d, _ in sets:
        assert (d in left) or alike[d], "a text without a near copy must stay"


def test_no_near_copy_is_left(stages):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r.text) for r in stages[3].collect()]
    for i, x in enumerate(sets):
        for y in sets[:i]:
            assert len(x & y) < 0.8 * len(x | y)


def test_mixing_keeps_all_and_orders_them(spark, stages):
    assert sorted(map(tuple, stages[3].collect())) == sorted(map(tuple, stages[4].collect()))
    by_slot = mixing.mix(stages[3]).orderBy("mix_slot", "mix_rank").collect()
    in_order = mixing.mixed_order(stages[3]).collect()
    assert [r.source for r in in_order] == [r.source for r in by_slot]


def test_packing_covers_all_documents(stages):
    got = stages[5].collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in stages[4].collect()}
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(used) <= 1.02 * total / 2048 + 1


def test_packing_follows_the_mix(spark, stages):
    """Fails without the mixing stage: then the places are those of another order."""
    place = {r.doc_id: i for i, r in enumerate(mixing.mixed_order(stages[3]).collect())}
    first = {}
    for r in stages[5].collect():
        first[r.sequence_id] = min(place[r.doc_id], first.get(r.sequence_id, len(place)))
    assert sorted(first) == list(range(len(first)))
    assert [first[i] for i in sorted(first)] == sorted(first.values())
    unmixed = {}
    for r in dict(corpus_pipeline.STAGES)["packing"](spark, stages[3], SF).collect():
        unmixed[r.sequence_id] = min(place[r.doc_id], unmixed.get(r.sequence_id, len(place)))
    assert [unmixed[i] for i in sorted(unmixed)] != sorted(unmixed.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = check.rows_of(df.columns, df.collect())
    rel = con.execute(queries.ORACLES[name])
    assert got == check.rows_of([d[0] for d in rel.description], rel.fetchall())
