"""Conversation repair, centroid clustering and secret scan against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from newswake.llm import conversation_repair as repair, queries, secret_scan, vector_clusters
from newswake.llm.tables import table

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
SHAPE = "conv_id long, turn long, role string, text string, conv string, kind int"


def spaced(x):
    return " " if x is None else str(x)


def damage(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        yield from [(conv, turn, role, text)] * (2 if k == 3 else 1)


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows):
    """All prefixes by state, whole strings, without any cutting: (cost, audit, repaired)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        for _ in range(3):
            for at, (cost, audit, made) in list(states.items()):
                for name in ("user", "assistant"):
                    to = step.get((at, name[0]))
                    new = (cost + 5, audit + "I", [*made, f"{name}:"])
                    if to and (to not in states or new[:2] < states[to][:2]):
                        states[to] = new
        return states

    states = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        after = {}
        for at, (cost, audit, made) in states.items():
            ways = [(at, 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                ways += [(step[at, role[:1]], late, "K", role)] if (at, role[:1]) in step else []
                ways += [(step[at, r[0]], 1 + late, "R", r) for r in ("user", "assistant") if (at, r[0]) in step]
            for to, more, edit, new_role in ways:
                new = (cost + more, audit + edit, made if new_role is None else [*made, f"{new_role}:{text}"])
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        states = inserted(after)
    return min((states[s] for s in ("", "a") if s in states), key=lambda s: s[:2])


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damage(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, key(r[2], r[3])))
        f, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, made = best_edits(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"),
                     f.count("duplicate"), f.count("truncated"),
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)),
                     cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def awkward(seed, conversations=60, longest=14):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = rng.choice(["Hi.", "So?", "no end", None, "", " \t", f"t{turn}.", f"x{turn}!", "é" * 9 + "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_repair_matches_whole_search(spark, block):
    rows = awkward(block)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SHAPE).repartition(3)
    got = repair.report(repair.damaged(df), df, block).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for g in got:
        assert tuple(g)[1:] == want[g.conv_id], g.conv_id
        assert sum(c != "I" for c in g.audit) == sum(r[0] == g.conv_id for r in damage(rows))


def test_one_long_conversation_crosses_blocks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"a{t}.", f"b{t}", "", "Same."]))
            for t in range(700)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SHAPE).repartition(5)
    got = repair.report(repair.damaged(df), df, block=50).collect()
    assert [tuple(g)[1:] for g in got] == [expected(rows)[7]]
    edits = repair.repair(repair.damaged(df), block=50).orderBy("place").collect()
    assert "".join(e.edit for e in edits) == got[0].audit
    assert LEGAL.match("".join(e.role[0] for e in edits if e.edit != "D"))


def test_short_conversations_by_all_edit_sequences():
    """The search of the tests itself, and the streamed one, against every sequence of edits."""
    step = repair.STEPS
    for n in range(4):
        for fit in itertools.product([(repair.GOOD, "u"), (repair.GOOD, "a"), (repair.CUT, "s"), (repair.BLANK, "u")], repeat=n):
            best, todo = None, [(0, 0, 0, "")]
            while todo:
                at, state, cost, audit = todo.pop()
                if at == n and state in repair.ENDS and (best is None or (cost, audit) < best):
                    best = (cost, audit)
                if audit[-3:] != "III":
                    todo += [(at, to, cost + 5, audit + "I") for i, to in step[state].items() if i != "s"]
                if at < n:
                    fault, initial = fit[at]
                    todo.append((at + 1, state, cost + 2, audit + "D"))
                    if fault != repair.BLANK:
                        late = 5 if fault == repair.CUT else 0
                        for i, to in step[state].items():
                            if i == initial:
                                todo.append((at + 1, to, cost + late, audit + "K"))
                            if i != "s":
                                todo.append((at + 1, to, cost + 1 + late, audit + "R"))
            got = "".join(edit + ending for edit, _, ending in repair.edits_of(iter(fit)))
            assert got == best[1], fit


def test_survivors_share_their_past_and_memory_stays_small():
    rows = ((repair.GOOD, "ua"[t % 2]) for t in range(20000))
    stream, ahead = repair.edits_of(rows), 0
    for n, _ in enumerate(stream):
        ahead = max(ahead, n)
        if n == 10000:
            break
    taken = sum(1 for _ in rows)
    assert taken > 20000 - 10000 - 50  # at most a few rows were read beyond those emitted


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], SHAPE)
    assert repair.report(repair.damaged(df), df).collect() == []
    assert repair.repair(df).collect() == []


def test_every_conversation_is_reported_though_all_rows_fall(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.", "", 0)], SHAPE)
    got = repair.report(repair.damaged(df), df).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


def clusters_by_hand(rows, k, rounds, width):
    kept = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for n, vs in members.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    return sorted(((-1 if i is None else i, n, d, sum(x[1] for x in found if x[2] == n), sum(x[1] for x in found), centroids[n])
                   for i, d, n in found))


@pytest.mark.parametrize("leading", [1, 3, 8])
def test_clusters_match_all_distances(spark, leading):
    rng = np.random.default_rng(leading)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).astype(float).tolist()) for i in range(200)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(3, rows[3][1]), (None, rows[4][1]), (None, [1.0] * 8)]
    rows += [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 7 + [float("nan")]), (304, [None] + [0.0] * 7),
             (305, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS).repartition(4)
    got = vector_clusters.cluster_vectors(df, width=8, clusters=7, rounds=4, leading=leading)
    assert "label" in got.columns
    found = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid))
                   for r in got.collect())
    assert found == clusters_by_hand(rows, 7, 4, 8)


def test_few_large_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [3e38] * 8, 0, ""), (2, [-3e38] * 8, 0, "")], VECTORS)
    got = vector_clusters.cluster_vectors(df, width=8).orderBy("vec_id").collect()
    assert [r.distance for r in got] == [0, 0] and len({r.cluster for r in got}) == 2
    assert vector_clusters.cluster_vectors(df.limit(0), width=8).collect() == []


def test_bounds_rule_out_most_centroids(spark):
    whole = vector_clusters.whole_vectors(table(spark, SF, "embeddings"), "embedding", 64, 256)
    rotation = vector_clusters.Rotation(*vector_clusters.moments(whole, 64), 48)
    x = vector_clusters.matrix(whole.select("v").toPandas()["v"], 64)
    c = vector_clusters.first_centroids(whole, "vec_id", 40, 2)
    cluster, distance, verified = vector_clusters.nearest(x, rotation.turn(x), c, rotation.turn(c))
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert verified.mean() < 25


TEXTS = [
    None, "", "no secrets here.", 'token = "abcdefghijkl"', "PassWord:'x' token==abcdefghijklmnop", "paſſword=abcdefghijklmnop",
    "AKIAABCDEFGHIJKLMN and AKIASHORT1", "deadbeefdeadbeef deadbeef 0123456789abcdef0", 'token:secret"="abcdefghijklmnop"',
    "user=bob password=hunter22\nhost: db.example.com:5432", "user=bob\n\npassword=hunter22", "password=hunter22 alone",
    "é" * 50 + "login: anna@example.com " + "x " * 400 + "secret=short12", "https://api.example.com/v1 key Ab3dEf6hIj9kLmN0pQrStU",
    "Ab3dEf6hIj9kLmN0pQrStU lonely", "client_id=web-1 apikey: Zx9", "AKIAABCDEFGHIJKLMN next to wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    "\U0001f600 user=eve token=abcdefghijklmnop", "API_KEY=aaaaaaaaaaaa api-key=bbbbbbbbbbbb", "secret = user=abcdefghijkl"]


def base_by_hand(text):
    """Regular expressions as the contract writes them, filtered afterwards."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def linked_by_hand(text, reach):
    """All pairs of parts of one scope."""
    base, short = secret_scan.strong_spans(text)
    weak = secret_scan.weak_spans(text, short, base)
    scope = lambda at: len([m for m in re.finditer(r"\n[ \t\r]*\n", text) if m.start() <= at])
    out = []
    for part in weak:
        for other in [*base, *weak]:
            if ((other[0] in secret_scan.SECRETS) != (part[0] in secret_scan.SECRETS) and scope(other[1]) == scope(part[1])
                    and max(other[1] - part[2], part[1] - other[2]) <= reach):
                out.append(part)
                break
    return out


@pytest.mark.parametrize("reach", [40, 300])
def test_secret_spans_and_links(spark, reach):
    rng = random.Random(reach)
    pieces = ["user=bob", "password=hunter22", "\n\n", "AKIAABCDEFGHIJKLMN", "https://x.example.org/a", "word", "lorem ipsum", "\n",
              "Ab3dEf6hIj9kLmN0pQrStU", 'token = "04dbebab91ab85687d33"', "4845168114407329", "host=db.example.com"]
    texts = TEXTS + [rng.choice([" ", "  "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i % 100 if i % 9 else None, t, i, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, base int, spans string").repartition(3)
    packed = df.withColumnRenamed("base", "at").withColumn("text_again", F.col("text"))
    got = secret_scan.scan(packed, reach).collect()
    assert len(got) == len(texts)
    weak = 0
    for g in got:
        text = g.text_again or ""
        base, links = base_by_hand(text), linked_by_hand(text, reach)
        assert [tuple(s) for s in g.base] == base
        assert [tuple(s) for s in g.linked] == links
        assert [tuple(s) for s in g.spans] == sorted([*base, *links], key=secret_scan.in_order)
        weak += len(links)
    assert weak > 100
    assert secret_scan.scan(df.limit(0)).collect() == []
    assert len(secret_scan.scan(df.select("text")).collect()) == len(texts)


def test_secret_query_columns(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    got = queries.QUERIES["op13_secret_scan"](spark, SF).collect()
    assert len(got) == len(texts)
    for g in got:
        base = base_by_hand(texts[g.doc_id])
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(k == x for x, _, _ in base) for k in ("assign", "access", "hex")]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(g.spans.split(","))


def test_repair_query_on_the_small_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    want = expected(rows)
    got = queries.QUERIES["op11_conversation_repair"](spark, SF).collect()
    assert {g.conv_id: tuple(g)[1:] for g in got} == want
