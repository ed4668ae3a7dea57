"""Each operator against a brute-force version, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newswake.llm import (components, exact_dedup, golay, html_extract, lm_scoring, mixing, packing,
                          quality_model, quality_rules, simhash, suffix_dedup, token_counts, tokens)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string"
WORDS = "the of and inon thou reth bleed ersti onat heer antha ness tion wher éèau ñosci".split()


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, None, None, "x")
            for k, (i, t) in enumerate(zip(ids, texts))]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "in", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty texts, white space, copies, near copies, shared passages, a long text, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    shared = prose(rng, 60)
    texts = [None, "", " \t\n\r\x0b\x0c", "x", "a b", "a  b\n", *base, *base[:12],
             *[b.replace("the", "zzz", 1) for b in base[:10]],
             *[b[:40] + shared + b[40:] for b in base[20:30]], "ab " * 400, "A B " * 5,
             prose(rng, 9000), "é" * 300, "<|endoftext|> tail <|endoftext|>"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    data = rows(texts, ids) + rows([base[0], base[0], None], [ids[6], None, None])
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(corpus):
    return corpus.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(corpus, docs):
    got = exact_dedup.exact_dedup(corpus).collect()
    assert len(got) == len(docs)
    groups = defaultdict(list)
    for d in docs:
        groups[bare(d.text)].append(d)
    stays = defaultdict(int)
    for g in got:
        own = groups[bare(g.text)]
        best = min(own, key=lambda d: (-len(d.text or ""), d.doc_id is None, d.doc_id or 0))
        assert (g.keep_id, g.group_size) == (best.doc_id, len(own))
        assert g.text_sha256 == hashlib.sha256(bare(g.text).encode()).hexdigest()
        stays[bare(g.text)] += g.kept
        if g.kept:
            assert (g.doc_id, len(g.text or "")) == (best.doc_id, len(best.text or ""))
    assert set(stays.values()) == {1} and len(stays) == len(groups)
    assert got[0].lang == "en" and got[0].row == "x"


def test_exact_dedup_with_a_full_filter(corpus):
    """A filter too small for the rows lets more through and changes nothing."""
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    wide = sorted(map(str, exact_dedup.exact_dedup(corpus).select(*cols).collect()))
    assert wide == sorted(map(str, exact_dedup.exact_dedup(corpus, filter_words=1).select(*cols).collect()))


def test_keep_one_keeps_columns(corpus, docs):
    kept = exact_dedup.keep_one(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len({bare(d.text) for d in docs})


def repeat_words(words):
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_quality_measures(corpus, docs):
    want = Counter()
    for d in docs:
        t = d.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
             len(lines) - len(set(lines)), repeat_words(w),
             len(w) < 20 or 100 * repeat_words(w) > 30 * len(w)] += 1
    found = quality_rules.verdicts(quality_rules.ledger(corpus))
    got = Counter(tuple(r) for r in found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == want


def test_policies_and_ablations(corpus):
    ledger = quality_rules.ledger(corpus).cache()
    judged = quality_rules.verdicts(ledger).collect()
    names = list(quality_rules.RULES)
    policy = quality_rules.POLICIES["v1"]
    assert all(r.kept == (r.rule_bits & policy.mask == 0) for r in judged)
    assert all(r.kept <= (not r.base_failed) for r in judged)
    for a in quality_rules.ablations(ledger).collect():
        bit = 1 << names.index(a.rule)
        bits = [r.rule_bits & policy.mask for r in judged]
        assert a.failed == sum(b & bit != 0 for b in bits)
        assert a.only_this == sum(b == bit for b in bits)
        assert a.kept_without == sum(b & ~bit == 0 for b in bits)
    assert quality_rules.accepted(corpus).columns == corpus.columns


def test_token_counts_whole_and_in_chunks(corpus, docs):
    t = tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    want = Counter((d.doc_id, len((d.text or "").encode()),
                    len(t.encode(d.text or "", add_special_tokens=False))) for d in docs)
    for chunk, overlap in ((1 << 15, 512), (300, 60), (64, 40)):
        found = token_counts.token_counts(corpus, chunk=chunk, overlap=overlap)
        assert Counter(tuple(r) for r in found.select("doc_id", "n_bytes", "n_tokens").collect()) == want
        assert found.filter("over_limit <> (n_tokens > 1024)").count() == 0


def test_rank_encoder_gives_the_ids_of_the_json_file():
    rng = random.Random(3)
    t = tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    r = tokens.rank_encoder(tokens.vocabulary("byte_bpe_50k.tiktoken"))
    letters = "ab Z9é\n\t  ,.'s'll$  　日本🙂ß\x00<|endoftext|>"
    for _ in range(400):
        text = "".join(rng.choice([*letters, "<|endoftext|>", "  "]) for _ in range(rng.randint(0, 60)))
        assert t.encode(text, add_special_tokens=False).ids == r.encode(text, allowed_special="all")


def test_packing(corpus, docs):
    t = tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json"))
    got = packing.pack(packing.pieces(corpus, capacity=64), capacity=64).collect()
    want = Counter()
    for d in docs:
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        for i, (s, e) in enumerate(packing.cut_points(len(ids), 64)):
            assert i == 0 or e - s == 64
            want[d.doc_id, i, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for v in sequences.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_packing_plan_places_each_rank_once():
    rng = random.Random(1)
    sizes = sorted(rng.randint(1, 100) for _ in range(3000))
    runs, at = [], 0
    for s, n in sorted(Counter(sizes).items()):
        runs.append((s, at, at + n))
        at += n
    used, seen = defaultdict(list), set()
    for lo, hi, sequence, offset in packing.plan(runs, 100):
        for r in range(lo, hi):
            assert r not in seen
            seen.add(r)
            used[sequence + r - lo].append((offset, sizes[r]))
    assert len(seen) == 3000
    for v in used.values():
        assert sum(n for _, n in v) <= 100
        assert all(o == sum(n for p, n in v if p < o) for o, _ in v)
    assert len(used) <= 1.02 * sum(sizes) / 100 + 1


def test_packing_refuses_lengths_beyond_the_capacity(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 70)], "k int, length long"), capacity=64)


def test_pfair_schedule_stays_within_one_block():
    whole, period = mixing.shares({"a": 5, "b": 3, "c": 1, "d": 0.01}, 97)
    assert sum(whole.values()) == period and min(whole.values()) >= 1
    slots = sorted(mixing.schedule(whole, period), key=lambda x: x[2])
    assert [x[2] for x in slots] == list(range(period))
    done = Counter()
    for n, (s, j, _) in enumerate(slots, 1):
        assert j == done[s]
        done[s] += 1
        for k, share in whole.items():
            assert abs(done[k] - n * share / period) < 1


def test_exact_weights_stay_within_one_block_over_any_run():
    weights = {"a": 1 / 3, "b": 2 / 3 - 1e-4, "c": 1e-4}
    whole, period = mixing.exact_shares(weights)
    done, total = Counter(), sum(weights.values())
    for n, (s, j, slot) in enumerate(mixing.turns(whole, period, dict.fromkeys(weights, 1 << 40)), 1):
        assert j == done[s] and slot == n - 1
        done[s] += 1
        assert all(abs(done[k] - n * w / total) < 1 for k, w in weights.items())
        if n == 30_000:
            break


def test_mix_holds_weights_that_are_no_thousandths(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "if(id < 3000, 'a', 'b') as source")
    got = mixing.mix(df, weights={"a": 1, "b": 2}, block=1).orderBy("mix_slot").collect()
    done = 0
    for n, r in enumerate(got, 1):
        assert r.mix_slot == n - 1
        done += r.source == "a"
        assert abs(done - n / 3) < 1


def test_mix(corpus, docs):
    weights = {"s0": 3, "s1": 1}
    got = mixing.mix(corpus, weights=weights, block=4, period=8).orderBy("mix_slot", "mix_rank").collect()
    assert len(got) == len(docs) and len({(r.mix_slot, r.mix_rank) for r in got}) == len(got)
    assert Counter(r.doc_id for r in got) == Counter(d.doc_id for d in docs)
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r.mix_slot].add((r.source, r.mix_block))
        assert 0 <= r.mix_rank < 4
    assert all(len(v) == 1 for v in by_slot.values())
    ordered = mixing.mixed_order(corpus)
    assert ordered.columns == corpus.columns and ordered.count() == len(docs)


def test_lm_scores(corpus, docs):
    got = lm_scoring.score(corpus).collect()
    toks = [(d.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (d.text or "").encode().lower()) + [None]) for d in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in toks for w in ws if not held(i))
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 6)) for i, ws in toks)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_lm_probabilities_sum_to_one():
    import pandas as pd

    table = pd.DataFrame({"bucket": [0, 1, 3], "two": [lm_scoring.NONE, -10, -5], "one": [-40, -30, lm_scoring.NONE],
                          "n": [5, 10, 20]})
    w = lm_scoring.weights(table, 100)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and (w[:, 2] > 0).all()


PAGE = """<html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li>menu</ul></nav><div class="ad">buy</div><!-- no --><article><header>no</header>
<h1>T &amp; {0}</h1><p><b>one\n two<br><p title="a > b">three &eacute;&#x41;</p><ul><li>x<li>y</ul>
<div class="comments"><p>no</p></div><form><input value=1>no</form></article><aside>no</aside>
<footer>&copy; no</footer></body></html>"""


def test_html_extraction(spark, empty):
    pages = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(i), "given") for i in range(4)]
    plain = "<body><div id=top>same</div><div id=content><p>own {0}</p><p>more {0}</p></div><div>same</div>"
    pages += [(i, "http://plain.example.com/x", plain.format(i), "g") for i in range(10, 60)]
    pages += [(100, None, None, None), (101, "bad url", "", ""), (102, "http://h/", "<<p>a < b<p", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert len(got) == len(pages)
    for i in range(4):
        want = f"T & {i}\none two\nthree éA\nx\ny"
        assert got[i] == (want, len(want))
    assert got[12][0] == "own 12\nmore 12"  # the style tree finds the repeated branches
    assert got[100] == got[101] == ("", 0) and "a < b" in got[102][0]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_tree_weighs_articles_too(spark):
    page = "<body><article><p>own {0}<div class=teaser>see our <b>offers</b></div><p>more {0}</article><div id=x>beside {0}</div></body>"
    pages = [(i, "http://h.example.com/", page.format(i)) for i in range(30)]
    pages += [(i, "http://same.example.com/", "<article><p>one article</article>") for i in range(30, 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[7] == "own 7\nmore 7\nbeside 7" and got[40] == "one article"


def test_html_wrappers_do_not_drop_the_article():
    for wrap in ("<form>{}</form>", "<div class='site no-sidebar'>{}</div>", "<div class=has-sidebar>{}</div>",
                 "<div class='with-header'>{}</div>", "<div class=widget>{}</div>"):
        page = wrap.format("<nav>menu</nav><article>the text<form>no</form><div class=share>no</div></article>")
        assert html_extract.main_text(f"<body>{page}</body>", {}) == "the text"
    assert html_extract.main_text("<div class=no-sidebar><p>plain</div>", {}) == "plain"
    assert html_extract.main_text("<p>a longer text</p><div class=related><article>tease</article></div>", {}) == "a longer text"
    assert html_extract.main_text("<article>a</article><aside><article>b</article></aside>", {}) == "a"


def test_html_blocks_are_linear_in_hostile_pages():
    for page in ("<" * 50_000, "<p " * 20_000, "<!--" * 20_000, "<div>" * 3000, '<a b="' * 20_000):
        html_extract.parsed(page)
    assert html.unescape("&amp") == "&"


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    assert (np.bincount(golay.nearest(words), minlength=4096) == 2048).all()
    row, index = golay.around(words[::9973], 23)
    assert np.bincount(row).max() <= 6
    for bit in range(23):  # a word one bit off has its codeword among the keys
        other = golay.nearest(words[::9973] ^ np.uint32(1 << bit))
        keys = set(zip(row.tolist(), index.tolist()))
        assert all((i, k) in keys for i, k in enumerate(other.tolist()))


def brute_components(fps, most):
    par = list(range(len(fps)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= most:
                par[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(corpus, docs):
    from xxhash import xxh64_intdigest

    def print_of(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    got = simhash.near_duplicates(corpus).collect()
    fps = [print_of(r.text) for r in got]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    least = {}
    root = brute_components(fps, 3)
    for r, k in zip(got, root):
        if r.doc_id is not None:
            least[k] = min(r.doc_id, least.get(k, r.doc_id))
    assert [r.component_id for r in got] == [least.get(k) for k in root]


def test_simhash_crowded_keys(spark, monkeypatch):
    """A cluster of a thousand fingerprints around one, dealt over cells, has the same components."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = set()
    while len(fps) < 500:
        f = centre
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    while len(fps) < 600:
        fps.add(rng.getrandbits(64))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    monkeypatch.setattr(simhash, "CELL", 40)
    monkeypatch.setattr(simhash, "DENSE", 64)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.fp: r.component_id for r in simhash.groups(df).collect()}
    root, least = brute_components(fps, 3), {}
    for i, k in enumerate(root):
        least[k] = min(i, least.get(k, i))
    assert got == {f: least[k] for f, k in zip(fps, root)}


def test_one_of_each(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice(WORDS) + rng.choice("abcdef") * rng.randint(0, 3) for _ in range(200)) for _ in range(40)]

    def edited(t):
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        return " ".join(w)

    texts = base + [edited(b) for b in base] + [None, "", "short text"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    left = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert set(range(40)) <= left and 82 in left  # the first of each group stays, others' texts too
    assert len(left & set(range(40, 80))) <= 2
    assert simhash.one_of_each(df).columns == df.columns


def jaccard_groups(texts, least=0.8):
    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= least * len(x | y) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def test_one_of_each_leaves_no_near_copy(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    fresh = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(40):  # appended, replaced and repeated passages at similarities of 0.8 to 0.84
        w = fresh(220)
        line = fresh(11)
        for v in (w, w + fresh(rng.randint(42, 52)), w[:100] + fresh(18) + w[118:]):
            texts.append(" ".join(v))
        w = fresh(300)
        texts += [" ".join(w), " ".join(w + line * 11)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == jaccard_groups(texts)


def test_one_of_each_joins_crowded_groups(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(4):  # edits of one text are often less alike to each other than 0.8
        base = [word() for _ in range(150)]
        for _ in range(60):
            w = list(base)
            for i in rng.sample(range(150), rng.randint(1, 6)):
                w[i] = word()
            texts.append(" ".join(w))
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == jaccard_groups(texts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    want = {x: find(x) for x in par if find(x) != x}
    assert got == want


def brute_repeats(docs):
    order = sorted(docs, key=lambda d: (d.doc_id is None, d.doc_id or 0))
    first = {}
    for d in order:
        b = (d.text or "").encode()
        rank = (d.doc_id is None, d.doc_id or 0)
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], rank)
    for d in docs:
        b = (d.text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < (d.doc_id is None, d.doc_id or 0):
                gone[p:p + 50] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if b else 0
        yield d.doc_id, len(b), runs, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])


@pytest.mark.parametrize("segment", [1 << 18, 700])
def test_suffix_dedup(corpus, docs, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    if segment < 1000:  # the workers import the module themselves, so parse here
        from newswake.llm.exchange import Opened
        texts = [(d.text or "").encode() for d in docs if d.doc_id is not None]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        batch = Opened(0, np.arange(len(texts)), np.zeros(len(texts), int), starts, ends,
                       np.frombuffer(b"".join(texts), np.uint8))
        p = suffix_dedup.Parse(batch, 4)
        heads = sorted(zip(p.first.tolist(), p.last.tolist()))
        assert all(a[1] <= b[0] for a, b in zip(heads, heads[1:]))
        assert sum(b - a for a, b in heads) == sum(max(0, len(t) - 49) for t in texts)
        return
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.repeats(corpus).collect())
    assert got == Counter(brute_repeats(docs))


def test_quality_model_learns_and_holds_out(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        good = rng.random() < 0.6
        w = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randint(30, 90))]
        if not good:
            kind = i % 3
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "###" for x in w] if kind == 1 else [w[0]] * len(w)
        texts.append(" ".join(w))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows(texts + [None, ""], [*range(600), 600, None]), SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, known)
    got = quality_model.classify(docs, model).collect()
    truth = {i: q for i, q, _ in labels}
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    nothing = quality_model.train(docs, known.limit(0))
    assert quality_model.classify(docs, nothing).filter("score = 0.5").count() == 602


def test_model_bins_are_additive():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # a pair, no single feature
    m = quality_model.fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    assert (0, 1) in [over for over, _ in m.tables]


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert quality_rules.verdicts(quality_rules.ledger(empty)).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    assert packing.pack(packing.pieces(empty)).count() == 0
    assert mixing.mix(empty).count() == 0
    assert lm_scoring.score(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
    assert suffix_dedup.repeats(empty).count() == 0
    model = quality_model.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality_model.classify(empty, model).count() == 0
    assert empty.select(F.lit(1)).count() == 0
