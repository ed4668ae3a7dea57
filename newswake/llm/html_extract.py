"""Main text of web pages by site style trees.

The DOMs of a host are merged: nodes are paths of tags with their classes and ids. Each node has the
styles its pages give it (the sequence of child elements, runs of one kind as one) and the contents
(its blocks of text, by hash). Both are distributions over the host's pages:

* presentation importance: the entropy of the styles, to the base of the number of pages; a menu
  that looks alike on all pages has none;
* content importance: one less the mean entropy of its blocks over pages; a block of its own scores
  one, a block on every page nothing.

Their weighted sum is the node's importance; branches below the threshold are removed from each
page of the host, inside `article` and `main` too. What elements say they are is evidence that is
added to it: for `article` and `main`, and against what stands beside the article of a page. Named
noise (below) is removed at any importance, also inside an article. A host with few pages has no importances, so there
the names decide. A page whose article would be left without text keeps it whole: a host may repeat
an article on many pages.

A form, or a class name, may wrap a whole page. If a page has no article but in such wrappers, and
it has more text there than beside them, it is the page's article and its wrappers are no noise.

The tree is built from (host, node, block) counts that are combined before their shuffle, so a host
with a third of all pages is no large group. The nodes to remove are stored, and whether their table
is broadcast to the pages is left to its size.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.tables import rows, stored, text_of, unpacked

THRESHOLD = 0.35
LEAST_PAGES = 8
STYLE_WEIGHT = 0.1
NAMED_KEPT = 0.2  # evidence of names, added to importances
BESIDE = -0.4

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary "
    "table ul".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select|object"
KEPT = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "article", "main"))  # too much to drop for a class name
NOISE = frozenset("nav header footer aside form button menu dialog head search".split())
# fixed values: words in class, id or role names that mark noise
NOISE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?(?:box|slot|sense|unit|wrap\w*|container)?|advert\w*|banner\w*|breadcrumb\w*|"
    r"captcha|comments?(?:list|form|section|area|box)?|consent|cookie\w*|disqus|footer\w*|gdpr|"
    r"header\w*|masthead|menu\w*|modal|nav|navbar\w*|navigation|newsletter\w*|notices?|notification\w*|"
    r"paywall|popup\w*|promo\w*|related\w*|repl(?:y|ies)|respond|share\w*|sharing|sidebar\w*|social\w*|"
    r"sponsor\w*|subscribe\w*|toolbar\w*|widget\w*|complementary|contentinfo)(?:$|[\s_-])", re.I)

# fixed values: names of a layout that has or lacks a part, not of the part
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|non|not|has|have|with|without)[-_]\S+|\S+[-_](?:no|has|with|without)[-_]\S+", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + RAW + r")(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<[!?][^>]*+>", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


def parsed(page: str) -> tuple[list, Counter]:
    """([(node, role, text)] of the blocks in page order, count of (node, style)).

    The role is "kept", "noise" or "" by the nearest ancestors that tell; noise wins, but for
    wrappers of the page's article."""
    blocks, styles = [], Counter()
    stack = [("", "", "", [])]  # tag, node, role, kinds of children
    pieces: list[str] = []

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            at = next(s for s in reversed(stack) if s[0] not in INLINE)
            blocks.append((at[1], stack[-1][2], text))

    def close(to: int):
        while len(stack) > to:
            _, node, _, kinds = stack.pop()
            styles[node, " ".join(kinds)] += 1

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if m[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                if tag not in INLINE or any(s[0] not in INLINE for s in stack[depth:]):
                    flush()
                close(depth)
            continue
        if tag not in INLINE:
            flush()
            ends = "p" if tag in ENDS_P else tag if tag in ("li", "tr", "td", "th", "dt", "dd", "option") else ""
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == ends:
                        close(i)
                        break
                    if stack[i][0] in ENDS_P or stack[i][0] in ("td", "th", "table"):
                        break
        names = " ".join(v for a in NAMES.findall(m[4]) for v in a[1:] if v) if "=" in m[4] else ""
        _, node, role, kinds = stack[-1]
        kind = f"{tag}.{'.'.join(sorted(names.split()))}" if names else tag
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
        if role != "noise":
            named = bool(names) and tag not in WHOLE and bool(NOISE_WORD.search(LAYOUT.sub(" ", names)))
            if (tag in NOISE and tag != "form") or ((named or tag == "form") and role in ("kept", "held")):
                role = "noise"
            elif tag in KEPT:
                role = "held" if role in ("held", "wrapper") else "kept"
            elif named or tag == "form":
                role = "wrapper"
        if tag not in INLINE or role != stack[-1][2]:
            node = f"{node}>{kind}"
        stack.append((tag, node, role, []))
    pieces.append(page[at:])
    flush()
    close(0)
    size = Counter()
    for _, role, text in blocks:
        size[role] += len(text)
    held = not size["kept"] and size["held"] > size[""]
    roles = {"held": "kept" if held else "noise", "wrapper": "noise"}
    return [(node, roles.get(role, role), text) for node, role, text in blocks], styles


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\w+://([^/?#:]+)", 1))


def page_facts(batches):
    """(host, page) to counts of (host, node, kind, value): in how many pages, how often in all, and
    the sum of n log n over pages; pages of a batch are combined."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        sums: dict = {}
        for host, page in zip(batch["host"], batch["page"]):
            blocks, styles = parsed(page)
            facts = Counter((node, 1, text) for node, role, text in blocks if role != "noise")
            facts.update({(node, 0, style): 1 for node, style in styles})
            facts.update({(node, 2, ""): 1 for node in {n for n, _ in styles}})
            for (node, kind, value), n in facts.items():
                s = sums.setdefault((host, node, kind, xxh64_intdigest(value) >> 1), [0, 0, 0.0])
                s[0] += 1
                s[1] += n
                s[2] += n * log(n)
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()],
                           columns=["host", "node", "kind", "value", "pages", "n", "n_log_n"])


def style_tree(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """host, node, pages, presentation, content, importance of each node of the merged DOMs.

    Nodes without blocks of text of their own have content importance 1, nodes of one page both."""
    given = pages.select(host_of(F.col(url)).alias("host"), text_of(page).alias("page"))
    facts = given.mapInPandas(page_facts, "host string, node string, kind int, value long, pages long, "
                                          "n long, n_log_n double")
    each = facts.groupBy("host", "node", "kind", "value").agg(
        F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("n_log_n").alias("n_log_n"))
    n, style, block = F.col("n"), F.col("kind") == 0, F.col("kind") == 1
    spread = F.log(n) - F.col("n_log_n") / n  # entropy of a block over pages, in nats
    node = each.groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == 2, F.col("pages"))).alias("pages"),
        F.sum(F.when(style, n)).alias("shown"), F.sum(F.when(style, n * F.log(n))).alias("shown_log"),
        F.sum(F.when(block, n * spread)).alias("spread"), F.sum(F.when(block, n)).alias("blocks"))
    base = F.log(F.col("pages"))
    many = F.col("pages") > 1
    presentation = F.when(many, (F.log("shown") - F.col("shown_log") / F.col("shown")) / base).otherwise(1.0)
    content = F.when(many & F.col("blocks").isNotNull(),
                     1 - F.col("spread") / F.col("blocks") / base).otherwise(1.0)
    return node.filter("pages is not null").select(
        "host", "node", "pages", presentation.alias("presentation"), content.alias("content"),
        (STYLE_WEIGHT * presentation + (1 - STYLE_WEIGHT) * content).alias("importance"))


def main_text(page: str, importance: dict, threshold: float = THRESHOLD) -> str:
    """The blocks of a page whose importance and names reach the threshold, joined by line feeds.

    `importance` has the nodes of the host's tree; a node without one is judged by names only."""
    blocks, _ = parsed(page)
    named = any(role == "kept" for _, role, _ in blocks)

    def stays(node, role):
        given = importance.get(node)
        if role == "noise" or given is None:
            return role == "kept" or (role == "" and not named)
        return given + (NAMED_KEPT if role == "kept" else BESIDE if named else 0) >= threshold

    left = [(role, t) for node, role, t in blocks if stays(node, role)]
    if named and not any(role == "kept" for role, _ in left):
        left = [(role, t) for _, role, t in blocks if role == "kept"]
    return "\n".join(t for _, t in left)


def extract(pages: DataFrame, page: str = "html", url: str = "url", threshold: float = THRESHOLD,
            least_pages: int = LEAST_PAGES) -> DataFrame:
    """Every row with text and n_chars.

    A null or empty page, and one of noise only, has an empty text. Hosts come from the url; null
    urls are one host. Nodes seen on fewer than `least_pages` pages are not removed for their
    importance. Repeated pages get the same text; an empty table gives an empty result. Given
    columns named as the results are replaced.
    """
    tree = style_tree(pages, page, url)
    # one row a host: the importances of the nodes of its templates
    noise = stored(tree.filter(F.col("pages") >= least_pages).groupBy("host").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("importance").alias("weights")))

    @F.pandas_udf("string")
    def texts(pages: pd.Series, nodes: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, dict(zip(n, w)) if n is not None else {}, threshold)
                          for p, n, w in zip(pages, nodes, weights)], dtype=object)

    given = rows(pages, host=host_of(F.col(url)), page=text_of(page)).join(noise, "host", "left")
    out = given.select("row", texts("page", "nodes", "weights").alias("text"))
    return unpacked(out.withColumn("n_chars", F.length("text").cast("long")), ["text", "n_chars"])
