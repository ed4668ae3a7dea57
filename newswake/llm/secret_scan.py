"""Secrets in texts: strong patterns, and weak candidates that are reported only where parts of one
credential stand together.

A credential in use has parts: something that names the account (an access identifier), something
that proves it (a secret), and something that it opens (an endpoint). The strong kinds `assign`,
`access` and `hex` are reported wherever they stand. Four weak kinds are only candidates:

* `identifier`: a user, login, client or account name that is assigned a value
* `endpoint`: an address with a scheme, or a host, endpoint or server that is assigned a value
* `short`: an assigned secret of 6 to 11 characters
* `opaque`: 20 or more characters of the secrets' alphabet with small and capital letters and digits

A text is divided into scopes by blank lines. Within a scope an interval join by sweep (window
functions over the parts in order of their places, no pairs) finds the nearest complementary part of
each candidate; a secret is complemented by an identifier or endpoint, these by a secret. A
candidate with none at most `reach` characters away is not reported. Parts move, texts do not, and
only those of texts that hold a candidate and a complement. A scope lies in one text, so what a
task sorts is bounded by one cell of the table.

Defined results: a null or empty text has no spans; repeated rows and repeated or null ids give a row
each; an empty table gives none. Given columns stay, but `text`, which is not carried through the
join (where it is the only one, `has_text` stays); results replace given columns of their names. Spans are in code points, the end exclusive, in
order of start and then of `KINDS`. Candidates that touch a strong span are part of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from newswake.llm.tables import stored, text_of, unpacked

KINDS = ["assign", "access", "hex", "identifier", "endpoint", "short", "opaque"]
SECRETS = {"assign", "hex", "short", "opaque"}
WEAK = set(KINDS[3:])

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
# runs of `AKIA[A-Z0-9]+` of 18 and of `[0-9a-f]+` of 16 letters or more
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
IDENTIFIER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id|_?name)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
                        re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}|\b(?:host(?:_?name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9_-]+(?:\.[a-z0-9_-]+)+(?::[0-9]+)?""",
                      re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

SPAN = "array<struct<kind: string, start: int, stop: int>>"
FOUND = f"base {SPAN}, parts array<struct<kind: string, scope: int, start: int, stop: int>>"

Span = tuple[str, int, int]


def strong_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the strong kinds, in order, and assigned values too short for one."""
    found, short = [], []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            found.append(("assign", m.start(), m.end()))
        elif len(m[2]) >= 6:
            short.append(("short", m.start(), m.end()))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=in_order), short


def in_order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def is_opaque(value: str) -> bool:
    return (any(c.isdigit() for c in value) and any(c.islower() for c in value)
            and any(c.isupper() for c in value))


def weak_spans(text: str, short: list[Span], base: list[Span]) -> list[Span]:
    """Candidates outside the strong spans; of touching candidates of one text the first stays."""
    found = list(short)
    found += [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if "://" in text or "=" in text or ":" in text:
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    found += [("opaque", m.start(), m.end()) for m in OPAQUE.finditer(text) if is_opaque(m[0])]
    starts, reached = [s for _, s, _ in base], []
    for _, _, stop in base:  # the furthest end among the spans so far
        reached.append(max(stop, reached[-1]) if reached else stop)
    kept, end = [], 0
    for span in sorted(found, key=in_order):
        _, start, stop = span
        before = bisect_left(starts, stop)
        if start < end or (before and reached[before - 1] > start):
            continue
        kept.append(span)
        end = stop
    return kept


def parts_of(text: str, base: list[Span], short: list[Span]) -> list[tuple[str, int, int, int]]:
    """What takes part in links, with scopes; nothing if no link is possible."""
    weak = weak_spans(text, short, base)
    every = sorted([*base, *weak], key=in_order)
    if not weak or len({kind in SECRETS for kind, _, _ in every}) < 2:
        return []
    blanks = [m.start() for m in BLANK_LINE.finditer(text)]
    return [(kind, bisect_right(blanks, start), start, stop) for kind, start, stop in every]


def _extract(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in frames:
        base, parts = [], []
        for text in texts:
            own, short = strong_spans(text)
            base.append([{"kind": k, "start": a, "stop": b} for k, a, b in own])
            parts.append([{"kind": k, "scope": s, "start": a, "stop": b}
                          for k, s, a, b in parts_of(text, own, short)])
        yield pd.DataFrame({"base": base, "parts": parts})


def extract(text):
    return F.pandas_udf(_extract, FOUND)(text)


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts (_id, scope, kind, start, stop) that have a complement within reach."""
    ascending = (Window.partitionBy("_id", "scope").orderBy("start", "stop", "kind")
                 .rowsBetween(Window.unboundedPreceding, -1))
    descending = (Window.partitionBy("_id", "scope").orderBy(F.desc("start"), F.desc("stop"), F.desc("kind"))
                  .rowsBetween(Window.unboundedPreceding, -1))
    secret = F.col("kind").isin(*sorted(SECRETS))
    near = parts.select(
        "*", secret.alias("secret"),
        F.max(F.when(secret, F.col("stop"))).over(ascending).alias("secret_before"),
        F.max(F.when(~secret, F.col("stop"))).over(ascending).alias("name_before"),
        F.min(F.when(secret, F.col("start"))).over(descending).alias("secret_after"),
        F.min(F.when(~secret, F.col("start"))).over(descending).alias("name_after"))
    before = F.when(F.col("secret"), F.col("name_before")).otherwise(F.col("secret_before"))
    after = F.when(F.col("secret"), F.col("name_after")).otherwise(F.col("secret_after"))
    within = (F.coalesce(F.col("start") - before <= reach, F.lit(False))
              | F.coalesce(after - F.col("stop") <= reach, F.lit(False)))
    return near.filter(F.col("kind").isin(*sorted(WEAK)) & within).select("_id", "kind", "start", "stop")


def in_span_order(spans):
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda k: k["span"])


def scan(docs: DataFrame, reach: int = 300) -> DataFrame:
    """All given columns but `text`, with `base` (strong spans), `linked` (weak ones reported) and
    `spans` (both), arrays of (kind, start, stop)."""
    named = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    named = named or [F.col("text").isNotNull().alias("has_text")]
    packed = docs.select(F.struct(*named).alias("row"), extract(text_of()).alias("_found"))
    found = stored(packed.select("row", F.monotonically_increasing_id().alias("_id"), "_found.*"))
    parts = (found.filter(F.size("parts") > 0)
             .select("_id", F.explode("parts").alias("p")).select("_id", "p.*"))
    links = linked(parts, reach).groupBy("_id").agg(
        F.collect_list(F.struct("kind", "start", "stop")).alias("linked"))
    none = F.array().cast(SPAN)
    out = (found.join(links, "_id", "left")
           .withColumn("linked", in_span_order(F.coalesce("linked", none)))
           .withColumn("spans", in_span_order(F.concat("base", "linked"))))
    return unpacked(out, ["base", "linked", "spans"])


def written(spans) -> F.Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
