"""Event labels from titles: rule registry, synonym dictionary, and merging of two labellers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newswake.functions.scores import clamp
from newswake.functions.starter_labels import INTRADAY, LABELS
from newswake.functions.text import has_any, keyword_hits, long_enough, text_array

OTHER_PRIORITY = 10**6


@dataclass(frozen=True)
class Label:
    name: str
    priority: int
    triggers: tuple[str, ...]
    fine: bool = False


def build_registry(base: Mapping[str, Mapping], overrides: Mapping[str, int] | None = None
                   ) -> list[Label]:
    """Labels from `{name: {fine, priority, triggers}}`, with a profile's priorities put over it."""
    overrides = overrides or {}
    return [
        Label(name.lower(), int(overrides.get(name, row["priority"])), tuple(row["triggers"]),
              bool(row.get("fine", False)))
        for name, row in base.items()
    ]


def starter_registry(profile: str | None = "intraday_kr") -> list[Label]:
    """The labels that ship with the package, with the priorities of a profile; other registries
    are read from files."""
    return build_registry(LABELS, INTRADAY if profile == "intraday_kr" else None)


def matched_labels(title: Column, registry: Sequence[Label]) -> Column:
    """All labels with a matching trigger, by priority, fine ones first among equals, then name.

    Patterns are literals, so each is compiled once per task and the whole match is one pass over
    the title without a join.
    """
    ranked = sorted(registry, key=lambda la: (la.priority, not la.fine, la.name))
    text = F.trim(title)
    # triggers of a label become one alternation; (?iU) ignores case and lets words end at any
    # letter, Hangul and Latin alike
    hits = [F.when(text.rlike("(?iU)" + "|".join(f"(?:{t})" for t in la.triggers)), F.lit(la.name))
            for la in ranked if la.triggers]
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))


def first(values: Column, top: int | None) -> Column:
    return values if top is None else F.slice(values, 1, top)


def rule_labels(title: Column, registry: Sequence[Label], top: int | None = 2) -> Column:
    return first(matched_labels(title, registry), top)


def classify(title: Column, registry: Sequence[Label], provider_labels: Column | None = None,
             provider_confidence: Column | None = None, top: int | None = 2) -> Column:
    """struct(labels, confidence) of a title, with the first `top` labels or all of them.

    A provider's answer stands unless it is `other` or under 0.6 confidence; then the rules
    answer at 0.75 if any fires. Without a provider the rules are all there is. Titles under five
    letters are `other` at 0.
    """
    rules = rule_labels(title, registry, top)
    other = F.array(F.lit("other"))

    def result(labels: Column, confidence: Column) -> Column:
        return F.struct(labels.alias("labels"), confidence.cast("double").alias("confidence"))

    by_rule = F.when(F.size(rules) > 0, result(rules, F.lit(0.75)))
    if provider_labels is None:
        answered = F.coalesce(by_rule, result(other, F.lit(0.0)))
    else:
        names = [la.name for la in registry]
        asked = valid_labels(provider_labels, names)
        weak = (asked == other) | (provider_confidence < 0.6)
        own = result(first(asked, top), provider_confidence)
        answered = F.when(weak, F.coalesce(by_rule, own)).otherwise(own)
    return F.when(long_enough(title), answered).otherwise(result(other, F.lit(0.0)))


def valid_labels(labels: Column, known: Sequence[str]) -> Column:
    """Known labels only, lower case, distinct; `other` when none is left."""
    clean = F.transform(F.coalesce(labels, F.array().cast("array<string>")),
                        lambda x: F.lower(F.trim(x)))
    kept = F.array_distinct(F.filter(clean, lambda x: F.array_contains(text_array(known), x)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("other")))


def parse_confidence(raw: Column) -> Column:
    """First number of a text as a 0..1 confidence; numbers in (1, 100] are percent."""
    x = F.regexp_extract(raw, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    scaled = F.when((x > 1.0) & (x <= 100.0), x / 100.0).otherwise(x)
    return F.coalesce(clamp(scaled, 0.0, 1.0), F.lit(0.0))


def parse_reply(reply: Column, known: Sequence[str], top: int | None = 2) -> Column:
    """struct(labels, confidence, reason) from a labeller's three-line or JSON text reply; the first
    `top` labels or all of them."""
    field = lambda words: rf"(?im)[\"']?(?:{words})[\"']?\s*[:=：]\s*[\"']?([^\n\"']+)"
    labels_text = F.regexp_extract(reply, field("라벨|labels?"), 1)
    listed = F.regexp_extract(reply, r"(?i)[\"']?(?:라벨|labels?)[\"']?\s*[:=：]\s*\[([^\]]*)\]", 1)
    source = F.lower(F.when(listed != "", listed).otherwise(labels_text))
    dotted = F.transform(
        F.regexp_extract_all(
            source, F.lit(r"(?:flow|company|sector|calendar|krx|analyst)\s*\.\s*[a-z0-9_]+"),
            F.lit(0)),
        lambda x: F.regexp_replace(x, r"\s*\.\s*", "."))
    # a bare word stands for the first label that ends in it
    words = F.filter(F.split(source, r"[,/|\s]+"), lambda x: x != "")
    ends = F.flatten(F.transform(words, lambda x: F.slice(F.filter(
        text_array(known), lambda k: (k == x) | k.endswith(F.concat(F.lit("."), x))), 1, 1)))
    labels = valid_labels(F.when(F.size(dotted) > 0, dotted).otherwise(ends), known)
    said = parse_confidence(F.regexp_extract(reply, field("정확도|confidence"), 1))
    default = F.when(labels != F.array(F.lit("other")), 0.7).otherwise(0.5)
    return F.struct(
        first(labels, top).alias("labels"),
        F.when(said > 0, said).otherwise(default).alias("confidence"),
        F.trim(F.regexp_extract(reply, field("근거|reason|이유|basis|rationale"), 1))
        .alias("reason"))


def clean_phrases(phrases: Column, top: int = 2) -> Column:
    """Distinct trimmed phrases with a Hangul or other non-ASCII letter, at most two."""
    kept = F.filter(F.transform(phrases, lambda p: F.trim(p)), lambda p: p.rlike(r"[^\x00-\x7F]"))
    return F.slice(F.array_distinct(kept), 1, top)


def merge_labellers(labels: Column, label_confidence: Column, phrases: Column,
                    phrase_confidence: Column) -> Column:
    """struct(labels, phrases, confidence, source): labels of one labeller, phrases of the other."""
    other = F.array(F.lit("other"))
    none = F.array().cast("array<string>")
    has_labels = (F.size(labels) > 0) & (labels != other)
    has_phrases = F.size(phrases) > 0

    def row(la, ph, conf, source):
        return F.struct(la.alias("labels"), ph.alias("phrases"),
                        conf.cast("double").alias("confidence"), F.lit(source).alias("source"))

    return (
        F.when(has_labels & has_phrases, row(
            labels, phrases, F.greatest(label_confidence, phrase_confidence), "both"))
        .when(has_labels, row(labels, none, label_confidence, "labels"))
        .when(has_phrases, row(other, phrases, phrase_confidence, "phrases"))
        .otherwise(row(other, none, F.lit(0.0), "none")))


# --- synonym dictionary -----------------------------------------------------------------------

def synonym_events(text: Column, synonyms: Sequence[tuple[str, str]]) -> Column:
    """array<struct(code, confidence)> of the codes whose alias is in the text, in alias order.

    The confidence comes from the first alias hit of a code: min(0.9, 0.5 + 0.05 x letters).
    Three word pairs then set a fixed confidence for their code.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    aliases: dict[str, list[str]] = {}
    for alias, code in synonyms:
        aliases.setdefault(code, []).append(alias.lower())
    pairs = {
        # fixed values: code -> (condition, confidence)
        "workout": (t.contains("워크아웃") & t.contains("개시"), 0.95),
        "liquidity_crunch": (t.contains("유동성") & (t.contains("위기") | t.contains("경색")), 0.9),
        "cb_issue": (t.contains("전환사채") & t.contains("발행"), 0.85),
    }
    found = []
    for code, words in aliases.items():
        first_hit = F.when(F.lit(False), F.lit(0.0))
        for w in words:
            first_hit = first_hit.when(t.contains(w), F.lit(min(0.9, 0.5 + len(w) * 0.05)))
        conf = first_hit
        if code in pairs:
            condition, fixed = pairs[code]
            conf = F.when(first_hit.isNotNull() & condition, F.lit(fixed)).otherwise(first_hit)
        found.append(F.when(first_hit.isNotNull(), F.struct(
            F.lit(code).alias("code"), conf.alias("confidence"))))
    return F.array_compact(F.array(*found))


def query_event_keywords(text: Column, synonyms: Sequence[tuple[str, str]],
                         terms: Sequence[str], limit: int | None = None) -> Column:
    """Synonym aliases in the text, then the fixed terms in it; distinct, all or the first `limit`."""
    by_alias = keyword_hits(text, [a for a, _ in synonyms])
    by_term = F.filter(text_array(terms), lambda k: F.coalesce(text, F.lit("")).contains(k))
    words = F.array_distinct(F.concat(by_alias, by_term))
    return words if limit is None else F.slice(words, 1, limit)


def label_rows(titles: DataFrame, title_col: str, registry: Sequence[Label]) -> DataFrame:
    """Every (row, label) hit with its rank, one row each."""
    return titles.select("*", F.posexplode(matched_labels(F.col(title_col), registry))
                         .alias("rank", "label"))


def lexicon_hits(text: Column, lexicon: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """array<struct(category, subcategory, keyword)> of a nested keyword lexicon found in a text."""
    def rows(category: str, sub: str, words: Sequence[str]) -> Column:
        return F.transform(keyword_hits(text, words), lambda k: F.struct(
            F.lit(category).alias("category"), F.lit(sub).alias("subcategory"),
            k.alias("keyword")))

    return F.concat(*[rows(category, sub, words) for category, groups in lexicon.items()
                      for sub, words in groups.items()])
