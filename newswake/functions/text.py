"""Text, list, URL and name expressions. All but key phrases run in the JVM; hashes that need Python
are in ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WORD = r"[A-Za-z0-9가-힣]{2,}"

# fixed values: publisher tiers
PUBLISHER_TIER = {
    "연합뉴스": 0.8, "매일경제": 0.8, "한국경제": 0.8, "파이낸셜뉴스": 0.8,
    "서울경제": 0.65, "중앙일보": 0.65, "아시아경제": 0.65, "이데일리": 0.65, "헤럴드경제": 0.65,
    "연합뉴스TV": 0.5, "한국경제TV": 0.5, "MBN": 0.5, "뉴스1": 0.5, "일간스포츠": 0.5,
}
DEFAULT_TIER = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row.

    An expression named inside a lambda is computed again for every element; a lambda variable
    is not, so the value is passed through a one-element array.
    """
    return F.transform(F.array(value), use)[0]


def each(values: Column) -> Column:
    """One row per element, and one null row for an empty list, to be dropped by the caller.

    A plain explode makes the optimizer add a filter on the list's size below it, which computes
    the list a second time.
    """
    return F.explode_outer(values)


def text_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


BLANKS = " \t\n\r\f\v"


def strip(text: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.btrim(text, F.lit(BLANKS))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def comma_list(raw: Column) -> Column:
    return _trimmed(F.split(raw, ","))


def split_companies(raw: Column) -> Column:
    """Split on comma, backslash, pipe, slash and middle dot; empty list for null."""
    return F.coalesce(_trimmed(F.split(raw, r"[,\\|/·]")), F.array().cast("array<string>"))


def distinct_names(names: Column) -> Column:
    """Trimmed, blanks dropped, first occurrence kept."""
    return F.array_distinct(_trimmed(names))


def publisher_tier(name: Column, tiers: dict[str, float] = PUBLISHER_TIER) -> Column:
    pairs = [c for k, v in tiers.items() for c in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.trim(name)], F.lit(DEFAULT_TIER))


def normalize_title(title: Column) -> Column:
    """Whitespace collapsed, punctuation turned into spaces, trimmed."""
    t = F.coalesce(title, F.lit(""))
    t = F.regexp_replace(t, r"[\[\]()<>…·,.!?:;\"'`]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _runs(words: Column, n: int, sep: str) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.concat_ws(sep, F.slice(words, i, n)))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, n: int, sep: str = " ") -> Column:
    """All runs of n consecutive words; empty when there are fewer."""
    return let(words, lambda w: _runs(w, n, sep))


PHRASE_BYTES = 8 << 20


def _phrases(words: list[str]) -> set[str]:
    pairs = list(zip(words, words[1:]))
    triples = list(zip(words, words[1:], words[2:]))
    return {*words, *map(" ".join, pairs), *map("".join, pairs), *map(" ".join, triples), *map("".join, triples)}


def _phrase_lists(batches: Iterator[pd.Series], most: int = PHRASE_BYTES) -> Iterator[pd.Series]:
    """Sorted phrases of lower-case texts, joined by |. The phrases of a text take many times its
    size, so they are given on as soon as they have `most` letters."""
    for texts in batches:
        out, letters = [], 0
        for text in texts:
            out.append("|".join(sorted(_phrases(re.findall(WORD, text)))))
            letters += len(out[-1])
            if letters >= most:
                yield pd.Series(out, dtype=object)
                out, letters = [], 0
        if out:
            yield pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def _joined_phrases(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _phrase_lists(texts)


def joined_keyphrases(title: Column) -> Column:
    """`keyphrases`, all of them, in one string with | between, which is no letter of a word."""
    return _joined_phrases(F.lower(F.coalesce(title, F.lit(""))))


def keyphrases(title: Column, limit: int | None = None) -> Column:
    """Words, pairs and triples with and without their spaces; distinct and sorted, all of them
    or the first `limit`."""
    phrases = F.array_remove(F.split(joined_keyphrases(title), r"\|"), "")
    return phrases if limit is None else F.slice(phrases, 1, limit)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All runs of n letters, lower case. The look-ahead yields overlapping runs in one pass."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


# --- URLs ----------------------------------------------------------------------------------

def _query_value(params: Column, key: str) -> Column:
    """Decoded value of the last parameter of that name, in any letter case."""
    hits = F.filter(params, lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))) == key)
    raw = F.regexp_extract(F.try_element_at(hits, F.lit(-1)), r"^[^=]*=?(.*)$", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def article_keys(url: Column) -> Column:
    """struct(oid, aid, date, office_id, article_id) from the query string.

    office_id and article_id stand in for a missing oid and aid and then leave their own slot.
    """
    params = F.split(F.try_parse_url(url, F.lit("QUERY")), "&")
    v = {k: _query_value(params, k) for k in ("oid", "aid", "date", "office_id", "article_id")}
    return F.struct(
        F.coalesce(v["oid"], v["office_id"]).alias("oid"),
        F.coalesce(v["aid"], v["article_id"]).alias("aid"),
        v["date"].alias("date"),
        F.when(v["oid"].isNotNull(), v["office_id"]).alias("office_id"),
        F.when(v["aid"].isNotNull(), v["article_id"]).alias("article_id"),
    )


def _form_encode(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")),
                     F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, decoded path, article keys in name order; no fragment.

    Text that is not a URL comes back as it is.
    """
    keys = article_keys(url)
    query = F.concat_ws("&", *[
        F.when(keys[k].isNotNull(), F.concat(F.lit(k + "="), _form_encode(keys[k])))
        for k in ("aid", "article_id", "date", "office_id", "oid")])
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    canon = F.concat(scheme, F.lit("://"), host, path,
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.coalesce(canon, url)


# --- stored text fields --------------------------------------------------------------------

def parse_list(value: Column) -> Column:
    """List from `['a', "b"]`, `a, b` or `a` text; empty for null and blank text."""
    v = F.trim(value)
    bracketed = v.startswith("[") & v.endswith("]")
    body = F.when(bracketed, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    parts = F.transform(F.split(body, ","), lambda p: F.trim(
        F.regexp_replace(F.trim(p), r"^['\"]+|['\"]+$", "")))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def parse_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(default))


def parse_vector(value: Column) -> Column:
    """array<float> from `[0.1, 0.2]` text; null for anything else."""
    v = F.trim(value)
    ok = v.rlike(r"^\[\s*[-+0-9.eE]+(\s*,\s*[-+0-9.eE]+)*\s*\]$")
    parts = F.split(F.regexp_replace(v, r"[\[\]\s]", ""), ",")
    return F.when(ok, F.transform(parts, lambda p: p.try_cast("float")))


# --- keywords, names, amounts --------------------------------------------------------------

def keyword_hits(text: Column, keywords: Iterable[str]) -> Column:
    """Keywords contained in the text in any letter case, in the order of the list."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return let(t, lambda v: F.filter(text_array(keywords), lambda k: v.contains(F.lower(k))))


def has_any(text: Column, keywords: Iterable[str]) -> Column:
    """Whether any keyword is contained, in any letter case; a plain chain of contains."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for k in keywords:
        out = out | t.contains(k.lower())
    return out


def strip_company_form(name: Column) -> Column:
    """Without (주) and 주식회사."""
    return F.trim(F.regexp_replace(name, r"\(주\)|주식회사", ""))


def company_key(name: Column) -> Column:
    """Lower case without (주), ㈜, 주식회사 and spaces, for comparing names."""
    return F.lower(F.regexp_replace(name, r"\(주\)|㈜|주식회사|\s+", ""))


def name_similarity(a: Column, b: Column) -> Column:
    """0.7 x Jaccard of the letter sets + 0.3 x closeness of the lengths; 0 for an empty name."""
    letters = lambda s: F.array_distinct(F.split(F.lower(s), ""))
    x, y = letters(a), letters(b)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    longer = F.greatest(F.length(a), F.length(b))
    closeness = 1.0 - F.abs(F.length(a) - F.length(b)) / longer
    return F.when((F.length(a) > 0) & (F.length(b) > 0),
                  jaccard * 0.7 + closeness * 0.3).otherwise(0.0)


# fixed values: amounts in a claim, and the wordings that name a contract party
AMOUNT = r"\d+[\.,]?\d*\s*(?:조|억|만|천|백|달러|원|%)"
PARTY_LETTERS = r"[가-힣A-Za-z0-9\s]+"
WITH_PARTY = rf"({PARTY_LETTERS})(?:와|과)\s*계약"
LABELLED_PARTY = rf"(?:매수인|매도인|거래처|공급처|수요처|계약상대방|상대방)\s*[:\s]\s*({PARTY_LETTERS})"
COMPANY_FORM = r"(?:주식회사|㈜|\(주\))\s*([가-힣A-Za-z0-9]+)"


def amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))


def counterparties(text: Column, limit: int | None = None, longest: int | None = None) -> Column:
    """Contract parties named in a text, by three wordings; distinct, all of them or the first
    `limit` of at most `longest` letters."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    found = lambda p, least: F.filter(
        F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda m: F.trim(m)),
        lambda m: F.length(m) > least)
    with_party = found(WITH_PARTY, 2)
    labelled = found(LABELLED_PARTY, 2)
    company_form = F.transform(found(COMPANY_FORM, 1), lambda m: F.concat(F.lit("(주)"), m))
    every = F.filter(F.concat(with_party, labelled, company_form),
                     lambda m: (m != "") & ((F.length(m) <= longest) if longest else F.lit(True)))
    names = F.array_distinct(every)
    return names if limit is None else F.slice(names, 1, limit)


def text_key(text: Column, title: Column | None = None) -> Column:
    """md5 of the whole text plus the title: equal keys share one extraction."""
    whole = F.coalesce(text, F.lit(""))
    return F.md5(F.concat(whole, F.coalesce(title, F.lit(""))) if title is not None else whole)


def long_enough(text: Column, least: int = 5, most: int | None = None) -> Column:
    n = F.length(strip(text))
    return (n >= least) & (n <= most) if most else n >= least


def json_block(text: Column) -> Column:
    """The JSON object in a text, from its first brace to its last; null if that is no JSON."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull(), block)


def company_list(reply: Column) -> Column:
    """Names in a reply: the strings of its JSON list, else its lines without numbers and bullets."""
    text = F.coalesce(reply, F.lit(""))
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    lines = F.transform(F.split(text, r"[\r\n]+"), lambda x: F.regexp_replace(
        x, r"^\s*(?:[-*\u2022]|\d+[.)])\s*|[\s,\"']+$", ""))
    return distinct_names(F.coalesce(listed, lines))
