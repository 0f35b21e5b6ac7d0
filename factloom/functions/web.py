"""Addresses and light HTML access as column expressions (the entity table needs one vectorised function)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom import dims
from factloom.functions import text


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(unescape, na_action="ignore")


def title(html: Column, fallback: Column | str = "") -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.coalesce(F.nullif(found, F.lit("")), fallback if isinstance(fallback, Column) else F.lit(fallback))


def links(html: Column) -> Column:
    """Values of href attributes without fragments, in order, each once."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda u: F.substring_index(u, "#", 1)), lambda u: u != ""))


def absolute(base: Column, link: Column) -> Column:
    """A link against its page: full addresses stay, rooted paths take the page's scheme and host, others its folder."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_extract(base, r"^([^?#]*)", 1), r"^(.*/)", 1)
    return (
        F.when(F.rlike(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def plain_text(html: Column) -> Column:
    """Scripts and styles dropped, tags to spaces, entities resolved, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(_unescaped(t), r"(?U)\s+", " "))


def table_rows(html: Column) -> Column:
    """array<struct<field, value>> of table rows with at least two non-empty cells."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), 1)
        return F.filter(F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))), lambda c: c != "")

    split = F.filter(F.transform(rows, cells), lambda c: F.size(c) >= 2)
    return F.transform(split, lambda c: F.struct(c[0].alias("field"), c[1].alias("value")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def allowed(url: Column, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    h, out = host(url), F.lit(False)
    for d in domains:
        out = out | (h == d) | F.endswith(h, F.lit(f".{d}"))
    return out


def score(url: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """The weights of all tokens that the address holds, added up."""
    out = F.lit(0)
    for token, weight in weights:
        out = out + F.when(F.contains(url, F.lit(token)), weight).otherwise(0)
    return out


def target_hints(url: Column, hints: Sequence[str]) -> Column:
    """The hint words that an address names, in the order of the hints."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(h)), h) for h in hints)))


def article_file(name: Column, ignored: Sequence[str] = ()) -> Column:
    """Whether a stored page is an article: no page of talk, help, files and the like, and none of the ignored names."""
    return ~F.rlike(name, F.lit("^(?:" + "|".join(dims.NO_ARTICLE) + ")")) & ~name.isin(*ignored, "")


def topical_title(title: Column, address: Column, words: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """Whether a discovered page belongs to the topic: 2 to 50 characters, no escapes, no excluded beginning, and a word of the topic in title or address."""
    bad = reduce(lambda a, p: a | F.rlike(title, F.lit(f"^(?:{p})")), excluded, F.contains(title, F.lit("%")))
    on_topic = text.contains_any(title, words) | text.contains_any(F.lower(F.coalesce(address, F.lit(""))), dims.TOPIC_ADDRESSES)
    return F.length(title).between(2, 50) & ~bad & on_topic
