"""Sitemaps: bodies as they come, the index of sub-sitemaps, and what the addresses in them name."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import is_handle
from .html import decoded

# The first bytes of a gzipped body; kinds of listing by their letter in an address; the longest sales code and listing name.
GZIP_MAGIC = b"\x1f\x8b"
LISTING_KINDS = {"c": "category", "r": "genre"}
CODE_DIGITS, NAME_LENGTH = 12, 61


@F.pandas_udf(T.StringType())
def body_text(body: pd.Series) -> pd.Series:
    """A body's text, whether it is gzipped or not; null stays null, a damaged body fails the read."""
    return body.map(lambda b: None if b is None else (gzip.decompress(b) if b[:2] == GZIP_MAGIC else bytes(b)).decode("utf-8", "replace"))


def _inside(text: Column, tag: str) -> Column:
    """What the first element of a tag holds, trimmed; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def index_entries(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, url, modified) of an index's sub-sitemaps in order; an entry without an address is left out. An index without rows here is a fault."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<sitemap>(.*?)</sitemap>"), 1)).alias("pos", "b"))
    return blocks.select(key, "pos", decoded(_inside(F.col("b"), "loc")).alias("url"), _inside(F.col("b"), "lastmod").alias("modified")).where("url is not null")


def newest(entries: DataFrame, key: str) -> DataFrame:
    """(key, modified): the greatest date as it is written, null if no entry has one."""
    return entries.groupBy(key).agg(F.max("modified").alias("modified"))


def named_page(url: Column) -> Column:
    """struct<kind, id> of a catalogue address: a product by its sales code, a category or genre by its name without the number of its page; null for any other."""
    steps = F.split(F.regexp_replace(url, "/$", ""), "/")
    area, letter, name = (F.get(steps, F.size(steps) - k) for k in (3, 2, 1))
    listing = F.regexp_replace(name, r"_p\d+$", "")
    code = F.substring(name, 2, 1 << 20)
    is_code = (letter == "g") & name.startswith("g") & code.rlike(r"^\d+$") & (F.char_length(code) <= CODE_DIGITS)
    is_listing = letter.isin(*LISTING_KINDS) & listing.rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$") & (F.char_length(listing) <= NAME_LENGTH)
    kinds = F.create_map(*[F.lit(x) for kv in LISTING_KINDS.items() for x in kv])
    found = F.when(is_code, F.struct(F.lit("product").alias("kind"), code.alias("id"))).when(is_listing, F.struct(kinds[letter].alias("kind"), listing.alias("id")))
    return F.when(area == "catalog", found)


def handle_of(url: Column) -> Column:
    """The handle that a product's address names, percent signs decoded before it is judged; null if it is no such address or decodes to no text."""
    steps = F.split(F.regexp_replace(url, "/$", ""), "/")
    named = (F.size(steps) == 5) & F.get(steps, F.lit(0)).isin("http:", "https:") & (F.get(steps, F.lit(1)) == "") & (F.get(steps, F.lit(2)) != "") & (F.get(steps, F.lit(3)) == "products")
    last = F.get(steps, F.lit(4))
    text = F.try_url_decode(F.regexp_replace(last, r"\+", "%2B"))
    return F.when(named & last.rlike("^[^?#]+$") & (~text.contains("�") | F.upper(last).contains("%EF%BF%BD")), text)


def addressed(locations: DataFrame, url: str) -> DataFrame:
    """(kind, id, n): what addresses name, each once, and how often: products, categories, genres, handles and handles of a shape that isn't supported."""
    handle = handle_of(F.col(url))
    by_handle = F.when(handle.isNotNull(), F.struct(F.when(is_handle(handle), "handle").otherwise("unsupported").alias("kind"), handle.alias("id")))
    found = locations.select(F.coalesce(named_page(F.col(url)), by_handle).alias("x")).where("x is not null")
    return found.groupBy("x.kind", "x.id").agg(F.count("*").alias("n"))
