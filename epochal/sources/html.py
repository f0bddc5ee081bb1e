"""Reading shop pages: links, addresses, cleaned text, price lines and listing rows."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import let

# Words of a price line.
QUANTITY, QUOTE_REQUEST = "数量", "価格お見積り"


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<a href="([^"]+)"'), 1)).alias("link"))


def sitemap_locations(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, loc) in document order, XML entities decoded: what stands between a tag and its end, if that is text."""
    after = F.split(xml, "<loc>")
    inside = F.transform(F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0))), lambda x: F.when(x.contains("</loc>"), F.btrim(F.substring_index(x, "</loc>", 1), F.lit(" \t\r\n"))))
    found = F.filter(inside, lambda x: (x != "") & ~x.contains("<"))
    return pages.select(key, F.posexplode(found).alias("pos", "raw")).select(key, "pos", decoded(F.col("raw")).alias("loc"))


def pattern(text: str) -> str:
    """A regular expression for a host or path in which `*` stands for anything."""
    return "^" + ".*".join(x if "(" in x else re.escape(x) for x in text.split("*")) + "$"


def url_parts(pages: DataFrame, key: str, url: str, host: str, path: str) -> DataFrame:
    """(key, scheme, host, path, lang, code, matches): an address taken apart, and whether host and path match the patterns."""
    u = F.col(url)
    rows = pages.select(key, F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1)).alias("host"), F.regexp_extract(u, "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    fits = (F.col("host").rlike(pattern(host)) | (F.col("host") == host.removeprefix("*."))) & F.col("path").rlike(pattern(path))
    return rows.withColumns({"lang": F.regexp_extract("path", "^/([a-z]{2})/", 1), "code": F.regexp_extract("path", "([0-9]+)", 1), "matches": fits})


def cleaned(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, clean): scripts, styles, comments, tags and named references out, white space collapsed."""
    t = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "&[a-z]+;", " ")
    return pages.select(key, F.trim(F.regexp_replace(t, r"[\t\n\r ]+", " ")).alias("clean"))


@F.pandas_udf(T.StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Character references decoded; unknown ones stay."""
    return text.map(lambda t: t if t is None or "&" not in t else entities.unescape(t))


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, ",", "").try_cast("long")


def price_line(line: Column) -> Column:
    """struct<least, unit, label, amount, ok> of one line: what stands in brackets before it (a quantity and its unit), what it is called, and the yen at its end."""
    bracket = F.regexp_extract(line, "^【([^】]*)】", 1)
    rest = F.trim(F.when(line.startswith("【"), F.substring_index(line, "】", -1)).otherwise(line))
    count = F.regexp_extract(bracket, f"^{QUANTITY}([0-9,]+)", 1)
    after = F.regexp_replace(bracket, f"^{QUANTITY}[0-9,]+", "")
    unit = F.regexp_replace(after, "[〜～]$", "")
    yen = F.regexp_extract(rest, "[¥￥]([0-9,]+)$", 1)
    label = F.trim(F.regexp_replace(rest, "[¥￥][0-9,]+$", ""))
    quote = (label == QUOTE_REQUEST) & yen.isin("", "0")
    whole = ~line.startswith("【") | ((count != "") & (F.char_length(after) > F.char_length(unit)) & (unit != "") & ~unit.rlike("^[0-9]|[〜～]"))
    ok = whole & (label != "") & ~label.rlike("[【】¥￥&]") & (quote | (yen != ""))
    return F.struct(_number(count).alias("least"), F.nullif(unit, F.lit("")).alias("unit"), label.alias("label"), F.when(~quote, _number(yen)).alias("amount"), ok.alias("ok"))


def price_lines(block: Column) -> Column:
    """array<struct<least, unit, label, amount>> of a price block, a line for each break; null where any of its text is no such line."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(block, r"(?i)<(?!br\b)[^>]*>", ""), "&yen;", "¥"), r"&nbsp;|\s+", " ")
    parts = F.transform(F.split(text, r"(?i)<br\s*/?>"), lambda x: F.trim(x))

    def read(d: Column) -> Column:
        good = F.transform(d["lines"], lambda x: F.struct(x["least"].alias("least"), x["unit"].alias("unit"), x["label"].alias("label"), x["amount"].alias("amount")))
        return F.when(d["ended"] & F.forall(d["lines"], lambda x: x["ok"]), good)

    lines = lambda parts: F.transform(F.filter(parts, lambda x: x != ""), price_line)
    return let(parts, lambda parts: let(F.struct((F.element_at(parts, -1) == "").alias("ended"), lines(parts).alias("lines")), read))


# Names of attributes that hold what a fixture must not keep.
SECRETS = ("csrf", "token", "session", "apikey", "api_key", "api-key")


def sanitized(html: Column, banner: Column) -> Column:
    """A page fit to be kept as a fixture: without scripts, with secrets blanked, and a banner behind its doctype."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    named = "|".join(SECRETS)
    t = F.regexp_replace(t, rf'(?i)((?:{named})[a-z_-]*"\s*(?:content|value)=")[^"]*', "$1")
    return F.regexp_replace(t, r"(?i)^(.*?<!doctype html>\r?\n?)", F.concat(F.lit("$1"), banner))
