"""Scalar functions at their boundaries."""

import json

import pytest
from pyspark.sql import functions as F

from epochal.functions import keys, money, times
from epochal.sources import html


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("before", "now", "want"), [(1150, 1200, (50, 4.35, "up")), (1200, 1150, (-50, -4.17, "down")), (0, 7, (7, None, "up")), (5, 5, (0, 0.0, "same")), (None, 5, (None, None, "unknown"))])
def test_price_change(spark, before, now, want):
    b, n = (F.lit(x).cast("long") for x in (before, now))
    assert tuple(one(spark, money.price_change(b, n))) == want


@pytest.mark.parametrize(("text", "want"), [("12.3", 1230), ("12.30", 1230), ("12", 1200), ("12.345", None), ("-1", None), ("", None), (None, None)])
def test_decimal_minor(spark, text, want):
    assert one(spark, money.decimal_minor(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("1200", 1200), ("1200.00", 1200), ("1200.5", None), ("1234567890123", None)])
def test_whole_yen(spark, text, want):
    assert one(spark, money.whole_yen(F.lit(text))) == want


def test_half_up_rounds_negative_halves_up(spark):
    assert one(spark, money.half_up(F.lit(-2.5))) == -2


@pytest.mark.parametrize(
    ("text", "want"),
    [("1970-01-01T00:00:00Z", 0), ("1970-01-01T09:00:00.123456789+09:00", 123), ("1969-12-31T23:00:00.5-01:00", 500), ("1970-01-01T00:00:00", None), ("1970-13-01T00:00:00Z", None), ("1970-01-01 00:00:00Z", None)],
)
def test_parse_iso(spark, text, want):
    assert one(spark, times.parse_iso(F.lit(text))) == want


def test_iso_round_trip(spark):
    ms = [0, 1, 86_399_999, 951_782_400_000, 4_102_444_799_999]
    rows = spark.createDataFrame([(m,) for m in ms], "m long").select("m", times.parse_iso(times.to_iso(F.col("m"))).alias("x")).collect()
    assert all(r.m == r.x for r in rows)


def test_keys(spark):
    rows = {"a.b-c": True, "..x": False, "_a": False, "": False, "a" * 128: True, "a" * 129: False, "é": False}
    got = {r.k: r.x for r in spark.createDataFrame([(k,) for k in rows], "k string").select("k", keys.is_safe_key(F.col("k")).alias("x")).collect()}
    assert got == rows


def test_tokens_keep_models_and_drop_measurements(spark):
    name = "MODULE 5V3A 12MM 2X20 4-PIN AWG22 V2.1 M78AR05-0.5"
    assert one(spark, keys.words_with_digits(F.lit(name))) == ["M78AR05-0.5"]
    assert one(spark, keys.words_with_digits(F.lit("DHT12/BMP280"))) == ["DHT12/BMP280", "DHT12", "BMP280"]


def test_stems(spark):
    assert one(spark, keys.code_stems(F.lit("AI-003-PRO"))) == ["AI-003", "AI-003-PRO"]


def test_fnv(spark):
    want = {"": 2166136261, "a": 0xE40C292C, "foobar": 0xBF9CF968}
    got = {r.k: r.x for r in spark.createDataFrame([(k,) for k in want], "k string").select("k", keys.fnv1a(F.col("k")).alias("x")).collect()}
    assert got == want


def test_canonical_json_and_handles(spark):
    text = '{"b":[1,{"z":null,"a":"é"}],"a":1}'
    assert one(spark, keys.canonical_json(F.lit(text))) == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, keys.canonical_json(F.lit("{"))) is None
    key = keys.page_key_of_handle(F.lit("a_bé+"))
    assert one(spark, key) == "h-a_5Fb_C3_A9_2B"
    assert one(spark, keys.handle_of_page_key(key)) == "a_bé+"
    assert [one(spark, keys.handle_of_page_key(F.lit(k))) for k in ("h-a b", "h-_zz", "h-_61", "x-a", "h-", "h-a")] == [None, None, None, None, None, "a"]
    assert [one(spark, keys.page_key_of_handle(F.lit(h))) for h in ("a b", "-a", "", "é" * 22, "é" * 21)] == [None, None, None, None, "h-" + "_C3_A9" * 21]


def test_shapes_of_codes(spark):
    from epochal.operators import rawchecks

    say = lambda shape, *texts: [one(spark, F.lit(t).rlike(shape)) for t in texts]
    assert say(rawchecks.SLUG, "foo.bar_1", "a" * 64, "a" * 65, "-a", "A", "a\n") == [True, True, False, False, False, False]
    assert say(rawchecks.CATEGORY_CODE, "EEHD-5MAE", "A-B-C-D", "A-B-C-D-E", "ABCDEFGHIJKL", "ABCDEFGHIJKLM", "a", "A-") == [True, True, False, True, False, False, False]


def test_names_lose_what_shops_note(spark):
    names = {"《お取り寄せ商品》 ABC-12": "ABC-12", "ｘ 【取寄せ品】y[eol] z": "X Y Z", "part--販売終了": "PART", "part--販売終了 2": "PART--販売終了 2", "a  b--在庫限り": "A B"}
    assert [one(spark, keys.clean_name(F.lit(k))) for k in names] == list(names.values())


def test_price_lines(spark):
    block = "【数量1個〜】単価&nbsp;¥1340<br>【数量10個〜】10個以上単価&nbsp;¥1,200<br>"
    got = [tuple(x) for x in one(spark, html.price_lines(F.lit(block)))]
    assert got == [(1, "個", "単価", 1340), (10, "個", "10個以上単価", 1200)]
    assert one(spark, html.price_lines(F.lit("what is this"))) is None
