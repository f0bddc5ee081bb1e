"""Registered queries of what readers are shown: charts, readouts, rows of statistics and sales, related products, price cards, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY_MS
from ..operators import changepoints, readside, series
from ..sources.tables import EVENTS_SQL, PRICES_SQL, cents, daily_prices, event_stream, table
from . import temporal
from .registry import query

FROM_MS, TO_MS = 915_148_800_000, 978_307_200_000  # 1999-01-01 and 2001-01-01
MID_MS = temporal.MID_MS

_MONEY = """CASE WHEN {0} < 0 THEN '-' ELSE '' END || CASE {1} WHEN 'JPY' THEN '￥' || format('{{:,}}', abs({0})) ELSE CASE {1} WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' ELSE {1} || chr(160) END || format('{{:,}}', abs({0}) // 100) || '.' || lpad((abs({0}) % 100)::VARCHAR, 2, '0') END"""


@query("price_texts", f"""WITH o AS (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'XAU' END AS currency, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END AS low, o_orderkey % 3 = 0 AS ranged, o_orderdate FROM orders),
p AS (SELECT *, CASE WHEN ranged THEN low + o_orderkey % 2 * 500 ELSE low END AS high FROM o)
SELECT o_orderkey, CASE WHEN low IS NULL THEN '価格表示なし' WHEN ranged AND low <> high THEN {_MONEY.format('low', 'currency')} || '〜' || {_MONEY.format('high', 'currency')} ELSE {_MONEY.format('low', 'currency')} END AS price,
CASE WHEN o_orderkey % 2 = 0 THEN '販売価格' ELSE '参考価格' END || ' / ' || CASE o_orderkey % 3 WHEN 0 THEN '税込' WHEN 1 THEN '税抜' ELSE '税区分不明' END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' / 1個' END || CASE WHEN currency = 'JPY' THEN '' ELSE ' / ' || currency END AS basis,
strftime(o_orderdate + INTERVAL 9 HOUR + INTERVAL (o_orderkey % 60) MINUTE, '%Y-%m-%d %H:%M') AS seen FROM p""")
def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    currency = F.when(F.col("o_custkey") % 4 == 0, "JPY").when(F.col("o_custkey") % 4 == 1, "USD").when(F.col("o_custkey") % 4 == 2, "GBP").otherwise("XAU")
    o = table(spark, sf_dir, "orders").select("o_orderkey", currency.alias("currency"), F.when(n % 11 != 0, cents("o_totalprice")).alias("low"), F.when(n % 3 == 0, "range").otherwise("exact").alias("state"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("t"))
    o = o.withColumn("high", F.when(F.col("state") == "range", F.col("low") + n % 2 * 500).otherwise(F.col("low")))
    tax = F.element_at(F.array(*map(F.lit, readside.TAX_LABELS)), (n % 3 + 1).cast("int"))
    label = readside.basis_label(F.when(n % 2 == 0, "selling").otherwise("compare_at"), tax, F.col("currency"), F.when(n % 5 != 0, "1個"))
    return o.select("o_orderkey", readside.price_text(F.col("state"), F.col("low"), F.col("high"), F.col("currency")).alias("price"), label.alias("basis"), readside.time_text(F.col("t") + n % 60 * 60_000, 540).alias("seen"))


_CHART = f"WITH {PRICES_SQL}, {temporal._DAILY}, {temporal._PRESENCE}, {temporal._LISTED}, w AS (SELECT part, greatest(start, {FROM_MS}) AS start, least(stop, {TO_MS}) AS stop, cents FROM l WHERE stop >= {FROM_MS} AND start <= {TO_MS})"


@query("step_chart", f"""{_CHART}, gp AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY part ORDER BY start) + 1 < start, false) AS gap FROM w), k AS (SELECT part, count(*) AS markers FROM q WHERE t BETWEEN {FROM_MS} AND {TO_MS} GROUP BY part)
SELECT gp.part, count(*) AS steps, count(*) FILTER (WHERE gap) AS gaps, min(cents) AS low, max(cents) AS high, min(start) AS start, max(stop) AS stop, coalesce(any_value(markers), 0) AS markers FROM gp LEFT JOIN k USING (part) GROUP BY gp.part""")
def step_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, what the chart of two years draws."""
    steps = readside.clipped(temporal.listed_prices(spark, sf_dir), F.lit(FROM_MS), F.lit(TO_MS)).withColumnRenamed("cents", "value")
    markers = changepoints.change_points(daily_prices(spark, sf_dir), ["part"], "t", ["cents"]).where(F.col("t").between(FROM_MS, TO_MS))
    return readside.chart_totals(steps, markers, ["part"])


@query("comparison_chart", f"""WITH {PRICES_SQL}, s AS (SELECT part, offer, t, min(cents) AS cents FROM x GROUP BY ALL), e AS (SELECT part, offer, max(t) AS last FROM s GROUP BY ALL),
p AS (SELECT part, offer, t, cents FROM (SELECT *, lag(cents) OVER w AS before, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY part, offer ORDER BY t)) WHERE n = 1 OR before IS DISTINCT FROM cents),
v AS (SELECT p.part, p.offer, t AS start, coalesce(lead(t) OVER (PARTITION BY p.part, p.offer ORDER BY t) - 1, last) AS stop, cents FROM p JOIN e ON e.part = p.part AND e.offer = p.offer)
SELECT part, offer, greatest(start, {FROM_MS}) AS start, least(stop, {TO_MS}) AS stop, cents FROM v WHERE stop >= {FROM_MS} AND start <= {TO_MS}""")
def comparison_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each supplier's price of each part; a series ends with its own last observation."""
    from pyspark.sql import Window

    from ..sources.tables import price_stream

    key = ["part", "offer"]
    seen = price_stream(spark, sf_dir).groupBy(*key, "t").agg(F.min("cents").alias("cents")).withColumn("last", F.max("t").over(Window.partitionBy(*key)))
    points = changepoints.change_points(seen, key, "t", ["cents"])
    stop = F.coalesce(F.lead("t").over(Window.partitionBy(*key).orderBy("t")) - 1, F.col("last"))
    return readside.clipped(points.select(*key, F.col("t").alias("start"), stop.alias("stop"), "cents"), F.lit(FROM_MS), F.lit(TO_MS))


_STEPS = f"""v AS (SELECT user_id, t, event_id, cents, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM e WHERE event_type <> 'error'), s AS (SELECT user_id, t AS start, coalesce(next, {MID_MS + 30 * DAY_MS}) AS stop, cents FROM v WHERE coalesce(next, t + 1) > t)"""


@query("chart_readout", f"""WITH {EVENTS_SQL}, {_STEPS}, n AS (SELECT user_id, min(t) AS first, max(t) AS last FROM e GROUP BY user_id), tg AS (SELECT user_id, {MID_MS} + k * {6 * 3_600_000} AS pointed FROM n, unnest([-90, -20, 0, 1, 2, 30, 90]) u(k)),
d AS (SELECT tg.user_id, tg.pointed, arg_min(v.cents, (abs(v.t - tg.pointed), v.t, v.event_id)) AS dot FROM tg JOIN v ON v.user_id = tg.user_id AND abs(v.t - tg.pointed) <= 3600000 GROUP BY ALL), p AS (SELECT tg.user_id, tg.pointed, s.stop, s.cents FROM tg ASOF LEFT JOIN s ON s.user_id = tg.user_id AND tg.pointed >= s.start),
r AS (SELECT tg.user_id, tg.pointed, tg.pointed < first - 3600000 OR tg.pointed > last + 3600000 AS outside, dot, CASE WHEN tg.pointed <= p.stop THEN p.cents END AS step FROM tg JOIN n USING (user_id) LEFT JOIN d ON d.user_id = tg.user_id AND d.pointed = tg.pointed JOIN p ON p.user_id = tg.user_id AND p.pointed = tg.pointed)
SELECT user_id, pointed, CASE WHEN NOT outside THEN coalesce(dot, step) END AS value, CASE WHEN outside THEN 'outside' WHEN dot IS NOT NULL THEN 'point' WHEN step IS NOT NULL THEN 'step' ELSE 'none' END AS source FROM r""")
def chart_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value under a pointer at seven times of each user's chart: a point an hour away at most, else the step."""
    from pyspark.sql import Window

    e = event_stream(spark, sf_dir)
    ends = e.groupBy("user_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    v = e.where("event_type <> 'error'").withColumn("next", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    points = v.groupBy("user_id", "t").agg(F.min_by("cents", "event_id").alias("value"))
    steps = v.where("coalesce(next, t + 1) > t").select("user_id", F.col("t").alias("start"), F.coalesce("next", F.lit(MID_MS + 30 * DAY_MS)).alias("stop"), F.col("cents").alias("value"))
    targets = ends.select("user_id", F.explode(F.array(*[F.lit(MID_MS + k * 6 * 3_600_000) for k in (-90, -20, 0, 1, 2, 30, 90)])).alias("at"))
    return readside.readout(targets, points, steps, ends, ["user_id"], 3_600_000).withColumnRenamed("at", "pointed")


@query("change_table", f"""WITH {PRICES_SQL}, {temporal._DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY t DESC) AS place FROM q)
SELECT part, place, strftime(epoch_ms(t), '%Y-%m-%d %H:%M') AS seen, {_MONEY.format('cents', "'USD'")} AS price FROM r""")
def change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All price changes of each part, newest first."""
    from pyspark.sql import Window

    points = changepoints.change_points(daily_prices(spark, sf_dir), ["part"], "t", ["cents"])
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("t").desc())).cast("long")
    return points.select("part", place.alias("place"), readside.time_text(F.col("t")).alias("seen"), readside.price_text(F.lit("exact"), F.col("cents"), F.col("cents"), F.lit("USD")).alias("price"))


@query("statistics_rows", f"""{_CHART}, st AS (SELECT part, arg_max(cents, t) AS current, min(cents) AS low, max(cents) AS high, count(*) AS n_points FROM q GROUP BY part),
ws AS (SELECT part, {', '.join(f"{f}(cents) FILTER (WHERE stop >= {temporal.PRICE_MID_MS} - {n * DAY_MS} AND start <= {temporal.PRICE_MID_MS}) AS {f}_d{n}" for n in (30, 90, 365) for f in ("min", "max"))} FROM l GROUP BY part), sk AS (SELECT part, arg_max(quantity, (t, offer, quantity)) AS stock FROM x GROUP BY part)
SELECT st.part, current, low, high, n_points, min_d30, max_d30, min_d90, max_d90, min_d365, max_d365, stock FROM st LEFT JOIN ws USING (part) LEFT JOIN sk USING (part)""")
def statistics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's figures side by side: current price, range, windows, latest stock."""
    from ..sources.tables import price_stream

    stats = series.segment_stats(daily_prices(spark, sf_dir), ["part"], "t", "cents").select("part", "current", "low", "high", "n_points")
    stock = price_stream(spark, sf_dir).groupBy("part").agg(F.max_by("quantity", F.struct("t", "offer", "quantity")).alias("stock"))
    return stats.join(temporal.window_stats(spark, sf_dir), "part", "left").join(stock, "part", "left")


@query("sales_rows", f"""WITH {EVENTS_SQL}, {temporal._COUNTS}, g AS (SELECT *, CASE WHEN t >= {MID_MS} - {7 * DAY_MS} THEN q - before END AS step FROM f WHERE t <= {MID_MS}),
u AS (SELECT user_id, CAST(coalesce(sum(-step) FILTER (WHERE step < 0), 0) AS BIGINT) AS sold, count(*) FILTER (WHERE step < 0) AS decreases, CAST(coalesce(sum(step) FILTER (WHERE step > 0), 0) AS BIGINT) AS added, count(*) FILTER (WHERE step > 0) AS increases,
bool_or(step < 0 AND before >= 20000) AS at_least, greatest(min(t) FILTER (WHERE q IS NOT NULL), {MID_MS} - {7 * DAY_MS}) AS since FROM g GROUP BY user_id HAVING count(q) > 0)
SELECT user_id, CASE WHEN sold = 0 THEN '0個' WHEN at_least THEN format('{{:,}}', sold) || '個以上' ELSE '約' || format('{{:,}}', sold) || '個' END AS sold, CASE WHEN decreases = 0 THEN '在庫数の減少は記録されていません' ELSE '在庫数の減少 ' || decreases || ' 回' END ||
CASE WHEN increases > 0 THEN ' · 増加 ' || increases || ' 回（+' || format('{{:,}}', added) || '個）' ELSE '' END || CASE WHEN since > {MID_MS - 7 * DAY_MS} THEN ' · 記録は ' || strftime(epoch_ms(since), '%Y-%m-%d') || ' から' ELSE '' END AS details FROM u""")
def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = temporal.estimated_sales(spark, sf_dir)
    details = readside.sales_details(F.col("decreases"), F.col("increases"), F.col("added"), F.col("since"), F.lit(MID_MS - 7 * DAY_MS))
    return s.select("user_id", readside.sold_text(F.col("sold"), F.col("at_least").cast("boolean")).alias("sold"), details.alias("details"))


_REL = """r AS (SELECT 'r' || lpad(p_partkey::VARCHAR, 6, '0') AS id, p_partkey % 50 AS a, (p_partkey * 7 + 3) % 50 + 50 AS b, ['same_product', 'same_product', 'similar_product', 'unresolved'][p_partkey % 4 + 1] AS kind, p_partkey % 4 = 0 AS verified, CASE WHEN p_partkey % 3 > 0 THEN 'f' || p_size % 3 END AS family,
CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 END AS distance, CASE WHEN p_partkey % 7 = 0 THEN []::VARCHAR[] WHEN p_partkey % 2 = 0 THEN ['size: ' || p_size % 4 || ' ↔ 9', 'pins: x ↔ y'] ELSE ['size: 9 ↔ ' || p_size % 4] END AS differences FROM part)"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    size = (s % 4).cast("string")
    differences = F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 2 == 0, F.array(F.concat(F.lit("size: "), size, F.lit(" ↔ 9")), F.lit("pins: x ↔ y"))).otherwise(F.array(F.concat(F.lit("size: 9 ↔ "), size)))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), F.lpad(n.cast("string"), 6, "0")).alias("id"), (n % 50).alias("a"), ((n * 7 + 3) % 50 + 50).alias("b"), pick(["same_product", "same_product", "similar_product", "unresolved"], n % 4).alias("kind"), (n % 4 == 0).alias("verified"),
        F.when(n % 3 > 0, F.concat(F.lit("f"), (s % 3).cast("string"))).alias("family"), F.when(n % 5 > 0, n % 5).alias("distance"), differences.alias("differences"), n.alias("n"),
    )


@query("related_products", f"""WITH {_REL}, e AS (SELECT *, a AS viewer, b AS target, true AS first FROM r UNION ALL SELECT *, b, a, false FROM r), k AS (SELECT *, CASE WHEN kind = 'same_product' AND verified THEN 0 WHEN kind = 'same_product' THEN 1 WHEN kind = 'similar_product' THEN 2 ELSE 3 END AS rank FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY viewer ORDER BY rank, coalesce(distance, len(differences)), id) AS place, ['verified', 'same', 'similar', 'unresolved'][rank + 1] AS grp, CASE WHEN rank = 2 AND family IS NOT NULL AND len(differences) > 0 THEN family || chr(10) || list_aggregate(list_sort(list_transform(differences,
lambda d: split_part(d, ': ', 1) || ': ' || CASE WHEN first THEN split_part(split_part(d, ': ', 2), ' ↔ ', 1) || ' → ' || split_part(d, ' ↔ ', 2) ELSE split_part(d, ' ↔ ', 2) || ' → ' || split_part(split_part(d, ': ', 2), ' ↔ ', 1) END)), 'string_agg', chr(10)) ELSE id END AS key FROM k),
m AS (SELECT *, min(place) OVER (PARTITION BY viewer, grp, key) AS top, min(place) OVER (PARTITION BY viewer, target) AS seen FROM p),
c AS (SELECT *, dense_rank() OVER (PARTITION BY viewer, grp ORDER BY top) AS card, dense_rank() OVER (PARTITION BY viewer ORDER BY seen) <= 8 AS loaded FROM m)
SELECT viewer, target, id, place::INTEGER AS place, grp AS "group", card::INTEGER AS card, card <= 3 AS shown, loaded FROM c""")
def related_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations as each side shows them. Ids have six digits, so beyond 999,999 parts some are the same; those stand in the order of their parts."""
    return readside.related(_relations(spark, sf_dir), ["n"])


@query("relation_drift", f"""WITH {_REL}, d AS (SELECT id, a, CASE a % 4 WHEN 0 THEN ' Part   ' || a || ' ' WHEN 1 THEN 'other' ELSE 'part ' || a END AS name, CASE WHEN a % 6 = 5 THEN NULL ELSE 'M-' || a END AS model, a % 9 = 8 AS suspicious, CASE WHEN b % 3 = 0 THEN NULL ELSE b % 2 END AS own FROM r)
SELECT id, NOT (a % 4 <> 1 AND a % 6 <> 5 AND NOT suspicious) AS drifted, own IS NULL OR own = 0 AS kept FROM d""")
def relation_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose product is no longer as it was reviewed, and those that belong to the shown offer."""
    a, b = F.col("a"), F.col("b")
    t = a.cast("string")
    name = F.when(a % 4 == 0, F.concat(F.lit(" Part   "), t, F.lit(" "))).when(a % 4 == 1, "other").otherwise(F.concat(F.lit("part "), t))
    r = _relations(spark, sf_dir).withColumns({"name": name, "model": F.when(a % 6 != 5, F.concat(F.lit("M-"), t)), "suspicious": a % 9 == 8, "own_offer": F.when(b % 3 != 0, (b % 2).cast("string")), "own_sku": F.when(b % 3 != 0, F.lit("k")), "shown": F.lit("0"), "sku": F.lit("k")})
    drifted = readside.has_drifted(F.array(F.concat(F.lit("PART "), t), F.lit("old name")), F.array(F.concat(F.lit("m-"), t)), F.col("name"), F.col("model"), F.col("suspicious"))
    return r.select("id", drifted.alias("drifted"), readside.of_offer(F.col("shown"), F.col("sku")).alias("kept"))


@query("shown_offers", f"""WITH {PRICES_SQL}, o AS (SELECT part, offer, max(run) AS last, max(run) >= {2001 * 12 + 6} AS present, min(t) AS first_t, count(*) AS n FROM x GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY offer = part % 100 DESC, present DESC, CASE WHEN NOT present THEN -last END, offer) AS i FROM o),
g AS (SELECT part, offer, run % 12 AS basis, run % 12 = 6 AS prim, max(t) AS seen FROM x GROUP BY ALL), b AS (SELECT part, offer, arg_min(basis, (CASE WHEN prim THEN 0 ELSE 1 END, basis)) AS basis FROM g GROUP BY 1, 2) SELECT k.part, k.offer, k.present, b.basis FROM k JOIN b ON b.part = k.part AND b.offer = k.offer WHERE i = 1""")
def shown_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offer that a part's page shows, with its primary quote: segments are months here, June the primary one."""
    from ..sources.tables import price_stream

    x = price_stream(spark, sf_dir)
    offers = x.groupBy("part", "offer").agg(F.max("run").alias("last_present"), (F.max("run") >= 2001 * 12 + 6).alias("present")).withColumn("selected", F.col("part") % 100)
    segments = x.select("part", "offer", (F.col("run") % 12).alias("basis")).distinct().withColumns({"primary": F.col("basis") == 6, "place": F.col("basis")})
    return readside.primary_quote(readside.shown_offer(offers, ["part"], "selected"), segments, ["part", "offer"]).select("part", "offer", "present", "basis")


@query("inventory_caps", f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, greatest(t, {MID_MS} - {7 * DAY_MS}) AS from_t, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), {MID_MS}), {MID_MS}) AS to_t, CASE WHEN event_type <> 'error' THEN cents END AS cents FROM e),
c AS (SELECT DISTINCT user_id, (2000 + user_id % 3 * 1000) || '+' AS cap FROM s WHERE cents IS NOT NULL AND from_t < to_t AND cents >= 2000 + user_id % 3 * 1000) SELECT user_id, string_agg(cap, ',' ORDER BY cap) AS caps FROM c GROUP BY user_id""")
def inventory_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = temporal.stock_steps(spark, sf_dir).withColumnsRenamed({"cents": "value"}).withColumn("cap", 2000 + F.col("user_id") % 3 * 1000)
    return readside.cap_notes(steps, ["user_id"], "cap").select("user_id", F.array_join("caps", ",").alias("caps"))


@query("home_prices", """WITH b AS (SELECT c_custkey, ['JPY', 'USD', 'GBP', 'CHF'][c_nationkey % 4 + 1] AS currency, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS low FROM customer), h AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN low + 250 ELSE low END AS high, CASE currency WHEN 'USD' THEN 151.25::DOUBLE WHEN 'GBP' THEN 190.5::DOUBLE END AS rate FROM b)
SELECT c_custkey, CASE WHEN currency = 'JPY' THEN low ELSE CAST(floor(low / pow(10, 2) * rate * (1 + 1.6 / 100) + 0.5) AS BIGINT) END AS home_low, CASE WHEN currency = 'JPY' THEN high ELSE CAST(floor(high / pow(10, 2) * rate * (1 + 1.6 / 100) + 0.5) AS BIGINT) END AS home_high, currency <> 'JPY' AND rate IS NOT NULL AS converted FROM h""")
def home_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = F.element_at(F.array(*map(F.lit, ("JPY", "USD", "GBP", "CHF"))), F.col("c_nationkey") % 4 + 1)
    c = table(spark, sf_dir, "customer").select("c_custkey", currency.alias("currency"), cents("c_acctbal").alias("low"))
    c = c.withColumn("high", F.when(F.col("c_custkey") % 2 == 0, F.col("low") + 250).otherwise(F.col("low")))
    rates = spark.createDataFrame([("USD", 151.25), ("GBP", 190.5)], "currency string, rate double")
    return readside.home_amounts(c, rates, 1.6).select("c_custkey", "home_low", "home_high", "converted")


@query("settings", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'auto' WHEN c_custkey % 3 = 0 THEN 'dark' WHEN c_custkey % 3 = 1 THEN 'light' ELSE 'auto' END AS theme, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 50 > 40 OR c_custkey % 4 = 1 THEN 0.0::DOUBLE ELSE (c_custkey % 50) / 4.0::DOUBLE END AS fee,
CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 < 3 THEN [30, 90, 365][c_custkey % 5 + 1] ELSE 90 END AS days, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE 150.0::DOUBLE / (1 + c_custkey % 4) END AS usd FROM customer""")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored preferences and a rate service's answers, both as text with faults, read part by part."""
    n = F.col("c_custkey")
    fee = F.when(n % 4 == 1, "1.234").otherwise(((n % 50) / 4.0).cast("string"))
    text = F.when(n % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"theme":"'), F.when(n % 3 == 0, "dark").when(n % 3 == 1, "light").otherwise("pink"), F.lit('","fee":'), fee, F.lit(',"days":'), F.when(n % 5 == 0, "30").when(n % 5 == 1, "90").when(n % 5 == 2, "365").otherwise("7"), F.lit("}")))
    rates = F.concat(F.lit('{"result":"'), F.when(n % 6 == 0, "error").otherwise("success"), F.lit('","base_code":"'), F.when(n % 11 == 0, "USD").otherwise("EUR"), F.lit('","time_last_update_unix":1,"rates":{"JPY":150,"USD":'), (1 + n % 4).cast("string"), F.lit(',"XXX":0}}'))
    c = table(spark, sf_dir, "customer").select("c_custkey", readside.preferences(text).alias("p"), readside.cross_rates(rates, "EUR", "JPY").alias("r"))
    return c.select("c_custkey", "p.*", F.try_element_at("r", F.lit("USD")).alias("usd"))
