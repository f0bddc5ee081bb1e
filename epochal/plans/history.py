"""The write path: snapshots into a versioned state of observations, series and a published dataset out of it.

State is a folder of files by table, version and writer. A version adds files and never touches older ones or another writer's; a manifest of its own, written last,
lists the files that count, and the latest manifest that is whole is the state. So an import writes what it brings, whatever the history, a run that fails at any
point leaves the state as it was, and of two writers of one version the second fails without harm to the first. Series are never updated in place: they are what change_points gives over all observations, so the order of imports and repeated ones do not matter.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY_MS
from ..operators import changepoints, digests, graph, imports, intervals
from ..sources import snapshots as S
from ..sources.tables import spread

FORMAT = 2


@dataclass
class Report:
    """What a run did, stage by stage; the first stage that fails ends it."""

    stages: list[dict] = field(default_factory=list)
    outcome: str = "ok"

    def exit_code(self) -> int:
        return {"ok": 0, "failed": 2, "quarantined": 3}[self.outcome]

    def markdown(self) -> str:
        rows = "\n".join(f"| {s['name']} | {s['status']} | {s.get('detail', '')} |" for s in self.stages)
        return f"**{self.outcome}**\n\n| stage | status | detail |\n|---|---|---|\n{rows}"


class State:
    """Observations of all imports, by version under one folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def acquire(cls, spark: SparkSession, root: str, bootstrap: bool = False) -> State:
        """The state to go on from. It starts anew only if that is asked for and there is none: a state that can't be found is never taken for an empty one."""
        state = cls(spark, root)
        if bootstrap == (state.manifest() is not None):
            raise ValueError("there is a state already" if bootstrap else "there is no state; a first run must say so")
        return state

    def manifests(self) -> list[str]:
        """Names of all manifests, the latest first, whole or not."""
        path = self.fs_path(f"{self.root}/manifests")
        if not self.fs.exists(path):
            return []
        return sorted((n for f in self.fs.listStatus(path) if (n := f.getPath().getName()).endswith(".json")), reverse=True)

    def manifest(self) -> dict | None:
        """The latest whole manifest: one that was cut off while it was written doesn't read as JSON and doesn't count."""
        for name in self.manifests():
            try:
                found = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{name}").collect()))
            except ValueError:
                continue
            if found["format"] > FORMAT:
                raise ValueError("the state was written by a newer version")
            return found
        return None

    def read(self, table: str, versions: list[int] | None = None) -> DataFrame | None:
        """A table's rows of all versions that count, or of some of them."""
        m = self.manifest()
        have = [p for p in (m or {"parts": {}})["parts"].get(table, []) if versions is None or int(p[1:9]) in versions]
        return self.spark.read.parquet(*[f"{self.root}/{table}/{p}" for p in have]) if have else None

    def commit(self, tables: dict[str, DataFrame], runs: list[dict] | None = None, replace: tuple[str, ...] = ()) -> dict:
        """Adds files for each table, reads back how many rows they have, then writes the manifest that lists them. Tables in `replace` are their new files alone.

        The version is above that of every manifest, one that was cut off included, whose name stays taken. Files carry the writer's own mark besides."""
        old = self.manifest() or {"format": FORMAT, "version": 0, "parts": {}, "rows": {}, "runs": []}
        version = max([old["version"], *(int(n.removesuffix(".json")) for n in self.manifests())]) + 1
        part = f"v{version:08d}-{uuid.uuid4().hex}"
        parts, rows = {t: list(v) for t, v in old["parts"].items()}, {t: dict(v) for t, v in old["rows"].items()}
        for name, df in tables.items():
            path = f"{self.root}/{name}/{part}"
            df.write.parquet(path)
            if name in replace:
                parts[name], rows[name] = [], {}
            parts.setdefault(name, []).append(part)
            rows.setdefault(name, {})[part] = self.spark.read.parquet(path).count()
        manifest = {"format": FORMAT, "version": version, "parts": parts, "rows": rows, "runs": old["runs"] + [r | {"version": version} for r in runs or []]}
        out = self.fs.create(self.fs_path(f"{self.root}/manifests/{version:08d}.json"), False)  # another writer of this version makes it fail
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return manifest

    def verify(self) -> list[str]:
        """Tables whose files have not as many rows as the manifest says."""
        m = self.manifest() or {"rows": {}}
        return [t for t, rows in m["rows"].items() if rows and self.read(t).count() != sum(rows.values())]

    def migrate(self) -> tuple[int, int]:
        """(format before, format now): applies each step between an older state's format and this one's, a version each."""
        m = self.manifest()
        before = FORMAT if m is None else m["format"]
        for step in range(before, FORMAT):
            tables = MIGRATIONS[step](self)
            self.commit(tables, replace=tuple(tables))
        return before, FORMAT


def offer_attributes(prices: DataFrame) -> DataFrame:
    """(store, product, offer, first_seen, last_seen): when each offer's attributes were observed, from all observations."""
    return prices.groupBy("store", "product", "offer").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


#: From each format to the next: the tables that the step (re)writes. Format 1 had no table of offers; it is filled from what was observed.
MIGRATIONS = {1: lambda state: {} if state.read("prices") is None else {"offers": offer_attributes(state.read("prices"))}}


def check(snapshot: DataFrame, before: DataFrame | None) -> list[str]:
    """Reasons not to import a snapshot (one row): incomplete, empty, unsafe or repeated keys, wrong prices, or too far from the run before."""
    p = snapshot.select("complete", F.explode_outer("products").alias("p"))
    quotes = F.flatten(F.transform("p.offers", lambda o: o["priceQuotes"]))
    key = F.col("p.pageKey")
    p = p.select(  # what is counted alone: counts of distinct values repeat their rows
        "complete", F.when(F.col("p").isNotNull(), 1).alias("p"), F.col("p.externalProductId").alias("id"), key.alias("page"),
        F.when(F.col("p").isNotNull() & ~F.coalesce(key.rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~key.startswith(".."), F.lit(False)), 1).otherwise(0).alias("unsafe"),
        F.when(F.exists(quotes, lambda q: ~S.is_valid_price(q)), 1).otherwise(0).alias("prices"),
    )
    r = p.agg(F.min("complete").alias("complete"), F.count("p").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("page").alias("pages"), F.sum("unsafe").alias("unsafe"), F.sum("prices").alias("prices")).first()
    out = [name for name, bad in (("incomplete", not r.complete), ("empty", r.n == 0), ("repeated id", r.ids < r.n), ("repeated page", r.pages < r.n), ("unsafe key", r.unsafe), ("invalid price", r.prices)) if bad]
    if before is not None and not out:
        c = imports.compare_runs(before, primary_prices(S.observations(snapshot)), ["product"], "price").first()
        out += [name for name in ("drop", "missing", "price", "unavailable") if c[f"{name}_error"]]
    return out


def primary_prices(obs: DataFrame) -> DataFrame:
    """(product, price): basis and amounts of the least offer's least basis."""
    price = F.when(F.col("state") != "unavailable", F.concat_ws(":", "basis", "state", "low", "high"))
    return obs.groupBy("product").agg(F.min_by(price, F.struct("offer", "basis")).alias("price"))


def dealt(snapshot: DataFrame) -> DataFrame:
    """A snapshot as rows of one product each, dealt over the cluster and written once: it may be one file, and checks and tables read it time and again."""
    rows = snapshot.withColumn("__p", F.explode_outer("products"))
    return graph.cut(spread(rows.withColumn("products", F.when(F.col("__p").isNotNull(), F.array("__p"))).drop("__p")))


def import_snapshot(state: State, snapshot: DataFrame) -> Report:
    """Validates one snapshot against the latest run of its shop and adds its observations; one that fails is kept out and noted.

    A large snapshot may come as several rows, each with some of its products.
    """
    report = Report()
    spark = state.spark
    run = snapshot.select(F.col("storeId").alias("store"), S_time().alias("t"), "normalizedHash").distinct()
    this = run.first()
    known = [r for r in (state.manifest() or {"runs": []})["runs"] if r["store"] == this.store]
    if same := next((r for r in known if r["t"] == this.t), None):
        if same["hash"] != this.normalizedHash:
            report.outcome = "failed"
            report.stages.append({"name": "import", "status": "failed", "detail": "another snapshot of this time is known"})
        else:
            report.stages.append({"name": "import", "status": "skipped", "detail": "known already"})
        return report
    snapshot = dealt(snapshot)
    obs, stock = S.observations(snapshot), S.stock_observations(snapshot)
    before = None
    if known:
        last = max(known, key=lambda r: r["t"])
        before = primary_prices(state.read("prices", [last["version"]]))  # the files of that run alone
    reasons = check(snapshot, before)
    report.stages.append({"name": "validate", "status": "failed" if reasons else "ok", "detail": ", ".join(reasons)})
    if reasons:
        manifest = state.commit({"rejected": spark.createDataFrame([(this.store, this.t, ", ".join(reasons))], "store string, t long, reason string")})
    else:
        manifest = state.commit({"runs": spark.createDataFrame([this], run.schema), "prices": obs, "stock": stock, "offers": offer_attributes(obs)}, [{"store": this.store, "t": this.t, "hash": this.normalizedHash}])
    report.outcome = "quarantined" if reasons else "ok"
    report.stages.append({"name": "import", "status": "skipped" if reasons else "ok", "detail": f"version {manifest['version']}"})
    return report


def S_time() -> Column:
    from ..functions.times import parse_iso

    return parse_iso(F.col("observedAt"))


def price_series(state: State) -> DataFrame:
    """(store, product, offer, basis, t, state, low, high): price change points of every segment."""
    return changepoints.change_points(state.read("prices"), ["store", "product", "offer", "basis"], "t", ["state", "low", "high"])


def inventory_series(state: State) -> DataFrame:
    """Change points of counts that were read."""
    return changepoints.change_points(state.read("stock").where("not unobserved"), ["store", "product", "offer"], "t", ["quantity"])


def segment_presence(state: State) -> DataFrame:
    """(store, product, offer, basis, t, present): segments over the runs of their shop; runs are numbered by time within it."""
    from pyspark.sql import Window

    w = Window.partitionBy("store").orderBy("t")
    runs = state.read("runs").select("store", "t").distinct().withColumn("run", F.row_number().over(w))
    seen = state.read("prices").select("store", "product", "offer", "basis", "t").distinct().join(runs, ["store", "t"])
    points = changepoints.presence_points(seen, ["store", "product", "offer", "basis"], "run", 1 << 30)
    return points.join(runs, ["store", "run"]).drop("run")


def published(state: State) -> DataFrame:
    """A row a product, nested as readers take it: offers, their segments with points, presence and statistics of 30, 90 and 365 days; and the dataset's version."""
    segment = ["store", "product", "offer", "basis"]
    latest = state.read("runs").groupBy("store").agg(F.max("t").alias("latest"), F.substring(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "t", "normalizedHash")))), 256), 1, 16).alias("version"))
    points, presence = price_series(state), segment_presence(state)
    ends = points.join(latest.select("store", "latest"), "store")
    spans = intervals.listed_spans(points, presence, segment, "t", ["low", "high"], F.lit(1 << 60)).join(latest.select("store", "latest"), "store")
    aggs = []
    for days in (30, 90, 365):
        inside = (F.col("stop") >= F.col("latest") - days * DAY_MS) & (F.col("start") <= F.col("latest"))
        aggs += [F.min(F.when(inside, F.col("low"))).alias(f"min_d{days}"), F.max(F.when(inside, F.col("high"))).alias(f"max_d{days}")]
    stats = spans.groupBy(*segment).agg(*aggs)
    series = ends.groupBy(*segment).agg(F.array_sort(F.collect_list(F.struct("t", "state", "low", "high"))).alias("prices"), F.max_by(F.struct("state", "low", "high"), "t").alias("current"))
    shown = presence.groupBy(*segment).agg(F.array_sort(F.collect_list(F.struct("t", "present"))).alias("presence"))
    rows = series.join(shown, segment).join(stats, segment, "left")
    columns = [c for c in rows.columns if c not in ("store", "product", "offer")]
    offers = rows.groupBy("store", "product", "offer").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("segments"))
    products = offers.groupBy("store", "product").agg(F.array_sort(F.collect_list(F.struct("offer", "segments"))).alias("offers"))
    return products.join(latest, "store")


def publish(state: State, path: str) -> dict:
    """Writes the dataset by store as JSON and checks what was written: as many products, one version a store, and the same products as the state gives, by digests
    that do not depend on order, so that no product is joined with its copy."""
    out = published(state)
    out.write.mode("overwrite").partitionBy("store").json(path, compression="gzip")
    back = state.spark.read.schema(out.schema).json(path)
    found = back.groupBy("store").agg(F.count("*").alias("products"), F.count_distinct("version").alias("versions"), F.count_distinct("product").alias("ids"))
    texts = lambda df: df.select("store", F.to_json(F.struct(*[c for c in out.columns if c != "store"])).alias("text"))
    wrong = {r.store for r in digests.disagreements(texts(out), texts(back), ["store"], ["text"]).collect()}  # a row a store
    return {r.store: {"products": r.products, "ok": r.versions == 1 and r.ids == r.products and r.store not in wrong} for r in found.collect()}
