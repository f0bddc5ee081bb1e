"""Relation graphs and covers: components by repeated contraction, gains of a greedy cover, rotation slices."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import fnv1a

#: Links of a node that one task joins; a node with more is split. Hubs that may be broadcast.
HUB, BROADCAST_HUBS = 100_000, 1_000_000
#: Groups of a cover that one step looks at, and their uncovered items, at most.
STEP_GROUPS, STEP_ITEMS = 10_000, 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; sets one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares; it goes when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes a table in the folder that the cluster shares, once, and reads it. A lost executor's share is read again, not made again."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_to_least(edges: DataFrame, links: int) -> DataFrame:
    """(u, v, m): edges (u, v), of which there are `links` at most, each with the least of u's neighbours.

    A hub is split: a node of more than HUB links counts as so many nodes of at most about HUB links each, told apart by the hash of the other end, and its least
    neighbour is repeated for each of them. How many links a node has is counted with the minimum; hubs are as many as the links divided by HUB at most.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    found = 0
    if links > HUB:
        hubs = cut(least.where(F.col("n") > HUB).select("u", F.ceil(F.col("n") / HUB).cast("int").alias("k")))
        found = hubs.count()
    least = least.select("u", "m")
    if not found:
        return edges.join(least, "u")
    hubs = F.broadcast(hubs) if found <= BROADCAST_HUBS else hubs
    k = F.coalesce("k", F.lit(1))
    dealt = edges.join(hubs, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), k).cast("int")).drop("k")
    least = least.join(hubs, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0), k - 1))).drop("k")
    return dealt.join(least, ["u", "part"]).drop("part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): components of an undirected graph, each named by its least node.

    Large-star and small-star steps in turn: every node's larger, then its smaller neighbours are linked to the least one around it, until nothing changes. Both
    are a minimum (combined before the shuffle) and a join back, in which hubs are split; the rounds grow with the logarithm of the graph's size, and each writes
    the links once. The end is seen by their number and the exclusive or of their hashes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    e = cut(e.where("u <> v").distinct())
    sign = lambda: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    before = sign()
    while True:
        links = 2 * before[0]
        both = joined_to_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), links)
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = joined_to_least(large, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct()
        e = cut(small)
        now = sign()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cover_gains(membership: DataFrame, covered: DataFrame, cost: DataFrame, group: str, item: str) -> DataFrame:
    """(group, gain, cost, score): how many uncovered items each group has, and that by its cost; groups that add nothing are left out."""
    left = membership.select(group, item).distinct().join(covered.select(item).distinct(), item, "left_anti")
    gains = left.groupBy(group).agg(F.count("*").alias("gain")).join(cost, group)
    return gains.select(group, "gain", "cost", (F.col("gain") / F.col("cost")).alias("score"))


def greedy_cover(spark: SparkSession, membership: DataFrame, cost: DataFrame, group: str, item: str, rounds: int | None = None, stable: Column | None = None) -> DataFrame:
    """(round, group, gain): a greedy cover's picks by gain for cost until no group has a gain, or the first `rounds`; ties go to more gain, then to the lesser group.

    With `stable`, a condition on cost's columns, those groups cover all that they can before any other is picked.

    Gains only shrink, so what a group gains now bounds what it gains later. Each step takes the groups that come first, as far as their items stay within
    STEP_ITEMS, and picks among them for as long as the best comes before the first group that was not taken. Groups of the two pools share no item: the second has
    only what no stable group holds. Only the keys of a step's groups and the picks, which are the plan, leave the cluster.
    """
    pools = cost.select(group, F.col("cost").cast("double").alias("cost"), (F.lit(True) if stable is None else F.coalesce(stable, F.lit(False))).alias("__s"))
    left = membership.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull()).distinct().join(pools, group)
    if stable is not None:
        first = left.where("__s").select(item).distinct()
        left = left.where("__s").unionByName(left.where("not __s").join(first, item, "left_anti").select(left.columns))
    left, picks, kind = cut(left), [], membership.schema[group].dataType.simpleString()
    key = F.struct(F.expr("not __s").alias("s"), (-F.col("gain") / F.col("cost")).alias("o"), (-F.col("gain")).alias("n"), F.col(group).alias("g"))
    while True:
        keys = left.groupBy(group, "cost", "__s").agg(F.count("*").alias("gain")).select(key.alias("k")).orderBy("k").limit(STEP_GROUPS + 1)
        keys = [tuple(r.k) for r in keys.collect()]
        if not keys:
            break
        size = np.cumsum([-k[2] for k in keys])
        many = min(int(np.searchsorted(size, STEP_ITEMS, side="right")), STEP_GROUPS)
        won = keys[:1]  # a group larger than a step comes first all the same
        if many > 1:
            taken = F.broadcast(spark.createDataFrame([(k[3],) for k in keys[:many]], f"{group} {kind}"))
            step = left.join(taken, group).select("__s", "cost", F.col(group).alias("g"), F.col(item).alias("i"))
            bound = keys[many] if many < len(keys) else None
            won = [tuple(r) for r in step.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda x: _greedy_step(x, bound), f"s boolean, o double, n long, g {kind}").collect()]
        picks += won
        here = F.broadcast(spark.createDataFrame([(k[3],) for k in won], f"{group} {kind}"))
        left = cut(left.join(left.join(here, group).select(item).distinct(), item, "left_anti").select(left.columns))
    schema = f"round int, {group} {kind}, gain long"
    return spark.createDataFrame([(i + 1, g, -n) for i, (_, _, n, g) in enumerate(sorted(picks)[:rounds])], schema)


def _greedy_step(rows: pd.DataFrame, bound: tuple | None) -> pd.DataFrame:
    """(s, o, n, g): picks in their order among groups (__s, cost, g) of items i, before the first whose key doesn't come before `bound`."""
    item, _ = pd.factorize(rows["i"])
    groups = rows.groupby("g", sort=False).indices
    s, cost = ~rows["__s"].to_numpy(dtype=bool), rows["cost"].to_numpy()
    key = lambda g, n: (bool(s[groups[g][0]]), -n / cost[groups[g][0]], -n, g)
    heap = [key(g, len(at)) for g, at in groups.items()]
    heapq.heapify(heap)
    covered, out = np.zeros(len(rows), dtype=bool), []
    while heap:
        best = heapq.heappop(heap)
        mine = item[groups[best[3]]]
        n = int((~covered[mine]).sum())
        if n < -best[2]:  # others took some of its items since
            if n:
                heapq.heappush(heap, key(best[3], n))
            continue
        if bound is not None and best >= bound:
            break
        covered[mine] = True
        out.append(best)
    return pd.DataFrame(out, columns=["s", "o", "n", "g"])


def rotation_slice(keys: DataFrame, key: str, round_: int, shards: int, cap: int) -> DataFrame:
    """The keys of a round's shard, in an order that changes with the round, at most `cap` of them."""
    h = fnv1a(F.col(key))
    order = fnv1a(F.concat(F.lit(f"{round_}:"), F.col(key)))
    return keys.withColumns({"hash": h, "__o": order}).where(F.col("hash") % shards == round_ % shards).orderBy("__o", key).limit(cap).drop("__o")


def fill_shards(counts: dict[int, int], shards: int) -> dict[int, list[tuple[int, int, int]]]:
    """{weight: [(first rank, number, shard)]}: heaviest first, each to the shard with least load, the lowest of equals. Those of one weight are dealt at once: up to
    the highest level that they fill evenly, then one by one."""
    load, out = [0] * shards, {}
    for w in sorted(counts, reverse=True):
        left, low, high = counts[w], min(load), max(load) + w * counts[w]
        room = lambda level: [max(0, (level - x) // w) for x in load]
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sum(room(mid)) <= left else (low, mid - 1)
        take = room(low)
        for i in range(shards):
            load[i] += take[i] * w
        for _ in range(left - sum(take)):
            i = min(range(shards), key=lambda j: (load[j], j))
            load[i] += w
            take[i] += 1
        at, out[w] = 0, []
        for i, k in enumerate(take):
            if k:
                out[w].append((at, k, i))
                at += k
    return out
