"""Exact top-k search by integer inner product: term-at-a-time accumulation of every query against every row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Bytes of vectors in a block of rows and of queries, and rows at most; blocks bound the memory of a task, and every query block meets every row block.
ROW_BYTES, QUERY_BYTES, ROWS, QUERIES = 64 << 20, 32 << 20, 65_536, 16_384
#: Query rows scored at a time: a dense score array of ROUND by ROWS numbers.
ROUND = 64
SCORES = "query_id long, query_key long, vec_id long, score long, over string"


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only, in doubles."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(F.col(vec).isNotNull()).where(~F.coalesce(bad, F.lit(False)))


def _postings(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, weight) of the components that are not zero; a term is a position in the vector. Weights above 2^53 become Python integers."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.diff(np.asarray(col.offsets))
    x = np.asarray(col.flatten().cast(pa.float64()))
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(x) and np.abs(x).max() >= 2.0**43:
        weight = np.array([int(v) * 1024 if abs(v) >= 2.0**53 else math.floor(v * 1024) for v in x.tolist()], dtype=object)  # above 2^53 there is no fraction
    else:
        weight = np.floor(x * 1024).astype(np.int64)
    there = weight != 0
    return term[there], row[there], weight[there]


def beyond(score: int) -> str:
    """Text by which scores order that 64 bits can't hold, and 1 for all others: more digits or higher ones rank later if positive, earlier if negative."""
    if -(2**63) <= score < 2**63:
        return "1"
    size, digits = f"{len(hex(abs(score))):04d}", hex(abs(score))[2:]
    if score > 0:
        return f"2{size}{digits}"
    turned = str.maketrans("0123456789abcdef", "fedcba9876543210")
    return "0" + "".join(str(9 - int(c)) for c in size) + digits.translate(turned) + "g"


def _safe(q: np.ndarray, c: np.ndarray, terms: int) -> bool:
    if q.dtype == object or c.dtype == object:
        return False
    top = lambda x: int(np.abs(x).max()) if len(x) else 0
    return top(q) * top(c) * max(terms, 1) < 2**62


def score_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of this block for each query of it, ties to the smaller vec_id; rows with the query's own vec_id take no part."""
    qt, qr, qw = _postings(queries["embedding"])
    ct, cr, cw = _postings(rows["embedding"])
    ids = np.asarray(rows["vec_id"].cast(pa.int64()))
    by_id = np.argsort(ids, kind="stable")  # columns of the score array in order of vec_id, so that ties are kept in it
    place = np.empty(len(ids), dtype=np.int64)
    place[by_id] = np.arange(len(ids))
    ids, cr = ids[by_id], place[cr]
    order = np.argsort(ct, kind="stable")
    ct, cr, cw = ct[order], cr[order], cw[order]
    terms = int(ct[-1]) + 1 if len(ct) else 0
    lists = np.searchsorted(ct, np.arange(terms + 1))
    kind = np.int64 if _safe(qw, cw, terms) else object
    qid = np.asarray(queries["vec_id"].cast(pa.int64()))
    qkey = np.asarray(queries["query_key"])
    out: list[tuple] = []
    for a in range(0, len(qid), ROUND):
        b = min(a + ROUND, len(qid))
        scores = np.zeros((b - a, len(ids)), dtype=kind)
        here = (qr >= a) & (qr < b)
        t, r, w = qt[here], qr[here] - a, qw[here].astype(kind)
        by_term = np.argsort(t, kind="stable")
        t, r, w = t[by_term], r[by_term], w[by_term]
        cut = np.searchsorted(t, np.arange(terms + 1))
        for term in range(terms):
            lo, hi, x, y = cut[term], cut[term + 1], lists[term], lists[term + 1]
            if lo == hi or x == y:
                continue
            weights = cw[x:y].astype(kind)
            if hi - lo == b - a and y - x == len(ids):  # every query and row has this term, each once and in order
                dense = np.empty(len(ids), dtype=kind)
                dense[cr[x:y]] = weights
                col = np.empty(b - a, dtype=kind)
                col[r[lo:hi]] = w[lo:hi]
                scores += col[:, None] * dense[None, :]
            else:
                for q, v in zip(r[lo:hi], w[lo:hi]):
                    scores[q, cr[x:y]] += v * weights
        for q in range(b - a):
            s = scores[q]
            own = ids == qid[a + q]
            found = np.nonzero(~own)[0]
            if len(found) > k:
                if kind is object:
                    found = found[np.argsort([-v for v in s[found]], kind="stable")[:k]]
                else:
                    v = s[found]
                    least = np.partition(v, len(v) - k)[len(v) - k]
                    above = found[v > least]
                    found = np.concatenate([above, found[v == least][: k - len(above)]])
            for i in found:
                out.append((int(qid[a + q]), int(qkey[a + q]), int(ids[i]), max(min(int(s[i]), 2**63 - 1), -(2**63)), beyond(int(s[i]))))
    cols = list(zip(*out)) if out else [[]] * 5
    return pa.table([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["query_id", "query_key", "vec_id", "score", "over"])


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, the k other rows with the highest inner product.

    Components count as floor(1024 * x). Vectors that are null or hold null or non-finite components take no part; one shorter than another lacks its last
    terms; an empty one scores 0. Rows with a null vec_id take no part. Rows that repeat a query's vec_id are the query's own; equal query rows are one query,
    different ones with one vec_id are merged under that id. Scores beyond 64 bits are ranked by their whole value and shown as the nearest long.

    Rows and queries are dealt into blocks by hash, as large as a task's memory allows; a grid of block pairs shares the work, so that n rows move once for
    each QUERY_BYTES of queries and queries once for each ROW_BYTES of rows. The blocks' winners are few (k for each query and block) and are merged by a
    window over each query, of which Spark keeps k rows a task before the shuffle.
    """
    rows = usable(vectors).where("vec_id is not null").select(F.col("vec_id").cast("long"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
    wide = F.size("embedding").cast("long") * 8
    query = F.col("vec_id") % every == 0
    c = rows.agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q"), F.coalesce(F.sum(wide), F.lit(0)).alias("rb"), F.coalesce(F.sum(F.when(query, wide)), F.lit(0)).alias("qb")).first()
    parallel = vectors.sparkSession.sparkContext.defaultParallelism * 2
    nr = max(-(-c["n"] // ROWS), -(-c["rb"] // ROW_BYTES), min(parallel, -(-c["n"] // 512)), 1)
    nq = max(-(-c["q"] // QUERIES), -(-c["qb"] // QUERY_BYTES), 1)
    key = F.xxhash64("vec_id", "embedding")
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("query_key", key).dropDuplicates(["vec_id", "query_key"])
    queries = queries.withColumn("qb", F.pmod(F.hash("query_key"), F.lit(nq))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    rows = rows.withColumn("rb", F.pmod(F.hash("vec_id", F.monotonically_increasing_id()), F.lit(nr))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    best = queries.groupBy("rb", "qb").cogroup(rows.groupBy("rb", "qb")).applyInArrow(lambda q, r: score_block(q, r, k), SCORES)
    w = Window.partitionBy("query_id").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id", "query_key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other rows of `embeddings` for each row whose vec_id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
