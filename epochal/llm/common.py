"""What several operators share: tables, scratch tables in the shared folder, hashing kernels and connected components."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP = 1 << 20
#: Ids (8 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """docs without columns whose names start with two underscores: those names are the operators' own."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__")])


LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc_sql(digits: str) -> str:
    """The unsigned CRC-32 in SQL of bytes given as hex digits: a byte at a time, with the table of its polynomial made here."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    one = f"list_transform(range(1, length({digits}), 2), lambda i: CAST('0x' || substr({digits}, i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {one}), lambda c, b: xor(c >> 8, list_extract(CAST({table} AS BIGINT[]), (xor(c, b) & 255) + 1))), 4294967295)"


class Scratch:
    """Tables written to the folder in spark.checkpoint.dir, which all executors share.

    They cut lineage: a lost executor recomputes from them. Results may read them until the application ends, which deletes the folder. Where the setting is unset
    (tests), a folder beside the warehouse is used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.root = f"{base.rstrip('/')}/epochal-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self) -> None:
        """Lets Spark delete the shuffles and broadcasts of finished steps, which it does once the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def salted_left_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str], salts: int = SALTS) -> DataFrame:
    """left join of a side with hot keys: its rows of a key are dealt over `salts` tasks by `salt_by`; the other side has one row a key and is repeated."""
    s = "__salt"
    left = left.withColumn(s, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, s], "left").drop(s)  # its size after repeating is not what a planner sees


def keep_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join by an id column; ids are broadcast only where a count shows that there are at most `limit`."""
    few = ids.count() <= limit
    return df.join(F.broadcast(ids) if few else ids, key, how)


# ---- hashing kernels -------------------------------------------------------------------------------------------------

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    have = _POW.get(0)
    if have is None or len(have) < n:
        m = max(n, 2 * STEP)
        for k, r in ((0, _R), (1, _RINV)):
            p = np.full(m, r, dtype=np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of value(buf[j]) r^j over j < i, modulo 2^64."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end], the same wherever the bytes stand."""
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts in them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def steps(off: np.ndarray, size: int = STEP):
    """Row ranges [a, b) of about `size` bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | np.uint8(32), buf)


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word `[^\\x20\\x09-\\x0D]+`; a word never crosses rows."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    ink = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    start = np.nonzero(ink & (np.concatenate([[True], ~ink[:-1]]) | first[:n]))[0]
    end = np.nonzero(ink & (np.concatenate([~ink[1:], [True]]) | first[1:]))[0] + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


_C = mix(np.arange(11, 27, dtype=np.uint64)) | np.uint64(1)


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of the distinct k-word shingles of each row, sorted by row, then hash; a row of fewer words has its whole sequence as one."""
    low = lower_ascii(buf)
    start, end, row = words_of(low, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = range_hash(prefix_hashes(low), start, end)
    rows, hashes = [], []
    m = len(w) - k + 1
    if m > 0:
        full = row[:m] == row[k - 1 :]
        acc = w[:m] * _C[0]
        for j in range(1, k):
            acc = acc + w[j : j + m] * _C[j]
        rows.append(row[:m][full])
        hashes.append(mix(acc[full]))
    count = np.bincount(row, minlength=len(off) - 1)
    at = np.concatenate([[0], np.cumsum(count)])
    few = np.nonzero((count > 0) & (count < k))[0]
    if len(few):
        acc = count[few].astype(np.uint64) * _C[k]
        for j in range(k - 1):
            has = count[few] > j
            acc[has] += w[at[few[has]] + j] * _C[j]
        rows.append(few)
        hashes.append(mix(acc))
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


# ---- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the graph with long columns a and b: equal roots for nodes that are linked, in some order of links.

    Each round every node takes the neighbour (or itself) that comes first by hash, and links are drawn between what was taken. In a path half of the nodes go
    in a round, in a star all but one; so the rounds grow with the logarithm of the longest path. Everything stays in tables; minima are combined before
    shuffles, so that a node with very many links makes no large task.
    """
    edges = scratch.write(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    labels = None
    while edges.take(1):
        key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        both = edges.select(F.col("a").alias("node"), key("b").alias("to")).unionAll(edges.select(F.col("b").alias("node"), key("a").alias("to")))
        near = both.groupBy("node").agg(F.min("to").alias("to"))
        near = scratch.write(near.select("node", F.least("to", key("node"))["n"].alias("root")))
        a, b = near.select(F.col("node").alias("a"), F.col("root").alias("ra")), near.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        later = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        later = scratch.write(later)
        if labels is None:
            labels = near
        else:
            step = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = scratch.write(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            scratch.drop(labels, near)
            labels = new
        scratch.drop(edges)
        edges = later
    if labels is None:
        schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
        labels = scratch.spark.createDataFrame([], schema)
    return labels
