"""Line dedup: Bloom filters of what was seen once and twice pick suspected repeats; only those shuffle, to be confirmed exactly; texts stay where they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import Scratch, plain, salted_left_join, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a filter for each document (about 16 a line), and the least and the most bits. The most (128 MB) bounds what is broadcast: a corpus that fills
#: them only makes more lines suspects, which are confirmed exactly all the same.
BITS_PER_DOC, LEAST_BITS, MOST_BITS = 256, 1 << 22, 1 << 30
#: Confirmed lines (24 bytes each) that may be broadcast; beyond that texts are joined with the lists of what they lose.
BROADCAST_LINES = 1_000_000
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The line as it is compared, or None if it is too short to count."""
    k = line.strip(BLANK)
    if len(k) < least or (not k.isascii() and len(k.decode()) < least):
        return None
    return k.lower()  # of bytes: A-Z only


def digest(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _bits(key: bytes, m: int) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(key)
    return h & (m - 1), (h >> 32) * 0x9E3779B1 & (m - 1)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    for t in batch.column(at).cast(pa.large_binary()):
        yield t.as_py() or b""


def seen_lines(texts: DataFrame, bits: int, least: int) -> DataFrame:
    """Each task's notes of the filter bits that its line keys set once and more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for b in batches:
            at = [x for t in _texts(b, 0) for line in t.split(b"\n") if (k := line_key(line, least)) is not None for x in _bits(k, bits)]
            seen.append(np.array(at, dtype=np.uint32))
        yield from bloom.notes(seen, bits)

    return texts.mapInArrow(run, bloom.NOTES)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")


class Suspects:
    """The filter of keys seen twice; its answer for a line is its key's digest, or None."""

    def __init__(self, twice, bits: int, least: int):
        self.have, self.bits, self.least = twice.value, bits, least

    def __call__(self, line: bytes) -> tuple[int, int] | None:
        if (k := line_key(line, self.least)) is None:
            return None
        for x in _bits(k, self.bits):
            if not self.have[x >> 3] & (128 >> (x & 7)):
                return None
        return digest(k)


def repeated(docs: DataFrame, scratch: Scratch, least: int, min_docs: int):
    """(filter of keys seen twice, its bits, suspected (doc_id, d1, d2), confirmed (d1, d2, keep)): keys of at least min_docs documents and the largest of them."""
    bits = bloom.bits_for(docs.count(), BITS_PER_DOC, LEAST_BITS, MOST_BITS)
    rows = _rows(docs)
    twice = docs.sparkSession.sparkContext.broadcast(bloom.twice_seen(seen_lines(rows.select("text"), bits, least), bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspect = Suspects(twice, bits, least)
        for b in batches:
            out = {(doc, *d) for doc, t in zip(b.column(0).to_pylist(), _texts(b, 1)) for line in t.split(b"\n") if (d := suspect(line)) is not None}
            cols = list(zip(*out)) or [[], [], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "d1", "d2"])

    found = scratch.write(rows.mapInArrow(suspects, "doc_id long, d1 long, d2 long").distinct())
    common = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs).select("d1", "d2", "keep")
    return twice, bits, found, scratch.write(common)


class Keepers:
    """Which document keeps a line, by the digest of its key: sorted arrays."""

    def __init__(self, table: pa.Table):
        by = np.argsort(np.asarray(table["d1"]), kind="stable")
        self.d1, self.d2, self.keep = (np.asarray(table[c])[by] for c in ("d1", "d2", "keep"))

    def holder(self, d: tuple[int, int]) -> int | None:
        i = int(np.searchsorted(self.d1, d[0]))
        while i < len(self.d1) and self.d1[i] == d[0]:
            if self.d2[i] == d[1]:
                return int(self.keep[i])
            i += 1
        return None


def line_dedup(docs: DataFrame, scratch: Scratch, least: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with `text` without its repeated lines, and __n_lines and __n_dropped.

    A line's key is the line stripped of ASCII white space and with A-Z in lower case. Keys of at least `least` code points in at least `min_docs` documents
    lose all their lines except in the largest doc_id that holds them. Documents are told apart by doc_id: rows that repeat one count once and are treated
    alike; null is the smallest. A null or empty text is one empty line and stays as it is. Extra columns pass through, but for names that start with two
    underscores, which are the operators' own. Lines are confirmed by 128-bit digests of their keys.

    The confirmed lines are few, as each is in several documents, and are broadcast after they were counted; then no text moves. More than BROADCAST_LINES are
    joined with the suspects, and the lists of what each document loses with the texts.
    """
    docs = plain(docs)
    twice, bits, found, common = repeated(docs, scratch, least, min_docs)
    names = docs.columns
    at = names.index("text")
    key = "__lines_of"
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    few = common.count() <= BROADCAST_LINES
    if few:
        keepers = docs.sparkSession.sparkContext.broadcast(Keepers(common.toArrow()))
        rows = rows.withColumn("__digests", F.lit(None).cast("array<struct<d1:bigint,d2:bigint>>"))
    else:
        lost = salted_left_join(found, common, ["d1", "d2"], ["doc_id"]).where("doc_id < keep")
        lists = lost.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("d1", "d2")).alias("__digests"))
        rows = rows.join(lists, key, "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspect = Suspects(twice, bits, least)
        holder = keepers.value.holder if few else None
        for b in batches:
            texts, lines, dropped = [], [], []
            for doc, t, lose in zip(b.column(len(names)).to_pylist(), b.column(at).cast(pa.large_binary()), b.column(len(names) + 1)):
                raw = t.as_py()
                own = kept = (raw or b"").split(b"\n")
                if few:
                    kept = [x for x in own if (d := suspect(x)) is None or (keep := holder(d)) is None or keep <= doc]
                elif lose.is_valid:
                    gone = {(x["d1"], x["d2"]) for x in lose.as_py()}
                    kept = [x for x in own if suspect(x) not in gone]
                texts.append(raw if raw is None or len(kept) == len(own) else b"\n".join(kept))
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            cols = b.columns[: len(names)]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[f"c{i}" for i in range(len(names) + 2)])

    kinds = [*(f.dataType for f in docs.schema.fields), T.LongType(), T.LongType()]
    safe = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*names, key, "__digests"])])
    out = safe.mapInArrow(rebuild, T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)]))
    return out.toDF(*names, "__n_lines", "__n_dropped")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many it loses and the SHA-256 of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, Scratch(spark))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(c.keep <> k.doc_id, false) AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
