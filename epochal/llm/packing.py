"""Best-fit packing of documents into sequences: Martello-Toth dominance reduction, then best-fit decreasing on what is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

CAPACITY = 1024
END_ID = 2
#: Groups that ranks are counted in; with the lengths they bound the array of counts, which is broadcast (CAPACITY * BUCKETS numbers, 2 MB, whatever the input).
BUCKETS = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[tuple[str | None, bool], object] = {}


def encoder(path: str | None = None, by_ranks: bool = True):
    """text -> ids as `tokenizers` gives them from the file at `path`, special tokens in texts included.

    by_ranks: where the same vocabulary lies beside the file as ranks, `tiktoken` encodes by them, which gives the same ids (tests compare both over all of
    `documents`) in a quarter of the time; a text that its regular expressions give up on goes to `tokenizers`.
    """
    if (path, by_ranks) not in _ENCODERS:
        import base64
        import os

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        file = path or P.path("byte_bpe_50k.json")
        plain = Tokenizer.from_file(file)
        encode = lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4")
        ranks = file.removesuffix(".json") + ".tiktoken"
        if by_ranks and os.path.exists(ranks):
            with open(ranks, "rb") as f:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in plain.get_added_tokens_decoder().items() if t.special}
            fast, slow = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=vocabulary, special_tokens=special), encode

            def encode(t: str) -> np.ndarray:
                try:
                    return np.array(fast.encode(t, allowed_special="all"), dtype="<u4")
                except (ValueError, RuntimeError):
                    return slow(t)

        _ENCODERS[path, by_ranks] = encode
    return _ENCODERS[path, by_ranks]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                raw = ids.tobytes()
                out += [(doc, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes bins that provably dominate every other bin holding their largest item, and takes their items out of `count` (items by length).

    For an item of length L with room r beside it: alone, if nothing fits; with a partner of length r exactly; with its longest fitting partner p, if no two
    others fit, or if no three fit and no two that fit exceed p together: any bin with L can then swap its other items for p (Martello and Toth 1990).
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(items: tuple[int, ...], n: int) -> None:
        for x in items:
            count[x] -= n
        fixed.append((items, n))

    changed = True
    while changed:
        changed = False
        for long in range(capacity, 0, -1):
            while count[long] > 0:
                room = capacity - long
                others = count.copy()
                others[long] -= 1
                fits = np.nonzero(others[: room + 1] > 0)[0]
                if not len(fits):
                    n = 1 if long <= room else int(count[long])
                    fix((long,), n)
                elif (p := int(fits[-1])) == room or _pair_is_best(others, fits, room, p):
                    fix((long, p), int(count[long] // 2) if p == long else int(min(count[long], count[p])))
                else:
                    break
                changed = True
    return fixed


def _pair_is_best(others: np.ndarray, fits: np.ndarray, room: int, p: int) -> bool:
    small = np.repeat(fits[:3], np.minimum(others[fits[:3]], 3))[:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return True
    if len(small) > 2 and small.sum() <= room:
        return False
    best, i, j = 0, 0, len(fits) - 1
    while i <= j:  # the largest sum of two that fit
        if fits[i] + fits[j] > room or (i == j and others[fits[i]] < 2):
            j -= 1
        else:
            best = max(best, int(fits[i] + fits[j]))
            i += 1
    return best <= p


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over items by length: each goes to the fullest bin with room. Equal bins are kept as one pattern and its number."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for long in range(capacity, 0, -1):
        left = int(count[long])
        while left:
            room = min((r for r in open_ if r >= long), default=None)
            if room is None:
                room, items, n = capacity, (), left
            else:
                items, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // long
            bins = min(n, left // each)
            if bins:
                open_.setdefault(room - each * long, []).append((items + (long,) * each, bins))
                left -= bins * each
                n -= bins
            if n and left and left < each:
                open_.setdefault(room - left * long, []).append((items + (long,) * left, 1))
                left, n = 0, n - 1
            if n and items:
                open_.setdefault(room, []).append((items, n))
    return [x for same in open_.values() for x in same]


def layout(count: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank on, which first sequence and which offset hold; the n-th item of a length goes to the sequence so many after the first."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in count.items():
        left[k] = v
    patterns = reduce_by_dominance(left, capacity)
    patterns += best_fit(left, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for items, n in patterns:
        offset = 0
        for x in items:
            rank = taken.get(x, 0)
            slots.setdefault(x, []).append((rank, base - rank, offset))
            taken[x] = rank + n
            offset += x
        base += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*s)) for x, s in slots.items()}


def pack(docs: DataFrame, scratch: Scratch, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed each for itself. Full pieces are sequences of their own, under
    negative numbers. The packing of the others is planned from how many there are of each length (at most `capacity` numbers, whatever the input); they take
    the places of their length by rank, which Spark counts within buckets.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")
    pieces = scratch.write(pieces_of(docs, path, capacity).withColumns({"bucket": bucket, "row": F.monotonically_increasing_id()}))
    short = pieces.where(F.col("length") < capacity)
    counts = np.zeros((capacity, BUCKETS), dtype=np.int64)
    found = scratch.write(short.groupBy("length", "bucket").agg(F.count("*").alias("n"))).toArrow()  # at most capacity * BUCKETS rows
    counts[np.asarray(found["length"]), np.asarray(found["bucket"])] = np.asarray(found["n"])
    total = counts.sum(axis=1)
    plan = layout({int(x): int(total[x]) for x in np.nonzero(total)[0]}, capacity)
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = short.withColumn("rank", F.row_number().over(within) - 1).select("doc_id", "piece", "start", "length", "ids_crc32", "bucket", "rank")
    places = docs.sparkSession.sparkContext.broadcast((plan, np.cumsum(counts, axis=1) - counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, before = places.value
        for b in batches:
            length, bucket, rank = (np.asarray(b.column(i)) for i in (3, 5, 6))
            rank = rank + before[length, bucket]
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                here = np.nonzero(length == x)[0]
                first, shift, offset = spots[int(x)]
                i = np.searchsorted(first, rank[here], side="right") - 1
                seq[here], off[here] = rank[here] + shift[i], offset[i]
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    full = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long").unionByName(full)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of `documents`: where it lies in which sequence of at most 1024 ids."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
