"""N-gram Jaccard join: a blocked sparse product of documents by shingles, over candidates that a lossless signature leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, keep_ids, mix, salted_left_join, shingles, steps, table, text_buffer

WORDS, NUM, DEN = 4, 85, 100
#: Counters of the frequency sketch, in parts that are summed apart; the whole (4 MB) is broadcast.
COUNTERS, PART = 1 << 20, 1 << 16
#: Documents of one side of a block of the product (at least and at most), and its shingles at most.
LEAST_BLOCK, BLOCK_DOCS, BLOCK_SHINGLES = 256, 2_048, 1_500_000
#: Blocks of a candidate component that is multiplied whole, each set being sent once a block. In larger ones: sets of a signature whose pairs are made one by
#: one, and common signatures from which on a pair closes a component of its own.
CLOSED_BLOCKS, PAIRED_SETS, STRONG = 4, 32, 8
U = np.uint64


class Threshold:
    """Jaccard similarity of at least num/den, and the signature that loses no pair that reaches it.

    Sets of n <= m shingles that reach it have den*n >= num*m and differ in at most d(n+m) = (den-num)(n+m)/(den+num) shingles. Sizes fall in classes whose
    bounds grow by den/num, so such a pair lies in one class or in two neighbours, and shares a window of two classes. Within a window no pair differs in more
    than D shingles; deal the shingles into more than D parts by hash, and some part holds the same shingles in both sets (pigeonhole). A document signs each
    part, in both windows of its class; pairs share a signature.

    Parts are a tenth more than D + 1. A document with more than D parts that are not empty signs only those: one of them must agree with any partner. The
    others sign their empty parts too.
    """

    def __init__(self, num: int = NUM, den: int = DEN):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * den // num)))
        self.bounds = np.array(bounds, dtype=np.int64)

    def reaches(self, common, total):
        return self.den * common >= self.num * (total - common)

    def parts(self, window: int) -> tuple[int, int]:
        """(most that a pair of the window differs by, number of parts)."""
        top = int(self.bounds[window + 2]) - 1
        d = (self.den - self.num) * 2 * top // (self.den + self.num)
        return d, d + 2 + (d + 1) // 10

    def signatures(self, h: np.ndarray, n: int, rare: np.ndarray) -> list[np.ndarray]:
        """The lists that `signed` gives, alone."""
        return [s for s, _ in self.signed(h, n, rare)]

    def signed(self, h: np.ndarray, n: int, rare: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Of one document: h its sorted shingles, rare those of them that the sketch doesn't call frequent. With each list, how many of it are to spare.

        Signing the rare shingles alone loses no pair (their sets differ in no more), and spares the parts that hold common passages only. Where too few parts
        have rare shingles, all shingles are signed as well, under other names, for partners that are in the same case.

        A set of n differs from no partner in more shingles than d(n + the largest partner's size): of its parts that are not empty all but so many agree, each of
        which signs. All but one of those are to spare: where both sets go without as many of their most common signatures, in one order of all of them, the rarest
        that they share is left to both.
        """
        c = int(np.searchsorted(self.bounds, n, side="right")) - 1
        out = []
        for window in (c - 1, c):
            if window < 0:
                continue
            d, k = self.parts(window)
            differ = (self.den - self.num) * (n + min(int(self.bounds[window + 2]) - 1, n * self.den // self.num)) // (self.den + self.num)
            sums, full = self._parts(rare, k)
            spare = max(int(full.sum()) - differ - 1, 0)
            out.append((mix(sums[full] + (np.nonzero(full)[0].astype(U) * U(2) + U(1)) * U(0x9E3779B97F4A7C15) + U(window + 1)), spare))
            if full.sum() <= d:
                sums, full = self._parts(h, k)
                spare = 0
                if full.sum() > d:
                    spare = max(int(full.sum()) - differ - 1, 0)
                    sums, at = sums[full], np.nonzero(full)[0]
                else:
                    at = np.arange(k)
                out.append((mix(mix(sums + U(7)) + (at.astype(U) * U(2) + U(1)) * U(0xD6E8FEB86659FD93) + U(window + 1)), spare))
        return out

    @staticmethod
    def _parts(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A digest of the shingles of each part, and which parts have any; parts are ranges of the sorted hashes."""
        sums, full = np.zeros(k, dtype=U), np.zeros(k, dtype=bool)
        if len(h):
            part = (((h >> U(32)) * U(k)) >> U(32)).astype(np.int64)
            first = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
            sums[part[first]] = np.add.reduceat(mix(h + U(0x632BE59BD9B4E019)), first)
            full[part[first]] = True
        return sums, full


def _sets(batch: pa.RecordBatch, at: int, words: int):
    """Per step: first row, and for each row of it the bounds of its sorted shingles."""
    buf, off = text_buffer(batch.column(at))
    for a, b in steps(off):
        r, h = shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)
        yield a, h, np.searchsorted(r, np.arange(b - a + 1))


def _digests(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; of empty ones 0."""
    out = []
    for c in (U(0x8CB92BA72F3D8DD7), U(0xA24BAED4963EE407)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ c), dtype=U)])
        n = np.diff(cut).astype(U)
        out.append(np.where(n > 0, mix(total[cut[1:]] - total[cut[:-1]] + n * c), U(0)))
    return out[0], out[1]


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def set_table(rows: DataFrame, words: int) -> DataFrame:
    """Per document its doc_id, set size and digests (part null); and per task parts of the sketch: how many sets hold each class of shingles."""
    schema = "doc_id long, n long, d1 long, d2 long, part int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, dtype=np.uint32)
        for b in batches:
            for a, h, cut in _sets(b, 1, words):
                d1, d2 = _digests(h, cut)
                sketch += np.bincount((h & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32) if len(h) * 8 > COUNTERS else 0
                if len(h) * 8 <= COUNTERS:
                    np.add.at(sketch, (h & U(COUNTERS - 1)).astype(np.int64), 1)
                n = len(d1)
                yield pa.record_batch([b.column(0).slice(a, n), _i64(np.diff(cut)), _i64(d1), _i64(d2), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "n", "d1", "d2", "part", "counts"])
        for p in range(COUNTERS // PART):
            own = sketch[p * PART : (p + 1) * PART]
            if own.any():
                none = pa.nulls(1, pa.int64())
                small = own.astype("<u2") if own.max() < 1 << 16 else own.astype("<u4")
                yield pa.record_batch([none, none, none, none, pa.array([p], pa.int32()), pa.array([small.tobytes()], pa.binary())], names=["doc_id", "n", "d1", "d2", "part", "counts"])

    return rows.mapInArrow(run, schema)


def frequent_bits(sets: DataFrame) -> bytes:
    """A bit for each counter of the sketch: set where it stands far above the mean, as counters of frequent shingles do."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for b in batches:
            for p, c in zip(b.column(0), b.column(1)):
                if p.as_py() != part:
                    if part is not None:
                        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])
                    part, total = p.as_py(), np.zeros(PART, dtype=np.int64)
                raw = c.as_py()
                total += np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * PART else "<u4")
        if part is not None:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    counts = np.zeros((COUNTERS // PART, PART), dtype=np.int64)
    parts = sets.where("part is not null").select("part", "counts").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, counts binary")
    for r in parts.collect():  # COUNTERS numbers
        counts[r.part] = np.frombuffer(r.counts, dtype=np.int64)
    mean = float(np.median(counts))
    return np.packbits(counts.reshape(-1) > mean + 8 * math.sqrt(mean + 1) + 24).tobytes()


def signature_rows(rows: DataFrame, words: int, rule: Threshold, frequent, whole: bool = False) -> DataFrame:
    """(sig, node): signatures of each set, its first digest as the node. Sets that share one within a batch come as pairs of their own, and as one row for
    that signature, so that a signature that very many sets share has a row a batch at most; with `whole` every set has a row for each of its signatures, with the
    list that it is of and how many of that list are to spare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(np.frombuffer(frequent.value, dtype=np.uint8)).astype(bool)
        for b in batches:
            sigs, nodes, lists, spares, seen = [], [], [], [], set()
            for _, h, cut in _sets(b, 0, words):
                d1, _ = _digests(h, cut)
                rare = ~often[(h & U(COUNTERS - 1)).astype(np.int64)]
                for i, node in enumerate(d1):
                    x, y = cut[i], cut[i + 1]
                    if x == y or int(node) in seen:
                        continue
                    seen.add(int(node))
                    own = h[x:y]
                    for at, (s, spare) in enumerate(rule.signed(own, int(y - x), own[rare[x:y]])):
                        sigs.append(s)
                        nodes.append(np.full(len(s), node, dtype=U))
                        lists.append(np.full(len(s), at, dtype=np.int32))
                        spares.append(np.full(len(s), spare, dtype=np.int32))
            if not sigs:
                continue
            s, n = np.concatenate(sigs), np.concatenate(nodes)
            if whole:
                yield pa.record_batch([_i64(s), _i64(n), pa.array(np.concatenate(lists)), pa.array(np.concatenate(spares))], names=["sig", "node", "list", "spare"])
                continue
            order = np.argsort(s, kind="stable")
            s, n = s[order], n[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            first = n[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
            more = ~new & (first != n)
            if more.any():
                pair = np.unique(np.stack([first[more], n[more]], axis=1), axis=0)
                own = mix(pair[:, 0] * U(3) + mix(pair[:, 1]))
                s, n = np.concatenate([s[new], own, own]), np.concatenate([n[new], pair[:, 0], pair[:, 1]])
            yield pa.record_batch([_i64(s), _i64(n)], names=["sig", "node"])

    return rows.select("text").mapInArrow(run, "sig long, node long" + (", list int, spare int" if whole else ""))


def candidate_links(sigs: DataFrame) -> DataFrame:
    """(a, b): a star from the first node of each signature to its others. Rows come sorted, so a task holds a batch of them, however many share a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for b in batches:
            s, n = np.asarray(b.column(0)), np.asarray(b.column(1))
            if not len(s):
                continue
            if last:
                s, n = np.concatenate([[last[0]], s]), np.concatenate([[last[1]], n])
            new = np.concatenate([[True], s[1:] != s[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            first = n[at]
            last = (int(s[-1]), int(first[-1]))
            link = first != n
            if link.any():
                pair = np.unique(np.stack([first[link], n[link]], axis=1), axis=0)
                yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long")


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def product_links(ids: np.ndarray, side: np.ndarray, cut: np.ndarray, h: np.ndarray, rule: Threshold, weights: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between documents of one block pair, by accumulating their overlaps; and for each document the weight of all that it links to.

    The product of the documents-by-shingles matrix with its transpose is built a row at a time: the lists of documents of a row's shingles are counted into a
    dense array of overlaps. Columns outside the size bounds, or whose overlap is below what their sizes ask for, are left out; links among documents that are
    already connected need no edge, but are counted. side tells the two sides of the block pair apart where it joins two blocks (both 0 within one).
    """
    m = len(ids)
    size = np.diff(cut)
    row = np.repeat(np.arange(m), size)
    order = np.argsort(h, kind="stable")
    hs, rs = h[order], row[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
    lists = np.append(np.nonzero(new)[0], len(hs))
    term = np.empty(len(h), dtype=np.int64)
    term[order] = np.cumsum(new) - 1
    count = np.diff(lists)
    parent = np.arange(m)
    links = []
    linked = np.zeros(m, dtype=np.int64)
    both = bool(side.any())
    for i in range(m):
        if both and side[i]:
            continue
        t = term[cut[i] : cut[i + 1]]
        t = t[count[t] > 1]
        if not len(t):
            continue
        n = count[t]
        at = np.repeat(lists[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(rs[at], minlength=m)
        total = size + size[i]
        ok = (overlap > 0) & (rule.den * np.minimum(size, size[i]) >= rule.num * np.maximum(size, size[i])) & rule.reaches(overlap, total)
        ok[: i + 1] = False if not both else ok[: i + 1]
        if both:
            ok &= side == 1
        linked[i] += weights[ok].sum()
        linked[ok] += weights[i]
        for j in np.nonzero(ok)[0]:
            x, y = _root(parent, i), _root(parent, int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(ids[i]), int(ids[j])))
    return links, linked


def hashed(docs: DataFrame, comps: DataFrame, words: int) -> DataFrame:
    """(doc_id, comp, blocks, d1, d2, same, h): comps with each set's sorted shingles; rows of the same doc_id that hold another text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, h, cut in _sets(b, 6, words):
                n = len(cut) - 1
                size = pa.array(cut * 8, pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), n, [None, size.buffers()[1], pa.py_buffer(np.ascontiguousarray(h).tobytes())])
                own = np.ones(n, dtype=bool)
                for i, d in zip((3, 4), _digests(h, cut)):
                    own &= np.asarray(b.column(i).slice(a, n)) == d.view(np.int64)
                yield pa.record_batch([*(b.column(i).slice(a, n) for i in range(6)), raw], names=names).filter(pa.array(own))

    names = ["doc_id", "comp", "blocks", "d1", "d2", "same", "h"]
    return docs.join(comps.select(*names[:-1]), "doc_id").select(*names[:-1], "text").mapInArrow(run, "doc_id long, comp long, blocks int, d1 long, d2 long, same long, h binary")


def verified_links(docs: DataFrame, comps: DataFrame, words: int, rule: Threshold) -> DataFrame:
    """(a, b, d1, d2, n), within each candidate component: doc_ids of links that connect what is linked; and for sets, by their digests, how many rows of other
    sets they link to, in parts that are to be summed.

    comps has the digests of each set and the number of its rows (same). A component is cut into blocks by hash so that a block has a bounded number of documents
    and shingles, and each pair of its blocks is one group.
    """

    rows = hashed(docs, comps, words)
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc_id", "d1", "d2", "same", "h")

    def product(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if t.num_rows:  # rows that repeat an id and its text are one set
            _, first = np.unique(np.stack([np.asarray(t["d1"]), np.asarray(t["d2"])]), axis=1, return_index=True)
            t = t if len(first) == t.num_rows else t.take(pa.array(np.sort(first))).combine_chunks()
        raw = t["h"].to_pylist()
        cut = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
        side = (np.asarray(t["block"]) != np.asarray(t["x"])).astype(np.int8)
        links, linked = product_links(np.asarray(t["doc_id"]), side, cut, np.frombuffer(b"".join(raw), dtype=U), rule, np.asarray(t["same"]))
        has = np.nonzero(linked)[0]
        none, many = pa.nulls(len(has), pa.int64()), pa.nulls(len(links), pa.int64())
        ends = [pa.concat_arrays([pa.array([x[i] for x in links], pa.int64()), none]) for i in (0, 1)]
        counts = [pa.concat_arrays([many, pa.array(np.asarray(c)[has], pa.int64())]) for c in (t["d1"], t["d2"], linked)]
        return pa.table([*ends, *counts], names=["a", "b", "d1", "d2", "n"])

    return rows.groupBy("comp", "x", "y").applyInArrow(product, "a long, b long, d1 long, d2 long, n long")


def without_spare(signed: DataFrame) -> DataFrame:
    """(sig, node, n, m): signatures that more than one set has, without those that a set can spare, its most common ones; m sets have it, of those that keep it.

    signed is (sig, node, n, list, spare). A passage that many sets hold signs the same in all of them, and would pair each with each.
    """
    count = lambda x: x.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1")
    place = F.row_number().over(Window.partitionBy("node", "list").orderBy(F.desc("m"), F.desc("sig")))
    kept = signed.join(count(signed), "sig").withColumn("place", place).where("place > spare").select("sig", "node", "n").distinct()
    return kept.join(count(kept), "sig")


def signed_pairs(sized: DataFrame, rule: Threshold) -> DataFrame:
    """(a, b, shared): first digests of sets that share signatures, and how many, and whose sizes let them link. sized is (sig, node, n)."""
    side = lambda x: sized.select("sig", F.col("node").alias(x), F.col("n").alias(f"n{x}"))
    fit = rule.den * F.least("na", "nb") >= rule.num * F.greatest("na", "nb")
    return side("a").join(side("b"), "sig").where((F.col("a") < F.col("b")) & fit).groupBy("a", "b").agg(F.count("*").alias("shared"))


def paired_links(pairs: DataFrame, sets: DataFrame, rule: Threshold) -> DataFrame:
    """As verified_links, of single pairs (a, b) of sets by their first digests. sets is (doc_id, d1, d2, same, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(b.column(8), b.column(9))):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                ok[i] = rule.reaches(int((x[at] == y).sum()), len(x) + len(y))
            yield pa.record_batch([b.column(i) for i in range(8)], names=names).filter(pa.array(ok))

    side = lambda x: sets.select(*[F.col(c).alias(f"{c}{x}") for c in ("doc_id", "d1", "d2", "same", "h")])
    names = [f"{c}{x}" for x in "ab" for c in ("doc_id", "d1", "d2", "same")]
    both = pairs.join(side("a"), F.col("a") == F.col("d1a")).join(side("b"), F.col("b") == F.col("d1b")).select(*names, "ha", "hb")
    links = both.mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()  # rows that repeat an id and its text are one set
    null = F.lit(None).cast("long")
    row = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("a", "b", "d1", "d2", "n"))])
    c = F.col
    told = F.array(row(c("doc_ida"), c("doc_idb"), null, null, null), row(null, null, c("d1a"), c("d2a"), c("sameb")), row(null, null, c("d1b"), c("d2b"), c("samea")))
    return links.select(F.explode(told).alias("x")).select("x.*")


def in_blocks(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, comp, blocks, d1, d2, same, n): sets (doc_id, comp, d1, d2, same, n) of components of more than one set, and into how many blocks each is cut."""
    comps = sets.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("size")).where("docs > 1")
    side = F.least(F.greatest(F.col("docs") / 16, F.lit(LEAST_BLOCK)), F.lit(BLOCK_DOCS))  # a group of copies is work for several tasks
    blocks = F.greatest(F.ceil(F.col("docs") / side), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    return scratch.write(sets.join(comps, "comp").select("doc_id", "comp", blocks, "d1", "d2", "same", "n"))


def links_by_signature(rows: DataFrame, wide: DataFrame, scratch: Scratch, words: int, rule: Threshold, frequent) -> DataFrame:
    """As verified_links, for components that chance signatures chain together: nearly all of a component's pairs share none, so pairs are made by signature.

    Signatures of many sets, and pairs that share many signatures, as near copies do, close components of their own, which are multiplied by blocks. All other pairs
    that share a signature are met one by one. Two sets that link share one, so no link is lost, and a pair is told once.
    """
    texts = scratch.write(keep_ids(rows, wide.select("doc_id").distinct()))
    node = wide.select(F.col("d1").alias("node"), "n")
    signed = scratch.write(signature_rows(texts, words, rule, frequent, whole=True).join(node, "node").distinct())
    sized = scratch.write(without_spare(signed))
    scratch.drop(signed)
    pairs = scratch.write(signed_pairs(sized.where(F.col("m") <= PAIRED_SETS), rule))
    strong = candidate_links(sized.where(F.col("m") > PAIRED_SETS).select("sig", "node")).unionByName(pairs.where(F.col("shared") >= STRONG).select("a", "b"))
    roots = components(strong, scratch)
    dense = in_blocks(wide.drop("comp", "blocks").join(roots.select(F.col("node").alias("d1"), F.col("root").alias("comp")), "d1"), scratch)
    told = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"c{x}"))
    pairs = pairs.join(told("a"), "a", "left").join(told("b"), "b", "left").where("ca is null or cb is null or ca <> cb")
    pairs = scratch.write(pairs.select("a", "b"))
    sets = scratch.write(hashed(texts, wide, words).select("doc_id", "d1", "d2", "same", "h"))
    return verified_links(texts, dense, words, rule).unionByName(paired_links(pairs, sets, rule))


def join_classes(docs: DataFrame, scratch: Scratch, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs; as join_links, without the numbers of links."""
    return join_links(docs, scratch, words, num, den).drop("n_links")


def join_links(docs: DataFrame, scratch: Scratch, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for each row of docs. n_links is the number of other rows that the row's text links to.

    Sets are the distinct `words`-word shingles in A-Z lower case (fewer words: the sequence as one), as 64-bit hashes. Two documents link when
    den * |intersection| >= num * |union|; a component is named by its smallest doc_id. Null and blank texts have no set and no link. Equal sets count once
    in the search, by 128-bit digests. Rows that repeat a doc_id are each judged by their own text and share its links. Rows with a null doc_id come back with
    a null component and link nothing.
    """
    rule = Threshold(num, den)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.write(set_table(rows, words))
    own = sets.where("part is null").select("doc_id", "n", "d1", "d2")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_bits(sets))
    links = scratch.write(candidate_links(signature_rows(rows, words, rule, frequent)).distinct())
    cands = components(links, scratch)
    scratch.drop(links)
    # one document for each distinct set, and of those the ones in candidate components
    reps = own.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("same"))
    reps = scratch.write(reps.join(cands.select(F.col("node").alias("d1"), F.col("root").alias("comp")), "d1", "left").where("same > 1 or comp is not null"))
    todo = in_blocks(reps.where("comp is not null"), scratch)
    closed, wide = todo.where(F.col("blocks") <= CLOSED_BLOCKS), todo.where(F.col("blocks") > CLOSED_BLOCKS)
    found = verified_links(keep_ids(rows, closed.select("doc_id").distinct()), closed, words, rule)
    if wide.take(1):
        found = found.unionByName(links_by_signature(rows, wide, scratch, words, rule, frequent))
    found = scratch.write(found)
    roots = components(found.where("a is not null").select("a", "b"), scratch)
    linked = found.where("d1 is not null").groupBy("d1", "d2").agg(F.sum("n").alias("linked"))
    least = scratch.write(roots.groupBy("root").agg(F.min("node").alias("component")))
    named = roots.join(least, "root").select(F.col("node").alias("doc_id"), "component")
    n_links = (F.col("same") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    by_set = reps.join(named, "doc_id", "left").join(linked, ["d1", "d2"], "left")
    by_set = by_set.select("d1", "d2", F.coalesce("component", "doc_id").alias("component"), n_links).where("d1 is not null")
    by_set = scratch.write(by_set)
    out = salted_left_join(own, by_set, ["d1", "d2"], ["doc_id"])
    judged = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    n_links = F.coalesce(F.when(judged, F.col("n_links")), F.lit(0)).alias("n_links")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(judged, F.col("component")), "doc_id").alias("component_id"), n_links)


def op9_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its set of 4-word shingles and the class that links of 85 % Jaccard similarity put it in."""
    return join_classes(table(spark, sf_dir, "documents"), Scratch(spark))


def op9_ngramjoin_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_ngramjoin, with the number of documents that each links to."""
    return join_links(table(spark, sf_dir, "documents"), Scratch(spark))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
LINKS_SQL = SQL.replace("m.c AS component_id FROM w", "m.c AS component_id, (SELECT count(*) FROM e WHERE e.x = w.doc_id) AS n_links FROM w")
