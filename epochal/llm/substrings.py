"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that an earlier document also holds are removed.

Every document is searched for all its strings of LENGTH bytes at once. Of each such string the least-hashed GRAM (the rightmost of equal ones) is its anchor:
equal strings have equal anchors at equal places, and neighbouring strings mostly share one. What an anchor's strings cover is its stretch. So the corpus becomes
stretches, about one for each 17 bytes, and only stretches whose anchor occurs twice matter:

1. Bloom filters of anchors seen once and twice, built by tasks; their size is bounded and the second one is broadcast.
2. Stretches whose anchor may repeat are shuffled as digests by anchor: which are found in several documents, and in which first; which anchors have several.
3. Of stretches whose anchor has several, the bytes that the first document holds (a second filter, of bounded size too, picks them) are sorted within their
   anchor as suffixes, to the right and to the left of it, by merging runs with hashed comparisons, checked against the bytes; what neighbours have in common
   tells which strings are equal, and so each one's first document.
4. Occurrences meet both answers; each document's removed bytes are gathered and applied to its text.

Stretches are equal if two 64-bit hashes of them are (one of the anchor, one of the whole); strings of stretches that differ are compared by their bytes.
Texts are read in steps of bounded size, however long they are: a stretch that two steps share is two shorter ones, which step 3 tells apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import STEP, Scratch, mix, plain, powers, prefix_hashes, range_hash, steps, table, text_buffer

LENGTH, GRAM = 50, 16
#: Bits of the filters for each document and for each stretch, and the least and most (128 MB) bits.
BITS_PER_DOC, BITS_PER_STRETCH, LEAST_BITS, MOST_BITS = 1_500, 8, 1 << 22, 1 << 30
#: An anchor with more different stretches than this is split by its strings.
HOT = 4_000
LEAST_ID = -(2**63)
#: A gram's place within its step, beside which its hash is compared; steps are shorter than this allows.
PLACE_BITS = 21
U = np.uint64


class Stretches:
    """Of one step of bytes: by stretch its text, the place of its anchor, and the first and last start of its strings (lo, hi).

    off are the texts' bounds in buf; strings that start at `starts` or later belong to the next step.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, starts: int | None = None, length: int = LENGTH, gram: int = GRAM):
        w = length - gram + 1
        self.length = length
        e = np.zeros(0, np.int64)
        self.row, self.at, self.lo, self.hi = e, e, e, e
        self.begin, self.anchor, self.digest = off, np.zeros(0, U), np.zeros(0, U)
        n = min(len(buf) - length + 1, len(buf) if starts is None else starts)
        if n <= 0:
            return
        h = prefix_hashes(buf)
        _, inv = powers(len(h))
        g = (h[gram:] - h[:-gram]) * inv[: len(h) - gram]
        low = U((1 << PLACE_BITS) - 1)
        m = (g ^ (g >> U(29))) * U(0xBF58476D1CE4E5B9)
        m &= ~low
        m |= low - np.arange(len(g), dtype=U)
        s = 1
        while 2 * s <= w:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        m = np.minimum(m[:n], m[w - s :][:n]) & low
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
        inside = np.arange(length, n + length) <= off[1:][row]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (m[1:] != m[:-1]) | (row[1:] != row[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        self.lo, self.hi = np.nonzero(new)[0], np.nonzero(last)[0]
        self.row, self.at = row[self.lo], (low - m[self.lo]).astype(np.int64)
        self.anchor = mix(g[self.at] + U(gram))
        self.digest = mix(range_hash(h, self.lo, self.hi + length) + (self.at - self.lo).astype(U) * U(0x9E3779B97F4A7C15))

    def bytes(self, buf: np.ndarray, which: np.ndarray) -> pa.Array:
        return _slices(buf, self.lo[which], self.hi[which] + self.length)


def _slices(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(hi - lo)])
    at = np.repeat(lo - off[:-1], hi - lo) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(buf[at])])


def _stretches(batch: pa.RecordBatch, at: int, size: int | None = None, length: int = LENGTH):
    """(first row, its bytes that came in earlier steps, bytes, stretches) by step; each string belongs to the step that it starts in."""
    buf, off = text_buffer(batch.column(at))
    size = size or STEP
    for a in range(0, len(buf), size):
        b = min(a + size + length - 1, len(buf))
        i, j = int(np.searchsorted(off, a, side="right")) - 1, int(np.searchsorted(off, b, side="left"))
        part = np.clip(off[i : j + 1], a, b) - a
        yield i, a - int(off[i]), buf[a:b], Stretches(buf[a:b], part, size, length)


def _bit(x: np.ndarray, bits: int) -> np.ndarray:
    return mix(x + U(0x2545F4914F6CDD1D)) & U(bits - 1)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


# ---- suffix sort -----------------------------------------------------------------------------------------------------


class Suffixes:
    """Strings of at most `most` bytes, each in a group: common extensions by binary search over prefix hashes, and a mergesort that compares by them."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, most: int = LENGTH):
        self.raw, self.start, self.size, self.group = raw, start, size, group
        self.h = prefix_hashes(raw)
        self.most = most
        self.by_bytes = False

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings x and y: log2(most) comparisons of hashes (of the bytes, once a hash was found to lie)."""
        if self.by_bytes:
            return self.shared_bytes(x, y)
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        a, b = self.start[x], self.start[y]
        _, inv = powers(len(self.h))
        ha, hb, ia, ib = self.h[a], self.h[b], inv[a], inv[b]
        for _ in range(self.most.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.h[a + mid] - ha) * ia == (self.h[b + mid] - hb) * ib
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def shared_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As common, from the bytes themselves."""
        out = np.empty(len(x), np.int64)
        col, top = np.arange(self.most), len(self.raw) - 1
        for a in range(0, len(x), 1 << 16):
            p, q = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
            bp, bq = (self.raw[np.minimum(self.start[z][:, None] + col, top)] for z in (p, q))
            short = np.minimum(self.size[p], self.size[q])
            differ = (bp != bq) | (col >= short[:, None])
            out[a : a + (1 << 16)] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), self.most), short)
        return out

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x before y: by the byte after what they share; the shorter first; equal ones by number."""
        n = self.common(x, y)
        ex, ey = n >= self.size[x], n >= self.size[y]
        top = len(self.raw) - 1
        bx = np.where(ex, -1, self.raw[np.minimum(self.start[x] + n, top)].astype(np.int64))
        by = np.where(ey, -1, self.raw[np.minimum(self.start[y] + n, top)].astype(np.int64))
        return np.where(bx == by, x < y, bx < by)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """(order within groups, common prefix with the one before, 0 at a group's first), checked against the bytes themselves.

        Runs of a group are merged in pairs, all groups at once: each string finds its place in the neighbouring run by binary search.
        """
        order = np.argsort(self.group, kind="stable")
        g = self.group[order]
        m = len(order)
        first = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0] if m else np.zeros(0, np.int64)
        size = np.diff(np.append(first, m))
        begin, many = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(m) - begin
        w = 1
        while m and w < size.max():
            act = np.nonzero(many > w)[0]
            run = place[act] // w
            lo = begin[act] + (run ^ 1) * w
            end = begin[act] + many[act]
            lo, hi = np.minimum(lo, end), np.minimum(lo + w, end)
            base = lo.copy()
            me = order[act]
            while True:
                open_ = np.nonzero(lo < hi)[0]
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                before = self.less(order[mid], me[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = begin[act] + (run // 2) * 2 * w + place[act] % w + lo - base
            order = order.copy()
            order[to] = me
            w *= 2
        lcp = np.zeros(m, np.int64)
        inner = np.nonzero(place > 0)[0]
        if len(inner):
            x, y = order[inner - 1], order[inner]
            lcp[inner] = self.common(x, y)
            # verification: where the bytes say otherwise, two strings have one hash, and the sort is made again by bytes
            if not self.by_bytes and not ((lcp[inner] == self.shared_bytes(x, y)) & self.less(x, y)).all():
                self.by_bytes = True
                return self.sort()
        return order, lcp


def first_holders(raw: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, group: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(bits of strings that a stretch before it in its group holds for a smaller doc, whether any string is new in its group), by stretch; docs rise within a group.

    left is how far the anchor stands from the stretch's start. A string that starts a bytes before the anchor is told by the first a bytes to the anchor's left
    and length - a bytes to its right; both classes are runs of the two suffix sorts in which neighbours have as much in common.
    """
    m = len(start)
    width = length - gram
    right = Suffixes(raw, start + left, size - left, group, length)
    back = raw[::-1]
    leftward = Suffixes(np.ascontiguousarray(back), len(raw) - (start + left), left, group, length)
    ro, rl = right.sort()
    lo_, ll = leftward.sort()
    bits, fresh = np.zeros(m, np.int64), np.zeros(m, bool)
    gone = np.zeros(m, np.int64)
    for a in range(width + 1):
        has = (left >= a) & (size - left >= length - a)
        idx = np.nonzero(has)[0]
        if not len(idx):
            continue
        cr, cl = np.empty(m, np.int64), np.empty(m, np.int64)
        cr[ro] = np.cumsum(rl < length - a)
        cl[lo_] = np.cumsum(ll < a) if a else np.cumsum(np.concatenate([[True], group[lo_][1:] != group[lo_][:-1]]))
        key = cr[idx] * np.int64(m + 1) + cl[idx]
        by = np.argsort(key, kind="stable")  # rows of a group come with rising docs, so a class's first row has its first document
        k, i = key[by], idx[by]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        lead = i[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        gone[i[doc[lead] < doc[i]]] |= np.int64(1) << np.int64(a)
        fresh[i[new]] = True
    bits |= gone
    return bits, fresh


# ---- the job ---------------------------------------------------------------------------------------------------------


def _anchor_notes(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            for _, _, _, s in _stretches(b, 0):
                seen.append(_bit(s.anchor, bits).astype(np.uint32))
        yield from bloom.notes(seen, bits)

    return texts.mapInArrow(run, bloom.NOTES)


def _digests(rows: DataFrame, twice, bits: int) -> DataFrame:
    """(anchor, digest, doc_id) of stretches whose anchor may repeat: the least doc_id of each within a batch, so that a common one has a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(twice.value, dtype=np.uint8)
        for b in batches:
            ids = np.asarray(b.column(0))
            out = []
            for first, _, _, s in _stretches(b, 1):
                hit = bloom.holds(have, _bit(s.anchor, bits))
                out.append((s.anchor[hit], s.digest[hit], ids[first + s.row[hit]]))
            g, d, i = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
            by = np.lexsort((i, d, g))
            g, d, i = g[by], d[by], i[by]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            # a stretch that the batch has for several documents is marked: it is shared, wherever else it is found
            many = np.add.reduceat(np.concatenate([[False], (~new[1:]) & (i[1:] != i[:-1])]).astype(np.int64), np.nonzero(new)[0]) > 0 if len(g) else np.zeros(0, bool)
            yield pa.record_batch([_i64(g[new]), _i64(d[new]), _i64(i[new]), pa.array(many)], names=["anchor", "digest", "doc_id", "many"])

    return rows.select("doc_id", "text").mapInArrow(run, "anchor long, digest long, doc_id long, many boolean")


def _shared(digests: DataFrame) -> DataFrame:
    """(anchor, digest, first, many, several) of stretches that matter: found in several documents (many), or one of several of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last stretch: it is known to be one of several only when the next one comes
        schema = ["anchor", "digest", "first", "many", "several"]

        def out(g, d, i, many, several):
            keep = many | several
            return pa.record_batch([_i64(g[keep]), _i64(d[keep]), _i64(i[keep]), pa.array(many[keep]), pa.array(several[keep])], names=schema)

        for b in batches:
            g, d, i, x = (np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)), b.column(3).to_numpy(zero_copy_only=False))
            if not len(g):
                continue
            more = np.zeros(len(g), bool)
            if held:
                g, d, i, x = (np.concatenate([[held[k]], v]) for k, v in enumerate((g, d, i, x)))
                more = np.concatenate([[held[4]], more])
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
            at = np.nonzero(new)[0]
            last = np.maximum.reduceat(i, at)
            many = np.logical_or.reduceat(x, at) | (last > i[at])
            several = np.logical_or.reduceat(more, at)
            gs = g[at]
            several[1:] |= gs[1:] == gs[:-1]
            several[:-1] |= gs[1:] == gs[:-1]
            held = (gs[-1], d[at][-1], i[at][-1], bool(many[-1]), bool(several[-1]))
            if len(at) > 1:
                yield out(gs[:-1], d[at][:-1], i[at][:-1], many[:-1], several[:-1])
        if held:
            yield out(*(np.array([v]) for v in held))

    return digests.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc_id").mapInArrow(run, "anchor long, digest long, first long, many boolean, several boolean")


def _key_bit(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    return _bit(mix(mix(anchor.view(U)) + digest.view(U)) + doc.view(U), bits)


def _masks(rows: DataFrame, wanted, bits: int, hot, hot_bits: int) -> DataFrame:
    """(anchor, digest, doc_id, mask): for stretches of anchors with several, which of their strings a smaller document holds too.

    Stretches are looked for where their first document holds them; what the filters let through besides changes nothing.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, split = np.frombuffer(wanted.value, dtype=np.uint8), np.frombuffer(hot.value, dtype=np.uint8)
        names = ["key", "anchor", "digest", "doc_id", "left", "raw"]

        def out(key, s, one, doc, back, lo, hi, buf):
            for a in range(0, len(one), 1 << 20):
                p = slice(a, a + (1 << 20))
                yield pa.record_batch([_i64(key[p]), _i64(s.anchor[one[p]]), _i64(s.digest[one[p]]), _i64(doc[p]), pa.array(back[p].astype(np.int32)), _slices(buf, lo[p], hi[p])], names=names)

        for b in batches:
            ids = np.asarray(b.column(0))
            for first, _, buf, s in _stretches(b, 1):
                doc = ids[first + s.row]
                hit = np.nonzero(bloom.holds(have, _key_bit(s.anchor, s.digest, doc, bits)))[0]
                hit = hit[np.lexsort((doc[hit], s.digest[hit], s.anchor[hit]))]
                new = np.ones(len(hit), bool)
                new[1:] = (s.anchor[hit[1:]] != s.anchor[hit[:-1]]) | (s.digest[hit[1:]] != s.digest[hit[:-1]])
                hit = hit[new]
                often = bloom.holds(split, _bit(s.anchor[hit], hot_bits))
                one = hit[~often]
                yield from out(s.anchor[one], s, one, doc[one], (s.at - s.lo)[one], s.lo[one], s.hi[one] + s.length, buf)
                if often.any():  # a string each, keyed by its own hash
                    one = hit[often]
                    n = s.hi[one] - s.lo[one] + 1
                    of = np.repeat(one, n)
                    at = np.repeat(s.lo[one] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    back = s.at[of] - at
                    key = mix(range_hash(prefix_hashes(buf), at, at + s.length) + back.astype(U))
                    yield from out(key, s, of, doc[of], back, at, at + s.length, buf)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        known = 0
        for b in batches:
            if held is not None:
                known = len(held)
                b = pa.concat_batches([held, b])
            raw = b.column(5)
            off = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            buf = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if len(raw) else np.zeros(0, np.uint8)
            key, doc = np.asarray(b.column(0)), np.asarray(b.column(3))
            mask, fresh = first_holders(buf, off[:-1] - off[0], np.diff(off), np.asarray(b.column(4)).astype(np.int64), key, doc)
            told = np.nonzero((mask != 0) & (np.arange(len(key)) >= known))[0]
            if len(told):
                yield pa.record_batch([b.column(1).take(pa.array(told)), b.column(2).take(pa.array(told)), b.column(3).take(pa.array(told)), pa.array(mask[told])], names=["anchor", "digest", "doc_id", "mask"])
            # rows that bring no new string are not needed to judge later ones
            held = b.take(pa.array(np.nonzero(fresh & (key == key[-1]))[0])) if len(key) else None
            known = 0

    schema = "key long, anchor long, digest long, doc_id long, left int, raw binary"
    found = rows.select("doc_id", "text").mapInArrow(pick, schema).repartition("key").sortWithinPartitions("key", "doc_id")
    return found.mapInArrow(sort, "anchor long, digest long, doc_id long, mask long").groupBy("anchor", "digest", "doc_id").agg(F.bit_or("mask").alias("mask"))


def _occurrences(rows: DataFrame, twice, bits: int) -> DataFrame:
    """(anchor, digest, doc_id, text_key, at, full) of stretches whose anchor may repeat; full has a bit for each of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(twice.value, dtype=np.uint8)
        for b in batches:
            ids, keys = np.asarray(b.column(0)), np.asarray(b.column(2))
            for first, before, _, s in _stretches(b, 1):
                i = np.nonzero(bloom.holds(have, _bit(s.anchor, bits)))[0]
                row = first + s.row[i]
                full = (np.int64(1) << (s.at - s.lo + 1)[i]) - (np.int64(1) << (s.at - s.hi)[i])
                at = s.at[i] - s.begin[s.row[i]] + np.where(s.row[i] == 0, before, 0)
                yield pa.record_batch([_i64(s.anchor[i]), _i64(s.digest[i]), _i64(ids[row]), _i64(keys[row]), pa.array(at.astype(np.int32)), pa.array(full)], names=["anchor", "digest", "doc_id", "text_key", "at", "full"])

    return rows.select("doc_id", "text", "text_key").mapInArrow(run, "anchor long, digest long, doc_id long, text_key long, at int, full long")


def removal_lists(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, cuts): places of anchors and bits of the strings to remove, of every document that loses any."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    bits = bloom.bits_for(docs.count(), BITS_PER_DOC, LEAST_BITS, MOST_BITS)
    rows = docs.select("doc_id", "text", "text_key")
    twice = share(bloom.twice_seen(_anchor_notes(rows.select("text"), bits), bits))
    shared = scratch.write(_shared(_digests(rows, twice, bits)))
    scratch.free()
    several = shared.where("several")
    own = bloom.bits_for(several.count(), BITS_PER_STRETCH, LEAST_BITS, MOST_BITS)

    def filled(keys: DataFrame, place, bits: int):
        """A filter of all keys: each is noted twice."""

        def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = [place(*(np.asarray(c) for c in b.columns), bits).astype(np.uint32) for b in batches]
            yield from bloom.notes([np.repeat(x, 2) for x in seen], bits)

        return share(bloom.twice_seen(keys.mapInArrow(note, bloom.NOTES), bits))

    wanted = filled(several.select("anchor", "digest", "first"), _key_bit, own)
    # a filter too: an anchor that is split without need gives the same answer
    hot = filled(several.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), lambda a, bits: _bit(a.view(U), bits), LEAST_BITS)
    masks = scratch.write(_masks(rows, wanted, own, hot, LEAST_BITS))
    scratch.free()
    known = shared.join(masks.withColumnRenamed("doc_id", "first"), ["anchor", "digest", "first"], "left").where("many or mask is not null").select("anchor", "digest", "first", F.coalesce("mask", F.lit(0)).alias("mask"))
    known = scratch.write(known)
    scratch.drop(shared, masks)
    scratch.free()
    found = _occurrences(rows, twice, bits).join(known.hint("merge"), ["anchor", "digest"])
    found = found.select("doc_id", "text_key", "at", F.when(F.col("doc_id") > F.col("first"), F.col("full")).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    lists = scratch.write(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "mask")).alias("cuts")))
    del found
    scratch.drop(known)
    scratch.free()
    return lists


def without(buf: np.ndarray, off: np.ndarray, row: np.ndarray, at: np.ndarray, mask: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(bytes that stay, number of those that go, number of their runs) of texts in buf from the strings to remove: bits of mask, by how far they start before `at`."""
    n = len(buf)
    on = np.zeros(n + 1, dtype=np.int64)
    for k in range(0, len(at), 1 << 18):
        p = slice(k, k + (1 << 18))
        bits = np.unpackbits(np.ascontiguousarray(mask[p]).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : LENGTH - GRAM + 1]
        which, back = np.nonzero(bits)
        start = (off[row[p]] + at[p])[which] - back
        on += np.bincount(start, minlength=n + 1)
        on -= np.bincount(start + LENGTH, minlength=n + 1)
    gone = np.cumsum(on[:n]) > 0
    fresh = gone.copy()
    first = np.zeros(n + 1, bool)
    first[off] = True
    fresh[1:] &= ~gone[:-1] | first[1:n]
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
    stay = np.concatenate([[0], np.cumsum(~gone)])[off].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(stay), pa.py_buffer(buf[~gone])]), count(gone), count(fresh)


def substring_dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text, further columns) with __kept, the bytes that stay, __n_bytes, __n_removed and __n_spans.

    Texts count as UTF-8 bytes, null as empty. Strings are judged on the input: each byte goes that a string of LENGTH bytes covers which also starts in a
    document with a smaller doc_id; a null doc_id is the smallest. Rows that repeat a doc_id do not remove each other's strings. Texts shorter than LENGTH stay.
    """
    docs = plain(docs)
    names = docs.columns
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id")
    text_key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    lists = removal_lists(docs.select(doc, F.coalesce("text", F.lit("")).alias("text"), text_key), scratch)
    lists = lists.withColumnsRenamed({"doc_id": "__doc", "text_key": "__text_key", "cuts": "__cuts"})
    rows = docs.withColumns({"__doc": doc, "__text_key": text_key}).join(lists, ["__doc", "__text_key"], "left")
    at = names.index("text")
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    fields += [T.StructField(f"c{len(names)}", T.BinaryType()), *(T.StructField(f"c{len(names) + i}", T.LongType()) for i in (1, 2, 3))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_buffer(b.column(at))
            cuts = b.column(len(names))
            for i, j in steps(off, 4 * STEP):
                c = cuts.slice(i, j - i)
                x = c.flatten()
                row = np.repeat(np.arange(j - i), np.nan_to_num(c.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                kept, lost, spans = without(buf[off[i] : off[j]], off[i : j + 1] - off[i], row, np.asarray(x.field("at")), np.asarray(x.field("mask")))
                cols = [*(v.slice(i, j - i) for v in b.columns[: len(names)]), kept, *(pa.array(v, pa.int64()) for v in (np.diff(off[i : j + 1]), lost, spans))]
                yield pa.record_batch(cols, names=[f"c{k}" for k in range(len(cols))])

    safe = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*names, "__cuts"])])
    return safe.mapInArrow(run, T.StructType(fields)).toDF(*names, "__kept", "__n_bytes", "__n_removed", "__n_spans")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes, how many go, in how many runs, and the SHA-256 of the rest."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


# texts as hexadecimal digits, two a byte; cut into pieces first, so that a string is found in a short text
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2098) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS i FROM d)),
s AS (SELECT doc_id, i + j AS p, substr(piece, 2 * j + 1, 100) AS string FROM (SELECT doc_id, i, piece, unnest(range(0, least(length(piece) // 2 - 49, 1000))) AS j FROM c)),
o AS (SELECT string, min(doc_id) AS first FROM s GROUP BY string HAVING count(*) > 1),
r AS (SELECT s.doc_id, p, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS fresh FROM s JOIN o USING (string) WHERE first < s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY p)),
g AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (SELECT * FROM g UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d)),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS kept, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k JOIN d USING (doc_id)
"""
