"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of LENGTH = 100 bytes that covers it also starts
earlier: in a smaller doc_id, or before it in the same document. Buckets of equal
strings are refined from short strings to long ones, and a bucket of one is dropped as
soon as it shows:

1. Initial buckets are 32-grams, but only at anchors: the gram of least hash in each
   100-byte window. Windows that share their anchor lie side by side and form a run, of which
   one row is shuffled by the anchor's gram; equal windows have equal grams there.
2. Each bucket is refined by the bytes that its whole run covers. Of equal runs the first
   stays and the others are removed whole. A run whose gram is in one run only has no equal window.
3. What is left are runs that share a gram but differ somewhere, at the ends of repeats. A
   window reaches 34 bytes or more to the left of its gram or to its right, so buckets of the
   gram with 34 bytes to either side drop the windows that no other run can share. For the rest `bucket_pointers` refines q-gram buckets of all positions, 8 bytes long, by the
   buckets of later offsets to 16, 32, 64 and 100 bytes, each level reusing the last, and the
   first of each bucket meets those of other tasks by the hash of its 100 bytes.

Tasks settle repeats among their own rows first and shuffle only the first of them, so
a string in a third of all documents costs each bucket a row per task.

Nulls: a null text is empty. Where a doc_id is null or repeated, documents are its
distinct texts: null ids come last, texts of one id in the order of their hash, and rows
equal in both are one document and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.llm import textcore as tc
from seams.llm.store import materialize

LENGTH, GRAM = 100, 32
SIDE = (LENGTH - GRAM) // 2
_AT = np.uint64(24)
_REST = np.uint64((1 << 15) - 1)
_HELD = 1 << 20


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, start of each within its row): blocks of rows; a long row in parts that overlap."""
    for lo, raw, at in tc.blocks(data, off):
        if len(raw) <= 2 * tc.BLOCK:
            yield raw, at, np.arange(lo, lo + len(at) - 1), np.zeros(len(at) - 1, np.int64)
        else:
            for a in range(0, len(raw) - LENGTH + 1, tc.BLOCK):
                part = raw[a : a + tc.BLOCK + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([lo]), np.array([a])


def runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, own, row, start, sides) of each run: windows start..start+more of a row share their anchor.

    own: 48 bits of the hash of all its bytes, 7 of more, 7 of the anchor's place after start,
    and a bit that is 0. sides: 16 bits each of the hashes of the gram with SIDE bytes to its left and right.
    """
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    prefix = tc.sums(raw)
    i = np.arange(len(raw) - GRAM + 1)
    h = tc.span_hashes(prefix, i, i + GRAM)
    order = h >> _AT << _AT | i.astype(np.uint64)
    anchor = (_least(order, LENGTH - GRAM + 1) & np.uint64((1 << int(_AT)) - 1)).astype(np.int64)
    row = np.searchsorted(off, np.arange(n), "right") - 1
    inside = np.arange(n) + LENGTH <= off[row + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    context = tc.mix(tc.span_hashes(prefix, first, last + LENGTH) + (last - first).astype(np.uint64))
    place = anchor[first]
    own = context & ~_REST | (last - first).astype(np.uint64) << np.uint64(8) | (place - first).astype(np.uint64) << np.uint64(1)
    begin, end = off[row[first]], off[row[first] + 1]
    left = tc.span_hashes(prefix, np.maximum(place - SIDE, begin), place + GRAM)
    right = tc.span_hashes(prefix, place, np.minimum(place + GRAM + SIDE, end))
    low = np.uint64(0xFFFF)
    sides = ((left & low) << np.uint64(16) | right & low).astype(np.int64)
    return h[place], own, row[first], first - begin, sides


def _first_of(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its key by (doc, start)."""
    order = np.lexsort((start, doc, key))
    head = np.ones(len(key), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), bool)
    out[order] = head
    return out


def _run_rows(docs: DataFrame) -> DataFrame:
    """(gram, own, doc, at) of all runs: `runs` values, at = start << 32 | sides; the last bit of own: an earlier equal one is in the same task."""
    names = ["gram", "own", "doc", "at"]

    def settle(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, own, doc, at = (np.concatenate(c) for c in zip(*held))
        again = ~_first_of(gram ^ own, doc, at)
        gram = np.where(again, tc.mix(own + at.astype(np.uint64) * tc._GOLD + doc.astype(np.uint64)), gram)  # of no bucket any more: spread them
        own = own | again.astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(own.view(np.int64)), pa.array(doc), pa.array(at)], names)

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = tc.utf8(batch.column(1))
            for raw, at, row, shift in segments(data, off):
                gram, own, mine, start, sides = runs(raw, at)
                if len(gram):
                    held.append((gram, own, ids[row[mine]], (start + shift[mine]) << 32 | sides))
                    size += len(gram)
                if size >= _HELD:
                    yield settle(held)
                    held, size = [], 0
        if size:
            yield settle(held)

    return docs.mapInArrow(rows, "gram bigint, own bigint, doc bigint, at bigint")


def bucket_pointers(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = 8) -> np.ndarray:
    """Bucket of the `length` bytes at each place of `at`: equal for equal strings only.

    Initial buckets are the gram-byte strings at all positions. A level pairs the bucket of a
    position with the bucket at a later offset, as found so far; positions of which either
    is alone in its bucket are not sorted again.
    """
    n = len(data) - gram + 1
    key = np.zeros(n, np.uint64)
    for j in range(gram):
        key = key << np.uint64(8) | data[j : j + n]
    bucket, size = np.unique(key, return_inverse=True, return_counts=True)[1:]
    alone = size[bucket] == 1
    have = gram
    while have < length:
        step = min(have, length - have)
        m = len(bucket) - step
        live = np.flatnonzero(~alone[:m] & ~alone[step:])
        fresh = np.arange(m) + len(data)  # of those that are alone now: a number of their own
        lone = np.ones(m, bool)
        if len(live):
            pair = bucket[live].astype(np.int64) * (2 * len(data) + 1) + bucket[live + step]
            _, again, count = np.unique(pair, return_inverse=True, return_counts=True)
            fresh[live] = again
            lone[live] = count[again] == 1
        bucket, alone, have = fresh, lone, have + step
    return bucket[at]


def _edge_rows(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Windows of the runs in edges: (code, doc, at), at = start << 32 | again << 31 | bytes. again: bytes that repeat earlier ones of the same task; else a window."""
    names = ["code", "doc", "at"]
    listed = edges.groupBy("doc").agg(F.collect_list(F.struct("start", "more")).alias("runs"))  # at most one for each of a document's bytes

    def settle(parts: list[tuple[int, int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        data = np.concatenate([p[2] for p in parts])
        begin = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
        count = np.array([p[3] for p in parts]) + 1
        part = np.repeat(np.arange(len(parts)), count)
        inner = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[part] + inner
        doc = np.array([p[0] for p in parts], np.int64)[part]
        start = np.array([p[1] for p in parts], np.int64)[part] + inner
        first = _first_of(bucket_pointers(data, at), doc, start)
        code = tc.span_hashes(tc.sums(data), at, at + LENGTH)
        # repeats, side by side: one row for each stretch
        r = np.flatnonzero(~first)
        cut = np.ones(len(r), bool)
        cut[1:] = (part[r[1:]] != part[r[:-1]]) | (start[r[1:]] != start[r[:-1]] + 1)
        head = r[cut]
        tail = r[np.append(cut[1:], True)] if len(r) else r
        f = np.flatnonzero(first)
        code = np.concatenate([code[f], tc.mix(code[head] + start[head].astype(np.uint64) * tc._GOLD + doc[head].astype(np.uint64))])
        packed = np.concatenate([start[f] << 32 | LENGTH, start[head] << 32 | 1 << 31 | start[tail] - start[head] + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.concatenate([doc[f], doc[head]])), pa.array(packed)], names)

    def rows(batches):
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = tc.utf8(batch.column(1))
            for i, own in enumerate(batch.column(2)):
                if own.is_valid:
                    s, m = (own.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    for a, more in sorted(zip(s.tolist(), m.tolist())):
                        parts.append((int(ids[i]), a, data[off[i] + a : off[i] + a + more + LENGTH], more))
                        size += more + LENGTH
                        if size >= 1 << 21:
                            yield from settle(parts)
                            parts, size = [], 0
        if parts:
            yield from settle(parts)

    return docs.join(listed, "doc").select("doc", "text", "runs").mapInArrow(rows, "code bigint, doc bigint, at bigint")


def spans(docs: DataFrame) -> DataFrame:
    """(doc, spans): stretches a..b of bytes to remove, in any order and overlapping. docs: doc bigint (unique, not null), text."""
    found = _run_rows(docs)
    context = F.shiftright("own", 1)  # with more and the anchor's place, which depend on the bytes
    found = found.withColumn("context", context).withColumn("again", F.col("own") % 2 != 0)
    bucket = W.partitionBy("gram")
    found = found.withColumn("lo", F.min("context").over(bucket)).withColumn("hi", F.max("context").over(bucket))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("gram", "context").orderBy("doc", "at"))).where("again or nth > 1 or lo < hi")
    repeat = F.col("again") | (F.col("nth") > 1)
    start, sides = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    more, place = F.shiftright("own", 8).bitwiseAND(F.lit(127)), F.shiftright("own", 1).bitwiseAND(F.lit(127))
    found = found.select("gram", "doc", start.alias("start"), more.alias("more"), place.alias("place"), repeat.alias("again"), F.shiftright(sides, 16).alias("left"), sides.bitwiseAND(F.lit(0xFFFF)).alias("right"))
    for side in ("left", "right"):
        found = found.withColumn(f"{side}s", F.count_if(~F.col("again")).over(W.partitionBy("gram", side)))
    # Windows up to place - SIDE hold the bytes left of the gram, those from there on the bytes right of it.
    middle = F.col("place") - SIDE
    lo = F.when(F.col("again") | (F.col("lefts") > 1), F.lit(0)).otherwise(F.greatest(middle, F.lit(0)))
    hi = F.when(F.col("again") | (F.col("rights") > 1), F.col("more")).otherwise(F.least(middle, F.col("more")))
    found = found.select("doc", "again", (F.col("start") + lo).cast("int").alias("start"), (hi - lo).cast("int").alias("more")).where("more >= 0")
    found = materialize(found, "repeat-runs")
    windows = _edge_rows(docs, found.where("not again"))
    again = F.shiftright("at", 31).bitwiseAND(F.lit(1)) == 1
    windows = windows.withColumn("nth", F.row_number().over(W.partitionBy("code").orderBy("doc", "at"))).where(again | (F.col("nth") > 1))
    begin = F.shiftright("at", 32)
    windows = windows.select("doc", begin.cast("int").alias("a"), (begin + F.col("at").bitwiseAND(F.lit((1 << 31) - 1))).cast("int").alias("b"))
    whole = found.where("again").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("more") + LENGTH).cast("int").alias("b"))
    return windows.unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most two for each of a document's bytes


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of each document once, and, unless doc is just doc_id, the (doc_id, doc) of each row.

    doc numbers rows in the order of (doc_id, null last, text hash), alike for equal rows only.
    """
    known = docs.where("doc_id is not null")
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte") and not docs.where("doc_id is null").limit(1).count() and not known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), None
    key = F.xxhash64("text")
    order = docs.select("doc_id", key.alias("key")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "key").withColumn("doc", F.monotonically_increasing_id())
    order = materialize(order, "repeat-order").withColumnRenamed("doc_id", "id_")
    docs = materialize(docs.join(order, F.col("doc_id").eqNullSafe(F.col("id_")) & (key == F.col("key"))).select("doc_id", "doc", "text"), "repeat-documents")
    return docs.select("doc", "text").dropDuplicates(["doc"]), docs.select("doc_id", "doc")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of each document. docs: doc_id, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, ids = _numbered(docs.select("doc_id", "text"))
    docs = docs.where("doc is not null")
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tc.utf8(batch.column(1))
            removed, pieces, sha, kept = [], [], [], []
            for i, own in enumerate(batch.column(2)):
                raw = data[off[i] : off[i + 1]]
                gone = pieces_ = 0
                if own.is_valid and len(own):
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, own.values.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, own.values.field(1).to_numpy(zero_copy_only=False), -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    pieces_ = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    raw = raw[~out]
                left = raw.tobytes()
                removed.append(gone)
                pieces.append(pieces_)
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])], names)

    fields = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    out = docs.join(spans(docs), "doc", "left").select("doc", "text", "spans").mapInArrow(cut, fields)
    if ids is not None:
        return ids.join(out, "doc").drop("doc")
    return out.withColumnRenamed("doc", "doc_id").withColumn("doc_id", F.col("doc_id").cast(kind))
