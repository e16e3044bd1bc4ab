"""Benchmark decontamination by winnowing.

Words are lower-case runs of ASCII letters and digits and of characters beyond
ASCII. A window is SPAN = 10 consecutive words of an item. The fingerprint of a
window is the least hash of its 6 five-word grams, so texts that share a window
share its fingerprint: every shared span of 10 words or more is found. Fingerprints
are joined, and each hit is extended word by word: all windows of the item in the
document are marked. An item of fewer words, but not none, is one window of its
own length, whose hash is its fingerprint.

Items reach the documents in one of two ways: while their texts are at most
BROADCAST_BYTES (their measured size), as an index in each task; beyond that,
document and item fingerprints are shuffled and joined, and only texts with common
fingerprints meet.

Nulls: a null text has no words; items with a null id or no words have no windows. A
repeated item counts once; repeated documents are judged alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seams.llm import textcore as tc
from seams.llm.store import materialize

SPAN, GRAM = 10, 5
BROADCAST_BYTES = 32 << 20
_SLOTS = 1 << 20
OUT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of k words within a row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
    return start, tc.grams(h, k)[start]


def _least(h: np.ndarray) -> np.ndarray:
    """For each run of SPAN words (of whichever rows) the least hash of its GRAM-grams."""
    g = tc.grams(h, GRAM)
    n = len(g) - (SPAN - GRAM)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, SPAN - GRAM + 1):
        np.minimum(out, g[j : j + n], out=out)
    return out


class Index:
    """Windows of items, by length, and the fingerprints of the full ones."""

    def __init__(self, items: list[tuple[object, str]]):
        by: dict[int, dict[int, set[str]]] = {}
        prints: set[int] = set()
        for item, text in items:
            if item is None or not text:
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _, _, row = tc.word_hashes(raw, np.array([0, len(raw)]), tc.NOT_ALNUM)
            k = min(len(h), SPAN)
            if k:
                for x in _windows(h, row, k)[1].tolist():
                    by.setdefault(k, {}).setdefault(x, set()).add(str(item))
                if k == SPAN:
                    prints.update(_least(h).tolist())
        self.items = by
        self.hashes = {k: np.array(sorted(v), np.uint64) for k, v in by.items()}
        self.prints = np.array(sorted(prints), np.uint64)
        self.maybe = np.zeros(_SLOTS, bool)
        self.maybe[(self.prints & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    @staticmethod
    def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), bool)
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

    def hits(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, number of words, items) of each window that is an item's."""
        for k in sorted(self.hashes):
            if k == SPAN:
                least = _least(h)
                at = np.flatnonzero(self.maybe[(least & np.uint64(_SLOTS - 1)).astype(np.int64)])
                at = at[self._among(least[at], self.prints)]
                at = at[row[at] == row[at + SPAN - 1]]
                code = np.zeros(len(at), np.uint64)
                for j in range(SPAN):
                    code = code * np.uint64(tc._BASE) + h[at + j]
                code = tc.mix(code + np.uint64(SPAN))
            else:
                at, code = _windows(h, row, k)
            found = self._among(code, self.hashes[k])
            for i, c in zip(at[found].tolist(), code[found].tolist()):
                yield i, k, self.items[k][c]


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _marks(column: pa.Array, index: Index) -> list[pa.Array]:
    """The OUT columns of a batch of texts."""
    data, off = tc.utf8(column)
    n = len(column)
    n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found: dict[int, set[str]] = {}
    for lo, raw, at in tc.blocks(data, off):
        h, _, _, row = tc.word_hashes(raw, at, tc.NOT_ALNUM)
        n_words[lo : lo + len(at) - 1] = np.bincount(row, minlength=len(at) - 1)
        hit = np.zeros(len(h) + 1, np.int64)
        for i, k, items in index.hits(h, row):
            hit[i] += 1
            hit[i + k] -= 1
            found.setdefault(lo + int(row[i]), set()).update(items)
        covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        n_hit[lo : lo + len(at) - 1] += np.bincount(row[covered], minlength=len(at) - 1)
    none = _digest(set())
    return [
        pa.array(n_words),
        pa.array(n_hit),
        pa.array([len(found.get(i, ())) for i in range(n)], pa.int64()),
        pa.array([_digest(found[i]) if i in found else none for i in range(n)], pa.string()),
        pa.array(n_hit > 0),
    ]


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (columns of these names are replaced)."""
    names = [c for c in docs.columns if c not in {x.split()[0] for x in OUT.split(", ")}]
    items = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("text")).where("item is not null and length(text) > 0").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _shuffled(docs, items, names, text)
    index = docs.sparkSession.sparkContext.broadcast(Index([(r.item, r.text) for r in items.collect()]))
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema), OUT])
    labels = [*names, *(x.split()[0] for x in OUT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_marks(batch.column(len(names)), index.value)], labels)

    return source.mapInArrow(run, fields)


def _prints(column: pa.Array, lengths: list[int] | None) -> Iterator[tuple[int, np.ndarray]]:
    """Row and distinct fingerprints of each text. lengths: of the short windows to look for; None: the texts are items."""
    data, off = tc.utf8(column)
    for lo, raw, at in tc.blocks(data, off):
        h, _, _, row = tc.word_hashes(raw, at, tc.NOT_ALNUM)
        first = tc.bounds(row, len(at) - 1)
        for i in range(len(at) - 1):
            own = h[first[i] : first[i + 1]]
            n = len(own)
            got = [_least(own)] if n >= SPAN else []
            for k in (lengths if lengths is not None else [n] if 0 < n < SPAN else []):
                if k <= n:
                    got.append(tc.mix(tc.grams(own, k) + np.uint64(k)))
            yield lo + i, np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def _shuffled(docs: DataFrame, items: DataFrame, names: list[str], text: str) -> DataFrame:
    """annotate() by a shuffled join of fingerprints."""

    def prints(lengths):
        def run(batches):
            for batch in batches:
                for i, p in _prints(batch.column(1), lengths):
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), batch.column(0).slice(i, 1).take(pa.array([0] * len(p)))], ["print", "key"])

        return run

    def count(batches):
        for batch in batches:
            data, off = tc.utf8(batch.column(0))
            for _, raw, at in tc.blocks(data, off):
                row = tc.words(tc.LOWER[raw], at, tc.NOT_ALNUM)[2]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.bincount(row, minlength=len(at) - 1)))], ["n"])

    lengths = sorted(r.n for r in items.select("text").mapInArrow(count, "n bigint").where(f"n > 0 and n < {SPAN}").distinct().collect())
    key = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    own = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    item_prints = items.select("item", "text").mapInArrow(prints(None), f"print bigint, key {kind}").withColumnRenamed("key", "item")
    doc_prints = own.mapInArrow(prints(lengths), "print bigint, key bigint")
    pairs = materialize(doc_prints.join(item_prints, "print").select("key", "item").distinct(), "winnow-pairs")
    texts = own.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    met = pairs.join(texts, "key").join(items.withColumnRenamed("text", "item_text"), "item").select("key", F.col("item").cast("string").alias("item"), "text", "item_text")

    def extend(batches):
        for batch in batches:
            out = {"key": [], "item": [], "at": [], "k": []}
            for r in batch.to_pylist():
                raw = np.frombuffer(r["text"].encode(), np.uint8)
                h, _, _, row = tc.word_hashes(raw, np.array([0, len(raw)]), tc.NOT_ALNUM)
                for i, k, _ in Index([(r["item"], r["item_text"])]).hits(h, row):
                    for x, v in zip(out, (r["key"], r["item"], i, k)):
                        out[x].append(v)
            yield pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.int64()), "item": pa.array(out["item"], pa.string()), "at": pa.array(out["at"], pa.int64()), "k": pa.array(out["k"], pa.int64())})

    spans = materialize(met.mapInArrow(extend, "key bigint, item string, at bigint, k bigint"), "winnow-spans")
    hit = spans.select("key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)).alias("w")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    which = spans.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("i")).select("key", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"))
    source = docs.select(*[F.col(f"`{c}`") for c in names], key.alias("__key"), F.col(f"`{text}`").alias("__text"))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema), "n_words bigint"])

    def counted(batches):
        for batch in batches:
            data, off = tc.utf8(batch.column(len(names) + 1))
            n = np.zeros(batch.num_rows, np.int64)
            for lo, raw, at in tc.blocks(data, off):
                n[lo : lo + len(at) - 1] = np.bincount(tc.words(tc.LOWER[raw], at, tc.NOT_ALNUM)[2], minlength=len(at) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], [*names, "__key", "n_words"])

    out = source.mapInArrow(counted, fields).join(hit.withColumnRenamed("key", "__key"), "__key", "left").join(which.withColumnRenamed("key", "__key"), "__key", "left")
    return out.select(*[F.col(f"`{c}`") for c in names], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any benchmark window, with docs' columns."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kept = annotate(renamed, benchmark, f"c{names.index('text')}").where("not contaminated")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
