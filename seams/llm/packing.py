"""Packing token sequences by minimum bin slack.

A document's ids, and the id 0 that ends it, are cut into pieces of CAPACITY ids
and one shorter rest. Full pieces are sequences of their own. The rests are packed by
minimum bin slack over the histogram of their lengths: a window opens with the longest
length left; subset sums over the remaining multiset of lengths (a bitset of CAPACITY
bits, counts split into powers of two) give the fill closest to CAPACITY, and walking
the bitsets back gives how often each length is used. A fill is repeated as often as
the counts allow, so the plan has at most some thousand rows however many documents
there are, and only the histogram (under CAPACITY numbers) reaches the driver. A rest
finds its place from its rank among the rests of its length, which is counted by
salted groups.

Nulls: a null text is empty and packs as its end id alone; a null doc_id is a document like others. Repeated rows pack as
separate documents. Texts are cut to ids whole, whatever their length. Of fills of equal slack (ties) the one with longer lengths is
taken; rests of equal length are ranked by salt, doc_id, start and checksum, and equal rows in any order. Only doc_id and text are read, so
other columns may have any names. No documents: no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.llm.store import materialize

CAPACITY = 1024
#: Rows of one rank group.
GROUP = 100_000


#: How a byte-level tokenizer cuts texts into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def plain_bytes(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE without a normalizer, prefix space or other rules, and its ids are the ranks of its merges."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and spec.get("normalizer") is None
    plain &= model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", ())}
    bytes_ = sorted(i for t, i in model["vocab"].items() if len(t) == 1 and t not in special)[:256]
    first = len(bytes_) + (bytes_[0] if bytes_ else 0)
    return plain and len(bytes_) == 256 and all(model["vocab"].get(m.replace(" ", "")) == first + i for i, m in enumerate(merges))


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from a text to its ids: those of the tokenizers library for the same file.

    Where the file is of the plain kind (`plain_bytes`), texts go through tiktoken, built from the file's own vocabulary,
    which gives the same ids several times faster; other files, and texts that hold a special token's string, take the library itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not plain_bytes(spec):
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = [t["content"] for t in spec.get("added_tokens", ())]
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            take, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.array([*encode(t.as_py() or ""), 0], "<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    take.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names)

    return source.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, opened by the longest, whose sum is closest to capacity."""
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == first), room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            n = min(step, left)
            stages.append((length, n, reach))
            reach |= reach << (length * n) & mask
            left -= n
            step *= 2
    at = reach.bit_length() - 1
    fill = {first: 1}
    for length, n, before in reversed(stages):
        if not before >> at & 1:
            fill[length] = fill.get(length, 0) + n
            at -= length * n
    return fill


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a sequence, first sequence, offset)."""
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        fill = best_fill(left, capacity)
        times = min(left[k] // n for k, n in fill.items())
        offset = 0
        for k, n in sorted(fill.items(), reverse=True):
            rows.append((k, used[k], used[k] + n * times, n, sequence, offset))
            used[k] += n * times
            offset += n * k
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    cut = materialize(pieces(docs, tokenizer, capacity=capacity, **columns), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by: dict[int, list[tuple[int, ...]]] = {}
    for length, *row in plan(counts, capacity):
        by.setdefault(length, []).append(tuple(row))
    where = {k: np.array(sorted(v), np.int64) for k, v in by.items()}
    salts = max(8, sum(counts.values()) // GROUP)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1).join(offsets, ["length", "salt"])
    kind = cut.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                rows = where[k][np.searchsorted(where[k][:, 0], rank[at], "right") - 1]
                inside = rank[at] - rows[:, 0]
                sequence[at] = rows[:, 3] + inside // rows[:, 2]
                offset[at] = rows[:, 4] + inside % rows[:, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("rank") + F.col("skip")).cast("long").alias("rank")).mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
