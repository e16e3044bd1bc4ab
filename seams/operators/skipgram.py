"""Skip-grams with negative samples (Mikolov et al. 2013) for vocabularies that no single process holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that one copy of the vectors is trained on, most words of a step, negative samples of a step and their weight, rate.
STRETCH = 2_000_000
STEP, NEGATIVES, WEIGHT, RATE = 2048, 32, 5.0, 0.1


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[first], np.add.reduceat(values[order], first)


def _descend(vectors: np.ndarray, squares: np.ndarray, rows: np.ndarray, slopes: np.ndarray) -> None:
    """One step of AdaGrad with one rate a row."""
    at, slope = _sums(rows, slopes)
    squares[at] += (slope * slope).mean(1)
    vectors[at] += RATE * slope / np.sqrt(squares[at] + 1e-8)[:, None]


def start(seeds: np.ndarray, size: int) -> np.ndarray:
    """The first vector of each word, from its 64-bit hash: the same in every stretch."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)


def train(ids: np.ndarray, sentence: np.ndarray, vectors: np.ndarray, window: int, rounds: int, seed: int) -> None:
    """Moves the vectors of words; ids: the words of the stretch, sentence: the number of the sentence of each."""
    rng = np.random.default_rng(seed)
    step, n = min(max(len(ids) // 200, 64), STEP), len(ids)
    shares = np.bincount(ids, minlength=len(vectors)) ** 0.75
    shares = np.cumsum(shares / shares.sum())
    out, squares, squares_out = np.zeros_like(vectors), np.zeros(len(vectors), np.float32), np.zeros(len(vectors), np.float32)
    for _ in range(rounds):
        for lo in range(0, n, step):
            # the words of the step, and as many as the window around them
            first, hi = max(lo - window, 0), min(lo + step, n)
            at = slice(first, min(hi + window, n))
            own, line = ids[at], sentence[at]
            reach = np.zeros(len(own), int)
            reach[lo - first : hi - first] = rng.integers(1, window + 1, hi - lo)
            x, y = vectors[own], out[own]
            to_x, to_y, pairs = np.zeros_like(x), np.zeros_like(y), np.zeros(len(own), np.float32)
            for d in range(1, min(window + 1, len(own))):
                near = line[d:] == line[:-d]
                for centre, context in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                    told = (near & (reach[centre] >= d)).astype(np.float32)
                    told_by = (told / (1 + np.exp(np.einsum("ij,ij->i", x[centre], y[context]))))[:, None]
                    pairs[centre] += told
                    to_x[centre] += told_by * y[context]
                    to_y[context] += told_by * x[centre]
            none = np.minimum(np.searchsorted(shares, rng.random(NEGATIVES)), len(vectors) - 1)
            z = out[none]
            miss = (-WEIGHT / NEGATIVES) * pairs[:, None] / (1 + np.exp(-(x @ z.T)))
            _descend(vectors, squares, own, to_x + miss @ z)
            _descend(out, squares_out, np.concatenate([own, none]), np.concatenate([to_y, miss.T @ x]))


def vectors(sentences: DataFrame, size: int, window: int, rounds: int, seed: int) -> DataFrame:
    """sentences (words) -> (word, v): trained in stretches of text side by side, each from the same start.

    The vectors of a word are averaged over the stretches by its occurrences in each (Zinkevich et al. 2010). A task
    holds the words of one stretch, the driver none.
    """

    def learn(parts: list[pa.Array]) -> pa.RecordBatch:
        words = pa.chunked_array(parts).combine_chunks()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(words).dictionary_encode()
        ids, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        hashes = np.array([hash_of(w) for w in names.to_pylist()], np.uint64)
        own = start(hashes, size)
        train(ids, np.repeat(np.arange(len(lengths)), lengths), own, window, rounds, seed)
        flat = pa.array(own.ravel())
        return pa.RecordBatch.from_arrays([names, pa.array(np.bincount(ids, minlength=len(names)).astype(np.float64)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), flat)], ["word", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            column = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(column):  # rows up to the end of the stretch, one at least
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + STRETCH - count, "right")))
                held.append(column.slice(lo, hi - lo))
                count += int(ends[hi - 1] - before)
                lo = hi
                if count >= STRETCH:
                    yield learn(held)
                    held, count = [], 0
        if count:
            yield learn(held)

    learnt = sentences.select("words").mapInArrow(run, "word string, n double, v array<float>")
    mean = [(F.sum(F.col("v")[i] * F.col("n")) / F.sum("n")) for i in range(size)]
    return learnt.groupBy("word").agg(F.array(*mean).alias("v"))


def hash_of(word: str) -> int:
    """64 bits of a word, the same in every process."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
