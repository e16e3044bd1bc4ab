"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes, with a symbol beyond the bytes for
both ends of a text. A symbol is coded in the longest context that training has seen;
where it is new there, an escape (method C: as likely as the context has distinct
symbols) leads to the context one byte shorter, in which the symbols of the longer one
are excluded; below the empty context all symbols not seen are equally likely. `score`
is the log10 probability of a text with its end.

Two modes. Adaptive (`code_lengths(..., adaptive=True)`, `Trie`): each document is coded by what came
before in it. Pretrained (`score_documents`): the trie is gathered from all training
documents, as counts of (ORDER + 1)-grams; contexts nest, so counts of all orders follow
from them, and with exclusion the probability of a gram needs only, per context, its total, its
number of symbols, and the total of these symbols one order down. Grams are valued in
buckets of those that share their last three context bytes, as many buckets as their number asks for; the counts of order 2 are
joined to the buckets whose grams end in them, and orders 1 and 0 (at most 257 x 257 numbers)
are told to all tasks. Base scores come from word counts gathered likewise.

Neither table is broadcast, as both grow with the corpus. Documents are dealt into chunks
of some megabytes of text; a chunk asks for the distinct words and grams that it
holds, these requests are joined with the tables, and each chunk is scored with its answers.

Nulls: a null text is empty (its end alone is scored). A null doc_id is not held out. Repeated rows
are scored alike, and each is learnt from. Without training documents all symbols are
equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seams.llm import textcore as tc
from seams.llm.store import materialize

ORDER = 4
END = 256
SYMBOLS = 257
BITS = 9
CHUNK_BYTES = 24 << 20
BLOCK = 1 << 22
#: Buckets in which grams are valued, at least, and the grams that one has on average, at most.
BUCKETS, BUCKET_GRAMS = 64, 1 << 18
WORD, GRAM, DOCS, BYTES = 0, 1, 2, 3
_HELD = 1 << 22


class Trie:
    """Counts of contexts of up to `order` symbols, with costs by method C and exclusion."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple[int, ...], dict[int, int]] = {}

    def add(self, past: tuple[int, ...], symbol: int) -> None:
        for k in range(self.order + 1):
            own = self.counts.setdefault(past[len(past) - k :], {})
            own[symbol] = own.get(symbol, 0) + 1

    def log10(self, past: tuple[int, ...], symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            own = {s: n for s, n in self.counts.get(past[len(past) - k :], {}).items() if s not in excluded}
            if not own:
                continue
            total = sum(own.values()) + len(own)
            if symbol in own:
                return out + math.log10(own[symbol] / total)
            out += math.log10(len(own) / total)
            excluded |= own.keys()
        return out - math.log10(SYMBOLS - len(excluded))

    def steps(self, text: bytes) -> Iterator[tuple[tuple[int, ...], int]]:
        past = (END,) * self.order
        for s in (*text, END):
            yield past, s
            past = (*past, s)[1:] if self.order else ()

    def learn(self, text: bytes) -> None:
        for past, s in self.steps(text):
            self.add(past, s)

    def score(self, text: bytes, adaptive: bool = False) -> float:
        out = 0.0
        for past, s in self.steps(text):
            out += self.log10(past, s)
            if adaptive:
                self.add(past, s)
        return out


def gram_keys(raw: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Key of each symbol with its context, ends included, and the first one of each row."""
    rows = len(off) - 1
    size = np.diff(off) + order + 1  # ends before, the text, an end
    begin = np.cumsum(size) - size
    seq = np.full(int(size.sum()), END, np.int64)
    seq[np.arange(len(raw)) + np.repeat(begin + order - off[:-1], np.diff(off))] = raw
    n = len(seq) - order
    key = np.zeros(max(n, 0), np.int64)
    for j in range(order + 1):
        key = key << BITS | seq[j : j + n]
    at = np.arange(rows) * order
    inside = np.ones(n, bool)
    gaps = (begin[1:] - order)[:, None] + np.arange(order)
    inside[gaps.ravel()] = False
    return key[inside], begin - at


def doc_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first one of each row and the end."""
    h, _, _, row = tc.word_hashes(raw, off, tc.SPACE)
    return h.view(np.int64), tc.bounds(row, len(off) - 1)


class Tally:
    """Counts by key, kept small by summing up what was added."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
        codes, unique = pd.factorize(keys)
        self.keys.append(unique)
        self.counts.append(np.bincount(codes, weights, len(unique)).astype(np.int64))
        self.size += len(unique)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, unique = pd.factorize(np.concatenate(self.keys))
        counts = np.bincount(codes, np.concatenate(self.counts), len(unique)).astype(np.int64)
        self.keys, self.counts, self.size = [unique], [counts], len(unique)
        return unique, counts


def gather(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, key, n): training counts of words and grams (those of held-out documents with 0), of documents; bytes of all. docs: held_out, text."""
    names = ["kind", "key", "n"]

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names)

    def run(batches):
        tallies = {WORD: Tally(), GRAM: Tally()}
        trained = size = 0
        for batch in batches:
            learnt = ~np.array(batch.column(0).to_pylist(), bool)
            data, off = tc.utf8(batch.column(1))
            trained += int(learnt.sum())
            size += int(off[-1] - off[0])
            for lo, raw, at in tc.blocks(data, off, BLOCK):
                own = learnt[lo : lo + len(at) - 1]
                key, first = gram_keys(raw, at, order)
                tallies[GRAM].add(key, np.repeat(own, np.diff(np.append(first, len(key)))).astype(np.int64))
                h, first = doc_words(raw, at)
                tallies[WORD].add(h[np.repeat(own, np.diff(first))])
            for kind, t in tallies.items():
                if t.size > _HELD and len(t.summed()[0]) > _HELD // 2:
                    yield rows(kind, *t.summed())
                    tallies[kind] = Tally()
        for kind, t in tallies.items():
            yield rows(kind, *t.summed())
        yield rows(DOCS, np.zeros(1, np.int64), np.array([trained]))
        yield rows(BYTES, np.zeros(1, np.int64), np.array([size]))

    return docs.select("held_out", "text").mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_values(key: np.ndarray, n: np.ndarray, low: np.ndarray, order: int = ORDER, two: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each gram. low[c, s]: training counts of s after c; two: keys and counts of order 2.

    All grams that share the last three context symbols are there, and two has all that share the last two; without two, grams do.
    """
    zero = low.sum(0)
    # what a level gives each gram: count, and of its context total, distinct symbols, total of these one order down
    levels = []
    for k in range(order, -1, -1):
        sub = key & ((1 << (BITS * (k + 1))) - 1)
        if k == 2 and two is not None:
            levels.append((two[0], pd.Index(two[0]).get_indexer(sub), two[1]))
        elif k >= 2:
            code, unique = pd.factorize(sub)
            count = np.bincount(code, n, len(unique)).astype(np.int64)
            levels.append((unique, code, count))
        elif k == 1:
            levels.append((None, None, low))
        else:
            levels.append((None, None, zero))
    symbol, last = key & 511, key >> BITS & 511
    seen = low > 0
    value = np.zeros(len(key))
    done = np.zeros(len(key), bool)
    over_n = over_d = np.zeros(len(key), np.int64)  # of the order above: the total, at this order, of its symbols, and their number
    for i, k in enumerate(range(order, -1, -1)):
        if k >= 2:
            unique, code, count = levels[i]
            context, place = np.unique(unique >> BITS, return_inverse=True)
            total = np.bincount(place, count, len(context)).astype(np.int64)
            distinct = np.bincount(place, count > 0, len(context)).astype(np.int64)
            below = unique & ((1 << (BITS * k)) - 1)
            if k > 2:
                found = pd.Index(levels[i + 1][0]).get_indexer(below)
                below_n = levels[i + 1][2][found]
            else:
                below_n = low[below >> BITS, below & 511]
            carried = np.bincount(place, np.where(count > 0, below_n, 0), len(context)).astype(np.int64)
            own, N, D, R = count[code], total[place][code], distinct[place][code], carried[place][code]
        elif k == 1:
            own, N, D, R = low[last, symbol], low.sum(1)[last], seen.sum(1)[last], (seen @ zero)[last]
        else:
            own, N, D, R = zero[symbol], np.full(len(key), zero.sum()), np.full(len(key), (zero > 0).sum()), over_n
        left_n, left_d = N - over_n, D - over_d
        whole = left_n + left_d
        at = ~done & (left_d > 0)
        hit = at & (own > 0)
        value[hit] += np.log10(own[hit] / whole[hit])
        done |= hit
        miss = at & ~hit
        value[miss] += np.log10(left_d[miss] / whole[miss])
        over_n, over_d = R, D
    rest = SYMBOLS - int((zero > 0).sum())
    value[~done] -= math.log10(max(rest, 1))
    return value


def _valued(counts: DataFrame, order: int, size: int) -> DataFrame:
    """(key, value) of all grams, of which there are `size`."""
    grams = counts.where(F.col("kind") == GRAM)
    one, pair, triple = ((1 << k * BITS) - 1 for k in (1, 2, 3))
    low = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for r in grams.groupBy(F.col("key").bitwiseAND(F.lit(pair)).alias("pair")).agg(F.sum("n").alias("n")).collect():  # at most 257 x 257 rows
        low[r.pair >> BITS, r.pair & one] = r.n
    shared = counts.sparkSession.sparkContext.broadcast(low)
    after = F.shiftright("key", BITS)
    end = after.bitwiseAND(F.lit(pair))
    own = grams.select("key", "n", F.pmod(F.hash(after.bitwiseAND(F.lit(triple)) if order > 2 else end), F.lit(max(BUCKETS, size // BUCKET_GRAMS))).alias("bucket"), end.alias("pair"))
    two = grams.groupBy(F.col("key").bitwiseAND(F.lit(triple)).alias("two")).agg(F.sum("n").alias("n")).withColumn("pair", F.shiftright("two", BITS))
    two = own.select(F.col("bucket").alias("of"), "pair").distinct().join(two, "pair").select("of", "two", "n")

    def run(table, ends):
        key, n = (table.column(c).to_numpy() for c in ("key", "n"))
        held = tuple(ends.column(c).to_numpy() for c in ("two", "n"))
        return pa.table({"key": pa.array(key), "value": pa.array(gram_values(key, n, shared.value, order, held))})

    return own.select("bucket", "key", "n").groupBy("bucket").cogroup(two.groupBy("of")).applyInArrow(run, "key bigint, value double")


def _requests(chunks: DataFrame, order: int) -> DataFrame:
    """(chunk, kind, key): the distinct words and grams of each chunk."""

    def run(key, table):
        tallies = {WORD: Tally(), GRAM: Tally()}
        for part in table.to_batches():
            data, off = tc.utf8(part.column(part.schema.get_field_index("text")))
            for _, raw, at in tc.blocks(data, off, BLOCK):
                tallies[WORD].add(doc_words(raw, at)[0])
                tallies[GRAM].add(gram_keys(raw, at, order)[0])
        keys = {k: t.summed()[0] for k, t in tallies.items()}
        kinds = np.repeat(np.array(list(keys), np.int32), [len(v) for v in keys.values()])
        return pa.table({"chunk": pa.array(np.full(len(kinds), key[0].as_py(), np.int64)), "kind": pa.array(kinds), "key": pa.array(np.concatenate(list(keys.values())))})

    return chunks.groupBy("chunk").applyInArrow(run, "chunk bigint, kind int, key bigint")


def held_out(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_documents(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document. docs: doc_id, text."""
    if not 2 <= order <= 6:
        raise ValueError("order must be from 2 to 6: keys have 63 bits")
    docs = docs.select("doc_id", (held_out() if held is None else held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(gather(docs, order), "lm-counts")
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("distinct"), F.count("*").alias("rows")).collect()}
    trained = sums[DOCS].n if DOCS in sums else 0
    words = sums[WORD] if WORD in sums else None
    N = (words.n if words else 0) + trained
    V = (words.distinct if words else 0) + (trained > 0)
    under = N + 0.1 * (V + 1)
    unknown, end = math.log10(0.1 / under), math.log10((trained + 0.1) / under)
    values = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("kind", "key", F.log10((F.col("n") + 0.1) / F.lit(under)).alias("value"))
    values = values.unionByName(_valued(counts, order, sums[GRAM].rows if GRAM in sums else 0).select(F.lit(GRAM).alias("kind"), "key", "value"))
    size = sums[BYTES].n if BYTES in sums else 0
    n_chunks = max(1, -(-size // chunk_bytes), min(12, size >> 21))
    chunks = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("long").alias("chunk"), "doc_id", "held_out", "text")
    answers = _requests(chunks, order).join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(own, known):
        tables = {}
        which = known.column("kind").to_numpy()
        for k in (WORD, GRAM):
            at = which == k
            key, value = known.column("key").to_numpy()[at], known.column("value").to_numpy()[at]
            tables[k] = pd.Index(key), np.append(value, unknown)  # the last is for what is not there

        def look(kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            index, value = tables[kind]
            codes, unique = pd.factorize(keys)
            at = index.get_indexer(unique)
            return value[at][codes], (at >= 0)[codes]

        def summed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
            return total[first[1:]] - total[first[:-1]]

        out = []
        for part in own.to_batches():
            n = part.num_rows
            tokens, in_train, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            data, off = tc.utf8(part.column(part.schema.get_field_index("text")))
            for lo, raw, at in tc.blocks(data, off, BLOCK):
                hi = lo + len(at) - 1
                h, first = doc_words(raw, at)
                value, there = look(WORD, h)
                tokens[lo:hi] = np.diff(first) + 1
                in_train[lo:hi] = summed(there.astype(np.int64), first) + (trained > 0)
                base[lo:hi] = summed(value, first) + end
                key, first = gram_keys(raw, at, order)
                value, there = look(GRAM, key)
                if not there.all():
                    raise ValueError("a chunk holds grams that were not valued")
                score[lo:hi] = np.add.reduceat(value, first)
            out.append(pa.table({"doc_id": part.column(part.schema.get_field_index("doc_id")), "held_out": part.column(part.schema.get_field_index("held_out")), "n_tokens": tokens, "n_known": in_train, "train_tokens": np.full(n, N), "base_score": base, "score": score}))
        if not out:
            return pa.table({c: own.column(c) for c in ("doc_id", "held_out")} | {"n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, fields)


def code_lengths(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id and bits: the adaptive code length of each document, by a trie that starts empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bits = [-Trie(order).score((t or "").encode(), adaptive=True) / math.log10(2) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64())], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bits double")
