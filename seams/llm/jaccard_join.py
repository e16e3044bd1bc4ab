"""Exact join of documents by the Jaccard similarity of their word shingles: a size-aware heavy-light join.

A document's set is its distinct 5-word shingles (lower-cased ASCII); sets that are
equal form a class. Two classes link when 100 x intersection >= 75 x union, and a
component is what links reach. Each class has a prefix of its set in one global
order, shingles common in many classes last, then by hash: as linked sets share
at least three quarters of either, they share a shingle within the first
n - ceil(3n/4) + 1 places of both, and two within one place more.

Shared prefix shingles are found by one shuffle of the prefixes; shingles of a single
class go no further. What is left is joined by size:
  light classes (small sets) enumerate the 2-subsets of their shared prefix shingles and
    meet the other light ones that have a subset in common;
  heavy classes (large sets) scan the inverted lists of their prefix shingles, and so
    meet all classes.
The boundary is the size at which the sum of subsets to enumerate below it and of list
entries to scan above it is least, from the measured counts.

A list (or subset) of at most MOST classes gives its pairs. Of a longer one the centre is the class with the largest
part of its prefix shared, and each class is dealt to the group of the centre c that most of its long lists have. A
long list gives the pairs of different groups only, of those that sizes and the counts of shingles in long
lists allow. Inside a group all members x are compared with c, and
x differs from c in the set D(x). As x and y link if and only if their symmetric difference is at most a seventh of the sum of
their sizes, and D(x) and D(y) have that symmetric difference too, members that link with c need no
pair of their own, and a member that does not link with c can only link with a y that shares at least
(|D(x)| + |D(y)| - (|x| + |y|) / 7) / 2 > 0 shingles of D. So the search goes on with the prefixes of the
differences, where all that the group has in common is gone, and copies of a copy, which share a large part of their
differences, are dealt to groups of their own again, up to LEVELS times. No link is lost.
Links of a group's members to its centre cost its size, not its square.

Nulls and empty texts: no set, a component of their own (doc_id itself). A null doc_id has the
least id of its component, if that has any. Repeated rows are copies. Ties between centres go to the larger hash. Texts are
read whole, whatever their length; other columns of the documents are not looked at. No documents: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.llm import textcore as tc
from seams.llm.graph import components
from seams.llm.store import materialize, scratch

WORDS = 5
PERCENT = 75
#: A shingle in more than 1 / COMMON of the classes of some chunk is a candidate for the end of the order.
COMMON = 512
#: Bound of the common shingles that tasks are told; others keep their place by hash.
MOST_COMMON = 200_000
CHUNK = 1 << 21
#: Keys into which the pairs of one class are dealt, so that its set goes to at most as many places.
PARTS = 256
#: The longest list that gives all its pairs.
MOST = 16
#: The part of a class's prefix that must lie in long lists of one centre for the class to be in its group.
LIKELY = 0.25
#: Groups are dealt anew, by differences, so often.
LEVELS = 4
BROADCAST_ROWS = 1_000_000
#: What forming and shuffling a subset costs, in list entries scanned (which are met in a row and seldom leave it).
SUBSET_COST = 3


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text."""
    data, off = tc.utf8(column)
    for lo, raw, at in tc.blocks(data, off):
        h, _, _, row = tc.word_hashes(raw, at, tc.SPACE)
        first = tc.bounds(row, len(at) - 1).tolist()
        g = tc.grams(h, WORDS)
        for i in range(len(at) - 1):
            a, z = first[i], first[i + 1]
            yield lo + i, np.unique(g[a : z - WORDS + 1] if z - a >= WORDS else tc.grams(h[a:z], z - a) if z > a else h[:0])


def _sig(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text"), F.xxhash64("doc_id", "text").alias("row_key"))


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: (doc_id, row_key, n, sig) of each document; kind 1: a shingle (sig) common in n classes of a chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "doc_id", "row_key", "n", "sig"]

    def common(held: dict[int, np.ndarray], like: pa.Array) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
        often = n >= max(3, len(held) / COMMON)
        token, n = token[often], n[often]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), like.type), pa.nulls(len(n), pa.int64()), pa.array(n.astype(np.int64)), pa.array(token.view(np.int64))], names)

    def run(batches):
        held, size, like = {}, 0, None
        for batch in batches:
            like = batch.column(0)
            n, sig = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in shingle_sets(batch.column(1)):
                n[i], sig[i] = len(s), _sig(s)
                if int(sig[i]) not in held:
                    held[int(sig[i])] = s
                    size += len(s)
                if size >= CHUNK:
                    yield common(held, like)
                    held, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), like, batch.column(2), pa.array(n), pa.array(sig)], names)
        if held:
            yield common(held, like)

    return _text(docs, "doc_id").mapInArrow(run, f"kind int, doc_id {kind}, row_key bigint, n bigint, sig bigint")


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(token, sig, n, place, often) of the first n - ceil(3n/4) + 2 shingles of each set of three or more; copies within a task count once. often: it is in common."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    names = ["token", "sig", "n", "place", "often"]

    def batch_of(rows: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
        size = [len(t) for t, _, _, _ in rows]
        place = np.concatenate([np.arange(k, dtype=np.int32) for k in size])
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([t for t, _, _, _ in rows]).view(np.int64)),
            pa.array(np.repeat(np.array([s for _, s, _, _ in rows], np.int64), size)),
            pa.array(np.repeat(np.array([n for _, _, n, _ in rows], np.int32), size)),
            pa.array(place),
            pa.array(place >= np.repeat(np.array([r for _, _, _, r in rows], np.int64), size)),
        ], names)

    def run(batches):
        late, seen, rows, size = shared.value, set(), [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                n = len(s)
                if n < 3 or (sig := _sig(s)) in seen:
                    continue
                seen.add(sig)
                rare = n
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s, rare = np.concatenate([s[~last], s[last]]), n - int(last.sum())
                rows.append((s[: n - (3 * n + 3) // 4 + 2], sig, n, rare))
                size += len(rows[-1][0])
                if size >= 1 << 17:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return docs.select("text").mapInArrow(run, "token bigint, sig bigint, n int, place int, often boolean")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, items) of the classes whose rows wanted (row_key) names; a row that is repeated gives its class again."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    names = ["sig", "items"]

    def packed(rows):
        off = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([s for _, s in rows]).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), items], names)

    def run(batches):
        seen = set()
        for batch in batches:
            rows, size = [], 0
            for _, s in shingle_sets(batch.column(0)):
                if (sig := _sig(s)) not in seen:
                    seen.add(sig)
                    rows.append((sig, s))
                    size += len(s)
                if size >= 1 << 18:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return _text(docs).join(wanted, "row_key", "left_semi").select("text").mapInArrow(run, "sig bigint, items array<bigint>")


def _with(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with columns of rows (sig) for both sides, those of b with a 2.

    Only rows in pairs are moved: one for each pair's b, to where the row of a waits once for many.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    once = pairs.select("a", "part").distinct()
    if pairs.count() <= BROADCAST_ROWS:
        pairs, once = F.broadcast(pairs), F.broadcast(once)
    x = rows.select(F.col("sig").alias("a"), *columns).join(once, "a")
    y = rows.select(F.col("sig").alias("b"), *[F.col(c).alias(f"{c}2") for c in columns]).join(pairs, "b")
    return x.join(y, ["a", "part"])


def _may(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs of fitting sizes that share enough of their prefixes.

    Of the last prefix shingles of both take the one that is first in the order. All shingles up
    to it are in both prefixes; behind it one set has n less its prefix, so the intersection
    is at most what the prefixes share and the larger of these rests.
    """
    both = _with(pairs, heads.select("sig", "n", F.col("t.token").alias("t")), "n", "t")
    return both.where(_enough(F.size(F.array_intersect("t", "t2")), F.col("n"), F.col("n2"))).select("a", "b", "how")


def _enough(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b that share so many prefix shingles may link."""
    rest = lambda n: F.floor((3 * n + 3) / 4) - 2
    return _fits(a, b) & (7 * (shared + F.greatest(rest(a), rest(b))) >= 3 * (a + b))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b, how) that link, as edges (u, v, how).

    A sieve of 16 bits of each shingle goes first: sets share at most the 16-bit values that both have and
    as many more as the one with fewer has shingles beyond its distinct values.
    """
    thin = sets.select("sig", F.size("items").cast("long").alias("n"), F.expr("array_distinct(transform(items, x -> cast(shiftright(shiftleft(x, 48), 48) as smallint)))").alias("w"))
    both = _with(pairs, thin, "n", "w")
    most = F.size(F.array_intersect("w", "w2")) + F.least(F.col("n") - F.size("w"), F.col("n2") - F.size("w2"))
    good = materialize(both.where(100 * most >= PERCENT * (F.col("n") + F.col("n2") - most)).select("a", "b", "how"), "jaccard-pairs")
    both = _with(good, sets, "items")
    met = both.select("a", "b", "how", F.size(F.array_intersect("items", "items2")).cast("long").alias("i"), (F.size("items") + F.size("items2")).cast("long").alias("s"))
    return met.where(100 * F.col("i") >= PERCENT * (F.col("s") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"), "how")


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) once, the lesser class first, with the first way it was found."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "how").groupBy("a", "b").agg(F.min("how").alias("how"))


def boundary(heads: DataFrame) -> int:
    """The largest size of a light class."""
    band = F.floor(F.log2("n") * 4).cast("int")
    entries = heads.select(band.alias("band"), F.explode("t.token").alias("token")).groupBy("token", "band").agg(F.count("*").alias("k"))
    scans = entries.withColumn("m", F.sum("k").over(W.partitionBy("token"))).groupBy("band").agg(F.sum(F.col("k") * F.least("m", F.lit(MOST))).alias("scan"))  # longer lists are scanned through their centre
    k = F.size("t").cast("long")
    subsets = heads.groupBy(band.alias("band")).agg(F.sum(SUBSET_COST * k * (k - 1) / 2).alias("subsets"), F.max("n").alias("top"))
    costs = sorted(subsets.join(scans, "band").collect())  # a row for each quarter of a power of two
    best, least = 2, sum(r.scan for r in costs)
    for i, r in enumerate(costs):
        cost = sum(x.subsets for x in costs[: i + 1]) + sum(x.scan for x in costs[i + 1 :])
        if cost < least:
            best, least = r.top, cost
    return best


def groups(heads: DataFrame, light: int) -> DataFrame:
    """(k1, k2, sig, n, s, heavy): members of subsets (k1, k2) of light classes and of lists (k1, 0); light classes have up to `light` shingles."""
    s = F.size("t").alias("s")
    few = heads.where(F.col("n") <= light).select("sig", "n", s, F.expr("array_sort(transform(t, x -> x.token))").alias("t"))
    subsets = few.select("sig", "n", "s", F.expr("inline(flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> struct(x as k1, y as k2)))))"))
    lists = heads.select("sig", "n", s, F.explode("t").alias("x")).where(F.col("x.place") < F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1)
    lists = lists.select(F.col("x.token").alias("k1"), F.lit(0).cast("long").alias("k2"), "sig", "n", "s", (F.col("n") > light).alias("heavy"))
    return lists.unionByName(subsets.withColumn("heavy", F.lit(False)))


def _fits(a: Column, b: Column) -> Column:
    return (4 * F.least(a, b)) >= (3 * F.greatest(a, b))


def _prefix(n: Column) -> Column:
    """Places within which linked sets share a shingle."""
    return n - F.floor((3 * n + 3) / 4) + 1


def _lists(members: DataFrame) -> DataFrame:
    """members with m, the number of members of the list, and c and nc, its centre and that one's size."""
    weight = F.least(F.col("s") / _prefix(F.col("n")), F.lit(1.0))
    lists = members.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.max("heavy").alias("any"), F.max(F.struct(weight.alias("w"), "sig", "n")).alias("c")).where("m > 1 and (any or k2 <> 0)")
    return members.join(lists.select("k1", "k2", "m", F.col("c.sig").alias("c"), F.col("c.n").alias("nc")), ["k1", "k2"])


def _short(lists: DataFrame) -> DataFrame:
    """Pairs (a, b, how) of the lists and subsets of at most MOST members, by sizes and counts of shared prefix shingles."""
    rows = lists.where(F.col("m") <= MOST).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("sig", "n", "s", "heavy"))).alias("x"))  # at most MOST
    pairs = rows.select("k2", F.explode(F.expr("flatten(transform(x, (p, i) -> transform(slice(x, i + 2, size(x)), q -> struct(p as p, q as q))))")).alias("z"))
    pairs = pairs.select("k2", "z.p", "z.q").where(_enough(F.least("p.s", "q.s"), F.col("p.n"), F.col("q.n")) & ((F.col("k2") != 0) | F.col("p.heavy") | F.col("q.heavy")))
    return pairs.select(F.col("p.sig").alias("a"), F.col("q.sig").alias("b"), F.when(F.col("k2") != 0, "light").otherwise("heavy").alias("how"))


def _dealt(lists: DataFrame) -> DataFrame:
    """(a, b): the centre and each member of its group."""
    long = lists.where((F.col("m") > MOST) & (F.col("sig") != F.col("c")) & (2 * F.least("n", "nc") >= F.greatest("n", "nc")))
    often = long.groupBy("sig", "n", "c").agg(F.count("*").alias("k")).where(F.col("k") >= LIKELY * _prefix(F.col("n")))
    return often.groupBy("sig").agg(F.max(F.struct("k", "c")).alias("x")).select(F.col("x.c").alias("a"), F.col("sig").alias("b"))


def _across(lists: DataFrame, dealt: DataFrame) -> DataFrame:
    """Pairs (a, b, how) of long lists that are not in one group.

    Shared shingles beyond those of long lists are at most the last place of either prefix: with another one the pair is in a short list.
    """
    rows = lists.where(F.col("m") > MOST).join(dealt.select(F.col("b").alias("sig"), F.col("a").alias("of")), "sig", "left")
    in_long = F.count_if(F.col("k2") == 0).over(W.partitionBy("sig")) + 2  # at most a prefix each
    rows = rows.select("k1", "k2", "sig", "n", "heavy", F.coalesce("of", "sig").alias("of"), F.when(F.col("k2") == 0, F.least(in_long, "s")).otherwise(F.col("s")).alias("s"))
    x, y = rows.alias("x"), rows.alias("y")
    met = (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")) & (F.col("x.sig") < F.col("y.sig")) & (F.col("x.of") != F.col("y.of"))
    good = _enough(F.least("x.s", "y.s"), F.col("x.n"), F.col("y.n")) & ((F.col("x.k2") != 0) | F.col("x.heavy") | F.col("y.heavy"))
    return x.join(y, met & good).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.when(F.col("x.k2") != 0, "light").otherwise("heavy").alias("how"))


def _stars(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, sig, n, d, out, first, pre) of pairs (a: centre, b: member): the member's size and that of its difference from the centre, whether they do not link,
    the length of the difference's prefix for partners that do not link with the centre, and the prefix itself, for members that do not link of the length for all partners.

    Shingles that the centre lacks come first: they are rarer in a group than those it lacks itself.
    """
    both = _with(wanted, sets, "items")
    both = both.select(F.col("a").alias("c"), F.col("b").alias("sig"), F.size("items2").alias("n"), F.size("items").alias("nc"), F.concat(F.array_except("items2", "items"), F.array_except("items", "items2")).alias("diff"))
    both = both.withColumn("d", F.size("diff")).withColumn("out", 7 * F.col("d") > F.col("n") + F.col("nc"))
    # Shared shingles of differences: 14 x shared >= 7d + 7d' - n - n'. A partner that does not link has 7d' - n' > nc; any has n' <= nc + d' and d' >= shared.
    first = F.col("d") - F.floor((7 * F.col("d") + F.col("nc") - F.col("n")) / 14)
    any_ = F.col("d") - F.greatest(F.ceil((7 * F.col("d") - F.col("n") - F.col("nc")) / 8), F.lit(1)) + 1
    return both.select("c", "sig", "n", "d", "out", first.cast("int").alias("first"), F.slice("diff", 1, F.when(F.col("out"), F.greatest(first, any_)).otherwise(first).cast("int")).alias("pre"))


def _apart(stars: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, how) that may link though one of them does not link with their centre, and the groups (a: centre, b) inside groups, whose own pairs are left out."""
    rows = stars.select("c", "sig", "n", "d", "out", "first", F.size("pre").alias("size"), F.posexplode("pre").alias("pos", "token"))
    lists = rows.groupBy("c", "token").agg(F.count("*").alias("m"), F.count_if("out").alias("outs"), F.min(F.struct("d", "sig")).alias("x")).where("m > 1 and outs > 0")
    rows = materialize(rows.join(lists.select("c", "token", (F.col("outs") * F.col("m") > MOST * MOST).alias("many"), F.col("x.sig").alias("centre")), ["c", "token"]), "jaccard-differences")
    often = rows.where("many and sig <> centre").groupBy("sig", "size", "centre").agg(F.count("*").alias("k")).where(F.lit(not last) & (F.col("k") >= LIKELY * F.col("size")))
    long = materialize(often.groupBy("sig").agg(F.max(F.struct("k", "centre")).alias("x")).select(F.col("x.centre").alias("a"), F.col("sig").alias("b")), "jaccard-members")
    rows = rows.join(long.select(F.col("b").alias("sig"), F.col("a").alias("of")), "sig", "left").withColumn("of", F.coalesce("of", "sig"))
    x, y = rows.where("out").alias("x"), rows.alias("y")
    f = lambda k: (F.col(f"x.{k}"), F.col(f"y.{k}"))
    (px, py), (dx, dy), (nx, ny), (fx, fy) = f("pos"), f("d"), f("n"), f("first")
    roles = (py < fy) & (~F.col("y.out") | ((F.col("x.sig") < F.col("y.sig")) & (px < fx)))
    enough = 7 * (dx + dy) - nx - ny <= 14 * (1 + F.least(dx - 1 - px, dy - 1 - py))
    pairs = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.of") != F.col("y.of")) & roles & enough & _fits(nx, ny))
    return pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.lit("other").alias("how")), long


def links(docs: DataFrame, described: DataFrame, light: int | None = None) -> DataFrame:
    """Edges (u, v, how) between classes (sig) whose components are those of all links. how: found by light or heavy classes, by a list's centre, or otherwise."""
    common = described.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig").limit(MOST_COMMON).select("sig").toPandas().sig.to_numpy(np.int64)
    postings = prefixes(docs, np.sort(common.view(np.uint64)))
    # A shingle that is common anywhere is taken as shared, and its postings are spread; the others have few.
    by = W.partitionBy("key")
    postings = postings.withColumn("key", F.when(F.col("often"), F.xxhash64("token", "sig")).otherwise(F.col("token")))
    shared = postings.withColumn("lo", F.min("sig").over(by)).withColumn("hi", F.max("sig").over(by)).where("often or lo < hi").select("key", "token", "sig", "n", "place").distinct()
    heads = shared.groupBy("sig").agg(F.first("n").alias("n"), F.collect_list(F.struct("token", "place")).alias("t")).where("size(t) > 1")  # at most a prefix each; linked sets share two places
    heads = materialize(heads, "jaccard-prefixes")
    members = groups(heads, boundary(heads) if light is None else light)
    lists = materialize(_lists(members), "jaccard-lists")
    long = materialize(_dealt(lists), "jaccard-members")
    pairs = materialize(_once(_short(lists).unionByName(_across(lists, long))), "jaccard-pairs")
    pairs = materialize(_may(pairs, heads), "jaccard-pairs")
    wanted = pairs.select("a", "b").unionByName(long).select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = materialize(_fetch(docs, described, wanted), "jaccard-sets")
    edges, level = None, 0
    while long.limit(1).count():
        level += 1
        stars = materialize(_stars(long, sets), "jaccard-stars")
        met = stars.where("not out").select(F.col("c").alias("u"), F.col("sig").alias("v"), F.lit("centre").alias("how"))
        edges = met if edges is None else edges.unionAll(met)
        more, long = _apart(stars, level == LEVELS)
        pairs = pairs.unionByName(more)
    if level:
        pairs = materialize(_once(pairs), "jaccard-pairs")
    found = _verified(pairs, sets)
    return materialize(found if edges is None else edges.unionByName(found), "jaccard-links")


def _fetch(docs: DataFrame, described: DataFrame, wanted: DataFrame) -> DataFrame:
    keys = described.where("kind = 0").groupBy("sig").agg(F.min("row_key").alias("row_key")).join(wanted, "sig", "left_semi").select("row_key")
    return full_sets(docs, materialize(keys, "jaccard-wanted"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n_shingles, sig) of each document, and (sig, root) of the classes with a link."""
    described = materialize(describe(docs), "jaccard-documents")
    with scratch(docs.sparkSession):
        edges = links(docs, described).select("u", "v")
        comp = components(edges, keep=1).withColumnRenamed("node", "sig")
    return described.where("kind = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "sig"), comp


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document. docs: doc_id, text."""
    one, comp = _classes(docs.select("doc_id", "text"))
    one = one.drop("row_key")
    classes = one.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(comp, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(roots, "root").select("sig", "component_id")
    out = one.join(named, (one.sig == named.sig) & (one.n_shingles > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs' rows of which each component keeps one: that of its least doc_id (null ids last), then of its least row_key.

    A doc_id tells no rows apart: different texts of one id stay unless they link. Rows without a set stay,
    repeated ones (the same id and text) once; with a null doc_id all of them, as nothing shows that they are repeated.
    """
    one, comp = _classes(docs.select("doc_id", "text"))
    least = lambda c: F.min(c).alias("first")
    classes = one.where("n_shingles > 0").groupBy("sig").agg(least(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row_key"))).join(comp, "sig", "left")
    kept = classes.groupBy(F.coalesce("root", "sig").alias("root")).agg(least("first")).select(F.col("first.row_key").alias("__key"))
    bare = one.where("n_shingles = 0")
    found = kept.unionAll(bare.where("doc_id is not null").select("row_key").distinct())
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    alone = keyed.where("doc_id is null").join(bare.where("doc_id is null").select(F.col("row_key").alias("__key")).distinct(), "__key", "left_semi")
    return keyed.join(found, "__key", "left_semi").dropDuplicates(["__key"]).unionByName(alone).select(*docs.columns)
