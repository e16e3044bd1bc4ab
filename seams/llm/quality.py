"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose ratio exceeds a cutoff. Per stratum (a
language) the labelled holdout decides how strict a cutoff may be: walking a
fixed grid from lenient to strict, a cutoff is certified while the exact binomial
test rejects "its false rejection rate is above alpha / rules", i.e. while
P(Bin(n, alpha / rules) <= clean documents rejected) <= delta / (rules x strata).
The walk stops at the first failure (fixed-sequence testing), the division of
delta is Bonferroni's, so with probability 1 - delta all cutoffs hold together and
no stratum loses more than alpha of its clean documents to the rules. Of the
certified cutoffs the one with the best `bad rate - cost x clean rate` is taken; a
stratum with too few labels to certify any cutoff rejects nothing by rule.

Nulls: a null text has no words; a null stratum is a stratum of its own. Repeated
rows are judged alike, texts whole whatever their length. A ratio equal to its cutoff (a tie) is not rejected; of cutoffs of equal value
the more lenient one is taken. Columns of docs may have any names, those of results too. No documents: no rows; no labels: no rule
but the base. Labels that are repeated count once per document, as clean
if any says so; null labels and null ids are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seams.llm.store import materialize

SEPARATORS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")

#: Rule -> (ratio, cutoffs from lenient to strict).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "capitals": ("n_capitals / word_chars", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "exclaims": ("n_exclaims / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.2, 0.1)),
}


def count_text(text: str) -> tuple[int, ...]:
    """The STATS of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    chars = len(raw.translate(None, SEPARATORS + _CONTINUATION))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    lines = dup = 0
    seen = set()
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) < len(windows):
        often = {k for k, n in Counter(windows).items() if n > 1}
        free = 0
        for i, k in enumerate(windows):
            if k in often:
                repeat += i + 3 - max(i, free)
                free = i + 3
    return len(w), chars, symbols, dup, repeat, lines, capitals, raw.count(b"!")


def with_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`keep` (all columns by default) of docs and the STATS of its text as longs."""
    names = list(docs.columns if keep is None else keep)
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    schema = source.drop("__text")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema), *(f"__{s} bigint" for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_text(t or "") for t in batch.column(len(names)).to_pylist()]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *counts], [*names, *(f"__{s}" for s in STATS)])

    return source.mapInArrow(run, fields)


def ratio(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.col(f"__{over}") / F.greatest(F.col(f"__{under}"), F.lit(1))


def certified(n: int, k: int, alpha: float, delta: float) -> bool:
    """Whether P(Bin(n, alpha) <= k) <= delta: the exact upper bound at level delta is at most alpha."""
    if n <= 0 or k >= n * alpha:
        return False
    term, total = n * math.log1p(-alpha), 0.0
    ratio_ = math.log(alpha) - math.log1p(-alpha)
    for i in range(k + 1):
        total += math.exp(term)
        if total > delta:
            return False
        term += math.log(n - i) - math.log(i + 1) + ratio_
    return True


def choose(clean: list[int], bad: list[int], n_clean: int, n_bad: int, cutoffs: tuple[float, ...], alpha: float, delta: float, cost: float) -> float | None:
    """The cutoff for one rule in one stratum; None where the rule rejects nothing."""
    best, value = None, 0.0
    for cut, k, b in zip(cutoffs, clean, bad):
        if not certified(n_clean, k, alpha, delta):
            break
        gain = b / max(n_bad, 1) - cost * k / n_clean
        if gain > value:
            best, value = cut, gain
    return best


def calibrate(stats: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, cost: float = 5.0, doc_id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """One row per stratum: `stratum`, and `cut_<rule>` (null: the rule rejects nothing there).

    stats: `with_stats` rows. labels: doc_id, quality (1 clean, 0 bad).
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__quality"))
    known = stats.join(marks, F.col(f"`{doc_id}`") == F.col("__id")).select(F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"), (F.col("__quality") > 0).alias("ok"), *[ratio(r).alias(r) for r in RULES])
    counts = [F.array(*[F.count_if((F.col("ok") == ok) & (F.col(r) > c)) for c in RULES[r][1]]).alias(f"{r}_{int(ok)}") for r in RULES for ok in (True, False)]
    table = materialize(known.groupBy("stratum").agg(F.count_if("ok").alias("n_1"), F.count_if(~F.col("ok")).alias("n_0"), *counts), "quality-holdout")
    strata = max(1, table.count())
    level = delta / (len(RULES) * strata)
    share = alpha / len(RULES)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = {"stratum": pa.array([r["stratum"] for r in rows], pa.string())}
            for name, (_, cutoffs) in RULES.items():
                out[f"cut_{name}"] = pa.array([choose(r[f"{name}_1"], r[f"{name}_0"], r["n_1"], r["n_0"], cutoffs, share, level, cost) for r in rows], pa.float64())
            yield pa.RecordBatch.from_pydict(out)

    return materialize(table.mapInArrow(run, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)), "quality-cutoffs")


#: Cutoffs of more strata than this are joined by a shuffle.
BROADCAST_STRATA = 10_000


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """stats with `base_failed` and `kept`."""
    small = cutoffs.withColumnRenamed("stratum", "__stratum")
    if cutoffs.count() <= BROADCAST_STRATA:
        small = F.broadcast(small)
    out = stats.join(small, F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) == F.col("__stratum"), "left")
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    ruled_out = F.lit(False)
    for r in RULES:
        ruled_out = ruled_out | F.coalesce(ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~ruled_out).drop("__stratum", *[f"cut_{r}" for r in RULES])


def verdicts(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document."""
    stats = materialize(with_stats(docs, keep=("doc_id", "lang")), "quality-stats")
    out = judge(stats, calibrate(stats, labels, **how))
    return out.select("doc_id", *[F.col(f"__{s}").alias(s) for s in STATS], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, with docs' columns."""
    names = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # as columns of any name may be there
    place = {c: f"c{names.index(c)}" for c in ("doc_id", "lang", "text")}
    stats = materialize(with_stats(renamed, place["text"]), "quality-stats")
    kept = judge(stats, calibrate(stats, labels, doc_id=place["doc_id"], stratum=place["lang"], **how), place["lang"]).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
