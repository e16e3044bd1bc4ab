"""Text vectors of units and their similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.checkpoints import settle
from seams.operators import skipgram


#: Words up to this many are told to every task, as those a frequent pair of words can consist of.
MOST_WORDS = 500_000
_WORD = r"((?U)\w\w+)"


def _words(texts: DataFrame) -> DataFrame:
    """texts (unit, text) -> (unit, w): words of two characters or more, in lower case."""
    return texts.select("unit", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(1)).alias("w"))


def _steps(texts: DataFrame) -> DataFrame:
    """(unit, x, y): each word with the one after it, null after the last."""
    return _words(texts).select("unit", F.explode(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(0))).alias("y"))).alias("s")).select("unit", "s.x", "s.y")


def vocabulary(texts: DataFrame, max_features: int, least: int) -> DataFrame:
    """(term, x, y), settled: the max_features most frequent words x and pairs of words x y in a row, of `least` units or more. Ties of frequency are in the order of terms.

    A pair is not more frequent than either of its words, and not in more units. So pairs are counted only of words that reach the frequency
    of the last word among the first max_features, and only the frequency and whether there is a second unit are kept of a term
    (units are told apart by 64-bit hashes; where more than two are asked for, they are counted).
    """
    unit = F.xxhash64("unit")
    counted = [F.count("*").alias("cf"), *([F.min("u").alias("lo"), F.max("u").alias("hi")] if least <= 2 else [F.countDistinct("u").alias("df")])]
    enough = F.lit(True) if least <= 1 else F.col("lo") < F.col("hi") if least == 2 else F.col("df") >= least
    ones = settle(_words(texts).select(unit.alias("u"), F.explode("w").alias("x")).groupBy("x").agg(*counted).where(enough).select("x", "cf"))
    last = ones.orderBy(F.desc("cf")).limit(max_features).agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()  # one row
    bar = last.cf if last.n == max_features else 0
    frequent = ones.where(F.col("cf") >= bar)
    steps = _steps(texts).where("y is not null").select(unit.alias("u"), "x", "y")
    if frequent.count() <= MOST_WORDS:
        known = settle(frequent.coalesce(1).select("x", F.monotonically_increasing_id().alias("id")))
        i, j = (F.broadcast(known.select(F.col("x").alias(c), F.col("id").alias(k))) for c, k in (("x", "i"), ("y", "j")))
        pairs = steps.join(i, "x").join(j, "y").groupBy("i", "j").agg(*counted).where(enough & (F.col("cf") >= bar)).join(i, "i").join(j, "j")
    else:
        pairs = steps.groupBy("x", "y").agg(*counted).where(enough & (F.col("cf") >= bar))
    every = frequent.select(F.col("x").alias("term"), "x", F.lit(None).cast("string").alias("y"), "cf").unionAll(pairs.select(F.concat_ws(" ", "x", "y"), "x", "y", "cf"))
    return settle(every.orderBy(F.desc("cf"), "term").limit(max_features).select("term", "x", "y"))  # bounded by max_features


def tfidf(texts: DataFrame, max_features: int = 5000, min_df: int | None = None) -> DataFrame:
    """(unit, term, weight), settled: smooth idf, rows of length 1, over the max_features most frequent terms of min_df units or more.

    min_df is 2, or 1 with five units or fewer. Texts are read three times (words, pairs, the chosen terms of each unit),
    so that rare terms are never written or sent.
    """
    units = texts.select("unit").distinct().count()
    least = (1 if units <= 5 else 2) if min_df is None else min_df
    chosen = vocabulary(texts, max_features, least)
    ones = F.broadcast(chosen.where("y is null").select("x", F.col("term").alias("one")))
    twos = F.broadcast(chosen.where("y is not null").select("x", "y", F.col("term").alias("two")))
    found = _steps(texts).join(ones, "x", "left").join(twos, ["x", "y"], "left").select("unit", F.explode(F.array("one", "two")).alias("term")).where("term is not null")
    counts = settle(found.groupBy("unit", "term").agg(F.count("*").alias("n")))
    stats = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(F.broadcast(stats), "term").withColumn("x", F.col("n") * (F.log((1 + F.lit(units)) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return settle(raw.join(norms, "unit").select("unit", "term", (F.col("x") / F.col("norm")).alias("weight")))


def cosine_pairs(weights: DataFrame) -> DataFrame:
    """(a, b, sim), a < b, for units that share a term."""
    a = weights.select(F.col("unit").alias("a"), "term", F.col("weight").alias("x"))
    b = weights.select(F.col("unit").alias("b"), "term", F.col("weight").alias("y"))
    return a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))


def neighbours(pairs: DataFrame, k: int = 50, least: float = 0.05) -> DataFrame:
    """(unit, other, sim, rank): each unit's k most similar others above `least`; ties in the order of names."""
    both = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), "sim").unionAll(pairs.select(F.col("b").alias("unit"), F.col("a").alias("other"), "sim"))
    rank = F.row_number().over(W.partitionBy("unit").orderBy(F.desc("sim"), "other"))
    return both.where(F.col("sim") > least).withColumn("rank", rank).where(F.col("rank") <= k)


def mean_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors (unit, v) -> (unit, v): the mean of each unit's vectors."""
    return vectors.groupBy("unit").agg(F.array(*[F.avg(F.col("v")[i].cast("double")) for i in range(dim)]).alias("v"))


def vector_cosines(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) for the given pairs (a, b) of units; vectors has one row per unit."""
    from seams.functions.text import cosine

    a = vectors.select(F.col("unit").alias("a"), F.col("v").alias("x"))
    b = vectors.select(F.col("unit").alias("b"), F.col("v").alias("y"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", cosine(F.col("x"), F.col("y")).alias("sim"))


#: Vocabularies up to this many words are held by the driver, which Spark's Word2Vec needs some 0.5 kB a word for.
MOST_VOCABULARY = 100_000
#: Words that one partition of Spark's Word2Vec is trained on.
PARTITION_WORDS = 250_000


def word_vectors(sentences: DataFrame, size: int = 100, window: int = 5, rounds: int = 10, seed: int = 42):
    """Word vectors of sentences (words): a Word2Vec model of Spark, which trains skip-grams, with a partition for each PARTITION_WORDS.

    Beyond MOST_VOCABULARY words a settled table (word, v) of `skipgram.vectors`, which the driver never holds.
    """
    from pyspark.ml.feature import Word2Vec

    counts = sentences.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    every = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()  # one row
    if every.words > MOST_VOCABULARY:
        return settle(skipgram.vectors(sentences, size, window, rounds, seed))
    parts = max(1, every.n // PARTITION_WORDS)
    return Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=rounds, seed=seed, numPartitions=parts, inputCol="words", outputCol="vector").fit(sentences)


def unit_vectors(model, units: DataFrame, size: int = 100) -> DataFrame:
    """(unit, v) of units (unit, words): the mean vector of the words of each row, or for a table of vectors the mean of those over the rows of each unit."""
    from pyspark.ml.functions import vector_to_array

    if not isinstance(model, DataFrame):
        return model.transform(units).select("unit", vector_to_array("vector").alias("v"))
    shares = units.select("unit", F.explode("words").alias("word"), (1 / F.size("words")).alias("share")).groupBy("unit", "word").agg(F.sum("share").alias("share"))
    sums = shares.join(model, "word").groupBy("unit").agg(*[F.sum(F.col("share") * F.col("v")[i]).alias(f"v{i}") for i in range(size)])
    rows = units.groupBy("unit").agg(F.count("*").alias("n"))  # a row without words is a vector of zeros
    return rows.join(sums, "unit", "left").select("unit", F.array(*[F.coalesce(F.col(f"v{i}") / F.col("n"), F.lit(0.0)) for i in range(size)]).alias("v"))
