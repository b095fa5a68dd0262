"""Binary fingerprints as `words ARRAY<BIGINT>` (bit b is bit b % 64 of word b / 64) and `popcount INT`, and sums of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NAN
from ..operators.ranking import dense_index


def sign_words(vector: str | Column, size: int) -> Column:
    """words with bit b set where element b is above zero."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def word(first: int) -> Column:
        bits = [F.when(F.get(v, F.lit(b)) > 0, F.shiftleft(F.lit(1).cast("bigint"), b - first)).otherwise(F.lit(0).cast("bigint")) for b in range(first, min(first + 64, size))]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.array(*[word(k) for k in range(0, size, 64)])


def bit_words(bits: str | Column, size: int) -> Column:
    """words of a string of 0 and 1, bit 0 leftmost."""
    b = F.col(bits) if isinstance(bits, str) else bits
    return sign_words(F.transform(F.split(b, ""), lambda c: (c == "1").cast("int")), size)


def popcount(words: str | Column, count: int = 1) -> Column:
    w = F.col(words) if isinstance(words, str) else words
    return sum((F.bit_count(w[k]) for k in range(1, count)), F.bit_count(w[0]))


def fingerprints(df: DataFrame, vector: str, size: int, order: str, label: str | None = None) -> DataFrame:
    """(idx, words, popcount[, label]) with idx = 0..n-1 in the order of a key; numbered once, by a range sort."""
    packed = df.select(F.col(order).alias("_order"), sign_words(vector, size).alias("words"), *([F.col(label).alias("label")] if label else []))
    out = dense_index(packed.withColumn("popcount", popcount("words", (size + 63) // 64)), "idx", "_order")
    return out.select("idx", "words", "popcount", *(["label"] if label else []))


def token_fingerprint(text: str | Column, size: int) -> Column:
    """words with the bit hash(token) % size set for every lower-cased word of a text."""
    t = F.col(text) if isinstance(text, str) else text
    tokens = F.filter(F.split(F.lower(t), r"\W+"), lambda w: w != "")
    places = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    n_words = (size + 63) // 64
    return F.array(*[F.aggregate(places, F.lit(0).cast("bigint"), lambda a, p, k=k: F.when(F.floor(p / 64) == k, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 64).cast("int")))).otherwise(a)) for k in range(n_words)])


def bits_of(words: Column, size: int) -> Column:
    """The set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.call_function("shiftright", F.get(words, (b / 64).cast("int")), (b % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def linear_sums(df: DataFrame, size: int, by: str) -> DataFrame:
    """(by, bit, sum) of every bit, also those never set, and n items."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    set_bits = df.select(by, F.explode(bits_of(F.col("words"), size)).alias("bit")).groupBy(by, "bit").agg(F.count(F.lit(1)).alias("s"))
    every = n.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("bit"))
    return every.join(set_bits, [by, "bit"], "left").select(by, "bit", F.coalesce("s", F.lit(0)).cast("bigint").alias("sum"), "n")


def binary_centroids(sums: DataFrame) -> DataFrame:
    """The bits set in at least half of a group's items (a tie sets the bit; a group of none sets all)."""
    return sums.withColumn("bit_set", (2 * F.col("sum") >= F.col("n")).cast("int"))


def isim(sums: DataFrame, by: str) -> DataFrame:
    """(by, n, isim): mean Tanimoto similarity of a group from its linear sums, NaN where it is 0 / 0."""
    g = sums.groupBy(by).agg(F.first("n").alias("n"), F.sum("sum").alias("k"), F.sum(F.col("sum") * F.col("sum")).alias("k2"))
    a = (F.col("k2") - F.col("k")) / F.lit(2.0)
    den = a + F.col("n") * F.col("k") - F.col("k2")
    return g.select(by, "n", F.when(den == 0, F.lit(NAN)).otherwise(a / den).alias("isim"))
