"""Which strings occur inside which texts, by an inverted index of character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelake.operators.common import exploded, small_side

#: Characters of the longest gram.
WIDTH = 3
#: Hashed grams that are sent to the index, 16 bytes each; more are joined.
MARKED = 500_000


def _grams(chars: Column, width: int) -> Column:
    """Runs of ``width`` neighbours of an array of characters."""
    count = F.size(chars) - (width - 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(width)]))


def _hashes(grams: Column) -> Column:
    """Grams as numbers; two of one number only bring a candidate that is then turned down."""
    return F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))


def _characters(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__chars", F.filter(F.split(text, ""), lambda c: c != ""))


def substring_pairs(patterns: DataFrame, texts: DataFrame, pattern: str = "pattern", text: str = "text", id_col: str = "id", max_rows: int = MARKED) -> DataFrame:
    """``(pattern, id)`` for every distinct pattern and every text that contains it.

    Texts are indexed by their grams of up to three characters, which are counted first. A pattern is
    looked up by its rarest gram only, and one of its grams that no text has settles it at once; what
    the gram brings is verified on the text. So the work follows the occurrences of rare grams, not
    patterns times texts, and no frequent gram meets anything. Null patterns and texts match nothing;
    the empty pattern is in every text. Ids are distinct. The rarest
    grams are sent to the index while they are proven to be at most ``max_rows``, else joined.
    """
    asked = patterns.filter(F.col(pattern).isNotNull()).select(F.col(pattern).alias("__p")).distinct().withColumn("__h", F.xxhash64("__p"))
    held = texts.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    chars, n = F.col("__chars"), F.size("__chars")
    own = F.when(n == 0, F.array(F.lit("")))
    for width in range(1, WIDTH):
        own = own.when(n == width, _grams(chars, width))
    wanted = exploded(_characters(asked, "__p"), ["__h"], _hashes(own.otherwise(_grams(chars, WIDTH))), "__g")
    every = F.concat(F.array(F.lit("")), *[_grams(chars, w) for w in range(1, WIDTH + 1)])
    index = exploded(_characters(held, "__text"), ["__id"], _hashes(every), "__g")
    counts = index.groupBy("__g").agg(F.count("*").alias("__n"))
    rarest = (
        wanted.join(counts, "__g", "left")
        .groupBy("__h")
        .agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g").alias("g"))).alias("__rare"))
        .filter(F.col("__rare.n") > 0)
        .select("__h", F.col("__rare.g").alias("__g"))
    )
    found = index.join(small_side(rarest, max_rows), "__g").select("__h", "__id").join(asked, "__h").join(held, "__id")
    return found.filter(F.contains("__text", "__p")).select(F.col("__p").alias(pattern), F.col("__id").alias(id_col))
