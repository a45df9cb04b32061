"""Vector expressions and embedders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters whose shares are features of a text (fixed values), and how often each of the 13 features repeats in 384.
COMMON, POINTS = "的和在是了有一个上也", "，。！？；："
FEATURES, LENGTH = 13, 384
REPEATS = [LENGTH // FEATURES + (i < LENGTH % FEATURES) for i in range(FEATURES)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def text_features(c: Column) -> Column:
    """13 numbers: length, shares of ten common characters, of punctuation and of digits."""
    size = F.length(c)
    n = F.greatest(size, F.lit(1)).cast("double")
    without = lambda rest: (size - F.length(rest)) / n
    marks = without(F.translate(c, POINTS, "")), F.regexp_count(c, F.lit(r"\p{Nd}")) / n
    return F.array(size / F.lit(1000.0), *[without(F.replace(c, F.lit(x), F.lit(""))) for x in COMMON], *marks)


def feature_cosine(a: Column, b: Column) -> Column:
    """Cosine of two features tiled to LENGTH, without the tiling."""
    product = lambda x, y: sum((F.coalesce(x[i] * F.lit(float(r)) * y[i], F.lit(0.0)) for i, r in enumerate(REPEATS)), F.lit(0.0))
    size = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(size > 0, product(a, b) / size).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def feature_vector(c: Column) -> Column:
    """The features tiled to LENGTH and brought to unit length."""
    tiled = F.slice(F.flatten(F.array_repeat(text_features(c), LENGTH // FEATURES + 1)), 1, LENGTH)
    size = F.sqrt(dot(tiled, tiled))
    return F.transform(tiled, lambda x: F.when(size > 0, x / size).otherwise(x).cast("float"))


#: Embedders by name: text column to vector column.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"features": feature_vector}


def register_embedder(name: str, embedder: Callable[[Column], Column]) -> None:
    """``embedder``: a column function, such as a pandas UDF around a model that each Python worker loads once."""
    EMBEDDERS[name] = embedder


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: str = "features") -> DataFrame:
    """``df`` with vectors of ``text``; each distinct text is embedded once and joined back."""
    if embedder == "features":
        return df.withColumn(out, feature_vector(F.col(text)))
    distinct = df.select(F.col(text).alias("_q_text")).distinct()
    vectors = distinct.withColumn(out, EMBEDDERS[embedder](F.col("_q_text")))
    return df.join(vectors, F.col(text).eqNullSafe(F.col("_q_text")), "left").drop("_q_text")
