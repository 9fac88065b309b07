"""Text views of fixed length: tokens, the first N of them, boundaries, and a hashed encoder for where none is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

# fixed values: content tokens of the views, longest first
VIEWS = (128, 64, 32)


def token_ids(text: Column | str, vocabulary: int = 1 << 16) -> Column:
    """Whitespace words as hashed ids; a stand-in for a subword vocabulary that keeps the plan in the JVM."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))


def with_tokenizer(df: DataFrame, text: str, encode: Callable[[list[str]], list[list[int]]], name: str = "ids") -> DataFrame:
    """Ids of an own tokenizer, batch by batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encode(batch.fillna("").tolist()))

    return df.withColumn(name, F.pandas_udf(run, "array<int>")(F.col(text)))


def content_view(ids: Column | str, required: int) -> Column:
    """The first ``required`` ids, null if there are fewer."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(ids) >= required, F.slice(ids, 1, required))


def with_boundaries(ids: Column, first: int, last: int) -> tuple[Column, Column]:
    """Ids between two boundary ids, and the mask of the content places."""
    inner = F.transform(ids, lambda x: F.lit(True))
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last))), F.concat(F.array(F.lit(False)), inner, F.array(F.lit(False)))


def recovered(ids: Column, mask: Column) -> Column:
    """The ids at the mask's places."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("id"), mask.alias("keep")), lambda x: x["keep"]), lambda x: x["id"])


def hashed_embedding(ids: Column, dimensions: int = 64) -> Column:
    """Mean over tokens of signed hash features: what an encoder's masked mean pooling is for real weights."""
    unit = lambda d: F.try_divide(F.aggregate(ids, F.lit(0.0), lambda s, t: s + F.when(F.pmod(F.xxhash64(t, d), F.lit(2)) == 0, 1.0).otherwise(-1.0)), F.size(ids))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), unit)


def ladder(aurocs: DataFrame, views: tuple[int, ...] = VIEWS) -> DataFrame:
    """One row per cell with the AUROC of every view."""
    return aurocs.groupBy("cell").pivot("view", list(views)).agg(F.first("auroc"))


def view_ceilings(aurocs: DataFrame, limit: float = 0.9999) -> DataFrame:
    """view, cells at AUROC 1, cells at the plotted ceiling."""
    return aurocs.groupBy("view").agg(F.count_if(F.col("auroc") == 1).alias("exact"), F.count_if(F.col("auroc") >= limit).alias("plotted"))


def masked_mean(tokens: DataFrame, weights: DataFrame, key: list[str], required: int, dimensions: int, token: str = "token", keep: str = "keep", vector: str = "vector") -> DataFrame:
    """key, kept tokens, status and the mean vector of the kept tokens of every key, of ``tokens`` (key, token, keep).

    A sum for each dimension is combined before it moves, so a text's tokens may be on many tasks. The divisor is the
    required number of tokens, and a key has a vector only where just so many are kept (else ``count``) and all of them
    have weights of the dimensions (else ``weights``). Tokens that aren't kept, boundaries and padding, change nothing.
    """
    own = weights.select(F.col(token), F.col(vector).alias("_v"))
    met = tokens.where(F.coalesce(F.col(keep), F.lit(False))).select(*key, token).join(own, token, "left")
    known = F.coalesce(F.size("_v") == dimensions, F.lit(False))
    sums = [F.sum(F.get("_v", F.lit(d)).cast("double")).alias(f"_{d}") for d in range(dimensions)]
    pooled = tokens.select(*key).distinct().join(met.groupBy(*key).agg(F.count(F.lit(1)).alias("kept"), F.count_if(~known).alias("_unknown"), *sums), key, "left").na.fill(0, ["kept", "_unknown"])
    status = F.when(F.col("kept") != required, "count").when(F.col("_unknown") > 0, "weights").otherwise("ok")
    mean = F.when(status == "ok", F.array(*(F.col(f"_{d}") / float(required) for d in range(dimensions))))
    return pooled.select(*key, "kept", status.alias("status"), mean.alias("mean"))
