"""Vocabulary induction: score candidates, take the best, number them after the base vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.operators.mining import SPECIALS, _class


def gain(freq: Column, token: Column) -> Column:
    """Characters saved at most, were every occurrence one token."""
    return freq.cast("double") * F.greatest(F.length(token) - 1, F.lit(0)).cast("double")


def distortion(token: Column, bounds: str, mode: str = "none", penalty: float = 1.0) -> Column:
    """Price of crossing boundaries: penalty times the boundary characters inside. Other modes than these two are refused."""
    if mode == "none":
        return F.lit(0.0)
    if mode != "boundary_penalty":
        raise ValueError(f"no distortion mode {mode!r}")
    inside = F.regexp_replace(token, f"[^{_class(bounds)}]", "")
    return F.length(inside).cast("double") * F.lit(float(penalty))


def scored(cands: DataFrame, bounds: str, rate: float = 0.0, mode: str = "none", penalty: float = 1.0, price: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds score = gain - rate * distortion; negative scores stay. price, if given, is the distortion of a token in place of the mode's."""
    paid = price(F.col("token")) if price else distortion(F.col("token"), bounds, mode, penalty)
    cost = F.lit(float(rate)) * paid.cast("double") if rate > 0 else F.lit(0.0)
    return cands.withColumn("score", gain(F.col("freq"), F.col("token")) - cost)


def base_tokens(extra: Sequence[str], typed: Sequence[str], chars: Sequence[str] = ()) -> list[str]:
    """Reserved tokens in order of id, each once: model specials, extra ones, typed symbols, single characters."""
    return list(dict.fromkeys([*SPECIALS, *extra, *typed, *chars]))


def numbered(spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string").select("token", "id")


def best(cands: DataFrame, taken: DataFrame, room: int) -> DataFrame:
    """The `room` best scored candidates that are not taken; ties go to the longer, then the later in order."""
    free = cands.join(F.broadcast(taken.select("token")), "token", "left_anti")  # the base is bounded by the vocabulary size
    return free.orderBy(F.desc("score"), F.desc(F.length("token")), F.desc("token")).limit(room)


def vocabulary(cands: DataFrame, base: Sequence[str], size: int) -> DataFrame:
    """Rows (token, id): the base, then the best candidates up to size, densely numbered.

    The numbering window runs on at most `size` rows, which the top-k left in one place.
    """
    if size < len(base):
        raise ValueError(f"a vocabulary of {size} has no room for {len(base)} reserved tokens")
    first = numbered(cands.sparkSession, base)
    top = best(cands, first, size - len(base))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc(F.length("token")), F.desc("token")))
    return first.unionByName(top.select("token", (rank + len(base) - 1).cast("int").alias("id")))
