"""Joins that leave the large side where it is.

Rows of findings or files meet side tables whose size depends on users: ignore lists, learned helpers, places to look at. A
side table is stored and measured. Within a stated number of bytes it goes to every task and the large side does not
move. Beyond it both sides are shuffled, and the rows of a key that holds more than a thousandth of the large side are
dealt over several tasks, which each get the side table's rows of that key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written

MOST_BYTES = 32 << 20


def size_of(table: DataFrame) -> int:
    """Bytes of a stored table's values, as text."""
    return table.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def meet(
    large: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", also: Callable[[Callable[[str], Column]], Column] | None = None,
    most_bytes: int = MOST_BYTES, salt: int = 64,
) -> DataFrame:
    """Join on equal keys, and on what `also` makes of the side table's columns (given by name).

    `how` is inner, left, left_semi or left_anti. The result has the columns of `large`, then the side table's other ones.
    """
    side = written(side)
    own = [c for c in side.columns if c not in keys]
    renamed = side.select(*[F.col(c).alias(f"_side_{c}") for c in side.columns])
    test = reduce(Column.__and__, [F.col(k) == F.col(f"_side_{k}") for k in keys])
    if also is not None:
        test = test & also(lambda name: F.col(f"_side_{name}"))
    kept = [F.col(f"`{c}`") for c in large.columns] + ([F.col(f"_side_{c}").alias(c) for c in own] if how in ("inner", "left") else [])
    if size_of(side) <= most_bytes:
        return large.join(F.broadcast(renamed), test, how).select(*kept)
    counts = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = large.count()
    hot = written(counts.where(F.col("_rows") > max(1, total // 1000)).select(*keys).withColumn("_hot", F.lit(True)))  # fewer than a thousand
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(salt))).otherwise(0)
    dealt = large.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", spread).drop("_hot")
    hot_side = hot.select(*[F.col(k).alias(f"_side_{k}") for k in keys], "_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    copied = renamed.join(F.broadcast(hot_side), [f"_side_{k}" for k in keys], "left").withColumn("_side_salt", F.explode(copies)).drop("_hot")
    return dealt.join(copied, test & (F.col("_salt") == F.col("_side_salt")), how).select(*kept)
