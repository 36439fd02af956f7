"""Keys that hold most of the records: finding them, and joining in spite of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows, so there are at most 1,000 hot keys.
HOT_SHARE = 0.001


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The keys with at least ``share`` of the rows, most frequent first.

    At most ``1/share`` keys can qualify whatever the size of ``df``, which is what makes the
    result safe to hold on the driver and to broadcast. Counting combines map-side, so a hot key
    costs one row a task. Null keys never join and are left out. An empty frame gives no keys.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg((F.count(F.lit(1)) * F.lit(share)).alias("least"))
    rows = counts.crossJoin(F.broadcast(total)).where("n >= least").orderBy(F.desc("n"), key).select(key).collect()
    return [r[0] for r in rows]


def join_on_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join ``left``, whose ``key`` may be skewed, with ``right``, which has one row per key.

    Rows of hot keys meet a broadcast of at most ``1/HOT_SHARE`` rows of ``right`` and never move;
    only the others are shuffled, so no task gets a hot key's rows. They are merged: their size is
    not known to be bounded, so neither side may turn into a broadcast. ``how``: inner or left.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.hint("merge").join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if len(hot) <= 32 else None
    if is_hot is None:
        names = left.sparkSession.createDataFrame([(h,) for h in hot], left.select(key).schema)
        near = left.join(F.broadcast(names), key, "left_semi"), right.join(F.broadcast(names), key, "left_semi")
        far = left.join(F.broadcast(names), key, "left_anti")
    else:
        near, far = (left.where(is_hot), right.where(is_hot)), left.where(~is_hot)
    return near[0].join(F.broadcast(near[1]), key, how).unionByName(far.hint("merge").join(right.hint("merge"), key, how))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
