"""The N best items of every group, by partition lower bounds.

An item's last delivery is found by an aggregation, which combines before its exchange, so an item
delivered however often is no burden. That exchange spreads items by id, whatever their group.
Within a partition only the N best rows of a group are kept, and the N-th of them is a lower bound
of the group's N-th best overall. The best bound of each of the busiest groups is broadcast to what
the partitions kept, rows behind it go before anything else is shuffled, and only the survivors are
ranked. A group without a broadcast bound loses no row to it: it is ranked from all partitions' best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.plans.scale import cut_lineage, ship_code

#: Groups whose bound is broadcast, at most: those of which the partitions kept the most rows.
MOST_BOUNDS = 4_096
#: Rows that a partition holds before it passes on the best so far; a bound of some rows is as valid as one of all.
HELD_ROWS = 500_000


def _best(rows: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The first ``n`` rows of each group, best first, and which of them are a group's ``n``-th."""
    # Arrow compares strings as UTF-8, as Spark does
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("_group", "ascending"), ("_score", "descending"), ("_item", "ascending")]))
    group = rows.column("_group").combine_chunks().dictionary_encode().indices.to_numpy() if rows.num_rows else np.empty(0, np.int32)
    starts = np.flatnonzero(np.r_[True, np.diff(group) != 0]) if len(group) else np.empty(0, np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    kept = place < n
    return rows.filter(pa.array(kept)), place[kept] == n - 1


def _local(n: int):
    """A partition's rows to its ``n`` best of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        since, kept = 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, since, kept
            best, is_nth = _best(pa.Table.from_batches(held), n)
            since, kept = 0, best.num_rows
            if last or kept > HELD_ROWS // 2:  # else there is room for more
                yield from best.append_column("_nth", pa.array(is_nth)).combine_chunks().to_batches(max_chunksize=10_000)
                held, kept = [], 0
            else:
                held = best.to_batches()

        for b in batches:
            held.append(b)
            since += b.num_rows
            if since + kept > HELD_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def top_n(df: DataFrame, group: Column, item: str, score: str, version: str, n: int) -> DataFrame:
    """``(group_key, item_id, score, place)``: the ``n`` items of each group with the highest score, ties by item ascending.

    An item delivered several times counts once, by its row with the last ``version`` (unknown
    versions first; among equal versions the higher score, then the higher group). That row
    decides: with a null group, or a null or NaN score, the item is in no group. Infinite scores
    are scores, and the two zeros are equal. Items without id are dropped, as they cannot be named.
    """
    ship_code(df.sparkSession)
    number = F.col(score).cast("double")
    rows = df.where(F.col(item).isNotNull()).select(
        F.col(item).alias("_item"), F.struct(F.col(version).alias("version"), F.when(~F.isnan(number), number + 0.0).alias("score"), group.alias("group")).alias("_row")
    )
    items = rows.groupBy("_item").agg(F.max("_row").alias("_row")).select(F.col("_row.group").alias("_group"), "_item", F.col("_row.score").alias("_score"))
    items = items.where("_group is not null and _score is not null")
    local = cut_lineage(items.mapInArrow(_local(n), T.StructType([*items.schema.fields, T.StructField("_nth", T.BooleanType())])))
    best = [F.desc("_score"), F.asc("_item")]
    of_group = local.groupBy("_group").agg(F.count("*").alias("_n"), F.min(F.when(F.col("_nth"), F.struct((-F.col("_score")).alias("score"), F.col("_item").alias("item")))).alias("_bound"))
    bounds = of_group.where(F.col("_bound").isNotNull() & (F.col("_n") > n)).orderBy(F.desc("_n"), "_group").limit(MOST_BOUNDS).select("_group", "_bound")
    behind = F.struct((-F.col("_score")).alias("score"), F.col("_item").alias("item")) > F.col("_bound")
    survivors = local.join(F.broadcast(bounds), "_group", "left").where(~F.coalesce(behind, F.lit(False)))
    ranked = survivors.withColumn("_place", F.row_number().over(Window.partitionBy("_group").orderBy(*best))).where(F.col("_place") <= n)
    return ranked.select(F.col("_group").alias("group_key"), F.col("_item").alias("item_id"), F.col("_score").alias("score"), F.col("_place").alias("place"))
