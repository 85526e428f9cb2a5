"""Filling containers of fixed capacity with items of varying length, in target proportions.

Every source is a queue of its items in hash order. Deficit round-robin fills windows of tokens: per
window, a queue is granted its share of the window and sends items while its credit covers them; what
is left of the credit is carried into the next window. An item is therefore sent in the window in
which the credit granted so far covers the tokens queued up to its end, so the window follows from the
queue's running sum alone. Running sums need no sequential pass: a queue is cut into chunks of the
hash order, chunks are summed first, and each chunk starts with the sum of those before it -- the
deficit carried across partitions. A queue begins with a part of its largest item as credit, a part that
hangs on its name, so that queues of few items do not all wait for the last window. Within a window,
items are packed best fit, the longest first.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.plans.scale import cut_lineage, ship_code

#: Items of a chunk, about; a queue with a third of all rows is summed in as many tasks as its chunks.
CHUNK_ITEMS = 65_536
#: Containers' worth of tokens in a window.
WINDOW_CONTAINERS = 512
#: Bits of an item's hash.
HASH_BITS = 60

PACKED = "spec string, capacity int, item long, source string, part int, from_token long, tokens long, window_no long, container long, place int, at_token int"


def _hash(c: Column) -> Column:
    """``HASH_BITS`` bits that SQL can compute as well."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long")


def best_fit(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, place in it and offset of each item: longest first, each where the least space stays free."""
    container, place, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
    free: list[int] = []  # the sizes of free space that occur, ascending
    by_free: dict[int, list[int]] = {}
    held: list[int] = []
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        n = int(sizes[i])
        k = bisect_left(free, n)
        if k == len(free):
            c, space = len(held), capacity
            held.append(0)
        else:
            space = free[k]
            c = by_free[space].pop()
            if not by_free[space]:
                del free[k], by_free[space]
        container[i], place[i], at[i] = c, held[c], capacity - space
        held[c] += 1
        if left := space - n:
            if left not in by_free:
                by_free[left] = []
                insort(free, left)
            by_free[left].append(c)
    return container, place, at


def _targets(sums: DataFrame, mixture: Mapping[str, float] | None, temperature: float) -> tuple[Column, Column]:
    """Each queue's share of a window, the one asked for, else in proportion to a power of its tokens; and the
    tokens of windows that come before its first."""
    weight = F.pow(F.col("_all"), F.lit(float(temperature)))
    named = dict(mixture or {})
    if named and (min(named.values()) <= 0 or sum(named.values()) > 1 + 1e-9):
        raise ValueError("target shares are positive and sum up to 1 at most")
    is_named = F.col("_queue").isin(list(named))
    queues = sums.select("_queue", "_all").distinct()
    tokens = {r["_queue"]: r["_all"] for r in queues.where(is_named).collect()}  # as few as are named
    others = queues.where(~is_named).agg(F.sum(weight)).first()[0] or 1.0
    left, after = 1 - sum(named.values()), -1.0
    if left < 1e-9:  # nothing is left for the others: they share the windows after the mixture's
        left, after = 1.0, max([-1.0, *(n / named[q] for q, n in tokens.items())])
    rest = weight * F.lit(left / others)
    return F.coalesce(*[F.when(F.col("_queue") == k, F.lit(float(v))) for k, v in named.items()], rest), F.when(is_named, -1.0).otherwise(after)


def windows(sizes: DataFrame, specs: Mapping[str, int], mixture: Mapping[str, float] | None = None, temperature: float = 1.0, window_containers: int = WINDOW_CONTAINERS) -> DataFrame:
    """The window of each part of each item with tokens, for every spec: ``(spec, capacity, item, source,
    part, from_token, tokens, window_no, quantum, credit)``.

    ``quantum`` is what the queue is granted per window, ``credit`` what it begins with, less what
    comes before its first window. See ``pack`` for the arguments.
    """
    for name, capacity in specs.items():
        if capacity < 1:
            raise ValueError(f"capacity of {name!r} is below 1")
    return _windows(_items(sizes), specs, mixture, temperature, window_containers)


def _items(sizes: DataFrame) -> DataFrame:
    return cut_lineage(sizes.select(F.col("item").cast("long").alias("_item"), F.coalesce(F.col("source"), F.lit("")).alias("_queue"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("_size"), _hash(F.col("item")).alias("_hash")))


def _windows(items: DataFrame, specs: Mapping[str, int], mixture: Mapping[str, float] | None, temperature: float, window_containers: int) -> DataFrame:
    queued = items.where("_size > 0")
    bits = max(0, math.ceil(math.log2(max(1, queued.count()) / CHUNK_ITEMS)))
    queued = queued.withColumn("_chunk", F.shiftright("_hash", HASH_BITS - min(bits, 30)).cast("int"))
    chunks = queued.groupBy("_queue", "_chunk").agg(F.sum("_size").alias("_sum"), F.max("_size").alias("_most"))
    before, queue = Window.partitionBy("_queue").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_queue")
    chunks = chunks.select("_queue", "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(queue).alias("_all"), F.max("_most").over(queue).alias("_most"))
    target, after = _targets(chunks, mixture, temperature)
    chunks = chunks.withColumn("_target", target).withColumn("_after", after)
    running = Window.partitionBy("_queue", "_chunk").orderBy("_hash", "_item").rowsBetween(Window.unboundedPreceding, 0)
    queued = queued.join(chunks, ["_queue", "_chunk"]).withColumn("_start", F.col("_base") + F.sum("_size").over(running) - F.col("_size"))
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(c).alias("capacity")) for n, c in specs.items()]))
    parts = queued.withColumn("_spec", spec).select("*", "_spec.spec", "_spec.capacity", F.explode(F.expr("sequence(0L, (_size - 1) div _spec.capacity)")).alias("_part"))
    from_token, room = F.col("_part") * F.col("capacity"), F.col("capacity") * F.lit(float(window_containers))
    parts = parts.withColumn("from_token", from_token).withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("_size") - from_token))
    first = F.when(F.col("_after") >= 0, F.floor(F.col("_after") / room) + 1).otherwise(0)
    begin = F.pmod(_hash(F.col("_queue")), F.lit(1 << 20)) / F.lit(float(1 << 20)) * F.least("capacity", "_most")
    parts = parts.withColumn("quantum", F.col("_target") * room).withColumn("_begin", begin).withColumn("_first", first)
    covered = F.ceil((F.col("_start") + F.col("from_token") + F.col("tokens") - F.col("_begin")) / F.col("quantum")) - 1
    return parts.select(
        "spec", "capacity", F.col("_item").alias("item"), F.col("_queue").alias("source"), F.col("_part").cast("int").alias("part"), "from_token", "tokens",
        (F.col("_first") + F.greatest(covered, F.lit(0).cast("long"))).alias("window_no"), "quantum", (F.col("_begin") - F.col("_first") * F.col("quantum")).alias("credit"),
    )


def pack(sizes: DataFrame, specs: Mapping[str, int], mixture: Mapping[str, float] | None = None, window_containers: int = WINDOW_CONTAINERS, temperature: float = 1.0) -> DataFrame:
    """Where each part of each item goes, for every spec (name: capacity).

    ``sizes`` has ``item`` (long, unique), ``source`` and ``size`` in tokens. Per spec, an item is one part,
    or, if it alone exceeds the capacity, as many full parts as it holds and the remainder.
    Columns: spec, capacity, item, source, part (from 0), from_token and tokens (the item's share that the part
    is), window_no, container (unique within the spec), place (in the container, from 0), at_token
    (where in the container the part starts). An item without tokens is in no container: one row
    with 0 tokens and nulls. Items with a null source form a queue with those of the empty name. ``mixture`` gives
    target shares of tokens per source while that source lasts; sources not named share the rest in proportion to
    their tokens to the power ``temperature``, as all do without it; if the named ones take all, the others come
    in windows after theirs. An item occurring twice is two items with the same name.
    """
    for name, capacity in specs.items():
        if capacity < 1:
            raise ValueError(f"capacity of {name!r} is below 1")
    spark = sizes.sparkSession
    ship_code(spark)
    if not specs:
        return spark.createDataFrame([], PACKED)
    items = _items(sizes)

    def fill(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["item", "part"], kind="stable", ignore_index=True)
        container, place, at = best_fit(df["tokens"].to_numpy(), int(df["capacity"].iloc[0]))
        return df.assign(container=df["window_no"] * (1 << 32) + container, place=place, at_token=at)

    packed = _windows(items, specs, mixture, temperature, window_containers).drop("quantum", "credit").groupBy("spec", "window_no").applyInPandas(fill, PACKED)
    none = [F.lit(None).cast(t) for t in ("long", "long", "int", "int")]
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(c).alias("capacity")) for n, c in specs.items()]))
    empty = items.where("_size = 0").withColumn("_spec", spec)
    return packed.unionAll(empty.select("_spec.spec", "_spec.capacity", "_item", "_queue", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), *none))


def mixture_report(placed: DataFrame) -> DataFrame:
    """``(spec, window_no, source, target, tokens, carried)`` of ``windows``, for each source that sends something in a window:
    the tokens granted for it, those sent, and the credit that is carried on. Credit is never below 0."""
    each = placed.groupBy("spec", "window_no", "source").agg(F.sum("tokens").alias("tokens"), F.first("quantum").alias("target"), F.first("credit").alias("_credit"))
    sent = F.sum("tokens").over(Window.partitionBy("spec", "source").orderBy("window_no").rowsBetween(Window.unboundedPreceding, 0))
    carried = F.col("_credit") + (F.col("window_no") + 1) * F.col("target") - sent
    return each.select("spec", "window_no", "source", F.round("target", 3).alias("target"), "tokens", F.round(carried, 3).alias("carried"))


def fill_report(packed: DataFrame) -> DataFrame:
    """``(spec, capacity, containers, tokens, unused_share)`` of packed parts."""
    each = packed.where("container is not null").groupBy("spec", "capacity", "container").agg(F.sum("tokens").alias("_t"))
    return each.groupBy("spec", "capacity").agg(F.count("*").alias("containers"), F.sum("_t").alias("tokens")).withColumn(
        "unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)
    )
