"""References to records that do not exist.

``orphan_references`` puts the references of a table and the keys of their parent tables into one
key space, co-partitions and sorts both, and merges the two sorted streams once (a sort-merge
join). A parent key carries its validity interval -- first load, and removal if one is later than
the last load -- which tells a missing target from a removed one and from one that came later.
What the merge says about a reference's deliveries is then combined by the reference's id, in sums of
fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.text import pointer_key
from tamarack.plans.scale import salt, shuffle_parts

#: Why a reference is an orphan; the first that holds for any of its pointers stands.
REASONS = ("unreadable", "missing", "removed", "late")
#: References that heavy keys are looked for in, about, the share of them from which a key is heavy, and references that one task can hold.
SAMPLE, HEAVY, LIGHT = 200_000, 0.01, 500_000
#: A heavy key's ways are this part of a partition's fair share each.
FINE = 8
#: Ways over which what can't be read spreads.
UNREAD_WAYS = 1024


def parent_intervals(parents: Mapping[str, DataFrame], removals: DataFrame) -> DataFrame:
    """One row ``(_table, _key, _from, _until, _stored)`` per key of the parent tables.

    ``parents`` maps a table name to its rows ``(id, loaded_at)``; ``removals`` has
    ``(record_id, removed_at)``. ``_from`` is the first load. ``_until`` is the last removal if it
    is later than the last load, else null: a record loaded again after its removal lives.
    Unreadable ids are no records. Null times are unknown and decide nothing.
    """
    rows = []
    for name, df in parents.items():
        at = df["loaded_at"]
        rows.append(df.select(F.lit(name).alias("_table"), pointer_key(df["id"], name).alias("_key"), at.alias("_at"), F.lit(None).cast(at_type(df)).alias("_gone"), F.lit(1).alias("_stored")))
        rows.append(removals.select(F.lit(name), pointer_key(removals["record_id"], name), F.lit(None).cast(at_type(df)), removals["removed_at"].cast(at_type(df)), F.lit(0)))
    every = reduce(DataFrame.unionAll, rows).where(F.col("_key").isNotNull())
    return every.groupBy("_table", "_key").agg(
        F.min("_at").alias("_from"),
        F.when(F.max("_gone") > F.max("_at"), F.max("_gone")).alias("_until"),
        F.max("_stored").alias("_stored"),
    )


def at_type(df: DataFrame) -> str:
    return dict(df.dtypes)["loaded_at"]


def _exploded(references: DataFrame, sides: Mapping[str, tuple[str, str]], *columns: Column) -> DataFrame:
    """A row per reference and side: the given columns, ``_side``, ``_table``, ``_key`` and whether the pointer is ``_there``."""
    # keys are read before sides become rows, as Spark shares common parts of expressions in projections only
    read = references.select(*columns, *[x for s, (c, t) in sides.items() for x in (pointer_key(F.col(c), t).alias(f"_key_{s}"), F.col(c).isNotNull().alias(f"_there_{s}"))])
    own = [c for c in read.columns if not c.startswith(("_key_", "_there_"))]
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("_side"), F.lit(t).alias("_table"), F.col(f"_key_{s}").alias("_key"), F.col(f"_there_{s}").alias("_there")) for s, (_, t) in sides.items()]))
    return read.select(*own, side.alias("_r")).select(*own, "_r.*")


def _ways(references: DataFrame, sides: Mapping[str, tuple[str, str]], parts: int) -> Column:
    """Ways in which the references to a key are split, and its parent row repeated: 1, but for heavy keys as many as they fill partitions.

    Heavy keys are found in a sample, ``1 / HEAVY`` of them at most. It decides where rows go, not what comes out.
    """
    n = references.count()  # from the files' footers
    if n <= LIGHT:  # no key can be heavy
        return F.lit(1)
    some = references.sample(min(1.0, SAMPLE / n), seed=0)
    keys = _exploded(some, sides).where(F.col("_key").isNotNull()).groupBy("_table", "_key").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("_table"))
    heavy = keys.withColumn("share", share).where(F.col("share") >= max(HEAVY, 1 / (FINE * parts))).select("_table", "_key", "share").collect()
    ways = F.lit(1)
    for r in heavy:
        ways = F.when((F.col("_table") == r["_table"]) & (F.col("_key") == r["_key"]), min(1024, math.ceil(r["share"] * FINE * parts))).otherwise(ways)
    return ways


def orphan_references(references: DataFrame, sides: Mapping[str, tuple[str, str]], parents: Mapping[str, DataFrame], removals: DataFrame) -> DataFrame:
    """Every reference whose target is unreadable, missing, removed or late.

    ``references`` has ``id``, ``loaded_at`` and pointer columns; ``sides`` maps a side to its
    ``(pointer column, parent table)``. The result has one row ``(reference_id, side, table,
    first_loaded_at, reason)`` per reference id and side. A reference counts from its first load;
    delivered again with another pointer, each of its pointers is judged, and the first of
    ``REASONS`` stands. Null pointers are no references; rows without id
    are judged one by one and share a result row per side; empty tables give an empty result.
    """
    alone = F.when(F.col("id").isNull(), F.xxhash64(F.col("loaded_at"), *[F.col(c) for c, _ in sides.values()]))  # no id, no common group
    refs = _exploded(references, sides, F.col("id").alias("_id"), alone.alias("_alone"), F.col("loaded_at").alias("_at"))
    ways = _ways(references, sides, shuffle_parts(references, 1))
    # what has no key goes through the merge as well, in ways that no parent has, so that the references are read once
    way = F.when(F.col("_key").isNotNull(), F.pmod(F.xxhash64("_id", "_alone"), ways).cast("int")).otherwise(-1 - salt(F.coalesce("_id", F.col("_alone").cast("string")), UNREAD_WAYS))
    refs = refs.withColumn("_way", way).withColumn("_key", F.coalesce("_key", F.lit("")))
    keys = parent_intervals(parents, removals).withColumn("_way", F.explode(F.sequence(F.lit(0), ways - 1)))
    merged = refs.join(keys.hint("merge"), ["_table", "_key", "_way"], "left")
    known = F.col("_there") & (F.col("_way") >= 0)
    stored = F.coalesce("_stored", F.lit(0)) == 1
    said = {
        "unreadable": F.col("_there") & (F.col("_way") < 0),
        "missing": known & ~stored,
        "removed": known & stored & F.col("_until").isNotNull(),
    }
    # a reference is late if the last of its targets came after the first of its loads, whatever pointer that had
    came = F.when(known & stored & F.col("_until").isNull(), F.col("_from"))
    of_side = lambda s, c: F.when(F.col("_side") == s, c)
    by_id = merged.select("_id", "_alone", "_at", "_side", came.alias("_came"), *[c.alias(f"_{k}") for k, c in said.items()]).groupBy("_id", "_alone").agg(
        F.min("_at").alias("_first"),
        *[F.max(of_side(s, F.col("_came"))).alias(f"_came_{s}") for s in sides],
        *[F.max(of_side(s, F.col(f"_{k}"))).alias(f"_{k}_{s}") for s in sides for k in said],
    )
    reason = lambda s: F.coalesce(*[F.when(F.col(f"_{k}_{s}"), k) for k in REASONS[:3]], F.when(F.col(f"_came_{s}") > F.col("_first"), REASONS[3]))
    judged = by_id.select("_id", "_first", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(t).alias("table"), reason(s).alias("reason")) for s, (_, t) in sides.items()])).alias("_r"))
    found = judged.where(F.col("_r.reason").isNotNull()).select("_id", "_first", "_r.*")
    names = F.array(*map(F.lit, REASONS))
    # only rows without id have more than one row for a side
    shared = found.groupBy(F.col("_id").alias("reference_id"), "side", "table").agg(F.min("_first").alias("first_loaded_at"), F.min(F.array_position(names, F.col("reason"))).cast("int").alias("_i"))
    return shared.select("reference_id", "side", "table", "first_loaded_at", F.element_at(names, F.col("_i")).alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts ``(table, month, reason, n)``; month is ``yyyy-MM`` of the reference's first load, null if unknown."""
    month = F.date_format("first_loaded_at", "yyyy-MM").alias("month")
    return orphans.groupBy("table", month, "reason").agg(F.count("*").alias("n"))
