"""Identity, versions, provenance, verification and use of units: extensions of the conformance engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.plans.scale import cut_lineage


def stable_id(*parts: Column) -> Column:
    """The hash of a semantic tuple; parts are prefixed with their length, so no two tuples run together. Null differs from empty."""
    spelt = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.char_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.md5(F.concat_ws(";", *spelt))


def content_copies(units: DataFrame, text: str) -> DataFrame:
    """Texts that several units have: ``(content_hash, n, first_id)``; units have ``unit_id``. Null texts are no content."""
    each = units.where(F.col(text).isNotNull()).groupBy(F.md5(F.col(text)).alias("content_hash"))
    return each.agg(F.count("*").alias("n"), F.min("unit_id").alias("first_id")).where("n > 1")


def current_versions(versions: DataFrame) -> DataFrame:
    """Each unit's last version of ``(unit_id, version, ...)``; equal versions count once, unknown ones not."""
    rest = [c for c in versions.columns if c not in ("unit_id", "version")]
    last = versions.where("unit_id is not null and version is not null").groupBy("unit_id").agg(F.max(F.struct("version", *rest)).alias("_r"))
    return last.select(*[F.col("unit_id") if c == "unit_id" else F.col(f"_r.`{c}`") for c in versions.columns])


def stale_dependents(depends_on: DataFrame, current: DataFrame) -> DataFrame:
    """Units to be made again: ``(unit_id, origin_id, used, version)`` where an origin has a later version than the one used.

    ``depends_on`` has ``(unit_id, origin_id, used)``, ``current`` ``(unit_id, version)``. Unknown versions decide nothing.
    """
    now = current.select(F.col("unit_id").alias("origin_id"), "version")
    return depends_on.join(now, "origin_id").where(F.col("version") > F.col("used")).select("unit_id", "origin_id", "used", "version").distinct()


def collectable_versions(versions: DataFrame, citations: DataFrame, before: Column) -> DataFrame:
    """Superseded versions that nobody cites and that were made before a time: ``(unit_id, version)``."""
    last = versions.groupBy("unit_id").agg(F.max("version").alias("_last"))
    old = versions.join(last, "unit_id").where((F.col("version") < F.col("_last")) & (F.col("made_at") < before))
    return old.join(citations, ["unit_id", "version"], "left_anti").select("unit_id", "version").distinct()


def origins(units: DataFrame, depends_on: DataFrame, hops: int) -> DataFrame:
    """Everything that units rest on within ``hops`` steps: ``(unit_id, origin_id, hops)``, the shortest way each.

    A bounded walk, one join per hop; cycles end, as no pair is taken up twice.
    """
    edge = depends_on.select("unit_id", "origin_id").where("unit_id is not null and origin_id is not null").distinct()
    step = edge.select(F.col("unit_id").alias("origin_id"), F.col("origin_id").alias("_next"))
    front = units.select("unit_id").distinct().join(edge, "unit_id").withColumn("hops", F.lit(1))
    seen = front = cut_lineage(front)  # else each hop would run all hops before it again, several times
    for n in range(2, hops + 1):
        front = front.join(step, "origin_id").select("unit_id", F.col("_next").alias("origin_id")).distinct().join(seen, ["unit_id", "origin_id"], "left_anti").withColumn("hops", F.lit(n))
        front = cut_lineage(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def verify_quotes(citations: DataFrame, units: DataFrame) -> DataFrame:
    """Marks citations ``(citation_id, unit_id, quote, text_hash)``, dropping none: ``verified``, ``quote_missing``, ``unit_changed`` or ``unit_missing``.

    ``units`` has ``(unit_id, text)``. The hash, where given, tells whether the text is still the one cited.
    """
    u = units.select("unit_id", "text", F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull(), "unit_missing")
        .when(F.col("text_hash") != F.md5(F.coalesce("text", F.lit(""))), "unit_changed")
        .when(F.coalesce(F.contains("text", "quote"), F.lit(False)), "verified")
        .otherwise("quote_missing")
    )
    return citations.join(u, "unit_id", "left").select("citation_id", "unit_id", status.alias("status"))


def verify_existence(citations: DataFrame, units: DataFrame) -> DataFrame:
    """Marks citations ``(citation_id, unit_id)``: ``verified`` or ``unit_missing``, as is one of no unit. ``units`` has ``unit_id``."""
    u = units.select("unit_id").distinct().withColumn("_there", F.lit(True))
    return citations.join(u, "unit_id", "left").select("citation_id", "unit_id", F.when(F.col("_there"), "verified").otherwise("unit_missing").alias("status"))


def verify_derivations(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Marks derivations ``(unit_id, origin_id, used)``, dropping none: ``verified`` if the origin still has the version
    used, ``origin_changed`` or ``origin_missing``. ``current`` has ``(unit_id, version)``."""
    now = current.select(F.col("unit_id").alias("origin_id"), "version", F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "origin_missing").when(F.col("version").eqNullSafe(F.col("used")), "verified").otherwise("origin_changed")
    return derived.join(now, "origin_id", "left").select("unit_id", "origin_id", status.alias("status"))


def verify_receipts(receipts: DataFrame, units: DataFrame) -> DataFrame:
    """Marks receipts ``(receipt_id, unit_id, text_hash)``: ``verified`` if the text still has the hash that was delivered,
    ``text_changed`` or ``unit_missing``. ``units`` has ``(unit_id, text)``; a null text has the hash of an empty one."""
    u = units.select("unit_id", F.md5(F.coalesce("text", F.lit(""))).alias("_hash"))
    status = F.when(F.col("_hash").isNull(), "unit_missing").when(F.col("_hash").eqNullSafe(F.col("text_hash")), "verified").otherwise("text_changed")
    return receipts.join(u, "unit_id", "left").select("receipt_id", "unit_id", status.alias("status"))


def verify_figures(claimed: DataFrame, rows: DataFrame, keys: Sequence[str], figure: Column) -> DataFrame:
    """Marks claimed figures by computing them again: ``(*keys, claimed, actual, status)``, status ``verified`` or ``differs``."""
    actual = rows.groupBy(*keys).agg(figure.alias("actual"))
    return claimed.join(actual, list(keys), "left").withColumn("status", F.when(F.col("claimed").eqNullSafe(F.col("actual")), "verified").otherwise("differs"))


def undelivered_citations(citations: DataFrame, delivered: DataFrame) -> DataFrame:
    """Citations ``(run_id, unit_id)`` of units that the run was never given."""
    return citations.join(delivered, ["run_id", "unit_id"], "left_anti").select("run_id", "unit_id").distinct()


def mixed_configurations(units: DataFrame) -> DataFrame:
    """Types whose embeddings come from several configurations: ``(type, configurations)`` of ``(type, config_hash)``."""
    return units.groupBy("type").agg(F.count_distinct("config_hash").alias("configurations")).where("configurations > 1")


def chunks(units: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Texts cut by size: ``(unit_id, chunk_no, start_char, chunk)``. Null and empty texts have no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is shorter than the size")
    step = size - overlap
    texts = units.where(F.char_length("text") > 0)
    starts = F.expr(f"sequence(0, greatest(0, char_length(text) - {overlap} - 1), {step})")
    cut = texts.select("unit_id", "text", F.posexplode(starts).alias("chunk_no", "start_char"))
    return cut.select("unit_id", "chunk_no", "start_char", F.substr("text", F.col("start_char") + 1, F.lit(size)).alias("chunk"))


def sections(units: DataFrame) -> DataFrame:
    """Texts cut by structure: ``(unit_id, section_no, heading, section)``.

    Sections are parted by blank lines. A section that begins with a number and a point or with number signs,
    and has one line, is a heading: it heads the sections up to the next and is none itself. Null and blank texts have none.
    """
    blocks = F.filter(F.transform(F.split("text", r"\r?\n[ \t]*\r?\n\s*", -1), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")
    each = units.select("unit_id", F.posexplode(blocks).alias("_i", "section"))
    is_heading = F.col("section").rlike(r"^(#{1,6}|[0-9]+([.][0-9]+)*[.]) [^\r\n]*$")
    to_here = Window.partitionBy("unit_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_is", is_heading).withColumn("heading", F.last(F.when(F.col("_is"), F.col("section")), ignorenulls=True).over(to_here))
    each = each.withColumn("section_no", F.count_if(~F.col("_is")).over(to_here).cast("int") - 1)
    return each.where(~F.col("_is")).select("unit_id", "section_no", "heading", "section")


def use_by_tool(events: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Access events ``(tool, unit_id, latency, cited)`` per tool: calls, distinct units, citation rate, median and 95th percentile of latency.

    Percentiles are exact and hold all distinct latencies of a tool, or with an ``accuracy`` are within ``1 / accuracy`` of their rank, in bounded memory.
    """
    at = (lambda q: F.percentile("latency", q)) if accuracy is None else (lambda q: F.percentile_approx("latency", q, accuracy))
    return events.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_distinct("unit_id").alias("units"), (F.count_if("cited") / F.count("*")).alias("citation_rate"), at(0.5).alias("median_latency"), at(0.95).alias("p95_latency")
    )


def never_accessed(units: DataFrame, events: DataFrame) -> DataFrame:
    return units.join(events, "unit_id", "left_anti").select("unit_id")
