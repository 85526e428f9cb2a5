"""Frequency of every term: occurrences, and records that hold it.

The layout is vertical: per term, the records that hold it are a bitmap. Records meet their rows in
one exchange and get dense numbers where they arrive, so no dictionary of ids is built. A
partition sets the bits of each block of its records and compresses them term by term: a container of a
block lists the places of a rare term's records and has a bit for every record else. Rows of a record that
repeat a term set the same bit, so bits merge by union; blocks have no record in common, so document
frequency is the sum of the containers' cardinalities. Occurrences are counted in parallel, from
all rows, and combined before their exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.text import strip
from tamarack.plans.scale import cut_lineage, ship_code

SEPARATORS = "[;,/|]"
#: A term is too rare in fewer records than this, too common in more than this share of the records with any term.
FEWEST_RECORDS, LARGEST_SHARE = 3, (4, 10)
#: Records of a block, and from how many of them on a container has a bit for each; the size of both kinds is then equal.
BLOCK, LISTED = 65_536, 4096

BITMAPS = "field_name string, item string, block long, container binary, cardinality int"


def terms_of(value: Column) -> Column:
    """Pieces of a text between separators, without white space at their ends, in lower case, none empty."""
    return F.filter(F.transform(F.split(value, SEPARATORS, -1), lambda x: F.lower(strip(x))), lambda x: x != "")


def container_of(places: np.ndarray) -> bytes:
    """A container of ascending distinct places in a block: ``L`` and 16 bits for each, or if they are many ``B`` and a bit for every place of the block."""
    if len(places) <= LISTED:
        return b"L" + places.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[places] = 1
    return b"B" + np.packbits(bits).tobytes()


def places_of(container: bytes) -> np.ndarray:
    """The places in a container."""
    if container[:1] == b"L":
        return np.frombuffer(container, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1)))


class _Block:
    """The bits of a block's records, by field and term."""

    def __init__(self):
        self.known: dict[tuple[str, str | None], int] = {}
        self.codes: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def set(self, fields: pa.Array, items: pa.Array, first: int) -> None:
        """Records from place ``first`` on: a field and a list of terms each."""
        n = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        place = np.repeat(np.arange(first, first + len(n)), n)
        fields, terms = fields.dictionary_encode(), items.flatten().dictionary_encode()
        field, term = np.repeat(fields.indices.to_numpy(), n).astype(np.int64), terms.indices.to_numpy()
        names = terms.dictionary.to_pylist()
        pair, of = np.unique(field * max(1, len(names)) + term, return_inverse=True)
        field_names = fields.dictionary.to_pylist()
        code = np.array([self._code(field_names[p // len(names)], names[p % len(names)]) for p in pair.tolist()], np.int64)
        any_ = np.array([self._code(f, None) for f in field_names], np.int64)
        self.codes += [code[of] if len(of) else of, any_[field]]  # the second is the union over all terms
        self.places += [place, place]

    def _code(self, field: str, item: str | None) -> int:
        return self.known.setdefault((field, item), len(self.known))

    def rows(self, block: int) -> pa.RecordBatch:
        bits = np.unique(np.concatenate(self.codes) * BLOCK + np.concatenate(self.places)) if self.codes else np.empty(0, np.int64)
        code, place = bits // BLOCK, bits % BLOCK
        starts = np.flatnonzero(np.r_[True, np.diff(code) > 0]) if len(code) else np.empty(0, np.int64)
        ends, names = np.r_[starts[1:], len(code)], list(self.known)
        held = [names[c] for c in code[starts].tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f for f, _ in held], pa.string()), pa.array([i for _, i in held], pa.string()), pa.array(np.full(len(held), block), pa.int64()),
                pa.array([container_of(place[a:z]) for a, z in zip(starts, ends, strict=True)] if len(starts) else [], pa.binary()), pa.array((ends - starts if len(starts) else starts).astype(np.int32)),
            ],
            names=["field_name", "item", "block", "container", "cardinality"],
        )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, each in one row, to the containers of the partition's blocks."""
    number, block, part = 0, _Block(), TaskContext.get().partitionId() if TaskContext.get() else 0
    for b in batches:
        b, at = b.filter(pc.greater(pc.list_value_length(b.column(1)), 0)), 0
        while at < b.num_rows:
            some = b.slice(at, min(b.num_rows - at, BLOCK - number % BLOCK))
            block.set(some.column(0), some.column(1), number % BLOCK)
            at, number = at + some.num_rows, number + some.num_rows
            if number % BLOCK == 0:
                yield block.rows((part << 32) + (number - 1) // BLOCK)
                block = _Block()
    if number % BLOCK:
        yield block.rows((part << 32) + number // BLOCK)


def term_bitmaps(values: DataFrame) -> DataFrame:
    """``(field_name, item, block, container, cardinality)`` of ``values(field_name, id, value)``.

    Rows with a null ``item`` are the union over all terms of the field. Null and blank values hold
    no term. A row without id is no record and sets no bit. The distinct values of one record meet in one task.
    """
    ship_code(values.sparkSession)
    # values without a term are dropped behind the exchange, as a filter here would read every value twice
    records = values.where("id is not null and value is not null").groupBy("field_name", "id").agg(F.flatten(F.collect_set(terms_of(F.col("value")))).alias("items"))
    return records.select("field_name", "items").mapInArrow(_bitmaps, BITMAPS)


def term_frequency(values: DataFrame) -> DataFrame:
    """``(field_name, item, occurrences, records, mark)``; mark is ``too rare``, ``too common`` or null.

    A row without id counts in ``occurrences`` only. No values, or none with a term, give an empty result.
    """
    held = term_bitmaps(values).select("field_name", "item", F.lit(0).cast("long").alias("occurrences"), F.col("cardinality").cast("long").alias("records"))
    pieces = values.select("field_name", F.explode(terms_of(F.col("value"))).alias("item"), F.lit(1).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
    counts = held.unionAll(pieces).groupBy("field_name", "item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    counts = cut_lineage(counts)  # one row per term
    totals = {r["field_name"]: r["records"] for r in counts.where(F.col("item").isNull()).collect()}  # one row per field
    total = F.coalesce(*[F.when(F.col("field_name") == k, F.lit(n)) for k, n in totals.items()], F.lit(0))
    mark = F.when(F.col("records") < FEWEST_RECORDS, "too rare").when(F.col("records") * LARGEST_SHARE[1] > total * LARGEST_SHARE[0], "too common")
    return counts.where(F.col("item").isNotNull()).withColumn("mark", mark)
