"""Dropping rows of a wide table by key without shuffling the rows that stay for sure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import bitmap
from vigil.llm.store import staged


def _by_bitmap(bits, held: bool):
    """Rows whose last column, a hash, the bitmap lets through, or the others; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bitmap.may_contain(bits.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            rows = batch.filter(pa.array(found if held else ~found))
            yield rows.select(list(range(batch.num_columns - 1)))

    return run


def _unused(rows: DataFrame, name: str) -> str:
    """A column name that `rows` does not have, in whatever case."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def without(rows: DataFrame, key: Column, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """`rows` but for those whose key is in the one column of `gone`; of each `repeated` key one row stays.

    A key is a struct, so nulls inside it match. Rows that a bitmap of both key sets does not
    hold are passed on where they lie; the others are joined exactly. Columns may have any names.
    """
    gone = staged(gone.toDF("key").distinct(), "gone-keys")
    special = gone if repeated is None else staged(gone.union(repeated.toDF("key")).distinct(), "special-keys")
    bits = bitmap.build(special.select(F.xxhash64("key").alias("value")), special.count())
    hashed, asked_key = (_unused(rows, name) for name in ("hash", "key"))
    marked = rows.withColumn(hashed, F.xxhash64(key))
    stay = marked.mapInArrow(_by_bitmap(bits, False), rows.schema)
    asked = marked.mapInArrow(_by_bitmap(bits, True), rows.schema).withColumn(asked_key, key)
    asked = asked.join(gone.withColumnRenamed("key", asked_key), asked_key, "left_anti")
    if repeated is not None:
        asked = asked.dropDuplicates([asked_key])
    return stay.unionByName(asked.drop(asked_key))
