"""Arrow plumbing for operators that scan text or fold ordered state in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..runtime import ship


def map_rows(df: DataFrame, columns: list[str], schema: str, kernel: Callable[..., Iterable[tuple]]) -> DataFrame:
    """``kernel(*column_lists) -> tuples`` over the Arrow batches of the selected columns."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(kernel(*(c.to_pylist() for c in batch.columns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
