"""Arrow plumbing shared by the text operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..runtime import ship, spread, table

CHUNK_ROWS = 4096

__all__ = ["arrow_rows", "clean_blocks", "direct_elements", "scanned_blocks", "ocr_elements", "spread", "table"]


def arrow_rows(df: DataFrame, columns: list, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Run a Python kernel over Arrow batches.

    ``columns`` are selected first, so other columns (whatever their names) never reach Python. ``make()`` is
    called once per task and returns ``kernel(*column_lists) -> iterable of output tuples``; output is sent on
    in chunks so that a generator that multiplies rows does not build one huge batch.
    """
    ship(df.sparkSession)
    st: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            out: list[tuple] = []
            for row in kernel(*(c.to_pylist() for c in batch.columns)):
                out.append(row)
                if len(out) >= CHUNK_ROWS:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def clean_blocks(spark, sf_dir: str) -> DataFrame:
    """``blocks`` with null degradation: paragraphs and headings."""
    return table(spark, sf_dir, "blocks").where("degradation IS NULL")


def scanned_blocks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blocks").where("degradation = 'scanned'")


def _elements(spark, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "page_candidates").select("document_id", "page_index", F.posexplode(column).alias("line_index", "e")).select("document_id", "page_index", "line_index", "e.*")


def direct_elements(spark, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "direct_blocks")


def ocr_elements(spark, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "ocr_blocks")
