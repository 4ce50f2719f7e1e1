"""Python on the executors: hand them this package, and map frames batch by batch."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_given: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as spark-submit --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _given:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"{top.name}_llm.zip"  # addPyFile serves its own copy from the driver
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    _given.add(context.applicationId)


def give_back() -> None:
    """Hand memory that is free again back to the system: a worker lives on and serves the next stage too."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow on executors that can import this package."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)
