"""What the operators of this subpackage share: tables, shared folders and text as Arrow buffers."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cubelark.session import shared_folder, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; workers get this package."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[str, SparkSession] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing.

    The table stays until it is dropped, forgotten or the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def _delete(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``written`` gave, once nothing reads it any more; other DataFrames are left alone."""
    path = getattr(df, "_written", None)
    if path in _written:
        _delete(path, _written.pop(path))


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this driver has written to the shared folder; results that read them are void."""
    for path in list(_written):
        _written.pop(path)
        _delete(path, spark)


@atexit.register
def _forget_at_end() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001, S112: the JVM has gone before
            return


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def ints(column: pa.Array) -> np.ndarray:
    """A column of integers without nulls as int64."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def slices(batches, most: int, text: str = "text"):
    """Batches cut so that each holds about ``most`` bytes of ``text`` at most, a longer row alone."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
