"""Tables that pipeline steps hand over: gold, and the walk-forward predictions.

As in the file-based pipeline, a step writes its result once and later steps read it.
The tables go to the shared folder of the cluster, so a lost executor loses nothing,
and are kept per application, input folder and state of its files: a table that was
rewritten under its old path is not answered from an old result.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from panelwatch.session import shared_dir

_WRITTEN: dict[tuple[str, str, int, str], tuple[str, StructType]] = {}


def files_state(spark: SparkSession, sf: str) -> int:
    """A number that changes when a file below the folder is added, removed or rewritten; reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sf)
    return files.agg(F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0))).first()[0]


def folder(spark: SparkSession) -> str:
    """Where this application keeps its tables."""
    return f"{shared_dir(spark)}/panelwatch-{spark.sparkContext.applicationId}"


def staged(spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Read the named table of this application and input, building and writing it on first use."""
    state = files_state(spark, sf)
    key = (spark.sparkContext.applicationId, sf, state, name)
    if key not in _WRITTEN:
        path = f"{folder(spark)}/{sha1(f'{sf} {state}'.encode()).hexdigest()[:12]}/{name}"
        build(spark, sf).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path, spark.read.parquet(path).schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove this application's tables; to be called before its session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    app = spark.sparkContext.applicationId
    for key in [k for k in _WRITTEN if k[0] == app]:
        del _WRITTEN[key]
