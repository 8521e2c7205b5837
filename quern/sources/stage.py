"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where none is set, a cluster gets one below its warehouse, if that is in a store that all
    executors reach (a folder of one machine is refused); a temporary folder of this machine is
    made in local mode only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="quern-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not re.match(r"(?!file:)\w[\w+.-]*:", warehouse):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors reach; the warehouse is {warehouse}")
            folder = f"{warehouse.rstrip('/')}/_quern"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder (compressed by `codec`, else as the session has it) and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` made and nothing reads any more."""
    spark = df.sparkSession
    home = _home(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = folder.find(home.removeprefix("file://"))
        if at >= 0:
            delete(spark, folder)


def sweep(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are read or written elsewhere."""
    delete(spark, _home(spark))
