"""Tables that are written once and read again, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the setting is missing, a session in local mode gets a temporary
    folder of its own; on a cluster that would be a folder of one machine, so
    it is an error there.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = "file://" + tempfile.mkdtemp(prefix="frameweft-")
    spark.conf.set("spark.checkpoint.dir", known)
    return known


#: The most that an Arrow batch holds on its way to a Python worker, unless the session asks for less.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that a batch of whole texts is as small as one of keys.

    The default counts rows: 10,000 texts on either side of the pipe, for each
    task of an executor. A single text of any length still goes in one batch.
    """
    known = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if not known or not known.rstrip("bB").isdigit() or int(known.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, as no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later reads
    neither repeat its work nor depend on the executors that did it."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/frameweft/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._frameweft_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; df can't be read any more."""
    path = getattr(df, "_frameweft_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _delete_all() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone, and its folder is the cluster's to clear
            return
