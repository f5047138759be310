"""Tables written to the folder that all executors share, to cut lineage between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (local tests) a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gradeloom/{name}-{uuid.uuid4().hex}"


#: Arrow batches of steps that run inside an operator: whole texts are long, and a batch is held in two processes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


@contextmanager
def small_batches(spark: SparkSession):
    """The session's batch settings are BATCH for what runs inside, and as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, small: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; Spark's committer makes retries safe.

    ``small``: rows of a few numbers that an exchange has gathered; an eighth of the shuffle partitions write them, so that they don't
    make as many files as there are partitions."""
    path = scratch_path(df.sparkSession, name)
    if small:
        df = df.coalesce(max(8, width(df.sparkSession) // 8))
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gradeloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def own(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, names: list[str], further: str) -> StructType:
    """The schema of columns of ``df`` and of ``further`` ones; types are taken as they are, so that nested names may hold anything."""
    return StructType([*(df.schema[c] for c in names), *StructType.fromDDL(further).fields])


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
