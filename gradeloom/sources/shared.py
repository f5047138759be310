"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one, but only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as there are shuffle partitions, for steps whose work is much against the size of their rows: a small file is one task otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def gathered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with all rows of a key in one task, over as many tasks as there are shuffle partitions: what is made of it by this key meets on it without another shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def growing(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that has rows for each environment: it is shuffled and merged, never collected to be broadcast, however small its compressed shuffle is."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/gradeloom-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
