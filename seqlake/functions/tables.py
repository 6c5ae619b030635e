"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import StoreError

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="seqlake-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table written by :func:`materialize` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession, after: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that :func:`materialize` has written in this process; returns how many.

    For a long-lived session, once the results that read them are written.  ``after`` leaves the first so many (see
    :func:`made`), and the files that ``keep`` reads stay.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    name = lambda p: p.rsplit("/", 1)[-1]
    needed = {name(f.rsplit("/", 1)[0]) for f in keep.inputFiles()} if keep is not None else set()
    gone = [p for p in _made[after:] if name(p) not in needed]
    _made[after:] = [p for p in _made[after:] if name(p) in needed]
    done = 0
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        done += path.getFileSystem(conf).delete(path, True)
    return done


def made() -> int:
    """How many tables there are that :func:`release` would delete."""
    return len(_made)


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with the 1-based place of each row in the order of ``order``, without gathering the rows in one task."""
    return numbered(df, *order, name=name)[0]


def numbered(df: DataFrame, *order: str, name: str = "pos") -> tuple[DataFrame, int]:
    """(``df`` with the 1-based place of each row in the order of ``order``, how many rows there are).

    Rows are dealt by ranges, sorted and written once; the driver holds one count for each partition.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, bases = 0, []
    for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        bases.append((r["__part"], before))
        before += r["n"]
    base = F.broadcast(spark.createDataFrame(bases or [(0, 0)], "__part int, __base long"))
    return dealt.join(base, "__part").withColumn(name, F.col("__base") + F.col("__nth") + 1).select(*df.columns, name), before
