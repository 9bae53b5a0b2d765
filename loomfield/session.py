"""Session settings, table access and plan helpers shared by all operators."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterable
from hashlib import sha256
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that queries rely on for equal results; the rest is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    conf = SETTINGS | {
        "spark.master": f"local[{cores}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.appName("loomfield").config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shipped(spark: SparkSession) -> None:
    """Give the executors this package, once a session: Spark's driver serves it as a zip file to workers that cannot import it."""
    context = spark.sparkContext
    if getattr(context, "_loomfield", False):
        return
    home = Path(__file__).resolve().parent
    if home.suffix == ".zip" or not home.is_dir():  # already running from what was sent
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for file in sorted(home.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{home.name}/{file.relative_to(home)}"), file.read_bytes())
    target = Path(tempfile.mkdtemp(prefix="loomfield-")) / f"loomfield_{sha256(body.getvalue()).hexdigest()[:12]}.zip"
    target.write_bytes(body.getvalue())
    context.addPyFile(str(target))
    context._loomfield = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.

    Only where ``spark.checkpoint.dir`` is unset and the master is local is a folder of this machine used.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomfield-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for files that tasks read themselves. It is removed as the application ends."""
    folder = f"{_checkpoint_folder(spark)}/{name}-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


#: Operators that move rows between tasks: past one of them, a plan is dealt out already, and asking for its partitions would run it.
_MOVING = re.compile(r"(?m)^[ :+\-|]*(?:Join|Aggregate|Window|Sort|Repartition\w*|Distinct|Deduplicate|Intersect|Except|GlobalLimit)\b")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out when a scan has fewer splits than the cluster has cores, before Python work.

    A large input has more splits than cores and passes unchanged, without a shuffle; so does a plan that shuffles anyway.
    """
    if df.isStreaming or _MOVING.search(df._jdf.queryExecution().analyzed().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Hashed numbers of keys; so many at most are broadcast.
SLOTS = 1 << 18


def likely(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose columns may be among those of ``keys``, by hashed numbers of which there are ``SLOTS``, so that they can be broadcast.

    For what an exact join follows: no row that it needs is lost, and most others never reach its shuffle. Columns are matched by position.
    """
    slot = lambda names: F.pmod(F.xxhash64(*names), F.lit(SLOTS)).cast("int").alias("_slot")
    return df.withColumn("_slot", slot(columns)).join(F.broadcast(keys.select(slot(keys.columns)).distinct()), "_slot", "left_semi").drop("_slot")  # at most SLOTS numbers


def rows_of(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)


def running_sums(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds running sums of columns over all rows in an order, each row's own value included.

    A window over everything would put all rows into one task; here rows are dealt out by ordered ranges, windows run within a
    range, and only one row a range takes part in the window that gives the sums of the ranges before. Equal rows share a range.
    """
    from pyspark.sql import Window

    names = {k: f"_own_{k}" for k in values}
    ranged = checkpointed(df.withColumns({names[k]: v for k, v in values.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_range").agg(*[F.sum(n).alias(n) for n in names.values()])
    outer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(f"_before{n}") for n in names.values()])
    within = ranged.withColumns({k: F.sum(n).over(inner) for k, n in names.items()})
    return within.join(before, "_range").withColumns({k: F.col(k) + F.col(f"_before{n}") for k, n in names.items()}).drop("_range", *names.values(), *[f"_before{n}" for n in names.values()])


def lag_in_blocks(df: DataFrame, key: str, order: str, value: Column, block: int = 1024) -> DataFrame:
    """Adds ``previous``: ``value`` of the row before in ``order`` among the rows of ``key``, null for the first.

    ``order`` is an integer, unique within ``key``. A window over ``key`` alone would put a hot key into one task;
    here windows run over (key, block of the order), and only one row a block takes part in a second window.
    """
    from pyspark.sql import Window

    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    inner = Window.partitionBy(key, "_block").orderBy(order)
    seen = blocked.withColumn("_n", F.row_number().over(inner)).withColumn("_inner", F.lag("_value").over(inner))
    last = blocked.groupBy(key, "_block").agg(F.max_by("_value", F.col(order)).alias("_last"))
    outer = Window.partitionBy(key).orderBy("_block")
    carried = last.select(key, "_block", F.lag("_last").over(outer).alias("_carried"))
    joined = seen.join(carried, [key, "_block"], "left")
    previous = F.when(F.col("_n") == 1, F.col("_carried")).otherwise(F.col("_inner"))
    return joined.withColumn("previous", previous).drop("_block", "_value", "_n", "_inner", "_carried")
