"""Session-level helpers: durable cuts of lineage and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir`` where the session names one.  Only where it
    is unset and everything runs on one machine, as in tests, a temporary folder
    is made and set; a cluster must name a folder that its executors share.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="hybridrank-")
        spark.conf.set("spark.checkpoint.dir", set_to)
        _remove_at_exit(spark, set_to)
    return set_to


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def gone() -> None:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before
            pass

    atexit.register(gone)


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table survives the loss of any executor and cuts the lineage, so
    an iterative plan stays one step long.  Tables are Parquet: columnar, and
    read back with their known schema, without an inference job.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/hybridrank-{tag}-{uuid.uuid4().hex[:12]}"
        self.facts: dict[str, object] = {}
        _remove_at_exit(spark, self.base)

    def keep(self, df: DataFrame, name: str, **facts) -> DataFrame:
        """Write ``df`` and return it read back; ``facts`` are aggregates taken
        in the same pass and left in ``self.facts``."""
        schema, path = df.schema, f"{self.base}/{name}"
        if facts:
            seen = Observation()
            df = df.observe(seen, *[c.alias(k) for k, c in facts.items()])
        df.write.mode("overwrite").parquet(path)
        if facts:
            self.facts = seen.get
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.base}/{name}")


def small_side(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``most`` rows.

    The count stops at ``most + 1`` rows.  A larger side comes back without a
    hint, and the join shuffles.  For joins on equal keys only: any other join
    would then compare all pairs.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with the place of every row in the whole order, from 1.

    Rows are sorted by ranges and numbered where they are; only the size of
    every partition reaches the driver.  ``order`` should tell all rows apart.
    """
    spark = df.sparkSession
    low = (1 << 33) - 1  # what monotonically_increasing_id leaves to a partition
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = Scratch(spark, "numbered").keep(sorted_, "rows")
    part, before, offsets = F.shiftright("__id", 33), 0, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["count"]
    known = F.broadcast(spark.createDataFrame(offsets, "__p long, __before long"))
    place = F.col("__id").bitwiseAND(F.lit(low)) + F.col("__before") + 1
    return rows.join(known, part == F.col("__p")).withColumn(out, place).drop("__id", "__p", "__before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test or production table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
