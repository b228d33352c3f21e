"""Intermediate tables in the folder that all executors share, and connected components over edge tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset in local mode, as in tests, one of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written once and read back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/constella-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        self._fs.deleteOnExit(self._path(self.folder))
        self._at: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        out._scratch = self  # keeps the id alive as long as the frame
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later frame reads."""
        for df in frames:
            if path := self._at.pop(id(df), None):
                self._fs.delete(self._path(path), True)


def beside(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of ids, broadcast when it holds at most ``most`` rows and joined by shuffle beyond that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v``, which is no ``u`` itself; edges lead from greater to smaller ids."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").limit(1).count() == 0


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until all edges lead to the centre of a star, which has
    the least id. Hot nodes: minima are
    combined before the shuffle and written, so that joins on a node with very many edges read two plain shuffles, which
    adaptive execution splits.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.save(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small)
        scratch.drop(now, least, large, low)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", F.col("v").alias("w")).distinct())
