"""Connected components of a table of links, as joins and grouped sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only where none is set, as in tests, a folder in the
    warehouse is used, and only by a local session: elsewhere the warehouse may be a folder of the driver alone.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return context.getCheckpointDir()


def kept_frame(df: DataFrame) -> DataFrame:
    """The frame, checkpointed at once to the shared folder, so that no lost executor takes it away."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Written:
    """A frame written as Parquet to the shared folder; unlike a checkpoint's, its size is known to later plans."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.frame = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        """Delete the files, once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The frame of few, narrow columns, marked for broadcast if a count finds at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), both bigint; nodes of one component share their root.

    Links are contracted: in each round every node moves to the neighbour, or itself, that comes first in an
    order drawn anew for the round, and links within one node go.  A round leaves at most the nodes that come
    first among some neighbours, so the number of rounds grows with the logarithm of the longest chain.  Only
    ids move; a node with very many links is summed up before the shuffle, and its join is split at run time.
    An empty table gives no rows.  Which node of a component is its root is not promised.
    """
    links = Written(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    nodes = links.frame.select(F.col("a").alias("node")).union(links.frame.select("b")).distinct()
    labels = Written(nodes.select("node", F.col("node").alias("root")))
    turn = 0
    while not links.frame.isEmpty():
        moves = Written(_moves(links.frame, turn))
        old = [links, labels, moves]
        here = moves.frame.withColumnRenamed("node", "a")
        there = moves.frame.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        ends = links.frame.join(here, "a").join(there, "b").where(F.col("to") != F.col("b_to"))
        links = Written(ends.select(F.col("to").alias("a"), F.col("b_to").alias("b")).distinct())
        moved = labels.frame.join(moves.frame.withColumnRenamed("node", "root"), "root", "left")
        labels = Written(moved.select("node", F.coalesce("to", "root").alias("root")))
        for table in old:
            table.remove()
        turn += 1
    links.remove()
    return labels.frame


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """(node, to): the first of each node and its neighbours, in the order drawn for this round."""
    first = [F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("to")) for c in ("a", "b")]
    sides = links.select("a", "b").union(links.select("b", "a"))
    return sides.groupBy("a").agg(F.least(*map(F.min, first))["to"].alias("to")).withColumnRenamed("a", "node")
