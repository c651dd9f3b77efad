"""Connected components of link tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: spark.checkpoint.dir or the context's own. Only where both are unset and all runs in
    this process a temporary folder is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(where or tempfile.mkdtemp(prefix="granary-"))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, root): the least id that each id reaches. Each round sends least labels over the links and to the labels'
    own labels, until none changes; labels are checkpointed, so lineage stays short and lost executors cost no round."""
    checkpoints(links.sparkSession)
    both = links.select(F.col(left).alias("id"), F.col(right).alias("to"))
    edges = both.union(both.select(F.col("to"), F.col("id"))).distinct().checkpoint()
    labels = edges.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("root")).checkpoint()
    while True:
        near = edges.join(labels.select(F.col("id").alias("to"), "root"), "to").groupBy("id").agg(F.min("root").alias("near"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = step.join(up, "root", "left").select("id", "old", F.coalesce(F.least("up", "root"), "root").alias("root")).checkpoint()
        labels = step.select("id", "root")
        if not step.where("root <> old").limit(1).count():
            return labels
