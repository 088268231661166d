"""Connected components by labels that take over the least neighbour's and jump to its label."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUB_EDGES, HUBS = 500, 2000


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """The cluster's folder that spark.checkpoint.dir names; a local one only where it is unset and all runs on this machine."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() is not None:
        return
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="terrasift-"))


def with_labels(edges: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """edges (id, to) with the component of `to`. Ids on more than a HUBS-th of the n edges meet their label by broadcast: they are 2 * HUBS at most."""
    hubs = edges.groupBy("to").agg(F.count("*").alias("d")).where(F.col("d") > max(HUB_EDGES, n // HUBS)).select("to")
    known = labels.withColumnRenamed("id", "to")
    few = F.broadcast(known.join(F.broadcast(hubs), "to"))
    rest = edges.join(F.broadcast(hubs), "to", "left_anti").join(known, "to")
    return edges.join(few, "to").unionByName(rest)


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes (id) under edges (l, r); component is the least id reached."""
    ensure_checkpoint_dir(nodes)
    both = edges.select(F.col("l").alias("id"), F.col("r").alias("to")).unionByName(edges.select(F.col("r").alias("id"), F.col("l").alias("to"))).checkpoint()
    n = both.count()
    labels = nodes.select("id", F.col("id").alias("component")).checkpoint()
    while True:
        low = with_labels(both, labels, n).groupBy("id").agg(F.min("component").alias("low"))
        new = labels.join(low, "id", "left").select("id", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        # The label's own label: halves the way to the least in each round.
        jump = new.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = new.join(jump, "next", "left").select("id", "component", F.least("next", F.coalesce("far", "next")).alias("next")).checkpoint()
        changed = new.where(F.col("next") != F.col("component")).limit(1).count()
        labels = new.select("id", F.col("next").alias("component"))
        if not changed:
            return labels
