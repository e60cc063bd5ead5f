"""All tables of a run, written under one prefix, each as a folder that Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import plots
from ..sources import writers
from .runs import Run


def distances(graph: DataFrame, nodes: DataFrame, prefix: str) -> None:
    """prefix.names and prefix.distances, which a later run can start from."""
    writers.names(nodes, f"{prefix}.names")
    writers.distances(graph, nodes, f"{prefix}.distances")


def results(run: Run, prefix: str, names: bool = True, sound: bool = False) -> list[str]:
    """Write what a run has found; the endings of the folders written.

    embedding (x, y in the order of ids), dot, eq, telemetry, hexbin and plot always; hdbscan_clusters where points were clustered, frames where
    they were taken, and sound of them if asked for.  The plot's classes are clusters, else labels, else -1 for all; without ``names`` it has none.
    """
    spark, done = run.points.sparkSession, []

    def write(ending, table, **csv):
        (table.write.options(**csv).csv if csv else table.write.parquet)(f"{prefix}.{ending}")
        done.append(ending)

    writers.embedding(run.points, f"{prefix}.embedding")
    writers.dot(run.points, run.nodes, f"{prefix}.embedding.dot")
    done += ["embedding", "embedding.dot"]
    write("eq", spark.createDataFrame([(int(k), float(v)) for k, v in run.eq], "epoch long, eq double").orderBy("epoch"), header=True)
    write("telemetry", run.layout.telemetry().orderBy("epoch"), header=True)
    write("hexbin", plots.hexbin(run.points))
    if run.clusters is not None:
        writers.clusters(run.nodes, run.clusters, f"{prefix}.embedding_hdbscan_clusters")
        done.append("embedding_hdbscan_clusters")
        classes = run.clusters.select("id", F.col("cluster").cast("string").alias("cluster"))
    elif run.labels is not None:
        classes = run.labels.select("id", F.col("label").alias("cluster"))
    else:
        classes = run.nodes.select("id", F.lit("-1").alias("cluster"))
    table = plots.split_noise(plots.point_styles(plots.plot_table(run.points, run.nodes, classes), "cluster"), "cluster")
    write("plot", table if names else table.drop("name"))
    write("classes", plots.top_classes(classes, "cluster"), header=True)
    if run.layout.animated:
        write("frames", run.frames.repartitionByRange("frame").sortWithinPartitions("frame", "id"))
        if sound:
            writers.wave(run.sound(), f"{prefix}.sound")
            done.append("sound")
    return done
