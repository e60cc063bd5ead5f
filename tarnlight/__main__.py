"""python -m tarnlight: from one input to all tables of a run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import __version__
from .operators.layout import LayoutOptions
from .plans import runs, save
from .plans.options import RunOptions
from .sources import readers

#: Epochs of a run, and of one with an animation, whose schedule then has 400 frames.
EPOCHS, ANIMATED_EPOCHS = 60, 1_200


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("tarnlight", description="Distances, layout and clusters of samples.")
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--alignment", help="FASTA or FASTQ of aligned sequences")
    mode.add_argument("--accessory", help="tab-separated presence and absence of features")
    mode.add_argument("--sketches", help="Parquet table (name, k, hashes)")
    mode.add_argument("--distances", help="folder .distances of an earlier run, or a local .npz")
    p.add_argument("--output", default="tarnlight", help="prefix of all output folders")
    p.add_argument("--labels", help="table of names and labels, which take the place of clusters")
    p.add_argument("--weight-file", help="table of names and weights")
    p.add_argument("--no-html-labels", action="store_true", help="no names in the plot table")
    p.add_argument("--animate", action="store_true", help="keep frames")
    p.add_argument("--animate-sound", action="store_true", help="write the sound of the frames")
    sparse = p.add_mutually_exclusive_group()
    sparse.add_argument("--threshold", type=float)
    sparse.add_argument("--kNN", type=int)
    p.add_argument("--use-accessory", action="store_true", help="accessory instead of core distances of sketches")
    p.add_argument("--genomes", help="Parquet table (name, length, a, c, g, t): take chance matches of sketches off")
    p.add_argument("--no-preprocessing", action="store_true", help="1 - distance instead of calibrated probabilities")
    p.add_argument("--no-clustering", action="store_true")
    p.add_argument("--perplexity", type=float, default=15.0)
    p.add_argument("--maxIter", type=int, default=100_000, help="edges drawn in all")
    p.add_argument("--nRepuSamp", type=int, default=5)
    p.add_argument("--eta0", type=float, default=1.0)
    p.add_argument("--bInit", type=int, choices=(0, 1), default=0, help="1: strong attraction in the first tenth")
    p.add_argument("--cpus", type=int, default=1, help="threads of a local session; a cluster's own settings win")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--version", action="version", version=__version__)
    o = p.parse_args(args)
    if o.cpus < 1:
        p.error("cpus must be positive")
    if o.maxIter < 1:
        p.error("maxIter must be positive")
    if o.kNN is None and o.threshold is None and not o.distances:
        p.error("give one of --kNN and --threshold, unless there are --distances")
    if o.sketches and o.threshold is not None:
        p.error("use --kNN with --sketches")
    return o


def run(o: argparse.Namespace, spark: SparkSession) -> runs.Run:
    """The run that the options ask for; its distances are written as soon as they are known."""
    layout = LayoutOptions(epochs=ANIMATED_EPOCHS if o.animate else EPOCHS, n_repulse=o.nRepuSamp, eta0=o.eta0, boost=bool(o.bInit), seed=o.seed, frames=o.animate)
    how = RunOptions(k=o.kNN, threshold=o.threshold, stored=bool(o.distances), perplexity=-1.0 if o.no_preprocessing else o.perplexity, draws=o.maxIter, layout=layout)
    source = o.alignment or o.accessory or o.sketches or o.distances
    for path in (source, o.labels, o.weight_file, o.genomes):
        if path is not None:
            readers.must_exist(spark, path)
    more = {
        "weights": readers.weights(spark, o.weight_file) if o.weight_file else None,
        "labels": readers.labels(spark, o.labels) if o.labels else None,
        "clustering": not o.no_clustering,
    }
    if o.distances:
        return runs.from_stored(spark, o.distances, how, **more)
    more["found"] = lambda graph, nodes: save.distances(graph, nodes, o.output)
    if o.alignment:
        return runs.from_alignment(spark, o.alignment, how, **more)
    if o.accessory:
        return runs.from_presence(spark, o.accessory, how, **more)
    nodes, hashes, genomes = readers.sketches(spark, o.sketches, o.genomes)
    return runs.from_sketches(hashes, nodes, how, "accessory" if o.use_accessory else "core", genomes=genomes, **more)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run and write everything; the endings of the folders written beside the distances."""
    o = options(args)
    if spark is None:
        from .session import local_session

        spark = SparkSession.getActiveSession() or local_session("tarnlight", o.cpus)
    return save.results(run(o, spark), o.output, not o.no_html_labels, o.animate_sound)


if __name__ == "__main__":
    print("\n".join(main()), file=sys.stderr)
