"""Registry of the core queries: name to Spark callable, and name to oracle SQL.

Every query runs over its whole tables.  Samples stand for: a row of ``embeddings`` (its components, cut into 16 steps, as
an alignment of 64 bases; its first two as a layout), a supplier (its parts as features), a document (its name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases, schedule, wave
from ..operators import audio, cluster, edges, layout, naming, plots, probability, sketches, storage
from ..sources import readers, sequences, writers
from . import runs
from .options import RunOptions

#: Characters that stand for the steps of a component: all codes, a gap and an unknown base.
ALPHABET, LENGTH = "ACGTMRWSYKVHDBN-", 64
K, PERPLEXITY = 15, 5.0


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _msa(spark, sf):
    code = lambda x: F.substring(F.lit(ALPHABET), (F.pmod(F.floor(F.abs(x.cast("double")) * 100), F.lit(16)) + 1).cast("int"), F.lit(1))
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.array_join(F.transform("embedding", code), "").alias("seq"))


def _presence(spark, sf):
    return _table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("feature"))


def _suppliers(spark, sf):
    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def _points(spark, sf):
    at = lambda k: F.element_at("embedding", k).cast("double")
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), at(1).alias("x"), at(2).alias("y"))


def _frames(spark, sf):
    at = lambda k: F.element_at("embedding", k).cast("double")
    return _table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("id"), F.floor(F.col("vec_id") / 50).alias("frame"), at(1).alias("x"), at(2).alias("y"))


def _edges(spark, sf):
    return edges.vector_knn(_table(spark, sf, "embeddings"), "vec_id", "embedding", K)


def _r(*columns: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in columns]


def _rd(*columns: str):
    """Distances to six digits, for many rows: ``_r`` makes a BigDecimal of each; like SQL, this rounds the product."""
    return [F.when(F.col(c) < 1e9, F.floor(F.col(c) * 1e6 + 0.5) / 1e6).otherwise(F.col(c)).alias(c) for c in columns]


def iupac_encode(spark, sf):
    planes = edges.encoded(_msa(spark, sf), LENGTH)
    return planes.select("id", *[F.col(b)[k].alias(f"{b.lower()}{k}") for b in bases.BASES for k in range(2)])


def snp_distance(spark, sf):
    return edges.snp_all(_msa(spark, sf), LENGTH)


def snp_knn_ties(spark, sf):
    return edges.snp_knn(_msa(spark, sf), LENGTH, K).select("i", "j", *_r("d"))


def snp_threshold(spark, sf):
    return edges.snp_threshold(_msa(spark, sf), LENGTH, 0.1).select("i", "j", *_r("d"))


def jaccard_distance(spark, sf):
    return edges.jaccard(_presence(spark, sf), _suppliers(spark, sf)).select("i", "j", *_rd("d"))


def jaccard_knn(spark, sf):
    return edges.jaccard_knn(_presence(spark, sf), _suppliers(spark, sf), K).select("i", "j", *_r("d"))


def jaccard_threshold(spark, sf):
    return edges.jaccard_threshold(_presence(spark, sf), _suppliers(spark, sf), 0.85).select("i", "j", *_r("d"))


def vector_knn(spark, sf):
    return _edges(spark, sf).select("i", "j", *_r("d"))


def perplexity_p(spark, sf):
    return probability.perplexity(_edges(spark, sf), PERPLEXITY).select("i", "j", *_r("p"))


def edge_normalise(spark, sf):
    return probability.normalised(probability.perplexity(_edges(spark, sf), PERPLEXITY), "p").select("i", "j", *_r("p", digits=9))


def raw_similarity(spark, sf):
    return probability.raw_similarity(_edges(spark, sf)).select("i", "j", *_r("p"))


def _documents(spark, sf):
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("name"))


def _named_labels(spark, sf):
    return _table(spark, sf, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("toxic").cast("string").alias("label"), F.col("quality").cast("double").alias("weight"))


def labels_join(spark, sf):
    return naming.labelled(_documents(spark, sf), _named_labels(spark, sf))


def weights_join(spark, sf):
    """Nodes that all have a weight: the labelled documents."""
    marked = _table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("name")).distinct()
    return naming.weighted(marked, _named_labels(spark, sf))


def weights_mismatch(spark, sf):
    """Documents of which only some have a weight: all get 1."""
    return naming.weighted(_documents(spark, sf), _named_labels(spark, sf))


def name_symdiff(spark, sf):
    return naming.symmetric_difference(_documents(spark, sf), _named_labels(spark, sf))


def cdf_table(spark, sf):
    p = probability.normalised(probability.perplexity(_edges(spark, sf), PERPLEXITY), "p")
    return probability.cumulative(p, ["i", "j"], "p").select("i", "j", *_r("cum_lo", "cum_hi"))


def weighted_draw(spark, sf):
    """Draws from suppliers in proportion to their order lines."""
    w = _presence(spark, sf).groupBy("id").agg(F.count("*").cast("double").alias("w"))
    table = probability.cumulative(probability.normalised(w, "w"), ["id"], "w")
    draws = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"), (F.pmod(F.col("o_orderkey") * 7919, F.lit(100_003)) / 100_003.0 + 1e-6).alias("u"))
    return probability.weighted_draw(table, draws).select("draw", "id")


def _lines(spark, sf):
    return _presence(spark, sf).groupBy("id").agg(F.count("*").cast("double").alias("w"))


def alias_mass(spark, sf):
    """The probability of each supplier in the alias table of their order lines."""
    return probability.alias_mass(probability.alias_table(_lines(spark, sf))).select("id", *_r("p", digits=9))


def alias_draws(spark, sf):
    """A supplier for each order, drawn from that table."""
    u = lambda by: F.pmod(F.col("o_orderkey") * by, F.lit(100_003)) / 100_003.0
    draws = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"), u(104_729).alias("u"), u(7919).alias("v"))
    return probability.alias_draw(probability.alias_table(_lines(spark, sf)), draws).select("draw", "id")


def sce_step(spark, sf):
    p = _points(spark, sf)
    return layout.moved(p, layout.forces(p, _pairs(spark, sf), 0.5, 0.7, 2.0, 5)).select("id", *_r("x", "y"))


def eq_update(spark, sf):
    """Eq after each label's nodes, taken as the draws of one step: ten rows come to the driver, as a run's epochs do."""
    q = _table(spark, sf, "embeddings").select("label", (1 / (1 + F.element_at("embedding", 1).cast("double") ** 2)).alias("q"))
    eq, n = 1.0, q.count()
    for r in q.groupBy("label").agg(F.sum("q").alias("s"), F.count("*").alias("n")).orderBy("label").collect():
        eq = layout.eq_next(eq, n, r["s"], r["n"])
    return spark.createDataFrame([(eq,)], "eq double").select(F.round("eq", 9).alias("eq"))


def _pairs(spark, sf):
    p = _points(spark, sf)
    return p.select(F.col("id").alias("k"), (F.col("id") + 1).alias("l"), (F.col("id") % 3 != 0).alias("repel"))


def self_draws(spark, sf):
    """A step in which every fifth draw meets its own node: it moves nothing."""
    p = _points(spark, sf)
    drawn = _pairs(spark, sf).withColumn("l", F.when(F.col("k") % 5 == 0, F.col("k")).otherwise(F.col("l")))
    return layout.moved(p, layout.forces(p, drawn, 0.5, 0.7, 2.0, 5)).select("id", *_r("x", "y"))


def first_layout(spark, sf):
    """Where nodes start, in ten-thousandths."""
    at = layout.start(_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), 1)
    return at.select("id", *[F.round(F.col(c) * 1e4, 6).alias(c) for c in "xy"])


def telemetry(spark, sf):
    """What a layout of three epochs with given draws reports: each vector with the next, in the epoch of its label."""
    epochs = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), (F.col("label") % 3).cast("int").alias("epoch"))
    made = layout.steps(_points(spark, sf), _pairs(spark, sf).join(epochs, "k"))
    return made.telemetry().select("epoch", *_r("percent", "eta", "eq", digits=9), "draws", "clashes")


def run_frames(spark, sf):
    """Events taken as steps: those at which an animation of as many steps takes a frame."""
    steps = _table(spark, sf, "events").select(F.col("event_id").alias("step"))
    return schedule.frames_taken(steps, steps.count())


def worker_split(spark, sf):
    """Iterations of each worker, for suppliers' numbers taken as numbers of workers."""
    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("workers"), schedule.split_steps(F.lit(100_000), F.col("s_suppkey"), 8).alias("steps"))


def step_collisions(spark, sf):
    return layout.collisions(_pairs(spark, sf))


def eq_prefix(spark, sf):
    """Each label's mean first component as a step's value, in all frames from that step on."""
    s = _table(spark, sf, "embeddings").groupBy(F.col("label").alias("step")).agg(F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("eq"))
    return plots.eq_prefixes(s)


def sorted_labels(spark, sf):
    return plots.sorted_labels(_table(spark, sf, "events"), "event_type")


def eta_schedule(spark, sf):
    """Rates of a run with a step for each event."""
    at = _table(spark, sf, "events").select(F.col("event_id").alias("step"))
    steps = at.count()
    eta, a = schedule.eta(F.col("step"), steps), schedule.attraction(F.col("step"), steps, True)
    return at.select("step", F.round(eta, 9).alias("eta"), a.alias("attraction"), F.round(schedule.repulsion(1.0 / (F.col("step") + 1), 5), 9).alias("repulsion"))


def frame_schedule(spark, sf):
    """The step at which a run with a step for each event takes the frame of each supplier's number."""
    steps = _table(spark, sf, "events").count()
    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), schedule.frame_point(F.col("s_suppkey") % (schedule.FRAMES - 1), steps).alias("step"))


def scale_centre(spark, sf):
    return cluster.scaled(_points(spark, sf)).select("id", *_r("x", "y"))


def zscore_frame(spark, sf):
    return audio.z_scored(_frames(spark, sf)).select("frame", "id", *_r("x", "y"))


def frame_delta(spark, sf):
    return audio.motion(audio.z_scored(_frames(spark, sf))).select("frame", *_r("dx", "dy"))


def freq_map(spark, sf):
    return audio.frequencies(audio.motion(audio.z_scored(_frames(spark, sf)))).select("frame", *_r("fx", "fy"))


def core_distance(spark, sf):
    return cluster.core_distances(_points(spark, sf)).select("id", *_r("core"))


def mutual_reachability(spark, sf):
    p = _points(spark, sf)
    return cluster.mutual_reachability(p, cluster.core_distances(p)).select("i", "j", *_rd("d"))


def mst_weight(spark, sf):
    p = cluster.scaled(_points(spark, sf))
    tree = cluster.spanning_tree(p)
    return tree.agg(F.count("*").alias("n_edges"), F.round(F.sum("d"), 6).alias("weight"))


def hdbscan_labels(spark, sf):
    return cluster.hdbscan(_points(spark, sf))


def hexbin(spark, sf):
    return plots.hexbin(_points(spark, sf)).select(*_r("cx", "cy"), "n")


def _classes(spark, sf):
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") - 1).alias("cluster"))


def noise_split(spark, sf):
    return plots.split_noise(_classes(spark, sf), "cluster")


def plot_table(spark, sf):
    """All that a scatter plot of the embeddings' first components needs."""
    return plots.plot_table(_points(spark, sf).select("id", *_r("x", "y")), _vector_names(spark, sf), _classes(spark, sf))


def class_sizes(spark, sf):
    return plots.class_sizes(_table(spark, sf, "embeddings"), "label")


def top_classes(spark, sf):
    return plots.top_classes(_table(spark, sf, "events"), "user_id")


def point_size(spark, sf):
    return plots.point_styles(_table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 1).alias("label")), "label")


def n_clusters(spark, sf):
    return cluster.n_clusters(_table(spark, sf, "embeddings").select((F.col("label") - 1).alias("cluster")))


def colour_map(spark, sf):
    return plots.colours(_table(spark, sf, "embeddings"), "label")


def triangle_wave(spark, sf):
    v = F.col("value") / 10
    return _table(spark, sf, "events").select("event_id", F.round(wave.triangle(v - F.floor(v)), 6).alias("amp"))


def adsr(spark, sf):
    v = F.col("value") / 7
    return _table(spark, sf, "events").select("event_id", F.round(wave.envelope(v - F.floor(v)), 6).alias("level"))


def synth(spark, sf):
    notes = _table(spark, sf, "events").select((F.col("event_id") / 20).alias("start"), (wave.LOW + F.col("event_id") % 1200).alias("freq"))
    return audio.synthesised(notes, 1000, 1e9).select("t", *_r("amp"))


def pcm_scale(spark, sf):
    notes = _table(spark, sf, "events").select((F.col("event_id") / 20).alias("start"), (wave.LOW + F.col("event_id") % 1200).alias("freq"))
    return audio.pcm(audio.synthesised(notes, 100, 1e9))


def stereo(spark, sf):
    return audio.stereo(_frames(spark, sf), 20.0, 200, 1e9)


def _vector_names(spark, sf):
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("name"))


def fasta_read(spark, sf):
    """The alignment written as FASTA, lines of 20 bases, and read back."""
    msa = _msa(spark, sf)
    lines = F.concat(F.lit(">v"), "id", F.lit(" sample\n"), F.rtrim(F.regexp_replace("seq", "(.{20})", "$1\n"), F.lit("\n")))
    path = storage.new_path(spark, "fasta")
    msa.select(lines.alias("value")).write.text(path)
    return readers.fasta(spark, path).select("name", "seq", F.length("seq").cast("long").alias("length"))


def fastq_read(spark, sf):
    """The alignment written as FASTQ, with lines of 20 bases and quality strings of the characters that begin other lines, and read back."""
    cut = lambda c: F.rtrim(F.regexp_replace(c, "(.{20})", "$1\n"), F.lit("\n"))
    lines = F.concat(F.lit("@v"), "id", F.lit(" sample\n"), cut(F.col("seq")), F.lit("\n+\n"), cut(F.translate("seq", "ACGTMRWSYKVHDBN-", "@+>!@+>!@+>!@+>!")))
    path = storage.new_path(spark, "fastq")
    _msa(spark, sf).select(lines.alias("value")).write.text(path)
    return sequences.sequences(spark, path).select("name", "seq", F.length("seq").cast("long").alias("length"))


def rtab_read(spark, sf):
    """Suppliers and their parts written as a feature matrix and read back."""
    ids = _suppliers(spark, sf).agg(F.array_sort(F.collect_set("id"))).first()[0]  # a matrix has a column for each supplier
    path = storage.new_path(spark, "rtab")
    writers.matrix(_presence(spark, sf).select("feature", "id"), ids, path)
    nodes, cells = readers.rtab(spark, path)
    return cells.join(nodes, "id").select("name", "feature")


def distances_reload(spark, sf):
    """Nearest neighbours written as a run's distances, sorted by i and j, and read back."""
    path = storage.new_path(spark, "distances")
    writers.distances(_edges(spark, sf), _vector_names(spark, sf), path)
    found, nodes = readers.distances(spark, path)
    return found.join(nodes.withColumnRenamed("id", "i"), "i").select("name", "j", *_r("d"))


def labels_file(spark, sf):
    path = storage.new_path(spark, "labels")
    _named_labels(spark, sf).select("name", "label").write.option("sep", "\t").csv(path)
    return readers.labels(spark, path)


def weights_file(spark, sf):
    path = storage.new_path(spark, "weights")
    _named_labels(spark, sf).select("name", "weight").write.option("sep", "\t").csv(path)
    return readers.weights(spark, path)


def names_file(spark, sf):
    path = storage.new_path(spark, "names")
    writers.names(_suppliers(spark, sf), path)
    return spark.read.schema("name string").csv(path)


def embedding_file(spark, sf):
    path = storage.new_path(spark, "embedding")
    writers.embedding(_points(spark, sf).select("id", *_r("x", "y")), path)
    return spark.read.schema("x double, y double").option("sep", " ").csv(path)


def bare_names(spark, sf):
    """Supplier names of which every third ends as a sketch database does."""
    named = _table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(".h5"))).otherwise(F.col("s_name")).alias("file"))
    return named.select("s_suppkey", naming.bare_names(F.col("file")).alias("name"))


def edge_count(spark, sf):
    return edges.snp_threshold(_msa(spark, sf), LENGTH, 0.1).agg(F.count("*").alias("n_edges"))


def jaccard_knn_all(spark, sf):
    """As many neighbours as there are other suppliers: what k = 0 means for feature sets."""
    nodes = _suppliers(spark, sf)
    return edges.jaccard_knn(_presence(spark, sf), nodes, nodes.count() - 1).select("i", "j", *_rd("d"))


def dot_lines(spark, sf):
    return writers.dot_lines(_points(spark, sf).select("id", *_r("x", "y", digits=3)), _points(spark, sf).select("id", F.concat(F.lit("v"), "id").alias("name")))


def cluster_csv(spark, sf):
    e = _table(spark, sf, "embeddings")
    return writers.cluster_table(e.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("name")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")))


def _sketch(spark, sf):
    li = _table(spark, sf, "lineitem")
    parts = [F.col("l_partkey").cast("string"), F.concat_ws("/", "l_partkey", "l_returnflag"), F.concat_ws("/", "l_partkey", "l_returnflag", "l_linestatus")]
    return li.select(F.col("l_suppkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(k + 1).alias("k"), p.alias("hash")) for k, p in enumerate(parts)])).alias("s")).select("id", "s.k", "s.hash")


def minhash_jaccard(spark, sf):
    return sketches.jaccard_by_k(_sketch(spark, sf)).select("i", "j", "k", *_r("jaccard"))


def core_accessory(spark, sf):
    return sketches.all_distances(_sketch(spark, sf)).select("i", "j", *_rd("core", "accessory"))


def _genomes(spark, sf):
    """Suppliers' order lines as genomes: short ones, by the quantities, with the remainders of part numbers as bases."""
    share = lambda k: F.avg((F.col("l_partkey") % 4 == k).cast("double"))
    return _table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.avg("l_quantity") / 25).alias("length"), *[share(k).alias(b) for k, b in enumerate(sketches.BASES)])


def random_jaccard(spark, sf):
    return sketches.jaccard_by_k(_sketch(spark, sf), _genomes(spark, sf)).select("i", "j", "k", *_r("jaccard"))


def corrected_distances(spark, sf):
    return sketches.all_distances(_sketch(spark, sf), _genomes(spark, sf)).select("i", "j", *_r("core", "accessory"))


def sketch_knn(spark, sf):
    return sketches.sketch_knn(_sketch(spark, sf), _suppliers(spark, sf), K, "core").select("i", "j", *_r("d"))


def sketch_kmers(spark, sf):
    s = _sketch(spark, sf).withColumnRenamed("id", "name")
    return readers.sketch_names(s).select("name", F.lit(",".join(map(str, sketches.kmer_lengths(s)))).alias("ks"))


def embed_and_cluster(spark, sf):
    """The whole run on ``embeddings``: graph, probabilities, layout, clusters."""
    options = RunOptions(k=K, perplexity=PERPLEXITY, layout=layout.LayoutOptions(epochs=40, draws=4.0))
    run = runs.from_vectors(_table(spark, sf, "embeddings"), "vec_id", "embedding", options)
    return run.points.join(run.clusters, "id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_and_cluster(spark, sf_dir)


_QUERIES = (
    iupac_encode, snp_distance, snp_knn_ties, snp_threshold, jaccard_distance, jaccard_knn, jaccard_threshold, vector_knn, perplexity_p, edge_normalise, raw_similarity,
    labels_join, weights_join, weights_mismatch, name_symdiff, cdf_table, weighted_draw, alias_mass, alias_draws, sce_step, telemetry, step_collisions, eq_update, eq_prefix, eta_schedule, frame_schedule, scale_centre, zscore_frame, frame_delta, freq_map,
    core_distance, mutual_reachability, mst_weight, hdbscan_labels, hexbin, sorted_labels, class_sizes, top_classes, point_size, n_clusters, colour_map, triangle_wave, adsr, synth, pcm_scale, dot_lines, cluster_csv,
    minhash_jaccard, core_accessory, random_jaccard, corrected_distances, sketch_knn, sketch_kmers, embed_and_cluster,
    self_draws, first_layout, run_frames, worker_split, noise_split, plot_table, stereo, fasta_read, fastq_read, rtab_read, distances_reload, labels_file, weights_file, names_file, embedding_file, bare_names, edge_count, jaccard_knn_all,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
