"""Whole runs by the command line: every input, both ways to sparsify, every option, and what is written."""

import random

import pytest

from tarnlight import __main__ as command

QUICK = ["--maxIter", "40000"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """An alignment, a feature matrix, sketches with genomes, and labels and weights in another order."""
    at, rng = tmp_path_factory.mktemp("input"), random.Random(3)
    kinds = ["".join(rng.choices("ACGT", k=80)) for _ in range(4)]
    seqs = {f"s{k}": "".join(c if rng.random() > 0.03 else rng.choice("ACGTN") for c in kinds[k % 4]) for k in range(104)}
    (at / "a.fa").write_text("".join(f">{n} x\n{s}\n" for n, s in seqs.items()))
    (at / "a.fq").write_text("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in seqs.items()))
    genes = [{n for k, n in enumerate(seqs) if rng.random() < (0.7 if g % 4 == k % 4 else 0.1)} for g in range(40)]
    (at / "m.Rtab").write_text("Gene\t" + "\t".join(seqs) + "\n" + "".join(f"g{g}\t" + "\t".join("1" if n in has else "0" for n in seqs) + "\n" for g, has in enumerate(genes)))
    hashes = [(f"{n}.h5", k, [hash(s[a : a + k]) for a in range(len(s) - k + 1)]) for n, s in seqs.items() for k in (5, 9)]
    spark.createDataFrame(hashes, "name string, k int, hashes array<long>").write.parquet(str(at / "sk"))
    spark.createDataFrame([(f"{n}.h5", 80.0, *[s.count(c) / 80 for c in "ACGT"]) for n, s in seqs.items()], "name string, length double, a double, c double, g double, t double").write.parquet(str(at / "genomes"))
    names = rng.sample(sorted(seqs), len(seqs))
    (at / "labels.txt").write_text("".join(f"{n}\t{int(n[1:]) % 4}\n" for n in names))
    (at / "weights.txt").write_text("".join(f"{n}\t{1 + int(n[1:]) % 2}\n" for n in names))
    return at


def go(spark, files, out, *args):
    return command.main([*[str(files / a[1:]) if a.startswith("@") else a for a in args], *QUICK, "--output", str(out)], spark)


@pytest.mark.parametrize("args", [("--alignment", "@a.fa", "--kNN", "10"), ("--alignment", "@a.fq", "--threshold", "0.2"), ("--accessory", "@m.Rtab", "--kNN", "10"), ("--accessory", "@m.Rtab", "--threshold", "0.6"), ("--sketches", "@sk", "--kNN", "10", "--use-accessory", "--no-clustering"), ("--sketches", "@sk", "--kNN", "10", "--genomes", "@genomes", "--no-html-labels")])
def test_inputs(spark, files, tmp_path, args):
    out = tmp_path / "run"
    done = go(spark, files, out, *args)
    names = spark.read.text(f"{out}.names")
    assert sorted(r[0] for r in names.collect()) == sorted(f"s{k}" for k in range(104))
    xy = spark.read.schema("x double, y double").option("sep", " ").csv(f"{out}.embedding").collect()
    assert len(xy) == 104 and all(abs(r["x"]) < 1e6 for r in xy)
    assert spark.read.text(f"{out}.embedding.dot").count() == 106
    plot = spark.read.parquet(f"{out}.plot")
    assert plot.count() == 104 and ("name" in plot.columns) == ("--no-html-labels" not in args)
    assert ("embedding_hdbscan_clusters" in done) == ("--no-clustering" not in args)
    assert spark.read.parquet(f"{out}.hexbin").agg({"n": "sum"}).first()[0] == 104
    assert spark.read.option("header", True).csv(f"{out}.telemetry").count() == command.EPOCHS


def test_stored_distances_again(spark, files, tmp_path):
    first = tmp_path / "first"
    go(spark, files, first, "--alignment", "@a.fa", "--kNN", "10")
    stored = ("--distances", f"{first}.distances")
    go(spark, files, tmp_path / "b", *stored, "--eta0", "2", "--bInit", "1", "--perplexity", "5")
    go(spark, files, tmp_path / "c", *stored, "--weight-file", "@weights.txt", "--no-preprocessing")
    assert "embedding_hdbscan_clusters" not in go(spark, files, tmp_path / "d", *stored, "--labels", "@labels.txt")
    assert {(r["name"], r["cluster"]) for r in spark.read.parquet(f"{tmp_path / 'd'}.plot").collect()} == {(f"s{k}", str(k % 4)) for k in range(104)}
    done = go(spark, files, tmp_path / "e", *stored, "--animate", "--animate-sound")
    frames = spark.read.parquet(f"{tmp_path / 'e'}.frames")
    assert {"frames", "sound"} <= set(done) and frames.select("frame").distinct().count() == 400 and frames.count() == 400 * 104
    assert spark.read.parquet(f"{tmp_path / 'e'}.sound").count() > 0


def test_wrong_options(spark, files, tmp_path):
    for args in ((), ("--alignment", "@a.fa"), ("--alignment", "@a.fa", "--kNN", "3", "--threshold", "0.1"), ("--alignment", "@a.fa", "--kNN", "3", "--cpus", "0"), ("--sketches", "@sk", "--threshold", "0.1"), ("--alignment", "@a.fa", "--accessory", "@m.Rtab", "--kNN", "3")):
        with pytest.raises(SystemExit):
            go(spark, files, tmp_path / "x", *args)
    with pytest.raises(ValueError):
        go(spark, files, tmp_path / "x", "--alignment", "@a.fa", "--threshold", "1.5")
    with pytest.raises(FileNotFoundError):
        go(spark, files, tmp_path / "x", "--alignment", "@none.fa", "--kNN", "3")
