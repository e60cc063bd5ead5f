"""Sequence files in small splits, against one reader of the whole file."""

import gzip
import random

import pytest

from tarnlight.sources import readers, writers
from tarnlight.sources import sequences as S


def plain(text):
    """The records of a whole file."""
    reader, out = S.Reader(0, S.FRESH), []
    for line in text.split("\n"):
        out += reader.feed(line)
    out += reader.finish(True)
    return [(r[2], r[3]) for r in out]


def written(seed, kind):
    rng = random.Random(seed)
    lines, want = (["; a comment", ""] if seed % 2 else []), []
    for k in range(60):
        n = rng.choice([0, 1, 7, 40, 200])
        seq = "".join(rng.choice("ACGTN-") for _ in range(n))
        fastq = kind == "fastq" or (kind == "mixed" and rng.random() < 0.5)
        lines.append(("@" if fastq else ">") + f"r{k} words")
        step = rng.choice([5, 33, 1000])
        lines += [seq[a : a + step] for a in range(0, n, step)]
        if fastq:
            lines.append("+" + rng.choice(["", f"r{k}"]))
            quality = "".join(rng.choice("@+>!IJK~") for _ in range(n))
            lines += [quality[a : a + step] for a in range(0, n, step)]
        want.append((f"r{k}", seq))
    return "\n".join(lines) + "\n", want


@pytest.mark.parametrize("kind", ["fastq", "fasta", "mixed"])
@pytest.mark.parametrize("size", [97, 1_000_000])
def test_records_across_splits(spark, tmp_path, kind, size):
    text, want = written(size, kind)
    assert plain(text) == want
    (tmp_path / "a.fq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path / "a.fq")).rdd.getNumPartitions() > (20 if size < 1000 else 0)
        got = S.sequences(spark, str(tmp_path / "a.fq")).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["name"], r["seq"]) for r in got] == want and [r["id"] for r in got] == list(range(len(want)))


def test_gzip_files_and_truncation(spark, tmp_path):
    (tmp_path / "d").mkdir()
    text, want = written(1, "fastq")
    with gzip.open(tmp_path / "d" / "a.fq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "d" / "b.fa").write_text(">last\nAC GT\nNN")
    got = S.sequences(spark, str(tmp_path / "d")).orderBy("id").collect()
    assert [(r["name"], r["seq"]) for r in got] == [*want, ("last", "ACGTNN")]
    (tmp_path / "cut.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(ValueError, match="quality"):
        S.sequences(spark, str(tmp_path / "cut.fq"))
    (tmp_path / "none.fq").write_text("")
    assert S.sequences(spark, str(tmp_path / "none.fq")).count() == 0


def test_matrix_lines_are_made_after_the_sort(spark, tmp_path):
    cells = {(3, 10), (3, 30), (1, 20), (200, 10), (5, 99)}  # 99 has no column
    writers.matrix(spark.createDataFrame([*cells, (3, 10), (None, 10), (7, None)], "feature long, id long"), [10, 20, 30], str(tmp_path / "m"))
    (file,) = (tmp_path / "m").glob("part-*.txt")
    assert file.read_text() == "Gene\ts10\ts20\ts30\np1\t0\t1\t0\np3\t1\t0\t1\np5\t0\t0\t0\np7\t0\t0\t0\np200\t1\t0\t0\n"


def test_odd_cells_of_a_matrix(spark, tmp_path):
    (tmp_path / "m.Rtab").write_bytes(b"Gene\ta\tb\tc\td\r\ng1\t0\t1\t0.0\t-2e0\r\n\t00\t\tx\t3\r\nno cells\ng\xc3\xa9\t1\t0\t\t0\r\n")
    nodes, cells = readers.rtab(spark, str(tmp_path / "m.Rtab"))
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert {tuple(r) for r in cells.collect()} == {(1, "g1"), (3, "g1"), (3, ""), (0, "gé")}
