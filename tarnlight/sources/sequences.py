"""Sequence files of both kinds, FASTA and FASTQ, with records of any number of lines, read by splits.

Whether a line that begins with ``@`` is a header or part of a quality string depends on all lines before it.  So each split is read as a
transition of the reader's state, between records, within a sequence or within a quality string.  Every split is first read as if it began
between records; then those that the state before them contradicts are read again with the right one, until none is left.  A reader
that starts wrongly falls into step at some record, so few rounds are needed; the driver holds a state for each split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage

#: States of the reader between two lines.
BETWEEN, SEQUENCE, QUALITY = range(3)
#: (mode, characters read of a sequence or to come of a quality string, the split and line where the record began)
FRESH = (BETWEEN, 0, 0, 0)
RECORD = "split long, line long, name string, seq string, whole boolean, part long"


class Reader:
    """Reads a split's lines from a state on; yields, for each record or piece of one, the split and line
    where it began, its name where that was read here, sequence, whether all of it was read here, and this split."""

    def __init__(self, split: int, state: tuple[int, int, int, int]):
        self.split, self.state, self.line = split, state, 0
        self.name, self.parts, self.own = None, [], False

    def _piece(self, whole: bool):
        _, _, split, line = self.state
        out = (split, line, self.name, "".join(self.parts), whole and self.own, self.split)
        self.name, self.parts = None, []
        return out

    def feed(self, value: str):
        mode, count, split, line = self.state
        first = value[:1]
        if mode == QUALITY:
            count -= sum(33 <= ord(c) <= 127 for c in value)
            self.state = (QUALITY, count, split, line) if count > 0 else FRESH
        elif first in (">", "@") and first:
            if mode == SEQUENCE:
                yield self._piece(True)
            words = value[1:].split(None, 1)
            self.state = (SEQUENCE, 0, self.split, self.line)
            self.name, self.parts, self.own = "" if not words or value[1:2].isspace() else words[0], [], True
        elif mode == SEQUENCE and first == "+":
            yield self._piece(True)
            self.state = (QUALITY, count, split, line) if count else FRESH
        elif mode == SEQUENCE:
            more = "".join(c for c in value if "!" <= c <= "~")
            self.parts.append(more)
            self.state = (SEQUENCE, count + len(more), split, line)
        self.line += 1

    def finish(self, last: bool):
        if self.state[0] == SEQUENCE:
            yield self._piece(last)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, seq) of FASTA or FASTQ files, plain or gzipped; ids follow the files' order, and records within.

    A record is a header line with ``>`` or ``@``, sequence lines, and, after a line with ``+``, quality lines of as many characters as the sequence
    has, whatever they begin with.  A name ends at the first white space; only printable characters other than space stay in sequences.  Lines before the first
    header are passed over.  A quality string that the file ends in is an error.
    """
    from .readers import numbered

    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    found = storage.stored(text.groupBy("file", "start").count().select("file", "start"), "splits")
    splits = [(r["file"], r["start"]) for r in found.orderBy("file", "start").collect()]  # a row for each split
    number = {s: k for k, s in enumerate(splits)}
    first = {k for k, (f, _) in enumerate(splits) if not k or splits[k - 1][0] != f}

    def read(states, wanted, emit):
        send = storage.sent(spark, (number, states, wanted))

        def run(batches):
            number, states, wanted = send()
            key, reader, out = None, None, []
            for b in batches:
                for file, start, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (file, start) != key:
                        if reader:
                            yield from emit.close(reader, out)
                        key, out, k = (file, start), [], number[file, start]
                        reader = Reader(k, states[k]) if k in wanted else None
                    if reader:
                        emit.take(out, reader.feed(value or ""))
                if reader and len(out) > 10_000:
                    yield emit.batch(out)
                    out = []
            if reader:
                yield from emit.close(reader, out)

        return text.mapInArrow(run, emit.schema)

    states, wanted = {k: FRESH for k in range(len(splits))}, set(range(len(splits)))
    ends: dict[int, tuple] = {}
    while wanted:
        for r in read(states, wanted, _Ends()).collect():  # a row for each split that is read again
            ends[r["split"]] = (r["mode"], r["count"], r["at_split"], r["line"])
        now = {k: FRESH if k in first else ends[k - 1] for k in range(len(splits))}
        wanted = {k for k in now if now[k] != states[k]}
        states = now
    last = {k for k in range(len(splits)) if k + 1 == len(splits) or k + 1 in first}
    if any(ends[k][0] == QUALITY for k in last):
        raise ValueError("a file ends within a quality string")
    pieces = storage.stored(read(states, set(range(len(splits))), _Records(last)), "records")
    # records that go on in other splits are put together, others are whole
    joined = pieces.where("not whole").groupBy("split", "line").agg(F.max("name").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    rows = pieces.where("whole").select("split", "line", "name", "seq").unionByName(joined)
    return numbered(rows.select(F.struct("split", "line").alias("at"), "name", "seq"), "at").select("id", "name", "seq")


class _Ends:
    """The state at the end of each split."""

    schema = "split long, mode int, count long, at_split long, line long"

    def take(self, out, records):
        for _ in records:
            pass

    def batch(self, out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["split", "mode", "count", "at_split", "line"])

    def close(self, reader, out):
        yield self.batch([(reader.split, *reader.state)])


class _Records:
    """Records that a split has whole, and pieces of others, in the order of splits."""

    schema = RECORD

    def __init__(self, last: set[int]):
        self.last = last

    def take(self, out, records):
        out += records

    def batch(self, out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["split", "line", "name", "seq", "whole", "part"])

    def close(self, reader, out):
        yield self.batch([*out, *reader.finish(reader.split in self.last)])
