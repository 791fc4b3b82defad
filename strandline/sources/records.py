"""Readers that cut files at record borders inside the task that reads them.

Files are listed with their lengths and cut into byte ranges; only (file,
start, stop) rows move before reading. A record belongs to the range in which
its first byte lies, and the reader of that range goes on past its end until
the record is whole, so records are neither shuffled nor put together again.
Compressed files are one range each. A lost task reads its ranges again.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

# Bytes of a range, the work of one task.
RANGE_BYTES = 1 << 27
# Bytes of a sequence file that a task holds at a time, and letters of an Arrow batch.
BLOCK_BYTES = 1 << 24
# A header line of a sequence file is at most so long; a longer line is sequence.
HEADER_BYTES = 1 << 20
# Records of an Arrow batch.
BATCH = 8192
# Names of compressed files, read as one range.
COMPRESSED = r"\.(gz|bz2|zst|lz4)$"


def file_ranges(spark: SparkSession, path: str, pattern: str | None = None, size: int = RANGE_BYTES) -> DataFrame:
    """(file, start, stop): byte ranges of at most `size` of all files under `path`; stop is NULL for a compressed file. Empty files have none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    packed = F.col("file").rlike(COMPRESSED)
    start = F.explode(F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    return files.select("file", "length", start.alias("start")).select(
        "file", "start", F.when(~packed, F.least(F.col("start") + size, F.col("length"))).alias("stop"))


def spread(ranges: DataFrame) -> DataFrame:
    """A task per range. Their number is known from the listing; no file is opened for it."""
    return ranges.repartition(max(ranges.count(), 1))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: any that Arrow knows (local, HDFS, S3, GCS)."""
    uri = re.sub("^file:/+", "/", re.sub("^s3[an]:", "s3:", uri))
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def open_file(uri: str) -> io.BufferedReader:
    """The file's bytes, decompressed if its name says so."""
    system, name = file_system(uri)
    raw = system.open_input_stream(name, compression="detect") if re.search(COMPRESSED, name) else system.open_input_file(name)
    return io.BufferedReader(raw, 1 << 20)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


# -- four-line records ------------------------------------------------------------------

FASTQ = {"file": "string", "record": "long", "name": "string", "bases": "string", "quals": "string"}


def _first_record(f: io.BufferedReader, at: int) -> tuple[int, list[bytes]]:
    """Where the first record at or after `at` begins, and the lines read ahead from there.

    That is the first line that starts with @ and has a + two lines on. A
    quality line that starts with @ has bases there.
    """
    f.seek(at - 1)
    at += len(f.readline()) - 1
    ahead = list(islice(f, 3))
    while len(ahead) == 3 and not (ahead[0][:1] == b"@" and ahead[2][:1] == b"+"):
        at += len(ahead.pop(0))
        ahead += islice(f, 1)
    return at, ahead


def fastq_records(f: io.BufferedReader, start: int, stop: int | None) -> Iterator[tuple]:
    """Lists (record, name, bases, quals) of the records that begin in [start, stop)."""
    at, ahead = (start, []) if start == 0 else _first_record(f, start)
    while stop is None or at < stop:
        lines = ahead + list(islice(f, 4 * BATCH - len(ahead)))
        if not lines:
            return
        ahead, ends = [], list(accumulate(map(len, lines), initial=at))
        text = [_text(x).rstrip("\r\n") for x in lines] + [""] * (-len(lines) % 4)
        begin = ends[:len(lines):4]
        kept = [i for i, b in enumerate(begin) if (stop is None or b < stop) and text[4 * i].startswith("@") and text[4 * i + 2].startswith("+")]
        yield [begin[i] for i in kept], [text[4 * i][1:] for i in kept], [text[4 * i + 1] for i in kept], [text[4 * i + 3] for i in kept]
        at = ends[-1]


def read_fastq(spark: SparkSession, path: str, pattern: str | None = None, columns: tuple[str, ...] = tuple(FASTQ), size: int = RANGE_BYTES) -> DataFrame:
    """`columns` of (file, record, name, bases, quals) of four-line records; only these leave the Python worker.

    `record` is the offset of the record's first byte in the (decompressed)
    file: it orders the records of a file. Lines end with LF or CR LF. Four
    lines whose first has no @ or whose third has no + are left out; a missing
    last quality line is empty. Empty files give no rows.
    """
    schema = pa.schema([(c, pa.int64() if c == "record" else pa.string()) for c in columns])

    def read(batches):
        for r in _ranges(batches):
            with open_file(r["file"]) as f:
                for record, name, bases, quals in fastq_records(f, r["start"], r["stop"]):
                    cells = {"file": [r["file"]] * len(record), "record": record, "name": name, "bases": bases, "quals": quals}
                    yield pa.RecordBatch.from_arrays([pa.array(cells[x.name], x.type) for x in schema], schema=schema)

    return spread(file_ranges(spark, path, pattern, size)).mapInArrow(read, ", ".join(f"{c} {FASTQ[c]}" for c in columns))


# -- sequences of any length -----------------------------------------------------------------

_TITLE = re.compile(rb"^>([^\n]*)\n?", re.M)
_LETTERS = re.compile("[^NMRnmr]+")
_BLANK = b" \t\r\n\v\f"


def _in_header(f: io.BufferedReader, at: int) -> tuple[bool, bool]:
    """Whether byte `at` begins a line, and whether it lies inside a header line begun before."""
    low = max(0, at - HEADER_BYTES)
    f.seek(low)
    before = f.read(at - low)
    line = before.rfind(b"\n") + 1
    known = line > 0 or low == 0
    return line == len(before), known and line < len(before) and before[line:line + 1] == b">"


def fasta_parts(f: io.BufferedReader, start: int, stop: int | None, block: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(title or None, letters, whether they lie before `stop`) in order; None goes on with the sequence before.

    Goes on past `stop` to the next title, for the caller to end it when its last chunk is whole.
    """
    at, fresh = start, True
    if start:
        fresh, inside = _in_header(f, start)
        if inside:
            at, fresh = at + len(f.readline()), True
    while True:
        own = stop is None or at < stop
        # Past the end a small block is enough for most chunks.
        data = f.read(min(block, stop - at) if own and stop is not None else block if own else min(block, 1 << 16))
        if not data:
            return
        # A title is never cut: the last line is read to its end if it is one.
        last = data.rfind(b"\n") + 1
        if data[last:last + 1] == b">" and (last or fresh):
            data += f.readline()
        body = data if fresh else b"." + data
        pieces = _TITLE.split(body)
        head = pieces[0] if fresh else pieces[0][1:]
        yield None, head.translate(None, _BLANK), own
        for title, letters in zip(pieces[1::2], pieces[2::2]):
            if not own:
                return
            yield _text(title), letters.translate(None, _BLANK), own
        at, fresh = at + len(data), data.endswith(b"\n")


def _name(title: str) -> str:
    return (title.split() or [""])[0]


def _range_ends(batches):
    """One row per range: its titles, the last one's name, and the letters after it (all, if there is none)."""
    for r in _ranges(batches):
        titles, name, tail = 0, None, 0
        with open_file(r["file"]) as f:
            for title, letters, own in fasta_parts(f, r["start"], r["stop"]):
                if not own:
                    break
                if title is not None:
                    titles, name, tail = titles + 1, _name(title), 0
                tail += len(letters)
        yield pa.RecordBatch.from_pylist([{**r, "titles": titles, "last": name, "tail": tail}], schema=pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("titles", pa.int64()), ("last", pa.string()), ("tail", pa.int64())]))


def fasta_chunks(f: io.BufferedReader, start: int, stop: int | None, record: int, name: str | None, pos: int, chunk: int,
                 block: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(record, name, pos, letters) of the chunks whose first letter lies in [start, stop).

    `record`, `name` and `pos` are what the earlier ranges left: the sequence that goes on and its letters so far.
    """
    skip, held, size = -pos % chunk, [], 0
    pos += skip
    for title, letters, own in fasta_parts(f, start, stop, block):
        if title is not None:
            if size:
                yield record, name, pos, b"".join(held)
            record, name, pos, skip, held, size = record + 1, _name(title), 0, 0, [], 0
        if skip:
            drop = min(skip, len(letters))
            letters, skip = letters[drop:], skip - drop
        if not own and not size:
            return
        if letters and record:
            held.append(letters)
            size += len(letters)
        if size >= chunk:
            whole = b"".join(held)
            for i in range(0, size - chunk + 1, chunk):
                yield record, name, pos, whole[i:i + chunk]
                pos += chunk
                if not own:
                    return
            held = [whole[size - size % chunk:]] if size % chunk else []
            size %= chunk
    if size:
        yield record, name, pos, b"".join(held)


def range_states(ranges: DataFrame) -> DataFrame:
    """Ranges with the state their file is in where they start: (record, name, pos).

    Files of one range need no look at the file. The others are scanned for
    their titles and letter counts; windows hold one row per range of a file.
    """
    counted = ranges.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("file")))
    begin = lambda df: df.select("file", "start", "stop", F.lit(0).cast("long").alias("record"), F.lit(None).cast("string").alias("name"),
                                 F.lit(0).cast("long").alias("pos"))
    several = counted.where("_n > 1").drop("_n")
    ends = spread(several).mapInArrow(_range_ends, "file string, start long, stop long, titles long, last string, tail long")
    along = W.partitionBy("file").orderBy("start")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    known = ends.withColumns({"_record": F.sum("titles").over(upto), "_name": F.last("last", ignorenulls=True).over(upto)})
    known = known.withColumn("_pos", F.sum("tail").over(W.partitionBy("file", "_record").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    before = lambda c, empty: F.lag(c, 1, empty).over(along)
    return begin(counted.where("_n = 1")).union(known.select("file", "start", "stop", before("_record", 0), before("_name", None), before("_pos", 0)))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1_000_000, pattern: str | None = None, size: int = RANGE_BYTES) -> DataFrame:
    """(file, record, name, pos, seq): sequences in chunks of at most `chunk` letters with 0-based offsets.

    Runs of N, M or R are gaps: they advance the position and give no row.
    White space between letters is left out, letters before the first title
    too. A chunk is put together by the range in which it begins, so a long
    sequence spreads over the ranges of its file and no letter is shuffled.
    """
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("name", pa.string()), ("pos", pa.int64()), ("seq", pa.string())])

    def read(batches):
        for r in _ranges(batches):
            rows, letters = [], 0
            with open_file(r["file"]) as f:
                for record, name, pos, raw in fasta_chunks(f, r["start"], r["stop"], r["record"], r["name"], r["pos"], chunk):
                    rows += [(r["file"], record, name, pos + m.start(), m.group()) for m in _LETTERS.finditer(_text(raw))]
                    letters += len(raw)
                    if len(rows) >= BATCH or letters >= BLOCK_BYTES:
                        yield _batch(rows, schema)
                        rows, letters = [], 0
            yield _batch(rows, schema)

    # States are a row per range; their shuffle must not leave all reading to a few tasks.
    return spread(range_states(file_ranges(spark, path, pattern, size))).mapInArrow(read, "file string, record long, name string, pos long, seq string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cells = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cells, schema)], schema=schema)


# -- heads of files ------------------------------------------------------------------------------


def head_lines(spark: SparkSession, path: str, mark: str = "#") -> DataFrame:
    """(file, line_no, line): the lines at the top of each file that start with `mark`; no file is read further than that."""
    def read(batches):
        schema = pa.schema([("file", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])
        for r in _ranges(batches):
            rows = []
            with open_file(r["file"]) as f:
                for n, line in enumerate(f, 1):
                    if not line.startswith(mark.encode()):
                        break
                    rows.append((r["file"], n, _text(line).rstrip("\r\n")))
            yield _batch(rows, schema)

    return file_ranges(spark, path).where("start = 0").mapInArrow(read, "file string, line_no long, line string")
