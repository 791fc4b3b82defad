"""Numbered text files of a fixed number of lines, as a data source that publishes its files when all tasks are done."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..scale import SLICE, running_sum
from .records import file_system

_CODECS = {None: "", "gzip": ".gz", "bz2": ".bz2", "zstd": ".zst"}


def numbered_name(name: str, number: int, per_folder: int = 0) -> str:
    """`{}` in `name` (or its end) becomes the four-digit number; every `per_folder` files have a folder of their own."""
    digits = f"{number:04d}"
    label = name.replace("{}", digits, 1) if "{}" in name else name + digits
    return f"{number // per_folder:04d}/{label}" if per_folder else label


@dataclass
class Parts(WriterCommitMessage):
    """What one task wrote: (number of the file, path while the job runs)."""
    files: list[tuple[int, str]]


class NumberedWriter(DataSourceArrowWriter):
    """Rows (number, line), together and in order per number. Files lie in a folder of the job until it is committed.

    Each attempt of a task writes under a name of its own. Only the files of
    attempts that Spark counts are moved to their final names; what others
    left goes with the job's folder, as all does when the job fails.
    """

    def __init__(self, options: dict):
        self.path, self.name = options["path"].rstrip("/"), options["name"]
        self.per_folder, self.codec = int(options["perfolder"]), options.get("codec")
        self.job = f"{self.path}/_temporary-{options['job']}"

    def write(self, iterator) -> Parts:
        system, job = file_system(self.job)
        attempt, files = uuid.uuid4().hex, []
        system.create_dir(job, recursive=True)
        out = None
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch]).to_pydict()
                for number, rows in groupby(zip(table["number"], table["line"]), key=itemgetter(0)):
                    if not files or files[-1][0] != number:
                        if out:
                            out.close()
                        files.append((number, f"{job}/{attempt}-{number}"))
                        out = system.open_output_stream(files[-1][1], compression=self.codec)
                    out.write("".join(f"{line or ''}\n" for _, line in rows).encode())
        finally:
            if out:
                out.close()
        return Parts(files)

    def commit(self, messages: list[Parts | None]) -> None:
        system, job = file_system(self.job)
        target, folders = file_system(self.path)[1], set()
        for number, part in (f for m in messages if m for f in m.files):
            final = f"{target}/{numbered_name(self.name, number, self.per_folder)}{_CODECS[self.codec]}"
            folder = final.rsplit("/", 1)[0]
            if folder not in folders:
                system.create_dir(folder, recursive=True)
                folders.add(folder)
            system.move(part, final)
        self._clear(system, job)
        system.create_dir(target, recursive=True)
        with system.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def abort(self, messages: list[Parts | None]) -> None:
        system, job = file_system(self.job)
        self._clear(system, job)

    @staticmethod
    def _clear(system: fs.FileSystem, job: str) -> None:
        if system.get_file_info(job).type == fs.FileType.Directory:
            system.delete_dir(job)


class NumberedText(DataSource):
    """`df.write.format("numbered_text")` of (number, line) rows."""

    @classmethod
    def name(cls) -> str:
        return "numbered_text"

    def writer(self, schema, overwrite: bool) -> NumberedWriter:
        system, path = file_system(self.options["path"])
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        if any(not f.base_name.startswith("_temporary-") for f in found):
            raise ValueError(f"{path} is not empty")
        return NumberedWriter(dict(self.options))


def write_numbered(df: DataFrame, path: str, order: str, lines: int, name: str = "{}.txt", line: str = "line", files_per_folder: int = 0,
                   codec: str | None = None, width: int = SLICE) -> None:
    """Text files of exactly `lines` rows (the last one may have fewer), along the unique integer column `order`.

    Files are numbered from 0000 in that order, without gaps. `name` holds `{}`
    where the number goes, `codec` is gzip, bz2 or zstd and adds its ending.
    Rows with a NULL order are an error, a NULL line is an empty one, an empty
    table gives `_SUCCESS` alone, a target that holds files is refused.

    Row numbers come from slices (`running_sum`), and a task gets whole files
    of neighbouring numbers: no task holds more than a sort of its files.
    """
    if lines < 1 or codec not in _CODECS:
        raise ValueError(f"lines is {lines}, codec is {codec}")
    spark = df.sparkSession
    spark.dataSource.register(NumberedText)
    known = F.coalesce(F.col(order), F.raise_error(F.lit(f"{order} is NULL")).cast("long"))
    rows = df.select(known.alias("_o"), F.col(line).cast("string").alias("line"))
    placed = running_sum(rows, "_o", F.lit(1).cast("long"), "_n", width).withColumn("number", F.floor((F.col("_n") - 1) / lines).cast("long"))
    files = placed.repartitionByRange("number").sortWithinPartitions("_n").select("number", "line")
    options = {"name": name, "perfolder": str(files_per_folder), "job": uuid.uuid4().hex} | ({"codec": codec} if codec else {})
    files.write.format("numbered_text").options(**options).mode("append").save(path)
