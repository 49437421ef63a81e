"""A Spark data sink of whole files, each written by one task in pieces, published all or none.

Rows are (name, offset, content): the piece of the file `name` (may hold folders) that begins
at `offset`.  `write_files` brings a file's pieces to one task in order, so a task holds one
piece at a time and a file may be larger than memory.  With a `fill` what no piece holds up to
the next one is filled with it, so that files which hold mostly one number need few pieces; a
file then ends with its last piece, which may be empty.  Tasks write below `_temporary`; only
when all have ended does the driver move the files to their names.  A task that fails, is tried
again or runs twice leaves nothing behind: files are published from the attempt that Spark
commits, and an abort removes the folder of the attempts.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from hydroloom.sources.ranged import place

PIECES = "name string, offset long, content binary"
#: Files that the driver moves at a time.
AT_ONCE = 32
#: Bytes of fill that are written at a time, and tasks that files are dealt to at most.
RUN_BYTES = 1 << 20
MOST_TASKS = 2_000


@dataclass
class Written(WriterCommitMessage):
    """(place of the attempt, name) of a task's files."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, packed: bool, overwrite: bool, fill: bytes = b""):
        self.path, self.packed, self.overwrite, self.fill = path, packed, overwrite, fill
        self.attempts = f"{path}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, own = place(f"{self.attempts}/{uuid.uuid4().hex}")
        done: dict[str, str] = {}
        name = held = raw = None
        at = 0
        many = self.fill * (RUN_BYTES // max(len(self.fill), 1))

        def close() -> None:
            if held is not None:
                held.close()
            if raw is not None and not raw.closed:
                raw.close()

        try:
            for batch in iterator:
                for new, offset, content in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("name", "offset", "content")), strict=True):
                    new, offset = new.as_py(), offset.as_py()
                    if new is None or new != name:
                        close()
                        if new is None or new in done or new.startswith("/") or ".." in new.split("/"):
                            raise ValueError(f"no name of a file, or its pieces stand apart: {new}")
                        name, at, done[new] = new, 0, f"{own}/{len(done)}"
                        system.create_dir(own)
                        raw = system.open_output_stream(done[new], compression=None)
                        held = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.packed else raw
                    if self.fill and offset > at and (offset - at) % len(self.fill) == 0:
                        for _ in range((offset - at) // len(many)):
                            held.write(many)
                        held.write(many[: (offset - at) % len(many)])
                        at = offset
                    if offset != at:
                        raise ValueError(f"{name}: a piece begins at {offset}, the one before ends at {at}")
                    data = content.as_buffer() if content.is_valid else b""
                    held.write(data)
                    at += len(data)
        finally:
            close()
        return Written([(where, new) for new, where in done.items()])

    def commit(self, messages: list[Written]) -> None:
        system, base = place(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f"{base}/{new}{'.gz' * self.packed}" for _, new in files]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("pieces of one file were written by two tasks")
        there = [i.path for i in system.get_file_info(names) if i.type != fs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(there[0])
        for folder in {n.rsplit("/", 1)[0] for n in names}:
            system.create_dir(folder)

        def publish(where: str, name: str) -> None:
            if name in there:
                system.delete_file(name)
            system.move(where, name)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(publish, [w for w, _ in files], names))
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, own = place(self.attempts)
        above = own.rsplit("/", 1)[0]
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_dir(own)
        # the folder of all attempts goes with the last one
        if system.get_file_info(above).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


class FilesSink(DataSource):
    """`df.write.format("hydroloom_files").option("gzip", ...).mode(...).save(path)`: append refuses names that are there, overwrite replaces them."""

    @classmethod
    def name(cls) -> str:
        return "hydroloom_files"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if "path" not in self.options:
            raise ValueError("no path")
        return FilesWriter(self.options["path"].rstrip("/"), str(self.options.get("gzip", "false")).lower() == "true", overwrite, bytes.fromhex(self.options.get("fill", "")))


def write_files(pieces: DataFrame, path: str, packed: bool = False, overwrite: bool = False, fill: bytes = b"", files: int | None = None) -> None:
    """Write the files that rows (name, offset, content) make up below `path`; with `packed` gzipped, `.gz` added to the names.

    fill: what gaps between pieces hold; without it they raise.  files: their number, if known,
    by which they are dealt to tasks.
    """
    pieces.sparkSession.dataSource.register(FilesSink)
    # several tasks a file, so that few tasks have two
    dealt = ["name"] if files is None else [min(max(4 * files, 1), MOST_TASKS), "name"]
    ordered = pieces.select("name", "offset", "content").repartition(*dealt).sortWithinPartitions("name", "offset")
    writer = ordered.write.format(FilesSink.name()).option("gzip", str(packed).lower()).option("fill", fill.hex())
    writer.mode("overwrite" if overwrite else "append").save(path)
