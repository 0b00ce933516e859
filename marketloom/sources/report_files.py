"""A sink that writes each report as one file, whatever its length, and a source that takes the digest of such files.

Tasks write the lines of their partition as pieces; once all tasks are done, the pieces of a
report are put together in order, a megabyte at a time, and the file gets its name as a whole. A
task that is repeated writes other pieces, and only those of the attempt that counted are used; a failed
job leaves no file.

Reading gives a row per file, (file, lines, text_md5): a task passes a file by in chunks of a megabyte, so it holds no text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20
DIGEST = "file string, lines bigint, text_md5 string"


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class Pieces(WriterCommitMessage):
    """(report file, piece) of one task, in order."""

    partition: int
    written: list[tuple[str, str]]


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _open(self.path)
        files.create_dir(f"{base}/_pieces", recursive=True)
        done = Pieces(task.partitionId(), [])
        now, out = None, None
        try:
            for batch in iterator:
                names, lines = batch.column("file").to_pylist(), batch.column("line").to_pylist()
                begin = 0
                while begin < len(names):
                    if out is None or names[begin] != now:
                        if out:
                            out.close()
                        now = names[begin]
                        piece = f"{base}/_pieces/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done.written)}"
                        out = files.open_output_stream(piece)
                        done.written.append((now, piece))
                    # the rows are sorted, so a batch with one file at both ends has no other
                    end = len(names) if names[-1] == now else next(i for i in range(begin, len(names)) if names[i] != now)
                    out.write("".join(f"{line or ''}\n" for line in lines[begin:end]).encode())
                    begin = end
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Pieces | None]) -> None:
        files, base = _open(self.path)
        of_file: dict[str, list[str]] = {}
        for message in sorted([m for m in messages if m], key=lambda m: m.partition):
            for name, piece in message.written:
                of_file.setdefault(name, []).append(piece)
        for name, pieces in of_file.items():
            with files.open_output_stream(f"{base}/_pieces/{name}") as out:
                for piece in pieces:
                    with files.open_input_stream(piece) as part:
                        while chunk := part.read(CHUNK):
                            out.write(chunk)
            files.move(f"{base}/_pieces/{name}", f"{base}/{name}")
        self._clear(messages)

    def abort(self, messages: list[Pieces | None]) -> None:
        self._clear(messages)

    def _clear(self, messages: list[Pieces | None]) -> None:
        files, _ = _open(self.path)
        for message in messages:
            for _, piece in message.written if message else ():
                files.delete_file(piece)


@dataclass
class ReportFile(InputPartition):
    path: str


class ReportReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[ReportFile]:
        from pyarrow.fs import FileSelector

        files, base = _open(self.path)
        return [ReportFile(f.path) for f in files.get_file_info(FileSelector(base)) if f.is_file and f.base_name.endswith(".md")]

    def read(self, partition: ReportFile) -> Iterator[tuple[str, int, str]]:
        """Lines and digest of a file's text without the line ends that close it."""
        import hashlib

        files, _ = _open(self.path)
        digest, lines, ends = hashlib.md5(usedforsecurity=False), 1, 0
        with files.open_input_stream(partition.path) as text:
            while chunk := text.read(CHUNK):
                body = chunk.rstrip(b"\n")
                if body:
                    # line ends count once something follows them
                    while ends:
                        some = min(ends, CHUNK)
                        digest.update(b"\n" * some)
                        lines, ends = lines + some, ends - some
                    digest.update(body)
                    lines += body.count(b"\n")
                ends += len(chunk) - len(body)
        yield partition.path.rsplit("/", 1)[-1], lines, digest.hexdigest()


class ReportFiles(DataSource):
    """``df.write.format("report_files").mode("append").save(path)`` of rows (file, line), sorted over all partitions.

    ``spark.read.format("report_files").load(path)`` gives (file, lines, text_md5) of the files at ``path``.
    """

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return DIGEST

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReportReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])
