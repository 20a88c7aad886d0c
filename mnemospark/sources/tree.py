"""Data sources of this engine: the directories of a tree of learners, and a file of result lines.

Both work on stores that Arrow's file systems reach (local, HDFS, S3, GCS): a tree's directories
are listed by the driver once and looked into by tasks, and a result file is replaced whole.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Directories that one task looks into.
AT_ONCE = 500
_LEARNER = re.compile(r"user_id=([+-]?\d+)")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][\w+.-]*:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


class Directories(InputPartition):
    def __init__(self, paths: list[tuple[int, str]]):
        self.paths = paths


class LearnerTree(DataSource):
    """(user_id, files) of every directory user_id=* of the tree given as path, with its number of Parquet files.

    Directories without a file are among them, which a scan of the files never sees; other
    names and plain files are passed by. Without the tree itself there are no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "learner_tree"

    def schema(self) -> str:
        return "user_id long, files long"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])


class TreeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = located(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        named = [(_LEARNER.fullmatch(i.base_name), i) for i in found if i.type == fs.FileType.Directory]
        paths = [(int(m[1]), i.path) for m, i in named if m]
        return [Directories(paths[k : k + AT_ONCE]) for k in range(0, len(paths), AT_ONCE)] or [Directories([])]

    def read(self, partition: Directories) -> Iterator[tuple[int, int]]:
        store, _ = located(self.path)
        for user, path in partition.paths:
            inside = store.get_file_info(fs.FileSelector(path))
            yield user, sum(i.type == fs.FileType.File and i.base_name.endswith(".parquet") for i in inside)


class LineFile(DataSource):
    """Writes the one column of a frame of one partition as the lines of the file given as path.

    Lines go to a file beside it, which takes the path when the job commits: until then, and if
    the job fails or is killed, what was there before stays whole.
    """

    @classmethod
    def name(cls) -> str:
        return "line_file"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class LineWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staged = path, f".{uuid.uuid4().hex}.new"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, path = located(self.path)
        store.create_dir(os.path.dirname(path), recursive=True)
        mine = f"{path}.{uuid.uuid4().hex}{self.staged}"  # a task that runs twice writes two files
        with store.open_output_stream(mine) as out:
            for row in iterator:
                out.write(f"{row[0]}\n".encode())
        return Written(mine)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = located(self.path)
        done = [m.path for m in messages if m is not None]
        if len(done) > 1:
            raise ValueError("a file of lines takes one partition")
        if not done:
            done = [f"{path}{self.staged}"]
            store.open_output_stream(done[0]).close()
        if store.get_file_info(path).type == fs.FileType.Directory:
            aside = f"{path}{self.staged}.old"
            store.move(path, aside)
            store.move(done[0], path)
            store.delete_dir(aside)
        else:
            store.move(done[0], path)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = located(self.path)
        left = store.get_file_info(fs.FileSelector(os.path.dirname(path), allow_not_found=True))
        for i in left:
            if i.base_name.endswith(self.staged):
                store.delete_file(i.path)


def learners(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(user_id, files) of the directories of the tree root/kind."""
    spark.dataSource.register(LearnerTree)
    return spark.read.format("learner_tree").load(f"{root}/{kind}")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.sparkSession.dataSource.register(LineFile)
    lines.write.format("line_file").mode("overwrite").save(path)


def exists(path: str) -> bool:
    store, path = located(path)
    return store.get_file_info(path).type != fs.FileType.NotFound
