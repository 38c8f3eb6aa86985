"""A data source of file checksums: opens the listed files only, and reads each in
chunks, so that a file of any size costs a task a bounded amount of memory.

``spark.read.format("file_checksums").option("paths", json_list).load()`` gives
``path, length, md5``.  Paths may be on any store that Arrow's file systems open
(``file:``, ``hdfs:``, ``s3:``, ``gs:``; plain paths are local or mounted folders).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES = 8 << 20
FILES_PER_TASK = 8


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], per_task: int, chunk: int):
        self.paths, self.per_task, self.chunk = paths, per_task, chunk

    def partitions(self) -> list[_Files]:
        return [_Files(self.paths[i : i + self.per_task]) for i in range(0, len(self.paths), self.per_task)]

    def read(self, partition: _Files) -> Iterator[tuple[str, int, str]]:
        for path in partition.paths:
            digest, size = hashlib.md5(), 0
            with opened(path) as stream:
                while block := stream.read(self.chunk):
                    digest.update(block)
                    size += len(block)
            yield path, size, digest.hexdigest()


def opened(path: str):
    """An input stream of a file given by path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        # Hadoop writes local paths as file:/x
        system, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_stream(inner, compression=None)


class FileChecksums(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_checksums"

    def schema(self) -> str:
        return "path string, length bigint, md5 string"

    def reader(self, schema) -> DataSourceReader:
        per_task = int(self.options.get("filespertask", FILES_PER_TASK))
        return _Reader(json.loads(self.options.get("paths", "[]")), per_task, int(self.options.get("chunkbytes", CHUNK_BYTES)))


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, length, md5`` of the given files; an empty list reads nothing."""
    if not paths:
        return spark.createDataFrame([], "path string, length bigint, md5 string")
    spark.dataSource.register(FileChecksums)
    return spark.read.format(FileChecksums.name()).option("paths", json.dumps(list(paths))).load()
