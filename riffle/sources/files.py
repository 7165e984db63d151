"""Media files as tables and back: whole files, packets of files, and files written from binary rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from riffle.functions.bytesx import chunks
from riffle.functions.parsing import ts_fields


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, size, data``: every file of a folder as one row. Spark reads files in parallel; one file must fit in a row (2 GB)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), F.col("content").alias("data"))


def transport_packets(spark: SparkSession, path: str, glob: str = "*.ts") -> DataFrame:
    """``path, off`` and the header fields of every 188-byte packet; ``err`` says where a file is cut short or out of step."""
    rows = whole_files(spark, path, glob).select("path", F.posexplode(chunks(F.col("data"), 188)).alias("off", "packet"))
    return rows.select("path", "off", "packet", *[c.alias(k) for k, c in ts_fields(F.col("packet")).items()])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ByteFiles(DataSource):
    """Writes rows ``name, data`` as one file each below a folder: ``df.write.format("byte_files").mode("append").save(folder)``.

    Tasks write under hidden names; files get their own names when the job commits, and are removed when it fails. With mode overwrite,
    what the folder held before goes at the commit. The folder is any that pyarrow can write (a shared mount, HDFS or an
    object store), and a name may hold folders.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ByteFileWriter(self.options["path"], overwrite)


class ByteFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = self._store()
        attempt, files = TaskContext.get().taskAttemptId(), []
        folder = f"{root}/.writing-{self.job}"
        store.create_dir(folder, recursive=True)
        for row in rows:
            part = f"{folder}/{attempt}-{len(files)}"
            with store.open_output_stream(part) as out:
                out.write(bytes(row.data))
            files.append((part, row.name))
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = self._store()
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not old.base_name.startswith(".writing-"):
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for message in messages:
            for part, name in message.files if message else []:
                if "/" in name:
                    store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                store.move(part, f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/.writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/.writing-{self.job}")


def write_bytes(df: DataFrame, path: str, name: str = "name", data: str = "data") -> None:
    """One file for each row."""
    df.sparkSession.dataSource.register(ByteFiles)
    df.select(F.col(name).alias("name"), F.col(data).alias("data")).write.format("byte_files").mode("append").save(path)


def joined(df: DataFrame, by: str, order: str, data: str) -> DataFrame:
    """The binary rows of each group one after another: ``name, data``."""
    parts = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(data).alias("h")))).alias("p"))
    return parts.select(F.col(by).cast("string").alias("name"), F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"))
