"""Folders of image files as a Spark data source, whatever the files are called.

The file sources of Spark pass over names that start with ``_`` or ``.``; image
folders hold such names, and they count like any other. Here a folder is listed
by a task of its own (the driver holds no names), and names and sizes are
filtered in the listing. Contents are a second step, :func:`with_content`: the
listing's small rows are dealt over the cluster, and only files that are still
wanted are opened.

Paths are those of Hadoop (``file:/a/b.png``); folders may lie in any store that
Arrow's file systems open.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsift.session import ship_package

#: Rows in a batch of a listing, and bytes in a batch of contents.
LISTED_ROWS, CONTENT_BYTES = 10_000, 8 << 20

_LISTED = "path string, name string, length bigint"


def open_folder(folder: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what goes before a path in it to name it for Hadoop)."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(parts.path) if parts.scheme else folder), "file:"
    store, path = fs.FileSystem.from_uri(folder)
    before = folder[:folder.rindex(path)] if path and path in folder else f"{parts.scheme}://"
    return store, path, before


class _Folder(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class ImageFolderReader(DataSourceReader):
    """Lists each folder in one task; ``suffixes`` are those wanted, exactly or (with
    ``anycase``) in any case."""

    def __init__(self, options):
        self.folders = json.loads(options["folders"])
        self.suffixes = tuple(json.loads(options["suffixes"]))
        self.any_case = options.get("anycase", "false") == "true"
        self.least, self.most = (int(options[k]) if options.get(k) else None for k in ("minbytes", "maxbytes"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Folder(f) for f in self.folders]

    def _wanted(self, info: fs.FileInfo) -> bool:
        name = info.base_name.lower() if self.any_case else info.base_name
        return (info.type == fs.FileType.File and os.path.splitext("x" + name)[1] in self.suffixes
                and (self.least is None or info.size >= self.least) and (self.most is None or info.size <= self.most))

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        store, path, before = open_folder(partition.folder)
        found = [i for i in store.get_file_info(fs.FileSelector(path, recursive=False)) if self._wanted(i)]
        for at in range(0, max(len(found), 1), LISTED_ROWS):
            part = found[at:at + LISTED_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([before + i.path for i in part], pa.string()), pa.array([i.base_name for i in part], pa.string()),
                                              pa.array([i.size for i in part], pa.int64())], names=["path", "name", "length"])


class ImageFolder(DataSource):
    """``path, name, length`` of the image files that lie directly in some folders."""

    @classmethod
    def name(cls) -> str:
        return "image_folder"

    def schema(self) -> str:
        return _LISTED

    def reader(self, schema) -> ImageFolderReader:
        return ImageFolderReader(self.options)


def list_images(spark: SparkSession, folders: list[str], suffixes: Sequence[str], any_case: bool = False,
                min_bytes: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``path, name, length`` of files with one of ``suffixes`` (with the dot), in no
    order. Sub-folders are not entered; a folder that isn't there is an error."""
    ship_package(spark)
    spark.dataSource.register(ImageFolder)
    reader = (spark.read.format("image_folder").option("folders", json.dumps(list(folders))).option("suffixes", json.dumps(list(suffixes)))
              .option("anycase", str(any_case).lower()))
    for name, value in (("minbytes", min_bytes), ("maxbytes", max_bytes)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()


def _in_store(path: str) -> tuple[fs.FileSystem, str]:
    store, inside, _ = open_folder(path)
    return store, inside


def _local(path: str) -> str:
    """A Hadoop path as :func:`open_folder` takes it: ``file:/a%b`` is not encoded."""
    return path[len("file:"):] if path.startswith("file:") else path


def with_content(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """``files`` and the whole ``content`` of each ``path``. Rows are dealt over
    ``partitions`` tasks (default: the session's shuffle partitions) before any file
    is opened; a file that is gone is an error."""
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = files.columns.index("path")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    names = [*files.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(b.column(at).to_pylist()):
                store, inside = _in_store(_local(path))
                with store.open_input_file(inside) as f:
                    held.append(f.readall())
                size += len(held[-1])
                if size >= CONTENT_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in b.columns), pa.array(held, pa.binary())], names=names)
                    first, held, size = i + 1, [], 0

    return files.repartition(n, "path").mapInArrow(run, f"{fields}, content binary")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file in ``folder`` for each row, in the row's task; a repeated task writes
    the same files again. Two rows with one name are an error of the caller."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path, _ = open_folder(folder)
        store.create_dir(path, recursive=True)
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1)):
                with store.open_output_stream(f"{path}/{n}") as f:
                    f.write(data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    files.select(name, content).mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
