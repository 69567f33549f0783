"""A sink that writes one named file per row, as a Python data source.

Each task attempt writes into a folder of its own below ``_staging-<job>``; only the folders of
the attempts that Spark committed are moved into place, by name. So a killed and repeated task, or a
speculative one, leaves no double, and no file is seen before all tasks have ended. (After a job that failed, a
task that was still being killed may leave its staging folder.) Contents never reach the driver, which only renames.

The files are read back by tasks that take their names from a task's listing. (Spark's own file source lists them in the
driver, and counts each small file as 4 MB, so that 32 of them make a task.)
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SUFFIX = "_analysis.json"
#: renames that the driver has under way at a time
RENAMES = 32
#: files that a task opens at a time, file names in a batch, and bytes of contents in one, about
READS, NAMES, BATCH_BYTES = 8, 4096, 4 << 20


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else folder.replace("file:", "file://", 1))
    return store, root.rstrip("/")


def target(path: str) -> str:
    """The file of a version at ``path``, relative; a path that leaves the folder is refused."""
    name = posixpath.normpath(posixpath.splitext(path)[0].lstrip("/") + SUFFIX)
    if name.startswith("../"):
        raise ValueError(f"path leaves the folder: {path}")
    return name


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, root = _open(self.folder)
        attempt, made, n = f"{root}/{self.staging}/{uuid.uuid4().hex}", set(), 0
        for row in rows:
            file = f"{attempt}/{target(row.path)}"
            if (parent := posixpath.dirname(file)) not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(file) as out:
                out.write((row.result or "").encode())
            n += 1
        return Written(attempt, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.folder)
        made: set[str] = set()

        def publish(some: list[tuple[str, str]]) -> None:
            for file, name in some:
                store.move(file, f"{root}/{name}")

        with ThreadPoolExecutor(RENAMES) as pool:
            for m in filter(lambda m: m and m.files, messages):
                found = [f.path for f in store.get_file_info(fs.FileSelector(m.attempt, recursive=True)) if f.type == fs.FileType.File]
                names = [f[len(m.attempt) + 1 :] for f in found]
                for parent in {posixpath.dirname(f"{root}/{n}") for n in names} - made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                both = list(zip(found, names))
                list(pool.map(publish, [both[k::RENAMES] for k in range(RENAMES)]))
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        staging = f"{root}/{self.staging}"
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class VersionFiles(DataSource):
    """``df.write.format("version_files").mode("append").save(folder)`` of ``(path, result)``."""

    @classmethod
    def name(cls) -> str:
        return "version_files"

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files of other versions are never removed: use mode append")
        return Writer(self.options["path"])


def _hidden(part: str) -> bool:
    """Names that Spark's file sources leave out."""
    return part.startswith(".") or part.startswith("_") and "=" not in part or part.endswith("._COPYING_")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)``: every analysis file below ``folder`` that is not empty, its path from there and its bytes."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in range(b.num_rows):
                store, root = _open(folder)
                below = [root]
                while below:
                    found, own = store.get_file_info(fs.FileSelector(at := below.pop())), []
                    for f in found:
                        if _hidden(f.base_name):
                            continue
                        if f.type == fs.FileType.Directory:
                            below.append(f"{at}/{f.base_name}")
                        elif f.base_name.endswith(SUFFIX):
                            own.append(f"{at}/{f.base_name}"[len(root) + 1 :])
                    for i in range(0, len(own), NAMES):
                        yield pa.RecordBatch.from_arrays([pa.array(own[i : i + NAMES], pa.string())], ["path"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)

        def content(path: str) -> bytes:
            with store.open_input_stream(f"{root}/{path}") as file:
                return file.read()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.binary())], ["path", "content"])

        paths, found, size = [], [], 0
        with ThreadPoolExecutor(READS) as pool:
            for b in batches:
                listed = b.column("path").to_pylist()
                for i in range(0, len(listed), 8 * READS):
                    some = listed[i : i + 8 * READS]
                    for path, data in zip(some, pool.map(content, some)):
                        if not data:
                            continue
                        paths.append(path)
                        found.append(data)
                        size += len(data)
                        if size > BATCH_BYTES:
                            yield batch()
                            paths, found, size = [], [], 0
        if paths:
            yield batch()

    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.range(1, numPartitions=1).mapInArrow(names, "path string")
    return listed.repartition(tasks).mapInArrow(contents, "path string, content binary")
