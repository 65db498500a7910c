"""A Spark data source that writes rows (name, content) as files, all of them or none.

Tasks write below a hidden folder of their job, each attempt to a folder of its own, with a list of the names beside it.
When all tasks are done, `save` has Spark compare the lists of the attempts that count and move their files to the target,
an attempt a task, and a manifest beside the target lists them; other attempts go.  A job that fails leaves nothing but what was there
before; a job that runs again replaces its files by the same ones.  Spark's file sources, and `ranges.listed`, pass over
hidden folders.

The driver knows attempts and lists, never the single files: a manifest is a small JSON file that names lists, which lie in
a folder beside it.  `saved` gives the files as a table.

Moves are made by tasks through pyarrow, so a file system without cheap moves copies there.

A file system keeps a block and an entry for each file, however short it is.  `save` with `packed` writes ZIP archives
instead, of many files each; `saved` then gives the archives, and `ranges.members` reads their files.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rasterloom.sources.ranges import resolve

#: Names of one batch of a list.
NAMES = 1 << 14
#: Bytes at which an archive is closed; one archive is held in memory until then.
ARCHIVE = 1 << 24


@dataclass
class Written(WriterCommitMessage):
    """The name of an attempt's folder and list, and the number of its files."""

    attempt: str
    number: int


class _Files:
    """Files of a folder."""

    def __init__(self, system: fs.FileSystem, folder: str):
        self.system, self.folder = system, folder

    def add(self, name: str, content: pa.Buffer | bytes) -> None:
        with self.system.open_output_stream(f"{self.folder}/{name}") as out:
            out.write(content)

    def close(self) -> list[str]:
        return []


class _Archives:
    """Archives of a folder, whose names begin with `prefix`."""

    def __init__(self, system: fs.FileSystem, folder: str, prefix: str):
        self.files, self.prefix, self.names, self.held = _Files(system, folder), prefix, [], None

    def add(self, name: str, content: pa.Buffer | bytes) -> None:
        if self.held is None:
            self.held = io.BytesIO()
            self.archive = zipfile.ZipFile(self.held, "w", zipfile.ZIP_DEFLATED)
        info = zipfile.ZipInfo(name)  # without the time, so that the same files make the same archive
        info.compress_type = zipfile.ZIP_DEFLATED
        self.archive.writestr(info, memoryview(content))
        if self.held.tell() >= ARCHIVE:
            self._end()

    def _end(self) -> None:
        self.archive.close()
        self.names.append(f"{self.prefix}_{len(self.names):05d}.zip")
        self.files.add(self.names[-1], self.held.getbuffer())
        self.held = None

    def close(self) -> list[str]:
        """The names of the archives."""
        if self.held is not None:
            self._end()
        return self.names


class FileSetWriter(DataSourceArrowWriter):
    """Stages files below `{folder}/_staged-{job}`; `committed.json` there names the attempts that count.

    `lists` there have the names of the files, and with `packed` `archives` those of the archives.
    """

    def __init__(self, folder: str, job: str, packed: bool):
        self.folder, self.job, self.packed = folder, job, packed

    def _staging(self) -> str:
        return _staging(resolve(self.folder)[1], self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, attempt, number = resolve(self.folder)[0], uuid.uuid4().hex, 0
        own = f"{self._staging()}/files/{attempt}"
        system.create_dir(own, recursive=True)
        system.create_dir(f"{self._staging()}/lists", recursive=True)
        out = _Archives(system, own, attempt) if self.packed else _Files(system, own)
        with system.open_output_stream(f"{self._staging()}/lists/{attempt}") as listed:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                    if not name or "/" in name or name[0] in "._":
                        raise ValueError(f"{name!r} is no name for a file: it is empty, hidden or a path")
                    out.add(name, content.as_buffer() if content.is_valid else b"")
                    listed.write(json.dumps(name).encode() + b"\n")
                    number += 1
        archives = out.close()
        if self.packed:
            system.create_dir(f"{self._staging()}/archives", recursive=True)
            with system.open_output_stream(f"{self._staging()}/archives/{attempt}") as listed:
                listed.write(b"".join(json.dumps(name).encode() + b"\n" for name in archives))
        return Written(attempt, number)

    def commit(self, messages: list[Written | None]) -> None:
        system = resolve(self.folder)[0]
        system.create_dir(self._staging(), recursive=True)
        with system.open_output_stream(f"{self._staging()}/committed.json") as out:
            out.write(json.dumps([(m.attempt, m.number) for m in messages if m and m.number]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what the job has staged."""
        _delete(resolve(self.folder)[0], self._staging())


def _staging(root: str, job: str) -> str:
    return f"{root}/_staged-{job}"


def _delete(system: fs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


def _names(system: fs.FileSystem, path: str) -> Iterator[str]:
    with system.open_input_stream(path) as lines:
        rest = b""
        while data := lines.read(1 << 20):
            *whole, rest = (rest + data).split(b"\n")
            yield from map(json.loads, whole)


def _over_lists(spark: SparkSession, folder: str, lists: list[str], step: Callable[[fs.FileSystem, str, Iterator[str]], Iterator[str]]) -> DataFrame:
    """(name) as `step` gives it for (file system, list, its names); a task for each list, whose paths are those of `folder`'s system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = resolve(folder)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for name in step(system, path, _names(system, path)):
                    held.append(name)
                    if len(held) == NAMES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["name"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["name"])

    rows = spark.createDataFrame([(path,) for path in lists], "list string")
    return rows.repartition(max(1, len(lists))).mapInArrow(run, "name string")


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        return FileSetWriter(self.options["path"], self.options["job"], self.options["packed"] == "true")


def manifest_of(root: str) -> str:
    """Beside the folder, so that the folder holds the files alone."""
    parent, _, name = root.rstrip("/").rpartition("/")
    return f"{parent}/_{name}.manifest.json"


def sweep(folder: str) -> None:
    """Deletes what dead jobs have staged, also by tasks that began after their job was given up; no job may be writing."""
    system, root = resolve(folder)
    for found in system.get_file_info(fs.FileSelector(root)):
        if found.base_name.startswith("_staged-"):
            system.delete_dir(found.path)


def _manifest(folder: str) -> dict:
    system, root = resolve(folder)
    if system.get_file_info(manifest_of(root)).type != fs.FileType.File:
        return {"lists": [], "last": 0}
    with system.open_input_file(manifest_of(root)) as found:
        return json.loads(found.read())


def _lists(folder: str) -> list[str]:
    """Paths of the lists that the folder's manifest names."""
    where = manifest_of(resolve(folder)[1]).removesuffix(".json")
    return [f"{where}/{name}" for name in _manifest(folder)["lists"]]


def written(folder: str) -> list[str]:
    """The names of files or archives that the folder's manifest lists, all in this process; `saved` gives them as a table."""
    system = resolve(folder)[0]
    return sorted({name for path in _lists(folder) for name in _names(system, path)})


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the files or archives that the folder's manifest lists, a URI each; nothing is listed by the driver."""
    lists = _lists(folder)
    names = _over_lists(spark, folder, lists, lambda system, path, names: names)
    once = names if _manifest(folder).get("once") else names.distinct()
    return once.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"))


def _publish(spark: SparkSession, folder: str, job: str, overwrite: bool, packed: bool) -> int:
    """Moves what a job has staged to the folder and lists it."""
    system, root = resolve(folder)
    staging, where = _staging(root, job), manifest_of(root).removesuffix(".json")
    with system.open_input_file(f"{staging}/committed.json") as found:
        attempts = json.loads(found.read())
    lists, before = [f"{staging}/lists/{attempt}" for attempt, _ in attempts], _lists(folder)
    names = lambda paths: _over_lists(spark, folder, paths, lambda system, path, names: names)
    if lists and names(lists).groupBy("name").count().where("count > 1").limit(1).count():
        raise ValueError("two rows have the same file name")
    if packed:
        lists = [f"{staging}/archives/{attempt}" for attempt, _ in attempts]

    def move(system: fs.FileSystem, path: str, names: Iterator[str]) -> Iterator[str]:
        own = f"{staging}/files/{path.rsplit('/', 1)[1]}"
        for name in names:
            try:
                system.move(f"{own}/{name}", f"{root}/{name}")
            except OSError:  # a task that runs again finds its files moved
                if system.get_file_info(f"{own}/{name}").type == fs.FileType.File or system.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise
        return iter(())

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if system_of(folder).get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    system_of(folder).delete_file(f"{root}/{name}")
            yield batch.slice(0, 0)

    system_of = lambda uri: resolve(uri)[0]
    _over_lists(spark, folder, lists, move).count()
    if overwrite and before:
        names(before).distinct().join(names(lists), "name", "left_anti").mapInArrow(gone, "name string").count()
    system.create_dir(where, recursive=True)
    for path in lists:
        system.move(path, f"{where}/{path.rsplit('/', 1)[1]}")
    kept = [] if overwrite else [path.rsplit("/", 1)[1] for path in before]
    part, number = f"{manifest_of(root)}.{job}", sum(n for _, n in attempts)
    with system.open_output_stream(part) as out:
        out.write(json.dumps({"lists": kept + [attempt for attempt, _ in attempts], "last": number, "once": not kept}).encode())
    system.move(part, manifest_of(root))
    for path in before if overwrite else ():
        system.delete_file(path)
    return number


def save(named: DataFrame, folder: str, overwrite: bool = False, packed: bool = False) -> int:
    """Writes (name, content) rows as files of `folder`, a URI that every executor reaches; returns their number.

    Files of other names stay, or go with `overwrite` if a manifest lists them.  With `packed` the files lie in archives,
    which cannot replace single files of each other: the folder must be new then, or is overwritten.
    """
    spark, job = named.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileSet)
    system, root = resolve(folder)
    if packed and not overwrite and _manifest(folder)["lists"]:
        raise ValueError(f"{folder} has files already, and archives are not added to them")
    try:
        named.select("name", "content").write.format("file_set").options(job=job, packed=packed).mode("append").save(folder)
        return _publish(spark, folder, job, overwrite, packed)
    finally:
        _delete(system, _staging(root, job))
