"""Files under real names, written aside and put in place by one commit.

Tasks write below a hidden folder of the target. The commit (its moves are made by tasks where they are many) moves what they wrote to its names and only then removes what an
earlier commit of the same name had left and this one does not have again. What belongs to a commit is kept in its manifest,
so other files of the folder are never touched, and a run that fails before or within the commit leaves the old files whole.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import stage

#: The column that names each row's file.
NAME = "veilframe_name"
#: Moves that are under way at a time.
MOVES = 16
#: From so many files on, tasks look for them and move them, where Arrow reaches the folder.
BY_TASKS = 1_000
#: The file of rows without a name, as Spark's writer calls it.
UNNAMED = "__HIVE_DEFAULT_PARTITION__"


def arrow_system(folder: str):
    """Arrow's file system and the path of a folder that is named with its scheme."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", folder)
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", folder))


def _checksum(path: str) -> str:
    """Where Spark's local file system keeps the checksums of a file."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.crc"


def _move_file(system, source: str, target: str, back: bool, made: set[str]) -> None:
    """A move that may have been made before, by an earlier attempt; with `back` also one that never was."""
    from pyarrow import fs

    def there(path: str) -> bool:
        return system.get_file_info(path).type != fs.FileType.NotFound

    parent = target.rpartition("/")[0]
    if parent not in made:
        system.create_dir(parent, recursive=True)
        made.add(parent)
    try:
        system.move(source, target)
    except OSError:
        if there(source) or not (back or there(target)):
            raise
    if system.type_name == "local":  # checksums go with their file; none may stay beside another one
        if there(_checksum(source)):
            system.move(_checksum(source), _checksum(target))
        elif there(_checksum(target)) and not there(source):
            system.delete_file(_checksum(target))


class CommittedFolder:
    """The files of `base` in `folder`, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, base: str):
        if not base or "/" in base:
            raise ValueError(f"no name for a manifest: {base!r}")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._utils, self._conf = spark._jvm.org.apache.hadoop.io.IOUtils, spark._jsc.hadoopConfiguration()
        self.spark = spark
        root = self._path(folder)
        self.system = root.getFileSystem(self._conf)
        #: The folder with its scheme, as tasks need it.
        self.folder = self.system.makeQualified(root).toString().rstrip("/")
        self.base = base
        self.manifest = f"{self.folder}/_{base}.manifest"
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def _at(self, path: str):
        return self._path(path)

    def names(self) -> list[str]:
        """Names of the files of the last commit, below the folder."""
        return [entry["name"] for entry in self.entries()]

    def entries(self) -> list[dict]:
        """The files of the last commit: their names, and what the commit was told about them."""
        if not self.system.exists(self._at(self.manifest)):
            return []
        stream = self.system.open(self._at(self.manifest))
        try:
            text = bytes(self._utils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines()]

    def staged(self) -> list[str]:
        """Data files below the staging folder, relative to it."""
        found, at = [], self._at(self.staging)
        if self.system.exists(at):
            files = self.system.listFiles(at, True)
            root = self.system.makeQualified(at).toString().rstrip("/") + "/"
            while files.hasNext():
                path = files.next().getPath().toString().removeprefix(root)
                if not re.match(r"[_.]", path.rsplit("/", 1)[-1]):
                    found.append(path)
        return sorted(found)

    def make_staging(self) -> None:
        self.system.mkdirs(self._at(self.staging))

    def in_arrow(self) -> bool:
        """Whether Arrow sees the staging folder that Spark sees, so tasks can work on its files."""
        from pyarrow import fs

        try:
            system, path = arrow_system(self.staging)
            return system.get_file_info(path).type == fs.FileType.Directory
        except Exception:  # noqa: BLE001  no such file system, no library or no rights for it
            return False

    def _in_tasks(self, rows: list[tuple], schema: str, work) -> list[str]:
        """What `work(system, root, row)` returns for the rows but for None, from tasks that share them."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = arrow_system(folder)
            for batch in batches:
                found = [work(system, root, row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f for f in found if f is not None], pa.string())], ["found"])

        names = [c.split()[0] for c in schema.split(", ")]
        given = self.spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names))
        parts = self.spark.sparkContext.defaultParallelism * 2
        return [r.found for r in given.repartition(parts).mapInArrow(run, "found string").collect()]

    def _existing(self, names: set[str], by_tasks: bool) -> set[str]:
        if not by_tasks:
            return {n for n in names if self.system.exists(self._at(f"{self.folder}/{n}"))}

        def look(system, root: str, row: tuple[str]) -> str | None:
            from pyarrow import fs

            return row[0] if system.get_file_info(f"{root}/{row[0]}").type != fs.FileType.NotFound else None

        return set(self._in_tasks([(n,) for n in names], "name string", look)) if names else set()

    def _move(self, source: str, target: str) -> None:
        """From and to a path below the folder."""
        to = self._at(f"{self.folder}/{target}")
        self.system.mkdirs(to.getParent())
        if not self.system.rename(self._at(f"{self.folder}/{source}"), to):
            raise OSError(f"could not move {source} to {target}")

    def _move_in_tasks(self, pairs: list[tuple[str, str]], back: bool = False) -> None:
        """As `_move` for many files. A task reports what it could not move and goes on, so none works on when the job has failed."""
        made: set[str] = set()

        def move(system, root: str, row: tuple[str, str]) -> str | None:
            try:
                _move_file(system, f"{root}/{row[0]}", f"{root}/{row[1]}", back, made)
            except OSError as e:
                return f"could not move {row[0]} to {row[1]}: {e}"
            return None

        if pairs and (failed := self._in_tasks(pairs, "source string, target string", move)):
            raise OSError(f"{len(failed)} files: {min(failed)}")

    def commit(self, moves: Mapping[str, str], about: Mapping[str, Mapping] | None = None) -> None:
        """Staged files (relative to the staging folder) to their names below the folder; `about` a name goes into the manifest.

        A name that is taken by a file of no earlier commit of `base` is an error, and nothing is changed. An error on the way
        puts everything back.
        """
        old, new = set(self.names()), set(moves.values())
        if len(new) < len(moves):
            raise ValueError("two files have one name")
        by_tasks = len(old) + len(new) >= BY_TASKS and self.in_arrow()
        there = self._existing(new, by_tasks)
        if foreign := there - old:
            raise FileExistsError(f"{len(foreign)} files of {self.folder} are no part of {self.base}, such as {min(foreign)}")
        staging = self.staging.rsplit("/", 1)[1]
        aside = f"{staging}/_replaced"
        done: list[tuple[str, str]] = []
        begun: list[list[tuple[str, str]]] = []

        def move(pair: tuple[str, str]) -> None:
            self._move(*pair)
            done.append(pair)

        again = [(n, f"{aside}/{n}") for n in there]
        try:
            for pairs in (again, [(f"{staging}/{s}", n) for s, n in moves.items()]):
                if by_tasks:
                    begun.append(pairs)
                    self._move_in_tasks(pairs)
                else:
                    with ThreadPoolExecutor(MOVES) as pool:
                        list(pool.map(move, pairs))
            manifest = self.manifest.rsplit("/", 1)[1]
            if self.system.exists(self._at(self.manifest)):
                move((manifest, f"{aside}/_manifest"))
            self._write(f"{self.staging}/_manifest", "".join(json.dumps({**(about or {}).get(n, {}), "name": n}) + "\n" for n in sorted(new)))
            move((f"{staging}/_manifest", manifest))
        except BaseException:
            for source, target in reversed(done):
                self._move(target, source)
            for pairs in reversed(begun):
                self._move_in_tasks([(target, source) for source, target in pairs], back=True)
            raise
        if by_tasks:
            gone = self._existing(old - new, by_tasks)
            self._move_in_tasks([(n, f"{staging}/_removed/{n}") for n in gone])
        else:
            for name in old - new:
                self.system.delete(self._at(f"{self.folder}/{name}"), False)
        self.drop_staging()

    def _write(self, path: str, text: str) -> None:
        stream = self.system.create(self._at(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def drop_staging(self) -> None:
        self.system.delete(self._at(self.staging), True)


def save_named(df: DataFrame, folder: str, base: str, write) -> list[str]:
    """Rows to files called by column `NAME` (a path below `folder`) with `write(writer, path)`; returns the names.

    A name whose rows come from several tasks has several files: `<name>-part1`, `-part2`, ... before the ending. Rows are not
    gathered by name, so a large file stays spread.
    """
    out = CommittedFolder(df.sparkSession, folder, base)
    try:
        write(df.write.partitionBy(NAME), out.staging)
        by_name: dict[str, list[str]] = {}
        for path in out.staged():
            by_name.setdefault(unquote(path.split("/", 1)[0].removeprefix(f"{NAME}=")), []).append(path)
        moves = {}
        for wanted, files in by_name.items():
            stem, ending = re.fullmatch(r"(.*?[^/])((?:\.[^./]+)?)", wanted, re.S).groups()
            for i, path in enumerate(files, 1):
                moves[path] = wanted if len(files) == 1 else f"{stem}-part{i}{ending}"
        out.commit(moves)
    finally:
        out.drop_staging()
    return sorted(moves.values())


def save_lines(df: DataFrame, folder: str, base: str) -> list[str]:
    """Rows (`value`, `NAME`) as lines to files called by `NAME`, for very many small files; returns the names.

    Tasks write the files themselves, since a job of Spark's writer has a folder and several calls of its file system for each.
    Rows are dealt by name, so a name is one file. Where Arrow does not reach the folder, Spark's writer is used.
    """
    out = CommittedFolder(df.sparkSession, folder, base)
    try:
        out.make_staging()
        if not out.in_arrow():
            return save_named(df, folder, base, lambda writer, path: writer.text(path))
        staging = out.staging

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = arrow_system(staging)
            attempt, count, last, file = uuid.uuid4().hex, 0, None, None
            for batch in batches:
                paths, names = [], []
                for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name != last:
                        if file:
                            file.close()
                        else:
                            system.create_dir(f"{root}/{attempt}")
                        paths.append(f"{attempt}/{count}")
                        names.append(name)
                        file, last, count = system.open_output_stream(f"{root}/{paths[-1]}"), name, count + 1
                    file.write(f"{value or ''}\n".encode())
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], ["path", "name"])
            if file:
                file.close()

        name = F.coalesce(F.nullif(NAME, F.lit("")), F.lit(UNNAMED)).alias(NAME)
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = df.select("value", name).repartition(parts, NAME).sortWithinPartitions(NAME)
        # Staged, so only the files of the attempts that counted are known; what others left goes with the folder.
        written = stage(rows.mapInArrow(write, "path string, name string"), "files-written")
        moves = {r.path: r.name for r in written.collect()}
        out.commit(moves)
    finally:
        out.drop_staging()
    return sorted(moves.values())


def committed_files(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """`(name)` of the files of the last commit."""
    names = CommittedFolder(spark, folder, base).names()
    return spark.createDataFrame([(n,) for n in names], "name string")


def has_manifest(spark: SparkSession, folder: str, base: str) -> bool:
    out = CommittedFolder(spark, folder, base)
    return out.system.exists(out._at(out.manifest))


def plain_json(df: DataFrame) -> Column:
    """All columns as one JSON text, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
