"""Saved reports as files of their own: a create-only or replacing sink that publishes on commit, and a scan that checks files before it opens them.

Both are data sources: tasks write and read, the driver commits and lists. The folder must be one that all executors share (a mounted file system).
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
import shutil
import stat
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from loadlens.sources.files import REPORT_BYTES, tree_code

#: Bytes of files that one task of a scan should read.
TASK_BYTES = 64 << 20


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, and below a temporary folder only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.gettempdir()
    path = f"{at.removeprefix('file://').rstrip('/')}/{label}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _local(path: str) -> str:
    """The path of a folder in a mounted file system."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in plain:
        raise ValueError("reports are files of a mounted file system")
    return plain


def canonical_report(text: str) -> str:
    """A report as it is stored: keys sorted at every level, indented, a line break at the end. Raises ValueError on what is no JSON object, repeats a key or is not finite."""
    code = tree_code(text)
    if code:
        raise ValueError(code)
    return json.dumps(json.loads(text), indent=2, sort_keys=True, allow_nan=False) + "\n"


@dataclass
class _Staged(WriterCommitMessage):
    """The folder of one task's private files, which holds a list of their names: so the driver is told one path a task, however many reports there are."""

    folder: str


#: Name of a task's list, a line for each report: its name and the number of its private file, by name.
_NAMES = "names"
#: Bytes of a list that are read at a time.
_BLOCK = 1 << 16


def _lines(path: str) -> Iterator[list]:
    """The lines of a list, by blocks; the file is not held open, as many are read side by side."""
    at = 0
    while True:
        with open(path, "rb") as handle:
            handle.seek(at)
            block = handle.readlines(_BLOCK)
            at = handle.tell()
        if not block:
            return
        yield from map(json.loads, block)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, replace: bool) -> None:
        self.path, self.replace = _local(options["path"]), replace
        self.stage = f"{self.path}/.{uuid.uuid4().hex}"  # made once; a task that is left over after an abort finds it gone
        os.makedirs(self.stage, mode=0o700)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Each report goes to a private file in the write's own hidden folder and to disk; nothing has its name yet."""
        folder = f"{self.stage}/{uuid.uuid4().hex}"
        os.mkdir(folder, 0o700)
        done: list[tuple[str, int]] = []
        for row in rows:
            name = row["name"]
            if not name or name.startswith(".") or os.sep in name or "\0" in name or len(os.fsencode(name)) > 255:
                raise ValueError(f"invalid_report_name: {name!r}")
            if not self.replace and os.path.lexists(f"{self.path}/{name}"):
                raise FileExistsError(f"report_already_exists: {name}")
            body = canonical_report(row["report"])
            with os.fdopen(os.open(f"{folder}/{len(done)}", os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as handle:
                handle.write(body)
                handle.flush()
                os.fsync(handle.fileno())
            done.append((name, len(done)))
        with open(f"{folder}/{_NAMES}", "w", encoding="ascii") as handle:
            handle.writelines(f"{json.dumps(x)}\n" for x in sorted(done))
        return _Staged(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Publish all reports of the write, or none: a name that is given twice or taken meanwhile undoes it. The lists are read side by side, so no name is held but the last."""
        folders = [m.folder for m in messages if isinstance(m, _Staged)]
        published = 0
        try:
            last = None
            for name, _ in heapq.merge(*[_lines(f"{x}/{_NAMES}") for x in folders]):
                if name == last:
                    raise ValueError("report_name_given_twice")
                last = name
            for folder, name, number in self._files(folders):
                if self.replace:
                    os.replace(f"{folder}/{number}", f"{self.path}/{name}")
                else:
                    os.link(f"{folder}/{number}", f"{self.path}/{name}")  # fails where the name is taken, even by a link to nowhere
                    published += 1
        except BaseException:
            _remove(f"{self.path}/{name}" for _, name, _ in itertools.islice(self._files(folders), published))
            raise
        finally:
            shutil.rmtree(self.stage, ignore_errors=True)

    @staticmethod
    def _files(folders: list[str]) -> Iterator[tuple[str, str, int]]:
        return ((x, name, number) for x in folders for name, number in _lines(f"{x}/{_NAMES}"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


def _remove(paths) -> None:
    for path in paths:
        try:
            os.unlink(path)
        except FileNotFoundError:
            pass


@dataclass
class _Files(InputPartition):
    """Files of one task; ``listed`` is the file that names them where the scan has a folder for its lists."""

    files: list[tuple[str, int, str | None]]
    listed: str | None = None


class _Reader(DataSourceReader):
    """Lists names, kinds and sizes on the driver; only regular files within the bound are ever opened, by the tasks.

    With the option ``lists``, a shared folder, what one task is to read is written there as soon as it is complete, and the driver keeps only the path.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.most, self.lists = _local(options["path"]), int(options.get("mostBytes", REPORT_BYTES)), options.get("lists")
        self.names: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and tuple(f.attribute) == ("file",):
                self.names.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return all(name == f.value if isinstance(f, EqualTo) else name in f.value if isinstance(f, In) else name.startswith(f.value) for f in self.names)

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        found: list[tuple[str, int, str | None]] = []
        size = 0
        for name, n, code in self._entries():
            if found and size + n > TASK_BYTES:
                parts.append(self._part(found))
                found, size = [], 0
            found.append((name, n, code))
            size += (n if code is None else 0) + 4096
        return [*parts, self._part(found)] if found else parts

    def _entries(self) -> Iterator[tuple[str, int, str | None]]:
        with os.scandir(self.path) as entries:
            for e in entries:
                if e.name.startswith(".") or not self._wanted(e.name):
                    continue
                facts = e.stat(follow_symlinks=False)
                code = "report_not_regular_file" if not stat.S_ISREG(facts.st_mode) else "report_exceeds_size_limit" if facts.st_size > self.most else None
                yield e.name, facts.st_size, code

    def _part(self, files: list[tuple[str, int, str | None]]) -> InputPartition:
        if self.lists is None:
            return _Files(sorted(files))
        path = f"{self.lists}/{uuid.uuid4().hex}"
        with open(path, "w", encoding="ascii") as handle:
            handle.writelines(f"{json.dumps(x)}\n" for x in sorted(files))
        return _Files([], path)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name, size, code in partition.files if partition.listed is None else _lines(partition.listed):
            report = None
            if code is None:
                report, code = self._open(f"{self.path}/{name}")
            yield name, size, report, code

    def _open(self, path: str) -> tuple[str | None, str | None]:
        """Text and code of one file. It is opened without following links and judged again by its descriptor, as it may have been exchanged since it was listed."""
        try:
            descriptor = os.open(path, os.O_RDONLY | os.O_NONBLOCK | os.O_NOFOLLOW)
        except OSError:
            return None, "report_unreadable"
        with os.fdopen(descriptor, "rb") as handle:
            if not stat.S_ISREG(os.fstat(descriptor).st_mode):
                return None, "report_not_regular_file"
            raw = handle.read(self.most + 1)
        if len(raw) > self.most:
            return None, "report_exceeds_size_limit"
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None, "report_unreadable"
        return text, tree_code(text)


class ReportFiles(DataSource):
    """Reports of a folder: reading gives file, size, report and code; writing takes name and report (JSON text). Options: path, mostBytes, lists."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "file string, size bigint, report string, code string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, self.options.get("replace", "false").lower() == "true")


def save_reports(reports: DataFrame, path: str, name: str = "name", report: str = "report", replace: bool = False) -> None:
    """One private file (mode 0600) for each row: JSON with keys sorted at every level. All reports appear at once when the write commits.

    Without ``replace`` a name that exists fails the write and leaves everything as it was; with it files are replaced one by one, each at once. A
    report that is no JSON object, repeats a key or has a number that is not finite fails the write, and nothing is left behind.
    """
    reports.sparkSession.dataSource.register(ReportFiles)
    reports.selectExpr(f"`{name}` AS name", f"`{report}` AS report").write.format("report_files").option("path", path).option("replace", str(replace).lower()).mode("append").save()


def scan_reports(spark: SparkSession, path: str, most_bytes: int = REPORT_BYTES) -> DataFrame:
    """file, size, report and code (first failing check, null if none) of every file in a folder.

    Names in a filter are applied before any file is opened; for this the session lets data sources see filters from here on. What each task is to
    read is listed below spark.checkpoint.dir (without it, outside local mode, the driver holds all names).
    """
    spark.dataSource.register(ReportFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("report_files").option("path", path).option("mostBytes", str(most_bytes))
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local["):
        found = found.option("lists", shared_folder(spark, "lists"))
    return found.load()
