"""One file a row, in two phases: tasks write into folders of their own, and the files of tasks that count are renamed into place at the end.

    spark.dataSource.register(FileSink)
    rows.write.format("one_file_a_row").mode("append").save("store://folder")

Tasks that still run when their job has failed may leave files in ``_staging``, which readers skip; they never move.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Folder of unfinished writes, inside the target.
STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that has finished."""

    folder: str


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """Each attempt of a task has a folder of its own, so attempts don't meet."""
        store, root = _store(self.path)
        folder = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        seen: set[str] = set()
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name in (".", "..", STAGING):
                raise ValueError(f"not a file name: {name!r}")
            if name in seen:
                raise ValueError(f"two rows are called {name!r}")
            seen.add(name)
            content = row["content"]
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Written(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Names are checked before the first file moves; only names pass through the driver."""
        store, root = _store(self.path)
        moves: dict[str, str] = {}
        for message in messages:
            if message is None:
                continue
            for f in store.get_file_info(fs.FileSelector(message.folder)):
                if f.base_name in moves:
                    self._clear()
                    raise ValueError(f"two rows are called {f.base_name!r}")
                moves[f.base_name] = f.path
        if not self.overwrite:
            there = [f.base_name for f in store.get_file_info([f"{root}/{name}" for name in moves]) if f.type != fs.FileType.NotFound]
            if there:
                self._clear()
                raise FileExistsError(f"already in {self.path}: {sorted(there)[:5]}")
        for name, path in moves.items():
            store.move(path, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _store(self.path)
        if store.get_file_info([f"{root}/{STAGING}/{self.job}"])[0].type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")
        left = fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True)
        if not store.get_file_info(left) and store.get_file_info([left.base_dir])[0].type == fs.FileType.Directory:
            store.delete_dir(left.base_dir)


class FileSink(DataSource):
    """Format ``one_file_a_row``: rows of name and content (text or binary; null: an empty file). Option ``replace``: files that are there give way, otherwise they are an error."""

    @classmethod
    def name(cls) -> str:
        return "one_file_a_row"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite or str(self.options.get("replace", "false")).lower() == "true")


def write_files(rows: DataFrame, name: Column, content: Column, folder: str, replace: bool = False) -> None:
    """One file in ``folder`` for each row. An action: it ends with all files in place, or with none of them and an error."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select(name.alias("name"), content.alias("content")).write.format("one_file_a_row").option("replace", replace).mode("append").save(folder)


def keyframe_name(timestamp_ms: Column) -> Column:
    return F.format_string("keyframe_%07dms.png", timestamp_ms.cast("long"))
