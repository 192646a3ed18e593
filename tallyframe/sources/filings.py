"""Files of filings as a data source of tokens, for batches and for streams.

    spark.dataSource.register(Filings)
    spark.read.format("filings").load(folder)               # or option("path", folder), option("limit", bytes)
    spark.readStream.format("filings").load(folder)

The folder is listed once, in the planner: names and lengths tell which files are admitted and how they are dealt to partitions of
about `part_bytes`. A refused file is a row with its code and is never opened. With option("push", "true"), which needs
`spark.sql.python.filterPushdown.enabled`, filters on doc_id and code are pushed into the listing, so files that they rule out
aren't opened either. A stream takes files by
name, `per_batch` of them at a time; its offset is the last name, so files have to arrive in the order of their names (as dated or
numbered drops do). Folders are read through Arrow's file systems: local paths, and the URIs that these know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringEndsWith, StringStartsWith

from . import LIMIT, TOKENS, kind_of, refusal, tokens_in

#: Bytes of files in a partition, and files in a batch of a stream.
PART_BYTES, PER_BATCH = 64 << 20, 1000


@dataclass(frozen=True)
class Listed:
    path: str
    length: int
    code: str | None


@dataclass
class Share(InputPartition):
    """The files of one task."""

    files: list[Listed]


class _Folder:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("filings: which folder? Give load() a path, or the option path")
        self.path, self.limit = options["path"], int(options.get("limit", LIMIT))
        self.part_bytes, self.per_batch = int(options.get("part_bytes", PART_BYTES)), int(options.get("per_batch", PER_BATCH))

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def files(self) -> list[Listed]:
        """All files, by name."""
        store, root = self.store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((Listed(f.path, f.size, refusal(f.size, f.base_name, self.limit)) for f in found if f.is_file), key=lambda f: f.path)

    def dealt(self, files: list[Listed]) -> list[Share]:
        """Files in the order of their names, in shares of about part_bytes; what isn't opened weighs nothing."""
        out: list[Share] = []
        room = 0
        for f in files:
            weight = 0 if f.code else f.length
            if not out or weight > room:
                out.append(Share([]))
                room = self.part_bytes
            out[-1].files.append(f)
            room -= weight
        return out or [Share([])]

    def tokens(self, share: Share) -> Iterator[tuple]:
        store, _ = self.store()
        for f in share.files:
            if f.code:
                yield (f.path, *[None] * 11, f.code)
                continue
            with store.open_input_stream(f.path) as opened:
                content = opened.read()
            yield from tokens_in(f.path, content, kind_of(content[:8], f.path) if content else "EMPTY_FILE")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.wanted = _Folder(options), []

    def holds(self, file: Listed) -> bool:
        for f in self.wanted:
            if isinstance(f, IsNull):
                ok = file.code is None
            elif isinstance(f, EqualTo):
                ok = file.path == f.value
            elif isinstance(f, In):
                ok = file.path in f.value
            else:
                ok = file.path.endswith(f.value) if isinstance(f, StringEndsWith) else file.path.startswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Share]:
        return self.folder.dealt([f for f in self.folder.files() if self.holds(f)])

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.folder.tokens(partition)


class PushingReader(Reader):
    """Takes filters on the file's name, and those on the code of refused files; other filters stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("doc_id",) and isinstance(f, (EqualTo, In, StringEndsWith, StringStartsWith)):
                self.wanted.append(f)
            elif f.attribute == ("code",) and isinstance(f, IsNull):
                self.wanted.append(f)
                yield f  # a file that is opened may have a code too
            elif not (f.attribute == ("doc_id",) and isinstance(f, IsNotNull)):
                yield f


class Stream(DataSourceStreamReader):
    """Offsets are names: files up to and including one have been read."""

    def __init__(self, options: dict):
        self.folder = _Folder(options)
        self.at = ""

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        new = [f.path for f in self.folder.files() if f.path > self.at][: self.folder.per_batch]
        self.at = new[-1] if new else self.at
        return {"name": self.at}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        self.at = max(self.at, end["name"])
        return self.folder.dealt([f for f in self.folder.files() if start["name"] < f.path <= end["name"]])

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.folder.tokens(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go: files stay where they are."""


class Filings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return TOKENS

    def reader(self, schema) -> Reader:
        options = dict(self.options)
        return (PushingReader if options.get("push", "").lower() == "true" else Reader)(options)

    def streamReader(self, schema) -> Stream:
        return Stream(dict(self.options))
