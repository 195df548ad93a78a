"""Mail archives: tar files whose members lie at owner/folder paths, read in parts by an index of member offsets.

``spark.read.format("mail_archive")`` gives path, member, author, folder, place, text. The archive's headers are walked
once, without reading any member, until every author asked for has as many members as are wanted; the members found are
dealt to tasks by bytes, and a task reads its own ranges only. So no task holds more than one member, however large the
archive is. Filters on author and folder (equality and lists) are pushed to the walk. A compressed archive has no
offsets: one task reads it as a stream, with the same filters and the same early stop.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, member string, author string, folder string, place long, text string"
#: Bytes of members that one task reads.
SPLIT_BYTES = 64 << 20


def opened(path: str, mode: str = "file"):
    """A file of any store that Arrow reaches, for reading at places (`file`) or as a stream."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at) if mode == "file" else store.open_input_stream(at, compression=None)


def listed(path: str) -> list[str]:
    """The archives of a path: itself, or the files below it in the order of their names."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.split("/")[-1][:1] not in "._")


@dataclass
class Wanted:
    """What a walk looks for: members at root/author/folder/..., of some authors and folders (none: all), up to `most` per author."""

    root: str
    authors: frozenset[str] | None
    folders: frozenset[str] | None
    most: int | None

    def walk(self, archive: tarfile.TarFile) -> Iterator[tuple[tarfile.TarInfo, str, str, int]]:
        """Members in order, with author, folder and place among the author's; ends as soon as no more can come."""
        found: dict[str, int] = {}
        full = 0
        for member in archive:
            archive.members = []  # else the headers of all members are kept
            parts = member.name.split("/")
            if not member.isfile() or len(parts) < 4 or parts[0] != self.root:
                continue
            author, folder = parts[1], parts[2].lower()
            if self.authors is not None and author not in self.authors or self.folders is not None and folder not in self.folders:
                continue
            n = found.get(author, 0)
            if self.most is not None and n >= self.most:
                continue
            found[author] = n + 1
            yield member, author, folder, n
            full += self.most is not None and n + 1 == self.most
            if self.authors is not None and full == len(self.authors):
                return


@dataclass
class Ranges(InputPartition):
    """Members of an archive by offset, or the whole of a compressed one."""

    path: str
    members: list[tuple[str, str, str, int, int, int]] | None

    def __post_init__(self) -> None:
        super().__init__(self.path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        names = lambda key, change=str: frozenset(change(x.strip()) for x in options[key].split(",")) if options.get(key) else None
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        most = options.get("perauthor")
        self.wanted = Wanted(options.get("root", "maildir"), names("authors"), names("folders", str.lower), int(most) if most else None)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take conditions on author and folder; Spark checks the others. With a cap per author the folders must not
        be narrowed (the cap counts members of the folders asked for), nor need authors beyond the condition be walked."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column == "author" and all(isinstance(v, str) for v in values):
                self.wanted.authors = frozenset(values if self.wanted.authors is None else self.wanted.authors & values)
            elif column == "folder" and self.wanted.most is None and all(isinstance(v, str) for v in values):
                self.wanted.folders = frozenset(values if self.wanted.folders is None else self.wanted.folders & values)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path):
            if not path.endswith(".tar"):
                out.append(Ranges(path, None))
                continue
            held, size = [], 0
            with opened(path) as file, tarfile.open(fileobj=file, mode="r:") as archive:
                for member, author, folder, place in self.wanted.walk(archive):
                    if held and size + member.size > self.split:
                        out.append(Ranges(path, held))
                        held, size = [], 0
                    held.append((member.name, author, folder, place, member.offset_data, member.size))
                    size += member.size
            if held:
                out.append(Ranges(path, held))
        return out or [Ranges(self.path, [])]

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "member", "author", "folder", "place", "text"])

        for name, author, folder, place, data in self._contents(part):
            rows.append((part.path, name, author, folder, place, data.decode("utf-8", "ignore")))
            size += len(data)
            if size >= 4 << 20 or len(rows) >= 2_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def _contents(self, part: Ranges) -> Iterator[tuple[str, str, str, int, bytes]]:
        if part.members is None:
            with opened(part.path, "stream") as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
                for member, author, folder, place in self.wanted.walk(archive):
                    yield member.name, author, folder, place, archive.extractfile(member).read()
        elif part.members:
            with opened(part.path) as file:
                for name, author, folder, place, at, size in part.members:
                    file.seek(at)
                    yield name, author, folder, place, file.read(size)


class MailArchive(DataSource):
    """Options: path, root (`maildir`), authors and folders (lists with commas), perAuthor (a cap), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "mail_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def mail_archive(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Members of the archives at `path`; for the options see `MailArchive`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailArchive)
    return spark.read.format("mail_archive").options(**options).load(path)


def write_archives(files: DataFrame, path: str, archive: str, member: str, text: str) -> DataFrame:
    """Write one tar file per value of `archive` (members in the order of `member`, nulls empty), as a stream by one task each; the names written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(at, recursive=True)
        name, out, tar, done = None, None, None, []

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()
                store.move(f"{at}/.{name}.part", f"{at}/{name}.tar")  # a task that runs again writes the same file
                done.append(name)

        for batch in batches:
            for own, inner, value in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name or tar is None:
                    close()
                    name, out = own, store.open_output_stream(f"{at}/.{own}.part")
                    tar = tarfile.open(fileobj=out, mode="w|")
                data = (value or "").encode()
                info = tarfile.TarInfo(inner)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    rows = files.select(F.col(archive).cast("string").alias("archive"), F.col(member).alias("member"), F.col(text).alias("text"))
    return rows.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(write, "archive string")
