"""A Spark data source for ZIP archives: one row per member, contents read only when asked for.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archive").option("path", folder).option("contents", "json").load()

Partitions are contiguous ranges of members in the order of their place in the file, so a task reads forward; contents are read
for members of the named extensions only, which is how the bytes of videos are never touched.
"""

from __future__ import annotations

import glob
import hashlib
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenfold.functions.names import PHOTO_EXTS

MEMBERS = "zipkey string, zip_name string, member_idx long, member string, header_offset long, compress_size long, file_size long, crc32 long, is_dir boolean, content binary, sha256 binary, err string"


def zipkey(ident: str, size: int, modified: str) -> str:
    """Twelve hex digits that name one version of an archive."""
    return hashlib.sha256(f"{ident}|{size}|{modified}".encode()).hexdigest()[:12]


class Range(InputPartition):
    """A stretch of an archive: its entries with all that is needed to read them without the directory."""

    def __init__(self, path: str, key: str, entries: list[tuple]) -> None:
        self.path, self.key, self.entries = path, key, entries


class BadMember(ValueError):
    """A member that can't be read."""


def read_member(f: BinaryIO, offset: int, compressed: int, size: int, crc: int, method: int, flags: int) -> bytes:
    """The bytes of a stored or deflated member, from its local header on; raises BadMember for anything else."""
    if flags & 1 or method not in (0, 8):
        raise BadMember("encrypted or of another method")
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise BadMember("no local header")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(offset + 30 + name + extra)
    data = f.read(compressed)
    if len(data) < compressed:
        raise BadMember("cut off")
    try:
        out = data if method == 0 else zlib.decompressobj(-15).decompress(data, size + 1)
    except zlib.error as e:
        raise BadMember("damaged") from e
    if len(out) != size or zlib.crc32(out) != crc:
        raise BadMember("damaged")
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"].removeprefix("file://")
        self.paths = sorted(glob.glob(os.path.join(path, "*.zip"))) if os.path.isdir(path) else [path]
        if only := options.get("names"):
            self.paths = [p for p in self.paths if os.path.basename(p) in set(only.split("\n"))]
        self.per = int(options.get("membersPerPartition", "2000"))
        self.contents = {e.strip().lower() for e in options.get("contents", "").split(",") if e.strip()}
        self.most = int(options.get("maxMemberBytes", str(200 * 1024 * 1024)))

    def partitions(self) -> list[Range]:
        """The directory of each archive is read once; a task is given the entries of its stretch, in the order of their place."""
        out = []
        for p in self.paths:
            stat = os.stat(p)
            key = zipkey(os.path.abspath(p), stat.st_size, str(int(stat.st_mtime)))
            with zipfile.ZipFile(p) as z:
                entries = [(i, e.filename, e.header_offset, e.compress_size, e.file_size, e.CRC, e.compress_type, e.flag_bits, e.is_dir()) for i, e in enumerate(z.infolist())]
            entries.sort(key=lambda e: (e[2], e[0]))
            out += [Range(p, key, entries[a : a + self.per]) for a in range(0, max(len(entries), 1), self.per)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            for i, name, offset, compressed, size, crc, method, flags, is_dir in part.entries:
                content, err = None, None
                wanted = name.rpartition(".")[2].lower() in self.contents and not is_dir
                if wanted and size > self.most:
                    err = "TooLarge"
                elif wanted:
                    try:
                        content = read_member(f, offset, compressed, size, crc, method, flags)
                    except (BadMember, OSError) as x:
                        err = type(x).__name__  # a member that can't be read is a row, not a failed task
                digest = hashlib.sha256(content).digest() if content is not None else None
                yield (part.key, os.path.basename(part.path), i, name, offset, compressed, size, crc, is_dir, content, digest, err)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark, path: str, contents: str = "json", members_per_partition: int = 2000, names: list[str] | None = None) -> DataFrame:
    """The members of a file or of the archives of a folder, all or those of the given file names."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("path", path).option("names", "\n".join(names or [])).option("contents", contents).option("membersPerPartition", str(members_per_partition)).load()


def plan_shards(members: DataFrame, photos_per_shard: int, order: tuple[str, ...] = ("member_idx",), ext: str = "ext") -> DataFrame:
    """Add shard to the members of each archive: a new one at every photos_per_shard-th photo, the last takes the rest.

    One window for each archive; an archive is one file on one disk, so its directory is bounded.
    """
    w = Window.partitionBy("zipkey").orderBy(*order)
    photo = F.col(ext).isin(*PHOTO_EXTS).cast("int")
    nth = F.sum(photo).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(photo).over(Window.partitionBy("zipkey"))
    shards = F.greatest(F.floor(total / photos_per_shard), F.lit(1))
    return members.withColumn("shard", F.least(F.greatest(F.floor((nth - 1) / photos_per_shard), F.lit(0)), shards - 1).cast("long"))
