"""Members of tar archives as rows: archives are split by member, so that no archive is a single task."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, content binary, problem string"


def opened(path: str):
    """A seekable stream of a local path, or of a URI that Arrow's file systems know."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(name)


def listed(path: str) -> list[str]:
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if system.get_file_info(name).type == fs.FileType.File:
        return [path]
    found = [f.path for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".tar")]
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(f if "://" in f or not scheme else f"{scheme}{f}" for f in found)


class Members(InputPartition):
    def __init__(self, archive: str, members: list[tuple[str, int, int, str | None]]):
        self.archive, self.members = archive, members


class TarSource(DataSource):
    """``spark.read.format("tar").load(path)``: a row a regular file of an archive, or of all ``*.tar`` below a folder.

    The driver reads the headers alone, seeking over the contents; a partition is some
    consecutive members of about ``bytes`` together (32 MB), read by offset.  A member whose
    content is cut off, or an archive that goes on with a damaged header, is a row with its
    name (else the archive's) and a ``problem``; what stands before it is read.  Compressed
    archives cannot be split and are a problem too.
    """

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("bytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for archive in listed(self.path):
            held, size = [], 0
            for member in headers(archive):
                if held and size + member[2] > self.bytes:
                    out.append(Members(archive, held))
                    held, size = [], 0
                held.append(member)
                size += member[2]
            if held:
                out.append(Members(archive, held))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.members:
            return
        with opened(partition.archive) as stream:
            for name, offset, size, problem in partition.members:
                if problem:
                    yield partition.archive, name, None, problem
                    continue
                stream.seek(offset)
                yield partition.archive, name, stream.read(size), None


def headers(archive: str) -> Iterator[tuple[str, int, int, str | None]]:
    """``name, offset, size, problem`` of the regular files of an archive."""
    with opened(archive) as stream:
        total = stream.size()
        try:
            with tarfile.open(fileobj=_Stream(stream), mode="r:") as tar:
                for member in tar:
                    if member.isreg():
                        whole = member.offset_data + member.size <= total
                        yield member.name, member.offset_data, member.size if whole else 0, None if whole else "content is cut off"
                # Reading stops at what is no header: either the end, or damage.
                at = tar.offset
        except tarfile.TarError as error:
            yield os.path.basename(archive), 0, 0, f"damaged: {error}"
            return
        if at < total:
            stream.seek(at)
            block = stream.read(512)
            if block.strip(b"\0"):
                yield os.path.basename(archive), 0, 0, f"damaged: no header at byte {at}"


class _Stream(io.RawIOBase):
    """What ``tarfile`` needs of an Arrow stream."""

    def __init__(self, stream):
        self.stream = stream

    def read(self, n: int = -1) -> bytes:
        return self.stream.read(None if n < 0 else n)

    def seek(self, at: int, whence: int = 0) -> int:
        return self.stream.seek(at, whence)

    def tell(self) -> int:
        return self.stream.tell()


def read_archives(spark: SparkSession, path: str, bytes: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.read.format("tar").option("bytes", bytes).load(path)


def import_archives(spark: SparkSession, path: str, schema: str = "suite string, metric string, value double") -> tuple[DataFrame, DataFrame]:
    """Reports in the ``.json`` members of archives, each content once, and the members with a problem."""
    members = read_archives(spark, path)
    raw = members.where("problem IS NULL AND member LIKE '%.json'").select(F.sha2("content", 256).alias("sha256"), F.decode("content", "utf-8").alias("value")).dropDuplicates(["sha256"])
    rows = raw.select("sha256", F.explode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("line"))
    reports = rows.select("sha256", F.from_json("line", schema).alias("r")).select("sha256", "r.*")
    return reports, members.where("problem IS NOT NULL").select("archive", "member", "problem")


def write_markdown(metrics: DataFrame, path: str) -> None:
    """Reports ``suite, metric, value`` as Markdown: a folder a suite, in it parts of a table in the order of the metrics.

    The tables are sorted by range over all tasks; a suite's parts follow each other by name.
    """
    line = F.concat(F.lit("| "), F.replace("metric", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.coalesce(F.col("value").cast("string"), F.lit("n/a")), F.lit(" |"))
    rows = metrics.select("suite", "metric", line.alias("line")).repartitionByRange("suite", "metric").sortWithinPartitions("suite", "metric")
    rows.select("suite", "line").write.mode("overwrite").partitionBy("suite").text(path)
