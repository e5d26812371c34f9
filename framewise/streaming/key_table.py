"""A table of keys seen so far, made for lookups that cost what is looked up.

Every batch adds its keys as one folder. Folders are merged ``FAN`` at a time into
one of the next level, so that few are live whatever the number of batches: a
key is rewritten once per level. In a folder the keys lie in files by their leading
bits, sorted, ``KEYS_PER_FILE`` to a file and with a Bloom filter in each. A lookup
opens only files whose bits occur among the keys it asks for: at most one a key and folder.

A folder's name says what it holds (``writer=…/level-first-last-bits``), and it counts only when its
success marker is there and no live folder of a higher level covers it. So a crash at any point leaves
a table that reads the same, and adding or merging again is harmless.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of one level that are merged into one.
FAN = 8
KEYS_PER_FILE = 1 << 20
#: Leading bits of a key that files are told apart by, at most.
BITS = 16
#: So many keys are looked up as literals, for which Parquet skips row groups by their Bloom filters.
LITERALS = 1024
SCHEMA = "key string, writer string, batch bigint"
_NAME = re.compile(r"^(\d+)-(\d+)-(\d+)-(\d+)$")


@dataclass(frozen=True, order=True)
class Folder:
    writer: str
    level: int
    first: int
    last: int
    bits: int

    @property
    def place(self) -> str:
        return f"writer={self.writer}/{self.level}-{self.first}-{self.last}-{self.bits}"

    def covers(self, other: "Folder") -> bool:
        return self.writer == other.writer and self.level > other.level and self.first <= other.first and other.last <= self.last


class KeyTable:
    """Keys are hexadecimal digests; each row says which batch of which writer brought it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []

    def folders(self, writer: str | None = None) -> list[Folder]:
        """All live folders, or those of one writer."""
        found = []
        for name in self._names(self.path):
            own = name.removeprefix("writer=")
            if own == name or writer not in (None, own):
                continue
            for folder in self._names(f"{self.path}/{name}"):
                if (m := _NAME.match(folder)) and self._files.exists(self._path(f"{self.path}/{name}/{folder}/_SUCCESS")):
                    found.append(Folder(own, *map(int, m.groups())))
        return sorted(f for f in found if not any(other.covers(f) for other in found))

    def _drop(self, folders: list[Folder]) -> None:
        for f in folders:
            self._files.delete(self._path(f"{self.path}/{f.place}"), True)

    def _write(self, rows: DataFrame, writer: str, level: int, first: int, last: int) -> None:
        """One folder, its files by as many leading bits as the number of rows needs."""
        bits = min(BITS, max(0, (rows.count() - 1) // KEYS_PER_FILE).bit_length())
        place = f"{self.path}/{Folder(writer, level, first, last, bits).place}"
        rows = rows.select("key", "writer", "batch", F.shiftright(_leading(), BITS - bits).alias("bits"))
        laid = rows.repartition(1 << bits, "bits") if bits else rows.coalesce(1)
        laid = laid.sortWithinPartitions("bits", "key").write.mode("overwrite").partitionBy("bits")
        laid = laid.option("parquet.bloom.filter.enabled#key", "true")
        laid.option("parquet.bloom.filter.expected.ndv#key", str(KEYS_PER_FILE)).parquet(place)

    def add(self, keys: DataFrame, writer: str, batch: int) -> None:
        """Store ``keys`` (column key) as those of this batch, in place of what it stored before."""
        self._drop([f for f in self.folders(writer) if f.level == 0 and f.first == batch])
        rows = keys.select("key", F.lit(writer).alias("writer"), F.lit(batch).cast("bigint").alias("batch"))
        self._write(rows, writer, 0, batch, batch)

    def compact(self, writer: str, before: int) -> None:
        """Merge full levels of ``writer``; batches from ``before`` on, which may be added again, are left alone."""
        level = 0
        while own := [f for f in self.folders(writer) if f.level >= level]:
            here = [f for f in own if f.level == level and f.last < before]
            for k in range(0, len(here) - FAN + 1, FAN):
                some = here[k : k + FAN]
                self._write(self._rows(self._files_of(some, None)), writer, level + 1, some[0].first, some[-1].last)
                self._drop(some)
            level += 1

    def _files_of(self, folders: list[Folder], wanted: list[int] | None) -> list[str]:
        """The directories that can hold a key with one of the leading ``BITS`` bits ``wanted``."""
        out = []
        for f in folders:
            fits = None if wanted is None else {w >> BITS - f.bits for w in wanted}
            for name in self._names(f"{self.path}/{f.place}"):
                if name.startswith("bits=") and (fits is None or int(name.removeprefix("bits=")) in fits):
                    out.append(f"{self.path}/{f.place}/{name}")
        return out

    def _rows(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """key, writer, batch of rows that can hold one of ``keys`` (column key; read twice)."""
        wanted = [r[0] for r in keys.select(_leading()).distinct().collect()]  # 2 ** BITS numbers at most
        rows = self._rows(self._files_of(self.folders(), wanted))
        few = [r[0] for r in keys.select("key").limit(LITERALS + 1).collect()]
        return rows.filter(F.col("key").isin(few)) if len(few) <= LITERALS else rows


def _leading():
    return F.conv(F.substring("key", 1, BITS // 4), 16, 10).cast("int")
