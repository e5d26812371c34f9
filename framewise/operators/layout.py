"""A table laid out once by a key, for many joins on that key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import removed, scratch_path

#: So few keys are looked up as literals, for which Spark opens only their buckets.
LITERALS = 1000


class ByKey:
    """``df`` in buckets of ``key``, sorted, in the shared folder, as a table of the session while it is used.

    A join on ``key`` moves only the other side. Where that side has few keys, only
    their buckets and in them only the row groups that can hold them are read.
    """

    def __init__(self, df: DataFrame, key: str, buckets: int | None = None):
        self.spark, self.key = df.sparkSession, key
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.name = scratch_path(self.spark, "by-key"), f"by_key_{uuid.uuid4().hex}"
        laid = df.repartition(self.buckets, key)  # one file a bucket
        laid.write.bucketBy(self.buckets, key).sortBy(key).option("path", self.path).saveAsTable(self.name)

    def __enter__(self) -> "ByKey":
        return self

    def __exit__(self, *_) -> None:
        """The table goes; what was read from it has to be written by then."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.path)

    def joined(self, other: DataFrame) -> DataFrame:
        """``other``, a stored table, joined with the rows of its keys."""
        rows = self.spark.table(self.name)
        few = [r[0] for r in other.select(self.key).distinct().limit(LITERALS + 1).collect()]
        if len(few) <= LITERALS:
            rows = rows.filter(F.col(self.key).isin([k for k in few if k is not None]))
        return other.join(rows, self.key)
