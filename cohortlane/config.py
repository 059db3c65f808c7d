"""Where a study reads and writes, and the session settings it wants."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal


@dataclass(frozen=True)
class StudyCatalog:
    """Names of the three places a study works with.

    With ``layout="table"`` the names are catalog schemas (``spark.table``);
    with ``layout="parquet"`` they are folders holding one parquet dataset per
    table. ``result_suffix`` is appended to every result name.
    """

    cdm: str
    vocabulary: str
    results: str
    layout: Literal["table", "parquet"] = "table"
    result_suffix: str = ""

    def locate(self, area: str, name: str) -> str:
        separator = "." if self.layout == "table" else "/"
        return f"{area}{separator}{name}"

    def result_name(self, name: str) -> str:
        return self.locate(self.results, f"{name}{self.result_suffix}")


# Settings of the sessions this project starts itself (bench, tests). A session
# handed in by a caller is never changed.
SESSION_SETTINGS: dict[str, str] = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even if that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # buckets are written as one sorted file each: joins of stored tables need no sort
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}

# What to add on a cluster for about 2 TB per shuffle: 20,000 partitions of about
# 100 MB. Adaptive execution merges partitions that turn out smaller, but doesn't split
# larger ones (except of skewed joins): set the number to the largest shuffle's
# size divided by the advisory size. Also name a shared spark.checkpoint.dir.
CLUSTER_SETTINGS: dict[str, str] = {
    **SESSION_SETTINGS,
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}
