"""A larger copy of a test-data folder: every table several times under new ids."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Ids that are shifted from copy to copy; tables without any stay as they are.
IDS = {
    "customer": ("c_custkey",),
    "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey",),
    "events": ("event_id", "user_id"),
}
SHIFT = 10_000_000


def scaled_copy(spark: SparkSession, sf_dir: str, target: str, copies: int) -> None:
    """Write the tables ``copies`` times over; a third of all events goes to one person."""
    for table in ("region", "nation", "supplier", "part", *IDS):
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if table in IDS:
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            moved = {c: F.col(c) + F.col("_copy").cast("long") * SHIFT for c in IDS[table]}
            if table == "events":
                moved["user_id"] = F.when(F.xxhash64("event_id", "_copy") % 3 == 0, F.lit(1).cast("long")).otherwise(
                    moved["user_id"]
                )
            df = df.withColumns(moved).drop("_copy")
        df.write.mode("overwrite").parquet(f"{target}/{table}.parquet")
