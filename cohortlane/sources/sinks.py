"""Writers: result tables, CSV exports and staged intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlane.config import StudyCatalog
from cohortlane.sources.tables import read_result

_local_stage_roots: dict[str, str] = {}


def write_result(
    df: DataFrame, catalog: StudyCatalog, name: str, bucket_by: tuple[int, str] | None = None
) -> None:
    """Replace a result table.

    ``bucket_by=(n, column)`` stores a catalog table in n buckets, each one file
    sorted by the column. Tables bucketed by ``person_id`` need no shuffle for
    the per-person steps, and stored index, person and event tables join without
    a sort either (with the session's ``bucketedTableScan.outputOrdering``). A
    table where single persons own a large part of the rows is better left
    unbucketed.
    """
    if bucket_by is not None and catalog.layout != "table":
        raise ValueError("only catalog tables can be bucketed: use layout='table'")
    if bucket_by is None:
        writer = df.write.mode("overwrite").format("parquet")
    else:
        n, column = bucket_by
        # a sort order holds for a bucket only if it is one file
        writer = df.repartition(n, column).write.mode("overwrite").format("parquet")
        writer = writer.bucketBy(n, column).sortBy(column)
    if catalog.layout == "table":
        writer.saveAsTable(catalog.result_name(name))
    else:
        writer.save(catalog.result_name(name))


def materialize(df: DataFrame, catalog: StudyCatalog, name: str) -> DataFrame:
    """Write a result and go on from the stored copy (cuts the plan)."""
    write_result(df, catalog, name)
    return read_result(df.sparkSession, catalog, name)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Export as CSV. ``single_file`` is for report-sized results only."""
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def stage_root(spark: SparkSession) -> str:
    """Shared scratch folder: the session's checkpoint folder.

    A cluster has to name one, since a machine-local folder would be lost with
    its machine. Only a local session falls back to a temporary folder, which
    goes with the process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    # set by SparkContext.setCheckpointDir
    named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    application = spark.sparkContext.applicationId
    if application not in _local_stage_roots:
        folder = tempfile.mkdtemp(prefix="cohortlane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_stage_roots[application] = folder
    return _local_stage_roots[application]


def stage_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared scratch folder."""
    return f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the shared scratch folder and read it back.

    Unlike a cached frame it survives the loss of executors, and unlike a
    row checkpoint it is columnar and has a known size. The copy is left for
    the owner of the folder to clear, as checkpoints are.
    """
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
