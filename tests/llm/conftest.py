from __future__ import annotations

import pytest

from cohortlane.llm.frames import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Make a small documents table of (doc_id, text) pairs."""

    def make(*rows):
        full = [(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def table_dir(tmp_path_factory):
    """Write frames as the tables of a data folder."""

    def make(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, frame in frames.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return make
