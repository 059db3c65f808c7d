from cohortlane.sources.codesets import read_codeset, read_notes
from cohortlane.sources.sinks import materialize, stage, stage_path, write_csv, write_result
from cohortlane.sources.tables import (
    cdm_table,
    conform,
    get_result,
    read_result,
    read_result_csv,
    vocabulary_table,
)

__all__ = [
    "cdm_table",
    "conform",
    "get_result",
    "materialize",
    "read_codeset",
    "read_notes",
    "read_result",
    "read_result_csv",
    "stage",
    "stage_path",
    "vocabulary_table",
    "write_csv",
    "write_result",
]
