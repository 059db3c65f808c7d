"""Column contracts of the clinical tables and code sets.

Every table is described by the columns the operators touch. ``core`` columns
must be present; ``optional`` ones are picked up when the table has them.
Concept ids are ``bigint`` throughout so that no join needs a cast, and concept
codes stay text ("0086U", "90.52", "600-7" are not numbers).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableContract:
    core: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)


CDM_TABLES: dict[str, TableContract] = {
    "person": TableContract({
        "person_id": "bigint",
        "site": "string",
        "birth_date": "date",
        "gender_concept_id": "bigint",
        "race_concept_id": "bigint",
        "ethnicity_concept_id": "bigint",
    }),
    "visit_occurrence": TableContract(
        {
            "visit_occurrence_id": "bigint",
            "person_id": "bigint",
            "visit_start_date": "date",
            "visit_end_date": "date",
            "site": "string",
        },
        {
            "visit_start_datetime": "timestamp_ntz",
            "visit_end_datetime": "timestamp_ntz",
            "visit_concept_id": "bigint",
            "visit_concept_name": "string",
            "visit_start_age_in_months": "double",
            "preceding_visit_occurrence_id": "bigint",
        },
    ),
    "adt_occurrence": TableContract(
        {
            "person_id": "bigint",
            "visit_occurrence_id": "bigint",
            "service_concept_id": "bigint",
            "adt_type_concept_id": "bigint",
            "adt_date": "date",
        },
        {
            "adt_occurrence_id": "bigint",
            "adt_datetime": "timestamp_ntz",
            "site": "string",
        },
    ),
    "condition_occurrence": TableContract({
        "condition_occurrence_id": "bigint",
        "person_id": "bigint",
        "condition_concept_id": "bigint",
        "condition_source_concept_id": "bigint",
        "condition_start_date": "date",
        "site": "string",
    }),
    "procedure_occurrence": TableContract(
        {
            "person_id": "bigint",
            "procedure_concept_id": "bigint",
            "procedure_date": "date",
            "site": "string",
        },
        {"procedure_datetime": "timestamp_ntz", "visit_occurrence_id": "bigint"},
    ),
    "measurement_labs": TableContract(
        {
            "person_id": "bigint",
            "measurement_concept_id": "bigint",
            "measurement_date": "date",
            "site": "string",
        },
        {"measurement_datetime": "timestamp_ntz", "visit_occurrence_id": "bigint"},
    ),
    "drug_exposure": TableContract(
        {
            "person_id": "bigint",
            "drug_concept_id": "bigint",
            "drug_exposure_start_date": "date",
        },
        {
            "site": "string",
            "drug_exposure_start_datetime": "timestamp_ntz",
            "visit_occurrence_id": "bigint",
        },
    ),
    "fact_relationship": TableContract({"fact_id_1": "bigint", "fact_id_2": "bigint"}),
}

VOCABULARY_TABLES: dict[str, TableContract] = {
    "concept": TableContract(
        {"concept_id": "bigint", "concept_name": "string"},
        {"concept_code": "string", "vocabulary_id": "string"},
    ),
}

CODESET_COLUMNS: dict[str, str] = {
    "concept_id": "bigint",
    "concept_name": "string",
    "concept_code": "string",
    "vocabulary_id": "string",
}
