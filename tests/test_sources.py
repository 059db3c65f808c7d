"""Readers and writers."""

from datetime import date

import pytest

from cohortlane.config import StudyCatalog
from cohortlane.sources import (
    cdm_table,
    get_result,
    materialize,
    read_codeset,
    read_notes,
    read_result,
    read_result_csv,
    stage,
    vocabulary_table,
    write_csv,
    write_result,
)
from cohortlane.sources.sinks import stage_root


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_codeset_unquoted_with_extras(spark, tmp_path):
    path = write(
        tmp_path / "dx.csv",
        "concept_id,concept_name,concept_code,vocabulary_id,ancestor_concept_id,ancestor_concept_name\n"
        '1,Fever,0086U,CPT4,5,Heat\n2,"Shock, toxic",90.52,ICD9Proc,0,NA\n',
    )
    df = read_codeset(spark, path)
    assert dict(df.dtypes)["concept_id"] == "bigint"
    assert [tuple(r) for r in df.orderBy("concept_id").collect()] == [
        (1, "Fever", "0086U", "CPT4", "5", "Heat"),
        (2, "Shock, toxic", "90.52", "ICD9Proc", "0", None),
    ]


def test_codeset_is_read_by_header_name(spark, tmp_path):
    path = write(
        tmp_path / "lab.csv",
        '"concept_id","concept_code","concept_name","vocabulary_id"\n"7","600-7","Culture ""aerobic""","LOINC"\n',
    )
    assert read_codeset(spark, path).first().asDict() == {
        "concept_id": 7, "concept_name": 'Culture "aerobic"', "concept_code": "600-7", "vocabulary_id": "LOINC",
    }


def test_codeset_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "b.csv", "﻿concept_id,codeset,type\n1,v1,invasive\n")
    df = read_codeset(spark, path)
    assert df.columns == ["concept_id", "concept_name", "concept_code", "vocabulary_id", "codeset", "type"]
    assert df.first().concept_id == 1


def test_codeset_needs_concept_ids(spark, tmp_path):
    with pytest.raises(ValueError, match="concept_id"):
        read_codeset(spark, write(tmp_path / "x.csv", "a,b\n1,2\n"))


def test_notes(spark, tmp_path):
    path = write(
        tmp_path / "notes.csv",
        '﻿Component Name (17 Elements),Organ System,Details-8\nRatio,Lungs,"worst, in 24 hrs"\nINR,Blood,x',
    )
    df = read_notes(spark, path)
    assert df.columns == ["component_name_17_elements", "organ_system", "details_8"]
    assert [r.details_8 for r in df.collect()] == ["worst, in 24 hrs", "x"]


@pytest.fixture
def catalog(tmp_path):
    def area(name):
        return str(tmp_path / name)

    return StudyCatalog(area("cdm"), area("vocabulary"), area("results"), "parquet", "_v1")


def test_parquet_tables(spark, catalog):
    raw = spark.createDataFrame(
        [(1, 2, "2020-01-05", 3, 4, "x")],
        "person_id int, drug_concept_id long, drug_exposure_start_date string,"
        " visit_occurrence_id long, quantity long, note string",
    )
    raw.write.parquet(catalog.locate(catalog.cdm, "drug_exposure"))
    df = cdm_table(spark, catalog, "drug_exposure")
    assert dict(df.dtypes) == {
        "person_id": "bigint", "drug_concept_id": "bigint", "drug_exposure_start_date": "date",
        "visit_occurrence_id": "bigint",
    }
    assert df.first().drug_exposure_start_date == date(2020, 1, 5)
    raw.drop("person_id").write.parquet(catalog.locate(catalog.cdm, "person"))
    with pytest.raises(ValueError, match="person_id"):
        cdm_table(spark, catalog, "person")


def test_vocabulary(spark, catalog):
    spark.createDataFrame([(1, "a")], "concept_id int, concept_name string").write.parquet(
        catalog.locate(catalog.vocabulary, "concept")
    )
    assert vocabulary_table(spark, catalog).dtypes == [("concept_id", "bigint"), ("concept_name", "string")]


def test_results_are_replaced_and_reread(spark, catalog):
    write_result(spark.range(5), catalog, "cohort")
    stored = materialize(spark.range(3), catalog, "cohort")
    assert stored.count() == read_result(spark, catalog, "cohort").count() == 3
    assert catalog.result_name("cohort").endswith("results/cohort_v1")


def test_results_in_a_schema(spark):
    spark.sql("create schema if not exists study_results")
    catalog = StudyCatalog("cdm", "vocabulary", "study_results")
    assert materialize(spark.range(4), catalog, "cohort").count() == 4
    spark.sql("drop schema study_results cascade")


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice'), (2, None)], "n long, text string")
    path = str(tmp_path / "out")
    write_csv(df, path, single_file=True)
    back = read_result_csv(spark, path, "n long, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_result_from_table_or_export(spark, catalog, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n long, text string")
    write_result(df, catalog, "r")
    write_csv(df, str(tmp_path / "r.csv"))
    assert get_result(spark, catalog, "r").collect() == df.collect()
    exported = get_result(spark, catalog, "r", str(tmp_path))
    assert [tuple(r) for r in exported.collect()] == [("1", "a")]


def test_stage_uses_the_checkpoint_folder(spark):
    assert stage_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    staged = stage(spark.range(10).withColumnRenamed("id", "n"), "numbers")
    assert staged.count() == 10
    assert stage_root(spark) in staged.inputFiles()[0]


def test_only_catalog_tables_are_bucketed(spark, tmp_path):
    catalog = StudyCatalog("cdm", "vocabulary", str(tmp_path), layout="parquet")
    with pytest.raises(ValueError, match="bucketed"):
        write_result(spark.range(1), catalog, "x", bucket_by=(2, "id"))


def test_code_sets_are_read_by_line_unless_told_otherwise(spark, tmp_path):
    (tmp_path / "codes.csv").write_text('concept_id,concept_name\n1,"two\nlines"\n')
    assert read_codeset(spark, str(tmp_path / "codes.csv"), multi_line=True).count() == 1
    (tmp_path / "plain.csv").write_text("concept_name,concept_id\na,1\nb,2\n")
    assert read_codeset(spark, str(tmp_path / "plain.csv")).count() == 2
