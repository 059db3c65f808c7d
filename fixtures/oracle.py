"""The same queries as DuckDB SQL, written the long way round.

Views are common table expressions; each query pulls in those it needs. The
queries follow the definitions literally (anti joins, full joins, one query per
variable), unlike the Spark plans.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["person"] = """
SELECT CAST(c_custkey AS BIGINT) AS person_id, lower(r_name) AS site,
  DATE '2024-01-15' - CAST((c_custkey * 617) % 8000 AS INTEGER) AS birth_date,
  CAST(CASE WHEN c_custkey % 10 <= 4 THEN 8532 WHEN c_custkey % 10 <= 8 THEN 8507 ELSE 0 END AS BIGINT) AS gender_concept_id,
  CAST(CASE c_custkey % 11 WHEN 0 THEN 8527 WHEN 1 THEN 38003615 WHEN 2 THEN 8516 WHEN 3 THEN 8515
    WHEN 4 THEN 8657 WHEN 5 THEN 8557 WHEN 6 THEN 44814659 WHEN 7 THEN 44814650 WHEN 8 THEN 44814653
    WHEN 9 THEN 0 END AS BIGINT) AS race_concept_id,
  CAST(CASE c_nationkey % 5 WHEN 0 THEN 38003563 WHEN 1 THEN 38003564 WHEN 2 THEN 38003564
    WHEN 3 THEN 44814660 ELSE 0 END AS BIGINT) AS ethnicity_concept_id
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
CTES["person_star"] = """
SELECT person_id, site, DATE '2001-08-01' - CAST((person_id * 617) % 8000 AS INTEGER) AS birth_date,
  gender_concept_id, race_concept_id, ethnicity_concept_id FROM person
"""
CTES["ev"] = """
SELECT event_id, CAST(user_id AS BIGINT) AS person_id, ts, CAST(ts AS DATE) AS d, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) % 50 AS v50,
  CAST(user_id * 100 + day(ts) AS BIGINT) AS visit_occurrence_id
FROM events
"""
CTES["ev_site"] = "SELECT ev.*, person.site FROM ev JOIN person ON ev.person_id = person.person_id"
CTES["visit_occurrence"] = """
SELECT visit_occurrence_id, person_id, min(site) AS site, min(d) AS visit_start_date, max(d) AS visit_end_date,
  min(ts) AS visit_start_datetime, max(ts) AS visit_end_datetime
FROM ev_site GROUP BY visit_occurrence_id, person_id
"""
CTES["adt_occurrence"] = """
SELECT event_id AS adt_occurrence_id, person_id, site, visit_occurrence_id, ts AS adt_datetime, d AS adt_date,
  CAST(CASE WHEN value >= 20 THEN 2000000078 ELSE 2000000079 END AS BIGINT) AS service_concept_id,
  CAST(CASE event_type WHEN 'signup' THEN 2000000083 WHEN 'click' THEN 2000000085 WHEN 'error' THEN 2000000084
    WHEN 'purchase' THEN 2000000086 WHEN 'view' THEN 2000000087 END AS BIGINT) AS adt_type_concept_id
FROM ev_site
"""
CTES["condition_occurrence"] = """
SELECT event_id AS condition_occurrence_id, person_id, site, v50 AS condition_concept_id,
  k AS condition_source_concept_id, d AS condition_start_date FROM ev_site WHERE event_type = 'error'
"""
CTES["procedure_occurrence"] = """
SELECT event_id AS procedure_occurrence_id, person_id, site, k AS procedure_concept_id, d AS procedure_date
FROM ev_site WHERE event_type = 'purchase'
"""
CTES["measurement_labs"] = """
SELECT event_id AS measurement_id, person_id, site, k AS measurement_concept_id, d AS measurement_date
FROM ev_site WHERE event_type = 'click'
"""
CTES["drug_exposure"] = """
SELECT event_id AS drug_exposure_id, person_id, site, k AS drug_concept_id, d AS drug_exposure_start_date
FROM ev_site WHERE event_type = 'view'
"""
CTES["concept"] = """
SELECT p_partkey AS concept_id, p_name AS concept_name, p_brand AS concept_code, p_type AS vocabulary_id FROM part
"""
CTES["dx_sepsis"] = "SELECT * FROM concept WHERE concept_id BETWEEN 0 AND 4"
CTES["px_blood_culture"] = "SELECT * FROM concept WHERE concept_id BETWEEN 0 AND 9"
CTES["lab_blood_culture"] = "SELECT * FROM concept WHERE concept_id BETWEEN 0 AND 9"
CTES["iv_fluids"] = "SELECT * FROM concept WHERE concept_id BETWEEN 0 AND 29"
CTES["med_broad_spec_abx"] = "SELECT * FROM concept WHERE concept_id BETWEEN 20 AND 59"

CTES["visit_star"] = """
SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, o_orderdate AS visit_start_datetime,
  CAST(o_orderdate AS DATE) AS visit_start_date,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 9203 WHEN '2-HIGH' THEN 9201 WHEN '3-MEDIUM' THEN 2000000048
    WHEN '4-NOT SPECIFIED' THEN 2000000088 WHEN '5-LOW' THEN 9202 END AS BIGINT) AS visit_concept_id,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS preceding_visit_occurrence_id,
  lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following_visit_occurrence_id
FROM orders
"""
CTES["fact_relationship"] = """
SELECT visit_occurrence_id AS fact_id_1, following_visit_occurrence_id AS fact_id_2
FROM visit_star WHERE following_visit_occurrence_id IS NOT NULL
"""
CTES["clinical_star"] = """
SELECT l_orderkey AS visit_occurrence_id, o_custkey AS person_id, l_shipdate AS event_datetime,
  CAST(l_partkey % 100 AS BIGINT) AS concept_id,
  CASE l_returnflag WHEN 'A' THEN 'procedure' WHEN 'R' THEN 'measurement' WHEN 'N' THEN 'drug' END AS domain
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# Cohorts. {any} variants accept every sex.

_AGE = "CAST(date_diff('day', {b}, {d}) AS DOUBLE) / CAST(365.25 AS DOUBLE)"


def _age(birth: str, at: str) -> str:
    return _AGE.format(b=birth, d=at)


CTES["picu"] = """
SELECT a.*, v.visit_start_date, v.visit_end_date, p.birth_date
FROM adt_occurrence a
LEFT JOIN visit_occurrence v ON a.visit_occurrence_id = v.visit_occurrence_id
LEFT JOIN person p ON a.person_id = p.person_id
WHERE a.service_concept_id = 2000000078
"""
CTES["picu_adt"] = """
SELECT * FROM picu WHERE adt_date >= DATE '2024-01-01' AND adt_date <= DATE '2024-01-28'
  AND adt_type_concept_id IN (2000000083, 2000000085)
"""
CTES["picu_visit"] = """
SELECT * FROM picu WHERE visit_start_date >= DATE '2024-01-01' AND visit_start_date <= DATE '2024-01-28'
"""
for _source, _date in (("adt", "adt_date"), ("visit", "visit_start_date")):
    CTES[f"under18_any_{_source}"] = f"""
SELECT * FROM (SELECT DISTINCT person_id, birth_date, {_date}, {_age('birth_date', _date)} AS age FROM picu_{_source}) x
WHERE age >= 0 AND age < 18
"""
    CTES[f"under18_{_source}"] = f"""
SELECT u.person_id, u.birth_date, u.{_date}, u.age, p.gender_concept_id
FROM under18_any_{_source} u LEFT JOIN person p ON u.person_id = p.person_id
WHERE p.gender_concept_id IN (8507, 8532)
"""


def _near(event: str, index: str, pre: int, post: int) -> str:
    return (
        f"date_diff('day', {index}, {event}) <= {post} AND date_diff('day', {event}, {index}) <= {pre}"
    )


def _condition(cohort: str, date: str, days: int) -> str:
    near = _near("c.condition_start_date", f"x.{date}", days, days)
    return f"""
SELECT person_id, min(dt) AS min_date, max(dt) AS max_date, count(*) AS n_dates FROM (
  SELECT coalesce(s.person_id, r.person_id) AS person_id, coalesce(s.dt, r.dt) AS dt FROM (
    SELECT DISTINCT c.person_id, x.{date} AS dt FROM condition_occurrence c
    JOIN (SELECT DISTINCT concept_id FROM dx_sepsis) k ON c.condition_concept_id = k.concept_id
    JOIN {cohort} x ON c.person_id = x.person_id WHERE {near}) s
  FULL JOIN (
    SELECT DISTINCT c.person_id, x.{date} AS dt FROM condition_occurrence c
    JOIN (SELECT DISTINCT concept_id FROM dx_sepsis) k ON c.condition_source_concept_id = k.concept_id
    JOIN {cohort} x ON c.person_id = x.person_id
    WHERE {near} AND NOT EXISTS (
      SELECT 1 FROM condition_occurrence c2
      JOIN (SELECT DISTINCT concept_id FROM dx_sepsis) k2 ON c2.condition_concept_id = k2.concept_id
      JOIN {cohort} x2 ON c2.person_id = x2.person_id
      WHERE {near.replace('c.', 'c2.').replace('x.', 'x2.')}
        AND c2.condition_occurrence_id = c.condition_occurrence_id)) r
  ON s.person_id = r.person_id AND s.dt = r.dt) u
GROUP BY person_id
"""


_DOMAINS = {
    "px": ("procedure_occurrence", "procedure_concept_id", "procedure_date", "px_blood_culture"),
    "lab": ("measurement_labs", "measurement_concept_id", "measurement_date", "lab_blood_culture"),
    "iv": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date", "iv_fluids"),
    "abx": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date", "med_broad_spec_abx"),
}


def _keys_near(domain: str, cohort: str, date: str, days: int) -> str:
    table, concept, event_date, codes = _DOMAINS[domain]
    return f"""SELECT DISTINCT e.person_id, x.{date} AS dt FROM {table} e
  JOIN (SELECT DISTINCT concept_id FROM {codes}) k ON e.{concept} = k.concept_id
  JOIN {cohort} x ON e.person_id = x.person_id WHERE {_near('e.' + event_date, 'x.' + date, days, days)}"""


def _suspected(cohort: str, date: str, days: int) -> str:
    near = {d: _keys_near(d, cohort, date, days) for d in _DOMAINS}
    return f"""
SELECT person_id, min(dt) AS min_date, max(dt) AS max_date, count(*) AS n_dates FROM (
  SELECT c.person_id, c.dt FROM (
    SELECT coalesce(p.person_id, l.person_id) AS person_id, coalesce(p.dt, l.dt) AS dt
    FROM ({near['px']}) p FULL JOIN ({near['lab']}) l ON p.person_id = l.person_id AND p.dt = l.dt) c
  JOIN ({near['iv']}) f ON c.person_id = f.person_id AND c.dt = f.dt
  JOIN ({near['abx']}) b ON c.person_id = b.person_id AND c.dt = b.dt) u
GROUP BY person_id
"""


for _source, _date in (("adt", "adt_date"), ("visit", "visit_start_date")):
    for _prefix in ("", "any_"):
        CTES[f"coded_{_prefix}{_source}"] = _condition(f"under18_{_prefix}{_source}", _date, 7)
        CTES[f"suspected_{_prefix}{_source}"] = _suspected(f"under18_{_prefix}{_source}", _date, 7)


def _demographics(cohort: str, date: str, person: str = "person", keep: str = "x.*") -> str:
    return f"""
SELECT *, CASE WHEN age < 1 THEN '<1' WHEN age < 5 THEN '01 to 04' WHEN age < 10 THEN '05 to 09'
    WHEN age < 14 THEN '10 to 13' WHEN age < 18 THEN '14 to 17' ELSE 'Old or Unknown' END AS age_group
FROM (
SELECT {keep}, p.site, p.birth_date, p.gender_concept_id, p.race_concept_id, p.ethnicity_concept_id,
  {_age('p.birth_date', 'x.' + date)} AS age,
  CASE WHEN p.gender_concept_id = 8532 THEN 'Female' WHEN p.gender_concept_id = 8507 THEN 'Male'
    ELSE 'Other/unknown/ambiguous' END AS sex_cat,
  CASE WHEN p.ethnicity_concept_id = 38003563 THEN 'Hispanic'
    WHEN p.ethnicity_concept_id = 38003564 AND p.race_concept_id IN (8527, 38003615) THEN 'NH_White_or_Middle_Eastern_North_African'
    WHEN p.ethnicity_concept_id = 38003564 AND p.race_concept_id = 8516 THEN 'NH_Black/AA'
    WHEN p.ethnicity_concept_id = 38003564 AND p.race_concept_id = 8515 THEN 'NH_Asian'
    WHEN p.ethnicity_concept_id = 38003564 AND p.race_concept_id IN (44814659, 8657, 8557) THEN 'NH_Multiple_or_AI_AN_NH_OPI'
    ELSE 'Other/Unknown' END AS raceth_cat,
  CASE WHEN p.ethnicity_concept_id = 38003563 THEN 'Hispanic' WHEN p.ethnicity_concept_id = 38003564 THEN 'Not_Hispanic'
    WHEN p.ethnicity_concept_id IN (44814660, 44814649, 44814650, 44814653) THEN 'Refuse_Other_Unknown'
    ELSE 'Other/Unknown' END AS eth_cat,
  CASE WHEN p.race_concept_id IN (8527, 38003615) THEN 'White_or_Middle_Eastern_North_African'
    WHEN p.race_concept_id = 8516 THEN 'Black' WHEN p.race_concept_id = 8515 THEN 'Asian'
    WHEN p.race_concept_id = 8657 THEN 'American_Indian_Alaska_Native'
    WHEN p.race_concept_id = 8557 THEN 'Native_Hawaiian_Other_PI'
    WHEN p.race_concept_id = 44814659 THEN 'Multiple_Race'
    WHEN p.race_concept_id IN (44814650, 44814653, 44814649, 44814660) THEN 'Unknown_Other_Refuse' END AS race_cat,
  CASE WHEN p.ethnicity_concept_id = 38003563 THEN 'Hispanic' ELSE 'Not_Hispanic/Other/Unknown' END AS eth_cat2,
  CASE WHEN p.race_concept_id IN (8527, 38003615) THEN 'White_or_Middle_Eastern_North_African'
    WHEN p.race_concept_id = 8516 THEN 'Black_or_African_American' WHEN p.race_concept_id = 8515 THEN 'Asian'
    WHEN p.race_concept_id IN (8657, 8557, 44814659) THEN 'Multiple_or_AI_AN_or_NH_OPI'
    WHEN p.race_concept_id IN (44814650, 44814653, 44814649, 44814660) THEN 'Unknown_Other_Refuse' END AS race_cat2
FROM {cohort} x LEFT JOIN {person} p ON x.person_id = p.person_id) y
"""


for _source in ("adt", "visit"):
    for _prefix in ("", "any_"):
        for _kind in ("coded", "suspected"):
            CTES[f"{_kind}_{_prefix}{_source}_demog"] = _demographics(
                f"{_kind}_{_prefix}{_source}", "max_date"
            )
CTES["coded_adt_known"] = "SELECT * FROM coded_adt_demog WHERE sex_cat IN ('Male', 'Female')"
CTES["suspected_adt_known"] = "SELECT * FROM suspected_adt_demog WHERE sex_cat IN ('Male', 'Female')"
CTES["confirmed_adt_known"] = """
SELECT c.* FROM coded_adt_demog c JOIN (SELECT DISTINCT person_id FROM suspected_adt_demog) s ON c.person_id = s.person_id
WHERE c.sex_cat IN ('Male', 'Female')
"""
CTES["index_adt_demog"] = _demographics(
    "under18_adt", "adt_date", keep="x.person_id, x.adt_date"
)
for _cohort in ("coded", "suspected", "confirmed"):
    CTES[f"{_cohort}_adt_subset"] = (
        f"SELECT * FROM {_cohort}_adt_known WHERE site IN ('asia', 'europe')"
    )


def _summary(cohort: str, variables=("site", "race_cat2", "eth_cat2", "sex_cat", "age_group")) -> str:
    total = f"(SELECT count(DISTINCT person_id) FROM {cohort})"
    parts = [
        f"SELECT 'Total' AS variable, 'Total' AS category, {total} AS n_patients, "
        f"round(CAST(100 * {total} AS DOUBLE) / {total}, 2) AS percent_of_total"
    ]
    parts += [
        f"SELECT '{v}', {v}, count(*), round(CAST(100 * count(*) AS DOUBLE) / {total}, 2) FROM {cohort} GROUP BY {v}"
        for v in variables
    ]
    return "\nUNION ALL\n".join(parts)


def _labelled(cohort: str, variables=("site", "race_cat2", "eth_cat2", "sex_cat", "age_group")) -> str:
    return f"""
SELECT CASE variable WHEN 'site' THEN 'Site' WHEN 'raceth_cat' THEN 'Race/Ethnicity' WHEN 'race_cat2' THEN 'Race'
    WHEN 'eth_cat2' THEN 'Ethnicity' WHEN 'sex_cat' THEN 'Sex' WHEN 'age_group' THEN 'Age Group'
    WHEN 'Total' THEN '1_Total' ELSE variable END AS variable,
  category, n_patients, percent_of_total,
  CAST(n_patients AS VARCHAR) || ' (' || regexp_replace(CAST(percent_of_total AS VARCHAR), '\\.0$', '') || ')' AS n_pct
FROM ({_summary(cohort, variables)}) s
"""


def _crosstab(cohort: str) -> str:
    cell = (
        "count(*) FILTER (WHERE eth = '{e}' AND sex = '{s}') AS \"{e}_{s}\""
    )
    cells = ", ".join(
        cell.format(e=e, s=s)
        for e in ("Hispanic", "Not_Hispanic_or_Refuse_Other_Unknown")
        for s in ("Female", "Male")
    )
    return f"""
SELECT race_cat, {cells} FROM (
  SELECT race_cat, CASE WHEN ethnicity_concept_id = 38003563 THEN 'Hispanic'
      ELSE 'Not_Hispanic_or_Refuse_Other_Unknown' END AS eth,
    CASE WHEN gender_concept_id = 8532 THEN 'Female' WHEN gender_concept_id = 8507 THEN 'Male' END AS sex
  FROM {cohort} WHERE gender_concept_id IN (8532, 8507)) x
GROUP BY race_cat
"""


def _count(source: str) -> str:
    return f"(SELECT count(DISTINCT person_id) FROM {source})"


def _funnel(steps: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS INTEGER) AS step, '{text}' AS descriptions, {_count(source)} AS counts"
        for i, (text, source) in enumerate(steps, start=1)
    )


ATTRITION = _funnel([
    ("1. All patients", "person"),
    ("2. From 1: Patients with an ICU record", "picu"),
    ("3. From 2: ICU admission or transfer in within the study period", "picu_adt"),
    ("4. From 3: Aged >=0 and <18 with male or female sex", "under18_adt"),
    ("5. From 4: Suspected sepsis", "suspected_adt_known"),
    ("6. From 5: Confirmed sepsis", "confirmed_adt_known"),
    ("5B. From 5: Site subset", "suspected_adt_subset"),
    ("6B. From 6: Site subset", "confirmed_adt_subset"),
])

# Linked visits

_VISIT = "person_id, visit_occurrence_id, visit_start_date, visit_start_datetime, visit_concept_id"
CTES["ed"] = f"SELECT DISTINCT {_VISIT} FROM visit_star WHERE visit_concept_id IN (9203, 2000000048)"
CTES["ip"] = f"""
SELECT DISTINCT {_VISIT}, preceding_visit_occurrence_id FROM visit_star
WHERE visit_concept_id IN (9201, 2000000048, 2000000088)
"""
CTES["linked"] = f"""
SELECT DISTINCT {_VISIT} FROM visit_star
WHERE visit_concept_id = 2000000048 AND visit_start_date >= DATE '1996-01-01'
UNION
SELECT DISTINCT e.person_id, e.visit_occurrence_id, e.visit_start_date, e.visit_start_datetime, e.visit_concept_id
FROM ed e JOIN fact_relationship f ON e.visit_occurrence_id = f.fact_id_1
JOIN ip i ON f.fact_id_2 = i.visit_occurrence_id AND e.person_id = i.person_id
UNION
SELECT DISTINCT i.person_id, i.visit_occurrence_id, e.visit_start_date, e.visit_start_datetime, e.visit_concept_id
FROM ip i JOIN ed e ON i.preceding_visit_occurrence_id = e.visit_occurrence_id AND i.person_id = e.person_id
"""
CTES["wide_cultures"] = "SELECT * FROM concept WHERE concept_id BETWEEN 0 AND 49"
CTES["wide_fluids"] = "SELECT * FROM concept WHERE concept_id BETWEEN 0 AND 49"
CTES["wide_antibiotics"] = "SELECT * FROM concept WHERE concept_id BETWEEN 20 AND 79"
for _domain in ("procedure", "measurement"):
    CTES[f"culture_{_domain}"] = f"""
SELECT c.visit_occurrence_id, c.event_datetime AS culture_datetime
FROM (SELECT DISTINCT person_id, visit_start_datetime FROM linked) l
JOIN clinical_star c ON l.person_id = c.person_id AND c.domain = '{_domain}'
JOIN wide_cultures k ON c.concept_id = k.concept_id
WHERE c.event_datetime >= l.visit_start_datetime
"""
CTES["culture_in_ed"] = """
SELECT DISTINCT l.person_id, l.visit_occurrence_id, c.culture_datetime,
  date_sub('second', l.visit_start_datetime, c.culture_datetime) AS tst_time, l.visit_concept_id
FROM (SELECT coalesce(m.visit_occurrence_id, p.visit_occurrence_id) AS visit_occurrence_id,
        coalesce(m.culture_datetime, p.culture_datetime) AS culture_datetime
      FROM (SELECT DISTINCT * FROM culture_measurement) m FULL JOIN (SELECT DISTINCT * FROM culture_procedure) p
      ON m.visit_occurrence_id = p.visit_occurrence_id AND m.culture_datetime = p.culture_datetime) c
JOIN linked l ON c.visit_occurrence_id = l.visit_occurrence_id
"""


def _drug_in_visit(codes: str, attributes: str = "") -> str:
    extra = "".join(f", k.{a}" for a in attributes.split())
    return f"""
SELECT DISTINCT c.person_id, c.visit_occurrence_id, c.event_datetime AS drug_exposure_start_datetime,
  date_sub('second', l.visit_start_datetime, c.event_datetime) AS tst_time, l.visit_concept_id{extra}
FROM clinical_star c JOIN {codes} k ON c.concept_id = k.concept_id
JOIN linked l ON c.person_id = l.person_id AND c.visit_occurrence_id = l.visit_occurrence_id
WHERE c.domain = 'drug'
"""


CTES["abx_in_ed"] = _drug_in_visit("wide_antibiotics")
CTES["fluids_in_ed"] = _drug_in_visit("wide_fluids")
CTES["same_visit"] = """
SELECT DISTINCT f.person_id, f.visit_occurrence_id FROM fluids_in_ed f
JOIN (SELECT DISTINCT person_id, visit_occurrence_id FROM abx_in_ed) a
  ON f.person_id = a.person_id AND f.visit_occurrence_id = a.visit_occurrence_id
JOIN (SELECT DISTINCT person_id, visit_occurrence_id FROM culture_in_ed) c
  ON f.person_id = c.person_id AND f.visit_occurrence_id = c.visit_occurrence_id
"""
CTES["same_visit_persons"] = f"""
SELECT person_id, max(visit_start_date) AS max_sepsis_date FROM (
  SELECT s.person_id, v.visit_start_date, {_age('p.birth_date', 'v.visit_start_date')} AS age
  FROM same_visit s JOIN visit_star v ON s.visit_occurrence_id = v.visit_occurrence_id
  LEFT JOIN person_star p ON s.person_id = p.person_id) x
WHERE age >= 0 AND age < 18 GROUP BY person_id
"""
CTES["same_visit_demog"] = _demographics("same_visit_persons", "max_sepsis_date", "person_star")
for _source in ("adt", "visit"):
    for _kind in ("coded", "suspected"):
        CTES[f"{_kind}_any_{_source}_subset"] = (
            f"SELECT * FROM {_kind}_any_{_source}_demog WHERE site IN ('asia', 'europe')"
        )
CTES["same_visit_subset"] = "SELECT * FROM same_visit_demog WHERE site IN ('asia', 'europe')"

ATTRITION_WIDE = _funnel([
    ("1. All patients", "person"),
    ("2A. From 1: Patients with an ICU record", "picu"),
    ("3A. From 2A: ICU entry within the study period", "picu_adt"),
    ("3B. From 2A: Visit started within the study period", "picu_visit"),
    ("4A. From 3A: Aged >=0 and <18 at entry", "under18_any_adt"),
    ("4B. From 3B: Aged >=0 and <18 at visit start", "under18_any_visit"),
    ("5A. From 4A: Sepsis code near entry", "coded_any_adt_demog"),
    ("5B. From 4B: Sepsis code near visit start", "coded_any_visit_demog"),
    ("5C. From 4A: Suspected sepsis near entry", "suspected_any_adt_demog"),
    ("5D. From 4B: Suspected sepsis near visit start", "suspected_any_visit_demog"),
    ("6A. From 5A: Site subset", "coded_any_adt_subset"),
    ("6B. From 5B: Site subset", "coded_any_visit_subset"),
    ("6C. From 5C: Site subset", "suspected_any_adt_subset"),
    ("6D. From 5D: Site subset", "suspected_any_visit_subset"),
    ("2X. From 1: Emergency visit linked to an inpatient visit", "linked"),
    ("3X. From 2X: Suspected sepsis in the same visit", "same_visit_demog"),
    ("4X. From 3X: Site subset", "same_visit_subset"),
])


def _report(suspected: str, confirmed: str) -> str:
    return f"""
SELECT CASE WHEN s.variable = '1_Total' THEN 'Total' ELSE s.variable END AS variable, s.category,
  s.n_pct AS "Suspected Sepsis N (Col %)", c.n_pct AS "Confirmed Sepsis N (Col %)"
FROM (SELECT * FROM ({_labelled(suspected)}) a WHERE variable NOT IN ('Site')) s
LEFT JOIN (SELECT * FROM ({_labelled(confirmed)}) b WHERE variable NOT IN ('Site')) c
ON s.variable = c.variable AND s.category = c.category
"""


_WIDE = ("site", "raceth_cat", "sex_cat", "age_group")


def _report_wide(kind: str) -> str:
    return f"""
SELECT CASE WHEN a.variable = '1_Total' THEN 'Total' ELSE a.variable END AS variable, a.category,
  a.n_pct AS "adt_date confirmed N (%)", b.n_pct AS "visit_start_date confirmed N (%)",
  c.n_pct AS "adt_date suspected N (%)", d.n_pct AS "visit_start_date suspected N (%)",
  e.n_pct AS "suspected ED/IP N (%)"
FROM ({_labelled(f'coded_any_adt_{kind}', _WIDE)}) a
LEFT JOIN ({_labelled(f'coded_any_visit_{kind}', _WIDE)}) b ON a.variable = b.variable AND a.category = b.category
LEFT JOIN ({_labelled(f'suspected_any_adt_{kind}', _WIDE)}) c ON a.variable = c.variable AND a.category = c.category
LEFT JOIN ({_labelled(f'suspected_any_visit_{kind}', _WIDE)}) d ON a.variable = d.variable AND a.category = d.category
LEFT JOIN ({_labelled(f'same_visit_{kind}', _WIDE)}) e ON a.variable = e.variable AND a.category = e.category
"""


def _continuous(cohort: str) -> str:
    parts = [
        "SELECT 'age' AS variable, CAST(NULL AS VARCHAR) AS category, count(age) AS n_patients, "
        "round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS sd, CAST(NULL AS DOUBLE) AS percent_of_total "
        f"FROM {cohort}"
    ]
    parts += [
        f"SELECT '{v}', {v}, count(*), NULL, NULL, CASE WHEN {v} IS NOT NULL THEN "
        f"round(CAST(100 * count(*) AS DOUBLE) / (SELECT count({v}) FROM {cohort}), 2) END FROM {cohort} GROUP BY {v}"
        for v in ("age_group", "site", "sex_cat", "raceth_cat")
    ]
    return "\nUNION ALL\n".join(parts)


def _episodes(records: str, with_visits: bool) -> str:
    """Stays by cumulative sums over whole groups."""
    key = "person_id, visit_occurrence_id, site"
    bookends = f"""
    UNION ALL
    SELECT person_id, visit_occurrence_id, site, visit_start_datetime, visit_start_date, 1, -1, 'start' FROM edges
    JOIN (SELECT visit_occurrence_id AS v, visit_start_datetime, visit_start_date FROM visit_occurrence) x
      ON visit_occurrence_id = v WHERE first_kind <> 'start'
    UNION ALL
    SELECT person_id, visit_occurrence_id, site, visit_end_datetime, visit_end_date, 2, -2, 'end' FROM edges
    JOIN (SELECT visit_occurrence_id AS v, visit_end_datetime, visit_end_date FROM visit_occurrence) x
      ON visit_occurrence_id = v WHERE first_kind <> 'start' OR last_kind <> 'end'
    """
    return f"""
SELECT person_id, visit_occurrence_id, site, CAST(arg_min(id, (dt, app, id)) AS BIGINT) AS episode_id,
  arg_min(d, (dt, app, id)) AS episode_start_date, min(dt) AS episode_start_datetime,
  arg_max(end_d, (end_dt, dt)) AS episode_end_date, max(end_dt) AS episode_end_datetime
FROM (
  SELECT *, sum(new_episode) OVER (PARTITION BY {key} ORDER BY dt, app, id) AS merged_no FROM (
    SELECT *, CASE WHEN date_sub('microsecond', lag(end_dt) OVER (PARTITION BY {key} ORDER BY dt, app, id), dt) < 43200000000
      THEN 0 ELSE 1 END AS new_episode
    FROM (
      SELECT o.*, c.run_end AS end_dt, c.run_end_d AS end_d FROM
        (SELECT * FROM numbered WHERE opens) o
        JOIN (SELECT * FROM numbered WHERE closes) c
        ON o.person_id = c.person_id AND o.visit_occurrence_id = c.visit_occurrence_id AND o.site = c.site AND o.seq = c.seq
    ) paired
  ) flagged
) m GROUP BY {key}, merged_no
""", f"""
numbered AS (
  SELECT *, max(dt) OVER run AS run_end, max(d) OVER run AS run_end_d,
    sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY dt, app, id) AS seq
  FROM (
    SELECT *, kind = 'start' AND coalesce(prev, 'end') = 'end' AS opens,
      kind = 'end' AND coalesce(prev, 'end') = 'start' AS closes,
      sum(CASE WHEN kind = 'end' AND before = 'end' THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY dt, app, id) AS run_no
    FROM (
      SELECT *, last_value(CASE WHEN kind <> 'other' THEN kind END IGNORE NULLS) OVER (
          PARTITION BY {key} ORDER BY dt, app, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
        lag(kind) OVER (PARTITION BY {key} ORDER BY dt, app, id) AS before
      FROM (SELECT * FROM kept {bookends if with_visits else ''}) a
    ) b
  ) c
  WINDOW run AS (PARTITION BY {key}, run_no)
)""", f"""
kept AS (
  SELECT person_id, visit_occurrence_id, site, adt_datetime AS dt, adt_date AS d, 0 AS app, adt_occurrence_id AS id, kind
  FROM (
    SELECT *, bool_or(kind = 'start') OVER w AND bool_or(kind = 'end') OVER w AS both_kinds FROM (
      SELECT *, CASE WHEN adt_type_concept_id IN (2000000083, 2000000085) THEN 'start'
        WHEN adt_type_concept_id IN (2000000084, 2000000086) THEN 'end' ELSE 'other' END AS kind
      FROM {records} WHERE adt_type_concept_id NOT IN (2000000087)) k
    WINDOW w AS (PARTITION BY {key}, adt_datetime, kind <> 'other')) x
  WHERE NOT both_kinds
), edges AS (
  SELECT {key}, arg_min(kind, (dt, id)) AS first_kind, arg_max(kind, (dt, id)) AS last_kind FROM kept GROUP BY {key}
)"""


CTES["icu_records"] = "SELECT * FROM adt_occurrence WHERE service_concept_id = 2000000078"

SQL: dict[str, str] = {
    "latest_visit_by_site": "SELECT site, max(visit_start_date) AS max_visit_date FROM visit_occurrence GROUP BY site",
    "index_events": "SELECT * FROM picu",
    "icu_cohort_adt": "SELECT * FROM under18_adt",
    "icu_cohort_visit": "SELECT * FROM under18_visit",
    "icu_admits": "SELECT * FROM adt_occurrence WHERE adt_type_concept_id IN (2000000083, 2000000085) "
    "AND adt_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-28' AND service_concept_id IN (2000000078)",
    "patient_count": "SELECT count(*) AS n_patients FROM (SELECT DISTINCT person_id FROM picu) x",
    "person_site_lookup": "SELECT x.person_id, p.site FROM (SELECT DISTINCT person_id FROM under18_adt) x "
    "LEFT JOIN person p ON x.person_id = p.person_id",
    "condition_near_index": "SELECT * FROM coded_adt",
    "condition_near_index_1day": _condition("under18_adt", "adt_date", 1),
    "condition_near_index_visit": "SELECT * FROM coded_visit",
    "phenotype_near_index": "SELECT * FROM suspected_adt",
    "phenotype_near_index_1day": _suspected("under18_adt", "adt_date", 1),
    "phenotype_near_index_visit": "SELECT * FROM suspected_visit",
    "two_level_cohort": "SELECT person_id, min_date, max_date, n_dates, sex_cat FROM confirmed_adt_known",
    "demographics": """SELECT person_id, min_date, max_date AS max_picu_date, n_dates, site, birth_date, gender_concept_id,
  race_concept_id, ethnicity_concept_id, age, sex_cat, raceth_cat, eth_cat, race_cat, eth_cat2, race_cat2, age_group
FROM coded_adt_demog""",
    "demographic_summary": _summary("coded_adt_known"),
    "demographic_summary_by_index": _summary("index_adt_demog"),
    "demographic_summary_site_subset": _summary("coded_adt_subset"),
    "demographic_summary_two_level": _summary("confirmed_adt_known"),
    "demographic_summary_same_visit": _summary("same_visit_demog", _WIDE),
    "study_cohorts": "\nUNION ALL\n".join(
        f"SELECT '{cohort}' AS cohort, person_id, min_date AS min_picu_date, max_date AS max_picu_date, "
        f"n_dates AS n_picu_dates, site, age_group FROM {cohort}_adt_known"
        for cohort in ("suspected", "coded", "confirmed")
    ),
    "labelled_summary": _labelled("suspected_adt_known"),
    "raceth_by_sex": _crosstab("coded_adt_demog"),
    "raceth_by_sex_all": "\nUNION\n".join(
        f"SELECT *, '{kind}' AS sepsis_type, '{label}' AS site FROM ({_crosstab(cohort)}) x"
        for kind, label, cohort in (
            ("suspected", "All", "suspected_adt_known"),
            ("suspected", "Asia and Europe", "suspected_adt_subset"),
            ("confirmed", "All", "confirmed_adt_known"),
            ("confirmed", "Asia and Europe", "confirmed_adt_subset"),
        )
    ),
    "age_quantiles": "\nUNION ALL\n".join(
        f"SELECT CAST({p} AS DOUBLE) AS probability, quantile_cont(age, {p}) AS age FROM coded_adt_demog"
        for p in (0.2, 0.4, 0.6, 0.8)
    ),
    "demographics_continuous": _continuous("coded_adt_demog"),
    "attrition": ATTRITION,
    "attrition_wide": ATTRITION_WIDE,
    "report_attrition": f'SELECT descriptions AS "Description", counts AS "Patient Count" FROM ({ATTRITION}) x',
    "report_demographics": _report("suspected_adt_known", "confirmed_adt_known"),
    "report_demographics_site_subset": _report("suspected_adt_subset", "confirmed_adt_subset"),
    "report_demographics_empty_cohort": """SELECT 'Total' AS variable, 'Total' AS category,
  (SELECT count(DISTINCT person_id) FROM suspected_adt_known WHERE site = 'St. John''s') || ' (NaN)' AS "Suspected Sepsis N (Col %)",
  (SELECT count(DISTINCT person_id) FROM confirmed_adt_known WHERE site = 'St. John''s') || ' (NaN)' AS "Confirmed Sepsis N (Col %)"
""",
    "report_demographics_wide": _report_wide("demog"),
    "report_demographics_wide_site_subset": _report_wide("subset"),
    "cdm_table_scan": """SELECT * FROM visit_occurrence
WHERE visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-28'""",
    "vocabulary_scan": "SELECT * FROM concept WHERE concept_id < 50",
    "concept_search_all": "SELECT * FROM concept WHERE regexp_matches(lower(concept_name), 'red') "
    "AND regexp_matches(lower(concept_name), 'widget')",
    "concept_search_any": "SELECT * FROM concept WHERE regexp_matches(lower(concept_name), 'red|blue') "
    "AND regexp_matches(lower(concept_name), 'widget|ring')",
    "concept_search_excluding": "SELECT * FROM concept WHERE regexp_matches(lower(concept_name), 'small') "
    "AND NOT regexp_matches(lower(concept_name), 'gear')",
    "codeset_availability_by_site": """SELECT 'blood culture' AS topic, site, count(*) AS n FROM procedure_occurrence
JOIN (SELECT DISTINCT concept_id FROM px_blood_culture) k ON procedure_concept_id = k.concept_id GROUP BY site""",
    "search_availability_by_site": "\nUNION ALL\n".join(
        f"SELECT '{topic}' AS topic, site, count(*) AS n FROM measurement_labs JOIN (SELECT DISTINCT concept_id "
        f"FROM concept WHERE {where}) k ON measurement_concept_id = k.concept_id GROUP BY site"
        for topic, where in (
            ("red or blue", "regexp_matches(lower(concept_name), 'red|blue')"),
            ("widget or ring", "regexp_matches(lower(concept_name), 'widget|ring')"),
            ("small, no gear", "regexp_matches(lower(concept_name), 'small') "
             "AND NOT regexp_matches(lower(concept_name), 'gear')"),
        )
    ),
    "observed_concepts": """SELECT k.* FROM (SELECT DISTINCT measurement_concept_id FROM measurement_labs) m
JOIN concept k ON m.measurement_concept_id = k.concept_id
WHERE regexp_matches(lower(concept_name), 'red|blue') AND regexp_matches(lower(concept_name), 'widget|ring')""",
    "observed_concepts_by_topic": "\nUNION ALL\n".join(
        f"SELECT '{topic}' AS topic, k.* FROM concept k WHERE ({where}) AND concept_id IN "
        "(SELECT measurement_concept_id FROM measurement_labs)"
        for topic, where in (
            ("red or blue", "regexp_matches(lower(concept_name), 'red|blue')"),
            ("widget or ring", "regexp_matches(lower(concept_name), 'widget|ring')"),
            ("small, no gear", "regexp_matches(lower(concept_name), 'small') "
             "AND NOT regexp_matches(lower(concept_name), 'gear')"),
        )
    ),
    "ed_visits": "SELECT * FROM ed",
    "inpatient_visits": "SELECT * FROM ip",
    "ed_linked_to_inpatient": "SELECT * FROM linked",
    "blood_culture_after_ed": "SELECT * FROM culture_in_ed",
    "blood_culture_within_30_days": "SELECT * FROM culture_in_ed WHERE tst_time >= 0 AND tst_time <= 2592000",
    "drug_in_visit": "SELECT * FROM abx_in_ed",
    "drug_in_visit_with_attributes": _drug_in_visit("wide_fluids", "concept_code vocabulary_id"),
    "same_visit_criteria": "SELECT * FROM same_visit",
    "same_visit_phenotype": "SELECT * FROM same_visit_persons",
    "adt_tie_guard": """SELECT max(n) AS max_records FROM (SELECT count(*) AS n FROM adt_occurrence
GROUP BY person_id, adt_datetime, adt_type_concept_id IN (2000000083, 2000000084, 2000000085, 2000000086)) x""",
    "codeset_semi_join": "SELECT * FROM drug_exposure WHERE drug_concept_id IN (SELECT concept_id FROM iv_fluids)",
    "codeset_join_fanout": """SELECT d.* FROM drug_exposure d JOIN (SELECT concept_id FROM iv_fluids
UNION ALL SELECT concept_id FROM med_broad_spec_abx) k ON d.drug_concept_id = k.concept_id""",
    "codeset_attribute_join": """SELECT d.*, k.concept_name, k.vocabulary_id FROM drug_exposure d
JOIN iv_fluids k ON d.drug_concept_id = k.concept_id""",
    "source_code_anti_join": """SELECT * FROM condition_occurrence c
WHERE condition_source_concept_id IN (SELECT concept_id FROM dx_sepsis) AND NOT EXISTS (
  SELECT 1 FROM condition_occurrence s JOIN dx_sepsis k ON s.condition_concept_id = k.concept_id
  WHERE s.condition_occurrence_id = c.condition_occurrence_id)""",
    "interval_join": f"""SELECT c.condition_occurrence_id, c.person_id, c.condition_start_date, x.adt_date
FROM condition_occurrence c JOIN dx_sepsis k ON c.condition_concept_id = k.concept_id
JOIN under18_adt x ON c.person_id = x.person_id WHERE {_near('c.condition_start_date', 'x.adt_date', 2, 5)}""",
    "day_bucket_join": f"""SELECT DISTINCT c.person_id, x.adt_date
FROM condition_occurrence c JOIN dx_sepsis k ON c.condition_concept_id = k.concept_id
JOIN under18_adt x ON c.person_id = x.person_id WHERE {_near('c.condition_start_date', 'x.adt_date', 2, 5)}""",
    "key_union_full_join": f"""SELECT coalesce(p.person_id, l.person_id) AS person_id, coalesce(p.dt, l.dt) AS adt_date
FROM ({_keys_near('px', 'under18_adt', 'adt_date', 7)}) p
FULL JOIN ({_keys_near('lab', 'under18_adt', 'adt_date', 7)}) l ON p.person_id = l.person_id AND p.dt = l.dt""",
    "criteria_intersection": f"""SELECT f.person_id, f.dt AS adt_date FROM ({_keys_near('iv', 'under18_adt', 'adt_date', 7)}) f
JOIN ({_keys_near('abx', 'under18_adt', 'adt_date', 7)}) b ON f.person_id = b.person_id AND f.dt = b.dt""",
    "person_semi_join": "SELECT * FROM coded_adt WHERE person_id IN (SELECT person_id FROM suspected_adt)",
    "union_distinct_by_name": """SELECT concept_id, concept_name, CAST(NULL AS VARCHAR) AS concept_code FROM px_blood_culture
UNION SELECT concept_id, concept_name, concept_code FROM iv_fluids
UNION SELECT concept_id, concept_name, NULL FROM lab_blood_culture""",
    "result_table_roundtrip": "SELECT * FROM coded_adt",
    "result_csv_roundtrip": _labelled("suspected_adt_known"),
    "notes_table": """SELECT concept_name AS component_name_all,
  concept_code || ', ' || vocabulary_id AS notes_on_data_availability FROM concept""",
    "notes_result": """SELECT concept_name AS component_name,
  'said "' || concept_code || '",' || chr(10) || 'then ' || vocabulary_id AS notes FROM concept""",
    "codeset_csv_roundtrip": "SELECT * FROM med_broad_spec_abx",
}

SQL["phenotype_near_stored_index"] = f"""
SELECT * FROM ({SQL['criteria_intersection']}) d INTERSECT SELECT * FROM ({SQL['key_union_full_join']}) c
"""
_both = "(SELECT count(*) FROM (SELECT person_id FROM {} INTERSECT SELECT person_id FROM {}) {})"
SQL["funnel_cuts"] = "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS step, '{text}' AS descriptions, {_both.format(a, b, f'b{i}')} AS counts"
    for i, (text, a, b) in enumerate([
        ("Coded and suspected near entry", "coded_any_adt_demog", "suspected_any_adt_demog"),
        ("Coded and suspected near entry, asia", "coded_any_adt_demog WHERE site = 'asia'", "suspected_any_adt_demog"),
        ("Coded near entry and near visit start, europe or africa",
         "coded_any_adt_demog WHERE site IN ('europe', 'africa')", "coded_any_visit_demog"),
        ("ICU record and linked emergency visit", "picu", "linked"),
        ("Nowhere", "person WHERE 1 = 0", "coded_any_adt_demog"),
    ], start=1)
)
SQL["phenotype_near_sieved_index"] = SQL["phenotype_near_stored_index"]
SQL["person_sieve_join"] = """SELECT c.condition_occurrence_id, c.person_id, c.condition_start_date
FROM condition_occurrence c WHERE c.condition_concept_id IN (SELECT concept_id FROM dx_sepsis)
AND c.person_id IN (SELECT person_id FROM under18_adt)"""

_near_index_level = " UNION ".join(
    f"SELECT DISTINCT c.person_id, x.adt_date AS dt FROM condition_occurrence c JOIN dx_sepsis k ON c.{column} = k.concept_id "
    f"JOIN under18_adt x ON c.person_id = x.person_id WHERE {_near('c.condition_start_date', 'x.adt_date', 7, 7)}"
    for column in ("condition_concept_id", "condition_source_concept_id")
)
SQL["two_level_cohort_same_index"] = f"""
SELECT b.person_id, min(b.dt) AS min_date, max(b.dt) AS max_date, count(*) AS n_dates,
  max(CASE WHEN p.gender_concept_id = 8532 THEN 'Female' ELSE 'Male' END) AS sex_cat
FROM (({_near_index_level}) INTERSECT ({SQL['criteria_intersection'].replace('f.dt AS adt_date', 'f.dt')})
  INTERSECT ({SQL['key_union_full_join'].replace('AS adt_date', 'AS dt')})) b
JOIN person p ON b.person_id = p.person_id GROUP BY b.person_id
"""

for _name, _test in (("null_key_left_join", "="), ("null_key_left_join_null_safe", "IS NOT DISTINCT FROM")):
    SQL[_name] = f"""
SELECT f.race_cat2, f.eth_cat2, f.n AS n_female, m.n AS n_male
FROM (SELECT race_cat2, eth_cat2, count(*) AS n FROM index_adt_demog WHERE sex_cat = 'Female' GROUP BY 1, 2) f
LEFT JOIN (SELECT race_cat2, eth_cat2, count(*) AS n FROM index_adt_demog WHERE sex_cat = 'Male' GROUP BY 1, 2) m
ON f.race_cat2 {_test} m.race_cat2 AND f.eth_cat2 {_test} m.eth_cat2
"""


def _needed(text: str) -> list[str]:
    """Names of the views a query uses, those it builds on first."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", sql)):
            if word in CTES and word not in ordered:
                visit(CTES[word])
                ordered.append(word)

    visit(text)
    return ordered


def _complete(body: str, *own: str) -> str:
    used = " ".join([*own, body])
    views = [f"{name} AS ({CTES[name]})" for name in _needed(used)]
    parts = [*views, *own]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def all_oracles() -> dict[str, str]:
    oracles = {name: _complete(body) for name, body in SQL.items()}
    for name, records, with_visits in (
        ("adt_episodes", "icu_records", True),
        ("adt_episodes_without_visits", "adt_occurrence", False),
    ):
        body, numbered, kept = _episodes(records, with_visits)
        oracles[name] = _complete(body, kept, numbered)
    return oracles
