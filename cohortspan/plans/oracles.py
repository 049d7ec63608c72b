"""The registered queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..sources.study import CONDITION_SUFFIX, CONDITIONS, DAY_ORIGIN, DEATH_BEFORE, STUDY_CUTOFF

ORACLES: dict[str, str] = {}

CTES: dict[str, str] = {}

CTES["person"] = """
SELECT c_custkey AS person_id, c_nationkey % 5 AS site_id,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(floor((c_acctbal + 1000) / 110) AS INT) END AS age,
       CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS sex,
       c_mktsegment AS race_ethnicity,
       CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_acctbal > 8000 THEN 1 ELSE 0 END AS morbid_obesity,
       CASE WHEN c_custkey % 59 = 0 THEN 1 ELSE 0 END AS possible_case
FROM customer"""

CTES["visit"] = """
SELECT o_custkey AS person_id, o_orderkey AS visit_id, CAST(o_orderdate AS DATE) AS visit_start_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS macrovisit_start_date,
       o_orderpriority AS kind, o_totalprice AS cost
FROM orders"""

CTES["idx"] = """
SELECT person_id,
       min(CASE WHEN kind = '1-URGENT' THEN visit_start_date END) AS pos_date,
       min(CASE WHEN kind = '4-NOT SPECIFIED' THEN visit_start_date END) AS neg_date,
       min(visit_start_date) AS first_visit_date, max(visit_start_date) AS last_visit_date,
       CAST(count(CASE WHEN kind = '3-MEDIUM' THEN 1 END) AS INT) AS doses
FROM visit GROUP BY person_id"""

CTES["deaths"] = f"""
SELECT person_id, last_visit_date AS death_date FROM idx WHERE last_visit_date < DATE '{DEATH_BEFORE}'"""

CTES["line_facts"] = """
SELECT l_orderkey, bit_or(1::BIGINT << CAST(l_partkey % 34 AS BIGINT)) AS conditions,
       count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
FROM lineitem GROUP BY l_orderkey"""

CTES["history_pos"] = """
SELECT v.person_id, i.pos_date,
       CAST(nullif(count(CASE WHEN v.visit_start_date < i.pos_date THEN 1 END), 0) AS INT) AS visits_before,
       CAST(date_diff('day', min(CASE WHEN v.visit_start_date <= i.pos_date THEN v.visit_start_date END),
                      max(CASE WHEN v.visit_start_date <= i.pos_date THEN v.visit_start_date END)) AS INT) AS observation_before,
       CAST(date_diff('day', i.pos_date, max(v.visit_start_date)) AS INT) AS observation_post,
       max(CASE WHEN v.visit_start_date > i.pos_date THEN CASE WHEN kind = '5-LOW' AND cost > 350000 THEN 1 ELSE 0 END END) AS dx,
       max(CASE WHEN v.visit_start_date > i.pos_date THEN CASE WHEN kind = '2-HIGH' AND cost > 400000 THEN 1 ELSE 0 END END) AS clinic,
       max(CASE WHEN v.visit_start_date > i.pos_date THEN CASE WHEN kind = '3-MEDIUM' AND cost > 480000 THEN 1 ELSE 0 END END) AS phenotype,
       max(CASE WHEN v.visit_start_date >= i.pos_date THEN CASE WHEN kind = '1-URGENT' AND cost > 450000 THEN 1 ELSE 0 END END) AS hospitalised,
       CAST(count(CASE WHEN v.visit_start_date <= i.pos_date AND kind = '3-MEDIUM' THEN 1 END) AS INT) AS vaccine_doses,
       bit_or(CASE WHEN v.visit_start_date <= i.pos_date THEN l.conditions END) AS conditions,
       CAST(sum(CASE WHEN v.visit_start_date <= i.pos_date THEN coalesce(l.returned, 0) END) AS INT) AS returned,
       count(CASE WHEN v.visit_start_date <= i.pos_date THEN l.returned END) AS with_lines
FROM visit v JOIN idx i ON v.person_id = i.person_id AND i.pos_date IS NOT NULL
LEFT JOIN line_facts l ON l.l_orderkey = v.visit_id
GROUP BY v.person_id, i.pos_date"""

_FLAGS = ",\n".join(
    f"       CASE WHEN (h.person_id + {i}) % 53 = 0 THEN NULL "
    f"ELSE CAST((coalesce(h.conditions, 0) >> {i}) & 1 AS INT) END AS {name}{CONDITION_SUFFIX}"
    for i, name in enumerate(CONDITIONS)
)
CTES["positive_facts"] = f"""
SELECT h.person_id, p.site_id, p.age, p.sex, p.race_ethnicity, h.pos_date AS index_date, h.dx, h.clinic, h.phenotype,
       h.hospitalised, h.visits_before, h.observation_before, h.observation_post, p.morbid_obesity, h.vaccine_doses,
       CASE WHEN d.person_id IS NULL THEN 0 ELSE 1 END AS death,
{_FLAGS}
FROM history_pos h JOIN person p ON h.person_id = p.person_id LEFT JOIN deaths d ON d.person_id = h.person_id"""

CTES["all_facts"] = """
SELECT p.person_id, p.site_id, p.age, p.sex, p.race_ethnicity, p.morbid_obesity, i.neg_date,
       CAST(date_diff('day', i.first_visit_date, i.last_visit_date) AS INT) AS observation_period,
       CASE WHEN i.pos_date IS NOT NULL THEN 1 ELSE 0 END AS confirmed_case, p.possible_case,
       CASE WHEN p.person_id IN (SELECT person_id FROM visit WHERE kind = '5-LOW' AND cost > 350000) THEN 1 ELSE 0 END AS dx,
       i.doses AS vaccine_doses, CASE WHEN d.person_id IS NULL THEN 0 ELSE 1 END AS death
FROM person p LEFT JOIN idx i ON i.person_id = p.person_id LEFT JOIN deaths d ON d.person_id = p.person_id"""

CTES["cci_pos"] = "SELECT person_id, returned AS comorbidity_score FROM history_pos WHERE with_lines > 0"

CTES["cci_all"] = """
SELECT v.person_id, CAST(sum(l.returned) AS INT) AS comorbidity_score
FROM visit v JOIN line_facts l ON l.l_orderkey = v.visit_id GROUP BY v.person_id"""

CTES["merged_visit"] = """
SELECT person_id, visit_id, visit_start_date, macrovisit_start_date FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, macrovisit_start_date ORDER BY visit_start_date, visit_id) AS rn
  FROM visit WHERE macrovisit_start_date IS NOT NULL) WHERE rn = 1
UNION ALL
SELECT person_id, visit_id, visit_start_date, macrovisit_start_date FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, visit_start_date ORDER BY visit_id) AS rn
  FROM visit WHERE macrovisit_start_date IS NULL) WHERE rn = 1"""

CTES["history_neg"] = """
SELECT m.person_id,
       CAST(nullif(count(CASE WHEN m.visit_start_date < i.neg_date THEN 1 END), 0) AS INT) AS visits_before,
       CAST(date_diff('day', min(CASE WHEN m.visit_start_date <= i.neg_date THEN m.visit_start_date END),
                      max(CASE WHEN m.visit_start_date <= i.neg_date THEN m.visit_start_date END)) AS INT) AS observation_before
FROM merged_visit m JOIN idx i ON i.person_id = m.person_id AND i.neg_date IS NOT NULL
GROUP BY m.person_id"""


def _rate(alias: str) -> str:
    r = f"30.0 * {alias}.visits_before / nullif({alias}.observation_before, 0)"
    return (f"CAST(round({r}, 6) AS DOUBLE) AS visit_rate, "
            f"round(coalesce(CASE WHEN {r} > 0 THEN ln({r}) END, 0), 6) AS log_visit_rate")


CTES["cases"] = f"""
SELECT f.*, i.last_visit_date AS latest_visit_date, DATE '2021-10-01' AS milestone_date, 1 AS is_case, {_rate('f')}
FROM positive_facts f JOIN idx i ON i.person_id = f.person_id
WHERE date_diff('day', f.index_date, i.last_visit_date) >= 45 AND f.age >= 18
  AND (f.dx = 1 OR f.clinic = 1 OR f.phenotype = 1)"""

CTES["positives"] = f"""
SELECT f.*, i.last_visit_date AS latest_visit_date, DATE '2021-10-01' AS milestone_date, 0 AS is_case, {_rate('f')},
       CASE WHEN f.site_id IN (SELECT site_id FROM positive_facts WHERE dx = 1) THEN 1 ELSE 0 END AS is_dx_site
FROM positive_facts f JOIN idx i ON i.person_id = f.person_id
WHERE date_diff('day', f.index_date, i.last_visit_date) >= 45 AND f.age >= 18
  AND f.person_id NOT IN (SELECT person_id FROM cases)"""

CTES["negatives"] = f"""
SELECT a.*, a.neg_date AS index_date, i.last_visit_date AS latest_visit_date, DATE '2021-10-01' AS milestone_date,
       h.visits_before, h.observation_before, 0 AS is_case, {_rate('h')},
       CASE WHEN a.site_id IN (SELECT site_id FROM all_facts WHERE dx = 1) THEN 1 ELSE 0 END AS is_dx_site
FROM all_facts a JOIN idx i ON i.person_id = a.person_id LEFT JOIN history_neg h ON h.person_id = a.person_id
WHERE date_diff('day', a.neg_date, i.last_visit_date) >= 45 AND a.age >= 18 AND a.confirmed_case = 0
  AND a.possible_case = 0 AND a.person_id NOT IN (SELECT person_id FROM cases)"""


def _pre_match(controls: str, period: str) -> str:
    day = f"CAST(date_diff('day', DATE '{DAY_ORIGIN}', index_date) AS INT) AS index_day"
    shared = "site_id, CAST(age AS INT) AS age, index_date, is_case, log_visit_rate"
    return f"""
SELECT person_id, {period} AS observation_period, {shared}, {day} FROM {controls}
WHERE site_id IN (SELECT site_id FROM cases)
UNION ALL
SELECT person_id, observation_post AS observation_period, {shared}, {day} FROM cases
WHERE site_id IN (SELECT site_id FROM {controls})"""


CTES["pre_match_pos"] = _pre_match("positives", "observation_post")
CTES["pre_match_neg"] = _pre_match("negatives", "observation_period")


def _mentions(name: str, text: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def with_ctes(body: str) -> str:
    """``body`` preceded by the common table expressions it needs, directly or indirectly."""
    needed: list[str] = []
    text = body
    for name in reversed(CTES):
        if _mentions(name, text):
            needed.append(name)
            text += CTES[name]
    if not needed:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in reversed(needed))
    recursive = "RECURSIVE " if any(name.startswith("greedy_") for name in needed) else ""
    return f"WITH {recursive}{parts}\n{body.strip()}"


def oracle(name: str, body: str) -> None:
    ORACLES[name] = with_ctes(body)


oracle("latest_visit", "SELECT person_id, max(visit_start_date) AS latest_visit_date FROM visit GROUP BY person_id")
oracle("first_last_visit", """
SELECT person_id, min(visit_start_date) AS first_visit_date, max(visit_start_date) AS last_visit_date
FROM visit GROUP BY person_id""")
oracle("attach_latest_visit", """
SELECT p.person_id, p.age, p.sex, i.last_visit_date AS latest_visit_date
FROM person p LEFT JOIN idx i ON i.person_id = p.person_id""")
oracle("consolidate_visits", "SELECT person_id, visit_id, visit_start_date, macrovisit_start_date FROM merged_visit")
oracle("keep_first_visit", """
SELECT person_id, macrovisit_start_date, visit_start_date, visit_id, kind FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id, macrovisit_start_date ORDER BY visit_start_date, visit_id) AS rn
  FROM visit WHERE macrovisit_start_date IS NOT NULL) WHERE rn = 1""")
oracle("dedup_visits", "SELECT DISTINCT person_id, visit_start_date FROM visit WHERE macrovisit_start_date IS NULL")
oracle("visits_before_index", "SELECT person_id, visits_before FROM history_neg WHERE visits_before IS NOT NULL")
oracle("observation_before_index",
       "SELECT person_id, observation_before FROM history_neg WHERE observation_before IS NOT NULL")
oracle("log_visit_rate", f"SELECT h.person_id, {_rate('h')} FROM history_neg h")

_CASE = ("person_id, site_id, age, sex, race_ethnicity, index_date, latest_visit_date, milestone_date, dx, clinic, "
         "phenotype, visits_before, observation_before, observation_post, death, morbid_obesity, vaccine_doses, "
         "is_case, visit_rate, log_visit_rate")
oracle("case_cohort", f"SELECT {_CASE} FROM cases")
oracle("positive_control", f"SELECT {_CASE}, is_dx_site FROM positives")
oracle("negative_control", """
SELECT person_id, site_id, age, sex, index_date, latest_visit_date, milestone_date, observation_period, visits_before,
       observation_before, is_dx_site, death, morbid_obesity, vaccine_doses, is_case, visit_rate, log_visit_rate
FROM negatives""")
oracle("flag_cohort_2", """
SELECT person_id, age, dx, clinic, phenotype FROM positive_facts WHERE (dx = 1 OR clinic = 1) AND age >= 18""")
oracle("flag_cohort_3", """
SELECT person_id, age, dx, clinic, phenotype FROM positive_facts
WHERE (dx = 1 OR clinic = 1 OR phenotype = 1) AND age >= 18""")
oracle("site_flag", """
SELECT person_id, person_id // 5 AS practice_id,
       CASE WHEN person_id // 5 IN (SELECT person_id // 5 FROM all_facts WHERE dx = 1) THEN 1 ELSE 0 END AS is_dx_site
FROM all_facts""")
oracle("common_sites", """
SELECT person_id, person_id // 5 AS practice_id, 'case' AS side FROM cases
  WHERE person_id // 5 IN (SELECT person_id // 5 FROM positives)
UNION ALL
SELECT person_id, person_id // 5, 'control' FROM positives WHERE person_id // 5 IN (SELECT person_id // 5 FROM cases)""")
oracle("attrition_funnel", """
SELECT 0 AS step, 'all' AS name, count(*) AS n FROM positive_facts
UNION ALL SELECT 1, 'adult', count(*) FROM positive_facts WHERE age >= 18
UNION ALL SELECT 2, 'followed', count(*) FROM positive_facts f JOIN idx i ON i.person_id = f.person_id
  WHERE age >= 18 AND date_diff('day', index_date, last_visit_date) >= 45
UNION ALL SELECT 3, 'flagged', count(*) FROM positive_facts f JOIN idx i ON i.person_id = f.person_id
  WHERE age >= 18 AND date_diff('day', index_date, last_visit_date) >= 45 AND (dx = 1 OR clinic = 1 OR phenotype = 1)""")
for _name, _pred in (("attrition_funnel_2", "dx = 1 OR clinic = 1"),
                     ("attrition_funnel_3", "dx = 1 OR clinic = 1 OR phenotype = 1")):
    oracle(_name, f"""
SELECT 0 AS step, 'all' AS name, count(*) AS n FROM positive_facts
UNION ALL SELECT 1, 'adult', count(*) FROM positive_facts WHERE age >= 18
UNION ALL SELECT 2, 'flagged', count(*) FROM positive_facts WHERE age >= 18 AND ({_pred})""")
oracle("cohort_disjoint", """
SELECT 'case|positive' AS pair, count(*) AS n FROM cases JOIN positives USING (person_id)
UNION ALL SELECT 'case|negative', count(*) FROM cases JOIN negatives USING (person_id)
UNION ALL SELECT 'positive|negative', count(*) FROM positives JOIN negatives USING (person_id)""")
oracle("cohort_overlap", """
SELECT count(*) AS n FROM positive_facts WHERE (dx = 1 OR clinic = 1) AND age >= 18""")
oracle("label_consistency", """
SELECT (SELECT count(*) FROM idx WHERE pos_date IS NOT NULL) AS n_positive,
       (SELECT count(*) FROM all_facts f JOIN idx i ON i.person_id = f.person_id
        WHERE i.pos_date IS NOT NULL AND confirmed_case = 0 AND possible_case = 0) AS n_inconsistent""")
oracle("pre_match_positive", "SELECT * FROM pre_match_pos")
oracle("pre_match_negative", "SELECT * FROM pre_match_neg")


def _summary(source: str) -> str:
    buckets = [
        ("1.Age less than 1 (in %)", "age < 1", 0), ("2.Age between 1 to 4 (in %)", "age BETWEEN 1 AND 4", 2),
        ("3.Age between 5 to 9 (in %)", "age BETWEEN 5 AND 9", 2),
        ("4.Age between 10 to 15 (in %)", "age BETWEEN 10 AND 15", 2),
        ("5.Age between 16 to 20 (in %)", "age BETWEEN 16 AND 20", 2),
        ("6.Age between 21 to 45 (in %)", "age BETWEEN 21 AND 45", 2),
        ("7.Age between 46 to 65 (in %)", "age BETWEEN 46 AND 65", 2),
        ("8.Age higher than 66 (in %)", "age >= 66", 2), ("9.Age missing (in %)", "age IS NULL", 2),
    ]
    rows = [
        f"SELECT '{label}' AS value_name, round(count(CASE WHEN {p} THEN 1 END) * 100.0 / count(*)::DOUBLE, {d}) AS percent_value, "
        f"count(CASE WHEN {p} THEN 1 END) AS count_value FROM src" for label, p, d in buckets
    ]
    rows += [
        "SELECT 'mean_age', round(avg(age), 6), NULL FROM src",
        "SELECT 'std_age', round(stddev_samp(age), 6), NULL FROM src",
    ]
    race = ("CASE race_ethnicity WHEN 'BUILDING' THEN 'Construction' WHEN 'HOUSEHOLD' THEN 'Household' "
            "WHEN 'MACHINERY' THEN 'Machines' ELSE 'Other' END")
    for prefix, c in (("Race_Ethnicity_", race), ("Sex_", "coalesce(sex, 'None')")):
        rows.append(f"SELECT '{prefix}' || {c}, round(count(*) * 100.0 / (SELECT count(*) FROM src)::DOUBLE, 2), count(*) "
                    f"FROM src GROUP BY {c}")
    body = "\nUNION ALL ".join(rows)
    return f"""
SELECT value_name, percent_value, count_value,
       coalesce(CAST(CAST(count_value AS DOUBLE) AS VARCHAR), 'nan') || '(' ||
       coalesce(CAST(percent_value AS VARCHAR), 'nan') || '%)' AS count_percent
FROM (WITH src AS (SELECT age, sex, race_ethnicity FROM {source})
{body})"""


oracle("cohort_summary", _summary("cases"))
oracle("cohort_summary_negative", _summary("negatives"))
oracle("cohort_summary_positive", _summary("positives"))
oracle("cohort_summary_2a", _summary("positive_facts WHERE (dx = 1 OR clinic = 1) AND age >= 18"))
oracle("cohort_summary_2b", _summary("positive_facts WHERE (dx = 1 OR clinic = 1 OR phenotype = 1) AND age >= 18"))
oracle("person_summary", _summary("person"))
oracle("category_share", """
SELECT sex, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM person)::DOUBLE, 2) AS percent_of_total
FROM person GROUP BY sex""")

CTES["race_flags"] = """
SELECT person_id, race_ethnicity,
       CASE WHEN race_ethnicity IN ('BUILDING') THEN 1 ELSE 0 END AS race_building,
       CASE WHEN race_ethnicity IN ('HOUSEHOLD') THEN 1 ELSE 0 END AS race_household,
       CASE WHEN race_ethnicity IN ('MACHINERY') THEN 1 ELSE 0 END AS race_machinery,
       CASE WHEN race_ethnicity IN ('AUTOMOBILE', 'FURNITURE') THEN 1 ELSE 0 END AS race_other
FROM person"""

_AGE_GROUPS = """
       CASE WHEN {a}age BETWEEN 0 AND 45 THEN 1 ELSE 0 END AS age_under45,
       CASE WHEN {a}age BETWEEN 46 AND 65 THEN 1 ELSE 0 END AS age_46to65,
       CASE WHEN {a}age > 66 THEN 1 ELSE 0 END AS age_66plus"""
_BARE = ", ".join(f"f.{c}{CONDITION_SUFFIX} AS {c}" for c in CONDITIONS)
for _name, _pred in (("features_a", "f.dx = 1 OR f.clinic = 1"),
                     ("features_b", "f.dx = 1 OR f.clinic = 1 OR f.phenotype = 1")):
    CTES[_name] = f"""
SELECT f.person_id, {_BARE}, f.vaccine_doses, f.hospitalised, f.death,
       r.race_building, r.race_household, r.race_machinery, r.race_other, {_AGE_GROUPS.format(a='f.')},
       CASE WHEN f.sex = 'MALE' THEN 1 ELSE 0 END AS male
FROM positive_facts f JOIN race_flags r ON r.person_id = f.person_id WHERE ({_pred}) AND f.age >= 18"""

CTES["arm_rows"] = f"""
SELECT s.person_id, s.index_date, s.case_arm, s.positive_arm, s.negative_arm,
       CASE WHEN d.person_id IS NULL THEN 0 ELSE 1 END AS death, d.death_date,
       CAST(date_diff('day', s.index_date, coalesce(d.death_date, DATE '{STUDY_CUTOFF}')) AS INT) AS duration
FROM (SELECT person_id, index_date, 1 AS case_arm, 0 AS positive_arm, 0 AS negative_arm FROM cases
      UNION ALL SELECT person_id, index_date, 0, 1, 0 FROM positives
      UNION ALL SELECT person_id, index_date, 0, 0, 1 FROM negatives) s
LEFT JOIN deaths d ON d.person_id = s.person_id
WHERE date_diff('day', s.index_date, coalesce(d.death_date, DATE '{STUDY_CUTOFF}')) >= 0"""

CTES["km_rows"] = """
SELECT arm, duration, died, at_risk,
       CASE WHEN max(CASE WHEN died = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0
            ELSE exp(sum(CASE WHEN died < at_risk THEN ln(1 - died::DOUBLE / at_risk) ELSE 0 END) OVER w) END AS survival,
       sum(CASE WHEN died < at_risk THEN died::DOUBLE / (at_risk::DOUBLE * (at_risk - died)) ELSE 0 END) OVER w AS greenwood
FROM (SELECT arm, duration, died,
             CAST(sum(n) OVER (PARTITION BY arm ORDER BY duration DESC) AS BIGINT) AS at_risk
      FROM (SELECT CASE WHEN case_arm = 1 THEN 'case' WHEN positive_arm = 1 THEN 'positive' ELSE 'negative' END AS arm,
                   duration, count(CASE WHEN death = 1 THEN 1 END) AS died, count(*) AS n
            FROM arm_rows GROUP BY ALL))
WINDOW w AS (PARTITION BY arm ORDER BY duration)"""

oracle("age_buckets", """
SELECT person_id, age, CASE WHEN age < 1 THEN 1 ELSE 0 END AS age_lt1,
       CASE WHEN age BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS age_1to4,
       CASE WHEN age BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS age_5to9,
       CASE WHEN age BETWEEN 10 AND 15 THEN 1 ELSE 0 END AS age_10to15,
       CASE WHEN age BETWEEN 16 AND 20 THEN 1 ELSE 0 END AS age_16to20,
       CASE WHEN age BETWEEN 21 AND 45 THEN 1 ELSE 0 END AS age_21to45,
       CASE WHEN age BETWEEN 46 AND 65 THEN 1 ELSE 0 END AS age_46to65,
       CASE WHEN age > 66 THEN 1 ELSE 0 END AS age_gt66
FROM person""")
oracle("age_groups", f"SELECT person_id, age, {_AGE_GROUPS.format(a='')} FROM person")
oracle("one_hot", "SELECT * FROM race_flags")
oracle("race_recode", """
SELECT person_id, CASE race_ethnicity WHEN 'BUILDING' THEN 'Construction' WHEN 'HOUSEHOLD' THEN 'Household'
       WHEN 'MACHINERY' THEN 'Machines' ELSE 'Other' END AS race,
       CASE WHEN sex = 'MALE' THEN 1 ELSE 0 END AS male
FROM person""")
oracle("feature_table_2a", "SELECT * FROM features_a")
oracle("feature_table_2b", "SELECT * FROM features_b")
_NUMERIC = (*CONDITIONS, "vaccine_doses", "hospitalised", "race_building", "race_household", "race_machinery",
            "race_other", "age_under45", "age_46to65", "age_66plus", "male")
oracle("mean_impute", "SELECT person_id, death, " + ", ".join(
    f"round(coalesce({c}::DOUBLE, avg({c}) OVER ()), 6) AS {c}" for c in _NUMERIC) + " FROM features_a")
oracle("complete_cases", "SELECT person_id, death FROM features_b WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in _NUMERIC))
oracle("fill_mean", "SELECT person_id, round(coalesce(age::DOUBLE, avg(age) OVER ()), 6) AS age FROM person")

_CORR = ("vaccine_doses", "morbid_obesity", "dx", "clinic", "phenotype", "hospitalised", "death")
for _name, _keep in (("corr_matrix", lambda i, j: True), ("corr_matrix_triangle", lambda i, j: i > j)):
    oracle(_name, "\nUNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr({a}, {b}), 6) AS r FROM positive_facts"
        for i, a in enumerate(_CORR) for j, b in enumerate(_CORR) if _keep(i, j)))

oracle("survival_target", "SELECT * FROM arm_rows")
oracle("km_curve", "SELECT arm, duration, died, at_risk, round(survival, 6) AS survival FROM km_rows")
oracle("km_band", """
SELECT arm, duration, died, at_risk, round(survival, 6) AS survival,
  round(CASE WHEN survival > 0 AND survival < 1 THEN
        exp(-exp(ln(-ln(survival)) + 1.959963984540054 * sqrt(greenwood) / abs(ln(survival)))) END, 6) AS lower95,
  round(CASE WHEN survival > 0 AND survival < 1 THEN
        exp(-exp(ln(-ln(survival)) - 1.959963984540054 * sqrt(greenwood) / abs(ln(survival)))) END, 6) AS upper95
FROM km_rows""")

CTES["scored"] = """
SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
       round(o_totalprice / 500000, 3) AS score
FROM orders"""

CTES["folds"] = """
SELECT row_id, y, score, repeat,
       CAST((row_number() OVER (PARTITION BY repeat, y ORDER BY md5('42|' || repeat || '|' || row_id), row_id) - 1) % 5 AS INT) AS fold
FROM scored, (SELECT unnest([0, 1, 2, 3, 4]) AS repeat)"""

CTES["score_rows"] = """
SELECT score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
       CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg
FROM (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
      FROM scored GROUP BY score)
WINDOW w AS (ORDER BY score DESC)"""

CTES["fold_rows"] = """
SELECT repeat, fold, score, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
       CAST(sum(pos) OVER g AS BIGINT) AS n_pos, CAST(sum(neg) OVER g AS BIGINT) AS n_neg
FROM (SELECT repeat, fold, score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
      FROM folds GROUP BY ALL)
WINDOW w AS (PARTITION BY repeat, fold ORDER BY score DESC), g AS (PARTITION BY repeat, fold)"""

CTES["fold_areas"] = """
SELECT repeat, fold, sum(pos::DOUBLE * (n_neg - fp + neg / 2.0)) / max(n_pos) / max(n_neg) AS auc
FROM fold_rows GROUP BY repeat, fold"""

CTES["fold_points"] = """
SELECT repeat, fold, fp::DOUBLE / n_neg AS fpr, tp::DOUBLE / n_pos AS tpr FROM fold_rows
UNION ALL SELECT DISTINCT repeat, fold, 0.0, 0.0 FROM fold_rows"""

CTES["grid_values"] = """
SELECT repeat, fold, step, x,
       CASE WHEN step = 0 THEN 0.0 WHEN r.tpr IS NULL THEN l.tpr
            ELSE l.tpr + (x - l.fpr) * (r.tpr - l.tpr) / (r.fpr - l.fpr) END AS tpr
FROM (SELECT p.repeat, p.fold, g.step, g.x,
             max(CASE WHEN p.fpr <= g.x THEN {'fpr': p.fpr, 'tpr': p.tpr} END) AS l,
             min(CASE WHEN p.fpr > g.x THEN {'fpr': p.fpr, 'tpr': p.tpr} END) AS r
      FROM fold_points p, (SELECT CAST(i AS INT) AS step, i / 99.0::DOUBLE AS x FROM range(100) t(i)) g
      GROUP BY ALL)"""

oracle("holdout_split", """
SELECT o_orderkey AS row_id,
       CASE WHEN ('0x' || substr(md5('42|' || o_orderkey), 1, 13))::BIGINT < CAST(floor(0.2 * 4503599627370496) AS BIGINT)
            THEN 1 ELSE 0 END AS is_test
FROM orders""")
oracle("stratified_folds", "SELECT row_id, y, repeat, fold FROM folds")
oracle("roc_curve", """
SELECT score AS threshold, round(fp::DOUBLE / n_neg, 6) AS fpr, round(tp::DOUBLE / n_pos, 6) AS tpr FROM score_rows
UNION ALL SELECT max(score) + 1, 0.0, 0.0 FROM score_rows""")
oracle("roc_auc", """
SELECT round(sum(pos::DOUBLE * (n_neg - fp + neg / 2.0)) / max(n_pos) / max(n_neg), 6) AS auc FROM score_rows""")
oracle("pr_curve", """
SELECT score AS threshold, round(tp::DOUBLE / n_pos, 6) AS recall, round(tp::DOUBLE / (tp + fp), 6) AS precision
FROM score_rows UNION ALL SELECT NULL, 0.0, 1.0""")
_SWEEP = """SELECT score AS threshold, (tp - pos)::DOUBLE / n_pos AS recall,
       coalesce(2.0 * (tp - pos) / nullif(tp - pos + fp - neg + n_pos, 0), 0.0)::DOUBLE AS f1 FROM score_rows"""
oracle("threshold_sweep", f"SELECT threshold, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_SWEEP})")
oracle("best_threshold", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS metric, threshold, round({m}, 6) AS value FROM ({_SWEEP}) ORDER BY {m} DESC, threshold LIMIT 1)"
    for m in ("recall", "f1")))
oracle("confusion_matrix", " UNION ALL ".join(
    f"SELECT {a} AS actual, {p} AS predicted, count(*) AS n FROM scored WHERE y = {a} AND (score >= 0.132) = {bool(p)}"
    for a in (0, 1) for p in (0, 1)))
oracle("recall_at_cutoff", """
SELECT round(count(CASE WHEN y = 1 AND score >= 0.132 THEN 1 END)::DOUBLE / count(CASE WHEN y = 1 THEN 1 END), 6) AS recall
FROM scored""")
oracle("fold_auc", "SELECT repeat, fold, round(auc, 6) AS auc FROM fold_areas")
oracle("auc_stats", """
SELECT count(*) AS folds, round(avg(auc), 6) AS avg_auc, round(stddev_pop(auc), 6) AS std_auc,
       round(stddev_pop(auc) / sqrt(count(*)), 6) AS std_error,
       round(1.96 * stddev_pop(auc) / sqrt(count(*)), 6) AS half_interval
FROM fold_areas""")
oracle("mean_roc", """
SELECT step, round(fpr, 6) AS fpr, round(mean_tpr, 6) AS mean_tpr, round(std_tpr, 6) AS std_tpr,
       round(greatest(least(mean_tpr - std_tpr, 1), 0), 6) AS lower, round(greatest(least(mean_tpr + std_tpr, 1), 0), 6) AS upper,
       round((SELECT sum(a) FROM (SELECT (x - lag(x) OVER (ORDER BY step)) * (m + lag(m) OVER (ORDER BY step)) / 2 AS a
              FROM (SELECT step, x, CASE WHEN step = 99 THEN 1.0 ELSE avg(tpr) END AS m FROM grid_values GROUP BY step, x))), 6) AS mean_auc
FROM (SELECT step, x AS fpr, CASE WHEN step = 99 THEN 1.0 ELSE avg(tpr) END AS mean_tpr, stddev_pop(tpr) AS std_tpr
      FROM grid_values GROUP BY step, x)""")

_ELIGIBLE = ("c.site_id = t.site_id AND abs(c.age - t.age) <= 10 AND abs(c.index_day - t.index_day) <= 45 "
             "AND abs(c.log_visit_rate - t.log_visit_rate) <= 1")
_LOWER = "(c.distance < t.distance OR (c.distance = t.distance AND c.h < t.h))"
# Nearest first; equal distances by hash distance for equal scores, else the lower score, then towards the unit.
_NEAREST = f"""{{'gap': abs(c.distance - t.distance),
  'tie': CASE WHEN c.distance = t.distance THEN abs(c.h - t.h) WHEN {_LOWER} THEN 0 ELSE 1 END,
  'walk': CASE WHEN {_LOWER} THEN -c.h ELSE c.h END}}"""


def _units(pre: str) -> str:
    return f"""
SELECT *, (index_day + 3 * age)::DOUBLE AS distance, ('0x' || substr(md5(person_id::VARCHAR), 1, 13))::BIGINT AS h
FROM {pre}"""


for _arm in ("pos", "neg"):
    CTES[f"units_{_arm}"] = _units(f"pre_match_{_arm}")
    CTES[f"queue_{_arm}"] = f"""
SELECT *, row_number() OVER (ORDER BY distance DESC, person_id) AS k FROM units_{_arm} WHERE is_case = 1"""
    # One treated unit per step, in order, over the controls not used so far.
    CTES[f"greedy_{_arm}"] = f"""
SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS treated_id, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS control_id
UNION ALL
SELECT s.k + 1, any_value(t.person_id), any_value(list_append(s.used, coalesce(s.control_id, -1))),
       arg_min(c.person_id, {_NEAREST})
FROM greedy_{_arm} s JOIN queue_{_arm} t ON t.k = s.k + 1
LEFT JOIN (SELECT * FROM units_{_arm} WHERE is_case = 0) c
  ON {_ELIGIBLE} AND NOT list_contains(s.used, c.person_id) AND c.person_id IS DISTINCT FROM s.control_id
GROUP BY s.k"""
    CTES[f"pairs_{_arm}"] = f"""
SELECT g.treated_id, g.control_id, abs(t.distance - c.distance) AS gap
FROM greedy_{_arm} g JOIN units_{_arm} t ON t.person_id = g.treated_id JOIN units_{_arm} c ON c.person_id = g.control_id"""

CTES["kept_cases"] = """
SELECT person_id, index_date FROM cases
WHERE person_id IN (SELECT treated_id FROM pairs_pos) AND person_id IN (SELECT treated_id FROM pairs_neg)"""
CTES["kept_pos"] = """
SELECT p.control_id AS person_id, p.treated_id AS subclass, u.index_date, u.distance
FROM pairs_pos p JOIN units_pos u ON u.person_id = p.control_id WHERE p.treated_id IN (SELECT person_id FROM kept_cases)"""
CTES["kept_neg"] = """
SELECT p.control_id AS person_id, p.treated_id AS subclass, u.index_date, u.distance
FROM pairs_neg p JOIN units_neg u ON u.person_id = p.control_id WHERE p.treated_id IN (SELECT person_id FROM kept_cases)"""
CTES["cohort_rows"] = """
SELECT s.person_id, s.index_date, s.case_arm, s.positive_arm, s.negative_arm, f.death, coalesce(f.morbid_obesity, 0) AS morbid_obesity,
       f.vaccine_doses, f.observation_before, f.visits_before, c.comorbidity_score,
       (30.0 * f.visits_before / nullif(f.observation_before, 0))::DOUBLE AS rate
FROM (SELECT person_id, index_date, 1 AS case_arm, 0 AS positive_arm, 0 AS negative_arm FROM kept_cases
      UNION ALL SELECT person_id, index_date, 0, 1, 0 FROM kept_pos) s
JOIN positive_facts f ON f.person_id = s.person_id LEFT JOIN cci_pos c ON c.person_id = s.person_id
UNION ALL
SELECT s.person_id, s.index_date, 0, 0, 1, f.death, coalesce(f.morbid_obesity, 0), f.vaccine_doses, h.observation_before,
       h.visits_before, c.comorbidity_score, (30.0 * h.visits_before / nullif(h.observation_before, 0))::DOUBLE
FROM kept_neg s JOIN all_facts f ON f.person_id = s.person_id LEFT JOIN cci_all c ON c.person_id = s.person_id
LEFT JOIN history_neg h ON h.person_id = s.person_id"""

for _name, _arm in (("match_pairs_positive", "pos"), ("match_pairs_negative", "neg"),
                    ("match_pairs_positive_chunked", "pos"), ("match_pairs_negative_chunked", "neg")):
    oracle(_name, f"SELECT treated_id, control_id, gap FROM pairs_{_arm}")
oracle("nearest_control", f"""
SELECT t.person_id AS treated_id, arg_min(c.person_id, {_NEAREST}) AS control_id, min(abs(c.distance - t.distance)) AS gap
FROM queue_neg t JOIN (SELECT * FROM units_neg WHERE is_case = 0) c ON {_ELIGIBLE}
GROUP BY t.person_id""")
oracle("matched_data", """
SELECT u.person_id, u.site_id, u.age, u.index_date, u.is_case, u.index_day, u.distance, 1.0::DOUBLE AS weights, p.treated_id AS subclass
FROM pairs_neg p JOIN units_neg u ON (u.is_case = 1 AND u.person_id = p.treated_id) OR (u.is_case = 0 AND u.person_id = p.control_id)""")
oracle("matched_cases", "SELECT * FROM kept_cases")
oracle("matched_controls", """
SELECT person_id, subclass, index_date, distance, 'positive' AS arm FROM kept_pos
UNION ALL SELECT person_id, subclass, index_date, distance, 'negative' AS arm FROM kept_neg""")
oracle("matched_disjoint", """
SELECT 'case|positive' AS pair, count(*) AS n FROM kept_cases JOIN kept_pos USING (person_id)
UNION ALL SELECT 'case|negative', count(*) FROM kept_cases JOIN kept_neg USING (person_id)
UNION ALL SELECT 'positive|negative', count(*) FROM kept_pos JOIN kept_neg USING (person_id)""")
oracle("analysis_cohort", """
SELECT person_id, index_date, case_arm, positive_arm, negative_arm, death, morbid_obesity, vaccine_doses, observation_before,
       visits_before, comorbidity_score, round(coalesce(rate, avg(rate) OVER ()), 6) AS visit_rate
FROM cohort_rows""")

CTES["whole_cohort"] = """
SELECT s.person_id, s.index_date, s.case_arm, s.positive_arm, s.negative_arm, f.death, coalesce(f.morbid_obesity, 0) AS morbid_obesity,
       f.vaccine_doses, f.observation_before, f.visits_before, c.comorbidity_score,
       (30.0 * f.visits_before / nullif(f.observation_before, 0))::DOUBLE AS rate
FROM (SELECT person_id, index_date, 1 AS case_arm, 0 AS positive_arm, 0 AS negative_arm FROM cases
      UNION ALL SELECT person_id, index_date, 0, 1, 0 FROM positives) s
JOIN positive_facts f ON f.person_id = s.person_id LEFT JOIN cci_pos c ON c.person_id = s.person_id
UNION ALL
SELECT s.person_id, s.index_date, 0, 0, 1, s.death, coalesce(s.morbid_obesity, 0), s.vaccine_doses, s.observation_before,
       s.visits_before, c.comorbidity_score, (30.0 * s.visits_before / nullif(s.observation_before, 0))::DOUBLE
FROM negatives s LEFT JOIN cci_all c ON c.person_id = s.person_id"""

oracle("analysis_cohort_unmatched", """
SELECT person_id, index_date, case_arm, positive_arm, negative_arm, death, morbid_obesity, vaccine_doses, observation_before,
       visits_before, comorbidity_score, round(coalesce(rate, avg(rate) OVER ()), 6) AS visit_rate
FROM whole_cohort""")
_COHORT_CORR = ("comorbidity_score", "morbid_obesity", "case_arm", "positive_arm", "negative_arm", "vaccine_doses", "death")
oracle("corr_matrix_cohort", "\nUNION ALL ".join(
    f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr({a}, {b}), 6) AS r FROM whole_cohort"
    for i, a in enumerate(_COHORT_CORR) for b in _COHORT_CORR[:i]))
# A 0/1 predictor has a closed form: log odds from the two-by-two table.
oracle("odds_ratio_single", """
SELECT term, round(exp(b), 6) AS estimate, round(se, 6) AS std_error, round(b / se, 6) AS statistic,
       round(exp(b - 1.959963984540054 * se), 6) AS conf_low, round(exp(b + 1.959963984540054 * se), 6) AS conf_high
FROM (
  SELECT '(Intercept)' AS term, ln(d0 / a0) AS b, sqrt(1 / d0 + 1 / a0) AS se FROM cells
  UNION ALL SELECT 'morbid_obesity', ln(d1 / a1) - ln(d0 / a0), sqrt(1 / d0 + 1 / a0 + 1 / d1 + 1 / a1) FROM cells)
""".replace("FROM cells", """FROM (
    SELECT count(CASE WHEN morbid_obesity = 0 AND death = 1 THEN 1 END)::DOUBLE AS d0,
           count(CASE WHEN morbid_obesity = 0 AND death = 0 THEN 1 END)::DOUBLE AS a0,
           count(CASE WHEN morbid_obesity = 1 AND death = 1 THEN 1 END)::DOUBLE AS d1,
           count(CASE WHEN morbid_obesity = 1 AND death = 0 THEN 1 END)::DOUBLE AS a1 FROM whole_cohort)"""))

oracle("logistic_features", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n_known FROM features_a" for c in (
        *CONDITIONS, "vaccine_doses", "hospitalised", "race_building", "race_household", "race_machinery", "race_other",
        "age_under45", "age_46to65", "age_66plus", "male")))

CTES["cells"] = """
SELECT count(CASE WHEN morbid_obesity = 0 AND death = 1 THEN 1 END)::DOUBLE AS d0,
       count(CASE WHEN morbid_obesity = 0 AND death = 0 THEN 1 END)::DOUBLE AS a0,
       count(CASE WHEN morbid_obesity = 1 AND death = 1 THEN 1 END)::DOUBLE AS d1,
       count(CASE WHEN morbid_obesity = 1 AND death = 0 THEN 1 END)::DOUBLE AS a1 FROM whole_cohort"""
CTES["wald_rows"] = """
SELECT '(Intercept)' AS term, ln(d0 / a0) AS b, sqrt(1 / d0 + 1 / a0) AS se, d0, a0, d1, a1 FROM cells
UNION ALL SELECT 'morbid_obesity', ln(d1 / a1) - ln(d0 / a0), sqrt(1 / d0 + 1 / a0 + 1 / d1 + 1 / a1), d0, a0, d1, a1 FROM cells"""

oracle("odds_ratio_table_single", """
SELECT term, round(exp(b), 6) AS estimate, round(exp(b - 1.959963984540054 * se), 6) AS conf_low,
       round(exp(b + 1.959963984540054 * se), 6) AS conf_high,
       CASE WHEN abs(b / se) > 1.959963984540054 THEN 'Significant' ELSE 'Non-Significant' END AS significance
FROM wald_rows WHERE exp(b + 1.959963984540054 * se) <= 1""")
# Profile limits of a two-by-two table by bisection. With the slope fixed the intercept solves a quadratic in
# its exponential u; with the intercept fixed the slope fits its own group exactly.
oracle("odds_ratio_single_profile", """
SELECT term, round(exp(any_value(b)), 6) AS estimate, round(any_value(se), 6) AS std_error,
       round(exp(max(CASE WHEN side = -1 THEN far END)), 6) AS conf_low,
       round(exp(max(CASE WHEN side = 1 THEN far END)), 6) AS conf_high, 'profile' AS conf_method
FROM (
  WITH RECURSIVE search AS (
    SELECT term, b, se, d0, a0, d1, a1, side, b AS near, b + side * 40.0 AS far, 0 AS step FROM wald_rows, (VALUES (-1), (1)) s(side)
    UNION ALL
    SELECT term, b, se, d0, a0, d1, a1, side, CASE WHEN rise < 3.841458820694124 THEN mid ELSE near END,
           CASE WHEN rise < 3.841458820694124 THEN far ELSE mid END, step + 1
    FROM (
      SELECT *, CASE WHEN term = '(Intercept)' THEN 2 * ((d0 + a0) * ln(1 + exp(mid)) - d0 * mid - (d0 + a0) * ln((d0 + a0) / a0) + d0 * ln(d0 / a0))
                ELSE 2 * ((d0 + a0) * ln(1 + u) - d0 * ln(u) + (d1 + a1) * ln(1 + u * e) - d1 * ln(u * e)
                          - (d0 + a0) * ln((d0 + a0) / a0) + d0 * ln(d0 / a0) - (d1 + a1) * ln((d1 + a1) / a1) + d1 * ln(d1 / a1)) END AS rise
      FROM (
        SELECT *, (-q + sqrt(q * q + 4 * e * (a0 + a1) * (d0 + d1))) / (2 * e * (a0 + a1)) AS u
        FROM (
          SELECT *, (near + far) / 2 AS mid, exp((near + far) / 2) AS e,
                 (d1 + a1) * exp((near + far) / 2) + d0 + a0 - (d0 + d1) * (1 + exp((near + far) / 2)) AS q
          FROM search WHERE step < 80)))
  ) SELECT * FROM search WHERE step = 80)
GROUP BY term""")

_COEFFICIENTS = {"comorbidity_score": 0.3, "case_arm": 0.8, "positive_arm": -0.2, "negative_arm": -0.6, "vaccine_doses": -0.1}
CTES["known_cohort"] = "SELECT * FROM whole_cohort WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _COEFFICIENTS)
CTES["given_attribution"] = "\nUNION ALL ".join(
    f"SELECT person_id, '{c}' AS feature, {c}::DOUBLE AS value, {w} * ({c} - avg({c}) OVER ()) AS attribution FROM known_cohort"
    for c, w in _COEFFICIENTS.items())
oracle("attribution_given", "SELECT person_id, feature, value, round(attribution, 6) AS attribution FROM given_attribution")
oracle("attribution_summary_given", """
SELECT feature, round(avg(abs(attribution)), 6) AS mean_abs,
       CASE WHEN corr(attribution, value) > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM given_attribution GROUP BY feature""")
oracle("attribution_quantiles_given", """
SELECT feature, round(mean_abs, 6) AS mean_abs, q AS quantile, round(list_sort(a)[greatest(1, ceil(q * len(a)))::INT], 6) AS attribution,
       list_sort(v)[greatest(1, ceil(q * len(v)))::INT] AS value
FROM (SELECT feature, avg(abs(attribution)) AS mean_abs, list(attribution) AS a, list(value) AS v
      FROM given_attribution GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 4),
     (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(q)""")

oracle("attribution_scatter_given", """
SELECT feature, round(mean_abs, 6) AS mean_abs, bin, n, low, high, q AS quantile,
       round(list_sort(a)[greatest(1, ceil(q * len(a)))::INT], 6) AS attribution
FROM (SELECT feature, any_value(mean_abs) AS mean_abs, bin, count(*) AS n, min(value) AS low, max(value) AS high, list(attribution) AS a
      FROM (SELECT g.feature, value, attribution, mean_abs,
                   CASE WHEN value IS NOT NULL THEN len(list_filter(cuts, lambda c: c < value)) END AS bin
            FROM given_attribution g JOIN (
                SELECT feature, mean_abs, list_transform(range(1, 8), lambda i: v[greatest(1, ceil(i / 8.0 * len(v)))::INT]) AS cuts
                FROM (SELECT feature, avg(abs(attribution)) AS mean_abs, list_sort(list(value)) AS v
                      FROM given_attribution GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 4)) f ON g.feature = f.feature)
      GROUP BY feature, bin),
     (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) t(q)""")

CTES["given_importance"] = """
SELECT o_orderkey % 5 AS repeat, (o_orderkey // 5) % 5 AS fold, 'f' || (o_custkey % 60) AS feature,
       sum(o_totalprice)::DOUBLE / sum(sum(o_totalprice)) OVER (PARTITION BY o_orderkey % 5, (o_orderkey // 5) % 5)::DOUBLE AS importance
FROM orders GROUP BY 1, 2, 3"""
oracle("importance_by_fold_given", "SELECT feature, " + ", ".join(
    f"round(max(CASE WHEN repeat * 5 + fold = {i} THEN importance END), 6) AS importance{i}" for i in range(25)
) + " FROM given_importance GROUP BY feature")
oracle("importance_mean_given", """
SELECT feature, round(avg(importance), 6) AS mean_importance FROM given_importance GROUP BY feature
ORDER BY avg(importance) DESC, feature LIMIT 50""")
oracle("importance_top_given", """
SELECT feature, round(importance, 6) AS importance FROM given_importance WHERE repeat = 0 AND fold = 0
ORDER BY given_importance.importance DESC, feature LIMIT 50""")

# The same steps over the matched arms.
oracle("corr_matrix_matched", "\nUNION ALL ".join(
    f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr({a}, {b}), 6) AS r FROM cohort_rows"
    for i, a in enumerate(_COHORT_CORR) for b in _COHORT_CORR[:i]))
CTES["matched_cells"] = """
SELECT count(CASE WHEN case_arm = 0 AND death = 1 THEN 1 END)::DOUBLE AS d0, count(CASE WHEN case_arm = 0 AND death = 0 THEN 1 END)::DOUBLE AS a0,
       count(CASE WHEN case_arm = 1 AND death = 1 THEN 1 END)::DOUBLE AS d1, count(CASE WHEN case_arm = 1 AND death = 0 THEN 1 END)::DOUBLE AS a1
FROM cohort_rows"""
oracle("odds_ratio_matched", """
SELECT term, round(exp(b), 6) AS estimate, round(se, 6) AS std_error,
       round(exp(b - 1.959963984540054 * se), 6) AS conf_low, round(exp(b + 1.959963984540054 * se), 6) AS conf_high
FROM (SELECT '(Intercept)' AS term, ln(d0 / nullif(a0, 0)) AS b, sqrt(1 / nullif(d0, 0) + 1 / nullif(a0, 0)) AS se FROM matched_cells
      UNION ALL SELECT 'case_arm', ln(d1 / nullif(a1, 0)) - ln(d0 / nullif(a0, 0)), sqrt(1 / nullif(d0, 0) + 1 / nullif(a0, 0) + 1 / nullif(d1, 0) + 1 / nullif(a1, 0)) FROM matched_cells)""")
CTES["matched_rows"] = f"""
SELECT s.person_id, s.case_arm, s.positive_arm, s.death,
       CAST(date_diff('day', s.index_date, CASE WHEN s.death = 1 THEN d.death_date ELSE DATE '{STUDY_CUTOFF}' END) AS INT) AS duration
FROM cohort_rows s LEFT JOIN (SELECT person_id, min(death_date) AS death_date FROM deaths GROUP BY person_id) d ON d.person_id = s.person_id
WHERE date_diff('day', s.index_date, CASE WHEN s.death = 1 THEN d.death_date ELSE DATE '{STUDY_CUTOFF}' END) >= 0"""
CTES["matched_km_rows"] = CTES["km_rows"].replace("FROM arm_rows", "FROM matched_rows")
oracle("km_curve_matched", "SELECT arm, duration, died, at_risk, round(survival, 6) AS survival FROM matched_km_rows")
