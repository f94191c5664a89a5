"""DuckDB SQL of the stand-in survey, the occupation index and the analysis table."""

SURVEY = """
WITH c AS (
  SELECT o_orderkey * 7919 AS k, o_orderkey AS respondent_id, o_custkey,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN FLOOR(l_quantity / 10) END), 0) AS BIGINT) AS r_f2f_0_4,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber IN (2, 3) THEN FLOOR(l_quantity / 10) END), 0) AS BIGINT) AS r_f2f_5_17,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber IN (4, 5, 6) THEN FLOOR(l_quantity / 10) END), 0) AS BIGINT) AS r_f2f_18_69,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN FLOOR(l_quantity / 10) END), 0) AS BIGINT) AS r_f2f_70,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN FLOOR(l_quantity / 25) END), 0) AS BIGINT) AS r_phys_0_4,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'A' AND l_linenumber IN (2, 3) THEN FLOOR(l_quantity / 25) END), 0) AS BIGINT) AS r_phys_5_17,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'A' AND l_linenumber IN (4, 5, 6) THEN FLOOR(l_quantity / 25) END), 0) AS BIGINT) AS r_phys_18_69,
    CAST(COALESCE(SUM(CASE WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN FLOOR(l_quantity / 25) END), 0) AS BIGINT) AS r_phys_70
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey)
SELECT respondent_id,
  CAST(1 + k % 2 AS INT) AS generation,
  CAST(2020 AS INT) AS survey_year,
  CAST(CASE WHEN k % 211 = 0 THEN -1 WHEN k % 39 < 22 THEN 4 ELSE 5 END AS INT) AS survey_month,
  CAST(CASE WHEN k % 39 < 22 THEN 9 + k % 39 ELSE k % 39 - 21 END AS INT) AS survey_day,
  CAST(CASE WHEN k % 101 = 0 THEN -11 ELSE 18 + (o_custkey * 37) % 72 END AS INT) AS age_years,
  CAST(CASE WHEN k % 389 = 0 THEN NULL ELSE 1 + (k % 5) % 2 END AS INT) AS sex,
  CASE WHEN (k + 1*104729) % 97 = 0 THEN -9 WHEN (k + 1*104729) % 97 = 1 THEN -1 WHEN (k + 1*104729) % 97 = 2 THEN -10 WHEN (k + 1*104729) % 97 = 3 THEN -11 ELSE r_f2f_0_4 END AS f2f_0_4,
  CASE WHEN (k + 2*104729) % 97 = 0 THEN -9 WHEN (k + 2*104729) % 97 = 1 THEN -1 WHEN (k + 2*104729) % 97 = 2 THEN -10 WHEN (k + 2*104729) % 97 = 3 THEN -11 ELSE r_f2f_5_17 END AS f2f_5_17,
  CASE WHEN (k + 3*104729) % 97 = 0 THEN -9 WHEN (k + 3*104729) % 97 = 1 THEN -1 WHEN (k + 3*104729) % 97 = 2 THEN -10 WHEN (k + 3*104729) % 97 = 3 THEN -11 ELSE r_f2f_18_69 END AS f2f_18_69,
  CASE WHEN (k + 4*104729) % 97 = 0 THEN -9 WHEN (k + 4*104729) % 97 = 1 THEN -1 WHEN (k + 4*104729) % 97 = 2 THEN -10 WHEN (k + 4*104729) % 97 = 3 THEN -11 ELSE r_f2f_70 END AS f2f_70,
  CASE WHEN (k + 5*104729) % 97 = 0 THEN -9 WHEN (k + 5*104729) % 97 = 1 THEN -1 WHEN (k + 5*104729) % 97 = 2 THEN -10 WHEN (k + 5*104729) % 97 = 3 THEN -11 ELSE r_phys_0_4 END AS phys_0_4,
  CASE WHEN (k + 6*104729) % 97 = 0 THEN -9 WHEN (k + 6*104729) % 97 = 1 THEN -1 WHEN (k + 6*104729) % 97 = 2 THEN -10 WHEN (k + 6*104729) % 97 = 3 THEN -11 ELSE r_phys_5_17 END AS phys_5_17,
  CASE WHEN (k + 7*104729) % 97 = 0 THEN -9 WHEN (k + 7*104729) % 97 = 1 THEN -1 WHEN (k + 7*104729) % 97 = 2 THEN -10 WHEN (k + 7*104729) % 97 = 3 THEN -11 ELSE r_phys_18_69 END AS phys_18_69,
  CASE WHEN (k + 8*104729) % 97 = 0 THEN -9 WHEN (k + 8*104729) % 97 = 1 THEN -1 WHEN (k + 8*104729) % 97 = 2 THEN -10 WHEN (k + 8*104729) % 97 = 3 THEN -11 ELSE r_phys_70 END AS phys_70,
  CASE WHEN (k + 9*104729) % 97 = 0 THEN -9 WHEN (k + 9*104729) % 97 = 1 THEN -1 WHEN (k + 9*104729) % 97 = 2 THEN -10 WHEN (k + 9*104729) % 97 = 3 THEN -11 ELSE (k + 9) % 2 END AS hh_0_4,
  CASE WHEN (k + 10*104729) % 97 = 0 THEN -9 WHEN (k + 10*104729) % 97 = 1 THEN -1 WHEN (k + 10*104729) % 97 = 2 THEN -10 WHEN (k + 10*104729) % 97 = 3 THEN -11 ELSE (k + 10) % 3 END AS hh_5_17,
  CASE WHEN (k + 11*104729) % 97 = 0 THEN -9 WHEN (k + 11*104729) % 97 = 1 THEN -1 WHEN (k + 11*104729) % 97 = 2 THEN -10 WHEN (k + 11*104729) % 97 = 3 THEN -11 ELSE (k + 11) % 4 END AS hh_18_69,
  CASE WHEN (k + 12*104729) % 97 = 0 THEN -9 WHEN (k + 12*104729) % 97 = 1 THEN -1 WHEN (k + 12*104729) % 97 = 2 THEN -10 WHEN (k + 12*104729) % 97 = 3 THEN -11 ELSE (k + 12) % 2 END AS hh_70,
  CASE k % 29 WHEN 0 THEN -9 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS had_covid,
  CASE k % 43 WHEN 0 THEN -9999 WHEN 1 THEN -11 WHEN 2 THEN -10 WHEN 3 THEN -9 WHEN 4 THEN -1
    WHEN 5 THEN 9 WHEN 6 THEN 2 WHEN 7 THEN 2 WHEN 8 THEN 3 WHEN 9 THEN NULL WHEN 10 THEN 4 ELSE 1 END AS isolation,
  CASE k % 11 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN NULL ELSE 1 END AS hcw,
  CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN NULL ELSE 2 END AS keyworker,
  CAST(1111 + k % 397 * 20 AS INT) AS soc_code
FROM c
"""

SOC = """
SELECT CAST(1111 + p_partkey % 397 * 20 AS VARCHAR(4)) AS soc_code, MIN(p_type) AS soc_title
FROM part WHERE p_partkey % 397 % 5 <> 0 GROUP BY 1
"""

PEOPLE = """
SELECT *,
  CASE WHEN children_in_house = 'Children' THEN 'Yes' ELSE 'No' END AS Children,
  CASE WHEN household_size >= 5 THEN '5+' ELSE household_size::VARCHAR END AS household_size2,
  CASE WHEN household_size = 1 THEN 'Live alone' ELSE 'Multiple Occp' END AS alone
FROM (SELECT *,
  1 + COALESCE(h0, 0) + COALESCE(h1, 0) + COALESCE(h2, 0) + COALESCE(h3, 0) AS household_size,
  COALESCE(h0, 0) + COALESCE(h1, 0) AS N_0to17yo,
  CASE WHEN COALESCE(h0, 0) + COALESCE(h1, 0) > 0 THEN 'Children' ELSE 'No children' END AS children_in_house,
  total_face_to_face + total_physical AS total_contacts,
  GREATEST(total_face_to_face, total_physical) AS total_contactsLD,
  CASE WHEN DAYOFWEEK(date_ymd) IN (0, 6) THEN 'Weekend' WHEN date_ymd IS NOT NULL THEN 'Weekday' END AS weekday2,
  CASE WHEN DAYOFWEEK(date_ymd) IN (0, 1) THEN 'Weekend' WHEN date_ymd IS NOT NULL THEN 'Weekday' END AS yesterday2
FROM (SELECT respondent_id, generation, age_years, sex, had_covid, isolation, hcw, keyworker, soc_code,
  f2f_0_4, f2f_5_17, f2f_18_69, f2f_70, phys_0_4, phys_5_17, phys_18_69, phys_70, h0, h1, h2, h3,
  COALESCE(f2f_0_4, 0) + COALESCE(f2f_5_17, 0) + COALESCE(f2f_18_69, 0) + COALESCE(f2f_70, 0) AS total_face_to_face,
  COALESCE(phys_0_4, 0) + COALESCE(phys_5_17, 0) + COALESCE(phys_18_69, 0) + COALESCE(phys_70, 0) AS total_physical,
  COALESCE(f2f_0_4, 0) + COALESCE(phys_0_4, 0) AS total_0to4,
  COALESCE(f2f_5_17, 0) + COALESCE(phys_5_17, 0) AS total_5to17,
  COALESCE(f2f_18_69, 0) + COALESCE(phys_18_69, 0) AS total_18to69,
  COALESCE(f2f_70, 0) + COALESCE(phys_70, 0) AS total_70over,
  CASE WHEN survey_month BETWEEN 1 AND 12 THEN MAKE_DATE(survey_year, survey_month, survey_day) END AS date_ymd,
  CASE WHEN age_years BETWEEN 1 AND 4 THEN '0 - 4' WHEN age_years BETWEEN 5 AND 17 THEN '5 - 17'
    WHEN age_years BETWEEN 18 AND 69 THEN '18 - 69' WHEN age_years >= 70 THEN '70+' END AS age,
  CASE WHEN age_years BETWEEN 1 AND 4 THEN '0 - 4' WHEN age_years BETWEEN 5 AND 17 THEN '5 - 17'
    WHEN age_years BETWEEN 18 AND 29 THEN '18 - 29' WHEN age_years BETWEEN 30 AND 49 THEN '30 - 49'
    WHEN age_years BETWEEN 50 AND 69 THEN '50 - 69' WHEN age_years >= 70 THEN '70+' END AS age2,
  CASE WHEN age_years BETWEEN 1 AND 4 THEN '0 - 4' WHEN age_years BETWEEN 5 AND 17 THEN '5 - 17'
    WHEN age_years BETWEEN 18 AND 29 THEN '23 - 29' WHEN age_years BETWEEN 30 AND 39 THEN '30 - 39'
    WHEN age_years BETWEEN 40 AND 49 THEN '40 - 49' WHEN age_years BETWEEN 50 AND 59 THEN '50 - 59'
    WHEN age_years BETWEEN 60 AND 69 THEN '60 - 69' WHEN age_years >= 70 THEN '70+' END AS age3,
  CASE WHEN age_years BETWEEN 1 AND 49 THEN '0 - 49' WHEN age_years >= 50 THEN '50+' END AS age4,
  CASE WHEN hcw = 2 THEN 'HCW' WHEN keyworker = 1 THEN 'Keyworker'
    WHEN hcw IS NOT NULL AND keyworker IS NOT NULL THEN 'Other' END AS occupation,
  CASE WHEN hcw = 2 THEN 'HCW' WHEN keyworker = 1 THEN 'Keyworker'
    WHEN hcw IS NOT NULL AND keyworker IS NOT NULL THEN 'Other' END AS occupation2,
  CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS sex2,
  CASE isolation WHEN 1 THEN 'No' WHEN 2 THEN 'Yes, am now' WHEN 3 THEN 'Yes, but have stopped'
    WHEN 9 THEN 'Prefer not to say' WHEN -9999 THEN 'UNK' WHEN -11 THEN 'UNK' WHEN -10 THEN 'UNK'
    WHEN -9 THEN 'UNK' WHEN -1 THEN 'UNK' END AS selfisolation_un
FROM (SELECT * REPLACE (
    CASE WHEN f2f_0_4 NOT IN (-11, -10, -9, -1) THEN f2f_0_4 END AS f2f_0_4,
    CASE WHEN f2f_5_17 NOT IN (-11, -10, -9, -1) THEN f2f_5_17 END AS f2f_5_17,
    CASE WHEN f2f_18_69 NOT IN (-11, -10, -9, -1) THEN f2f_18_69 END AS f2f_18_69,
    CASE WHEN f2f_70 NOT IN (-11, -10, -9, -1) THEN f2f_70 END AS f2f_70,
    CASE WHEN phys_0_4 NOT IN (-11, -10, -9, -1) THEN phys_0_4 END AS phys_0_4,
    CASE WHEN phys_5_17 NOT IN (-11, -10, -9, -1) THEN phys_5_17 END AS phys_5_17,
    CASE WHEN phys_18_69 NOT IN (-11, -10, -9, -1) THEN phys_18_69 END AS phys_18_69,
    CASE WHEN phys_70 NOT IN (-11, -10, -9, -1) THEN phys_70 END AS phys_70), 
    CASE WHEN hh_0_4 NOT IN (-11, -10, -9, -1) THEN hh_0_4 END AS h0,
    CASE WHEN hh_5_17 NOT IN (-11, -10, -9, -1) THEN hh_5_17 END AS h1,
    CASE WHEN hh_18_69 NOT IN (-11, -10, -9, -1) THEN hh_18_69 END AS h2,
    CASE WHEN hh_70 NOT IN (-11, -10, -9, -1) THEN hh_70 END AS h3
  FROM survey WHERE age_years > 0 AND respondent_id <> 9142)))
"""
