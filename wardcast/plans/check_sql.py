"""The catalogue's queries in ANSI SQL, written independently of the operators, for checking results."""

from __future__ import annotations

RAW = """
raw AS (
  SELECT p.p_type AS DIAG_PRINC,
    CASE l.l_linenumber % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE p.p_brand END AS DIAG_SECUN,
    '35503' || CAST(s.s_nationkey % 10 AS VARCHAR) || CAST(l.l_linenumber % 10 AS VARCHAR) AS MUNIC_RES,
    CAST(CAST(l.l_quantity * 2 AS INTEGER) AS VARCHAR) AS IDADE,
    CASE l.l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '3' WHEN 'N' THEN '2' END AS SEXO,
    CAST(l.l_linenumber AS VARCHAR) AS DIAS_PERM,
    CAST(CAST(l.l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS VAL_TOT,
    CASE WHEN l.l_linestatus = 'F' THEN '1' ELSE '0' END AS MORTE,
    CAST(year(l.l_shipdate) AS VARCHAR) AS ANO_CMPT,
    CAST(month(l.l_shipdate) AS VARCHAR) AS MES_CMPT,
    CAST(l.l_suppkey AS VARCHAR) AS CNES,
    n.n_regionkey AS region
  FROM lineitem l
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

LABELS = """
labels(ord, diag_group, diag_label) AS (
  VALUES (1, 'PRO', 'Promotional'), (2, 'ECO', 'Economy'), (3, 'XXX', 'Not sold'), (4, 'STA', 'Standard')
)"""

BAND = """CASE WHEN CAST(IDADE AS DOUBLE) <= 0 THEN NULL WHEN CAST(IDADE AS DOUBLE) <= 59 THEN '<60'
      WHEN CAST(IDADE AS DOUBLE) <= 69 THEN '60-69' WHEN CAST(IDADE AS DOUBLE) <= 74 THEN '70-74'
      WHEN CAST(IDADE AS DOUBLE) <= 79 THEN '75-79' WHEN CAST(IDADE AS DOUBLE) <= 84 THEN '80-84'
      WHEN CAST(IDADE AS DOUBLE) <= 200 THEN '85+' END"""

IN_COHORT = "upper(substr({0}, 1, 3)) IN ('PRO', 'ECO', 'STA')"
PRINCIPAL = IN_COHORT.format("DIAG_PRINC")
SECONDARY = IN_COHORT.format("DIAG_SECUN")
IN_CITY = "substr(MUNIC_RES, 1, 6) = '355030'"

CLEAN = f"""{RAW}, {LABELS},
clean AS (
  SELECT r.DIAG_PRINC AS diag_code, r.DIAG_SECUN AS diag_secondary,
    upper(substr(r.DIAG_PRINC, 1, 3)) AS diag_group, l.diag_label,
    r.MUNIC_RES AS residence_code,
    CAST(r.ANO_CMPT AS INTEGER) AS year, CAST(r.MES_CMPT AS INTEGER) AS month,
    CAST(r.DIAS_PERM AS INTEGER) AS stay_days,
    CAST(r.VAL_TOT AS DECIMAL(15,2)) AS total_value,
    CAST(r.IDADE AS INTEGER) AS age, {BAND} AS age_band,
    r.SEXO AS sex_code,
    CASE r.SEXO WHEN '1' THEN 'Male' WHEN '3' THEN 'Female' END AS sex_label,
    r.CNES AS facility_id, CAST(r.MORTE AS INTEGER) AS death, r.region
  FROM raw r LEFT JOIN labels l ON l.diag_group = upper(substr(r.DIAG_PRINC, 1, 3))
  WHERE {PRINCIPAL}
)"""


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """numerator / denominator of whole numbers, half away from zero, in integer arithmetic."""
    unit = 10**digits
    top = f"CAST({numerator} AS HUGEINT)"
    den = f"CAST({denominator} AS HUGEINT)"
    size = f"((2 * abs({top}) * {unit} + {den}) // (2 * {den}))"
    return f"CASE WHEN {den} = 0 THEN NULL ELSE CAST(sign({top}) * {size} AS DOUBLE) / {unit}.0 END"


CENTS = "sum(CAST(total_value * 100 AS HUGEINT))"
MEAN_VALUE = f"{half_up(CENTS, 'count(total_value) * 100', 2)}"
MEAN_STAY_2 = half_up("sum(stay_days)", "count(stay_days)", 2)
MEAN_STAY_1 = half_up("sum(stay_days)", "count(stay_days)", 1)
TOTAL_COST = "CAST(sum(total_value) AS DOUBLE)"

GROUPED = f"""
  SELECT year, diag_group, diag_label, age_band, count(*) AS admissions,
    {TOTAL_COST} AS total_cost, {MEAN_VALUE} AS mean_cost, {MEAN_STAY_1} AS mean_stay,
    CAST(sum(death) AS BIGINT) AS deaths
  FROM clean GROUP BY year, diag_group, diag_label, age_band"""

def anchors(region: str, joined: str) -> str:
    return f"""
dated AS (
  SELECT {region} AS region, CAST(o_orderdate AS DATE) AS d FROM orders {joined}
),
span AS (SELECT min(d) AS lo, max(d) + 1 AS hi FROM dated),
periods AS (
  SELECT region, CAST(1995 + 3 * floor((year(d) - 1995) / 3) AS INTEGER) AS year, count(*) AS n FROM dated GROUP BY 1, 2
),
anchors AS (
  SELECT region, year, CAST(n AS DOUBLE) * CAST(365 AS DOUBLE)
    / CAST(date_diff('day', greatest(make_date(year, 1, 1), lo), least(make_date(year + 3, 1, 1), hi)) AS DOUBLE) AS pop
  FROM periods, span WHERE year IS NOT NULL
)"""


ANCHORS = anchors("n_regionkey", "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
NATIONAL_ANCHORS = anchors("0", "")
SERIES = """
segments AS (
  SELECT region, year AS y0, pop AS v0,
    lead(year) OVER (PARTITION BY region ORDER BY year) AS y1,
    lead(pop) OVER (PARTITION BY region ORDER BY year) AS v1
  FROM anchors
),
dense AS (
  SELECT region, y0, v0, y1, v1, unnest(range(y0, coalesce(y1, y0 + 1))) AS yy FROM segments
),
series AS (
  SELECT region, CAST(yy AS INTEGER) AS year,
    round_even(CASE WHEN yy = y0 THEN v0 ELSE (v1 - v0) / (y1 - y0) * (yy - y0) + v0 END, 2) AS pop_millions
  FROM dense
)"""


def projected(base: str = "CAST(4000 AS DOUBLE)", rate: str = "CAST(24.25 AS DOUBLE)") -> str:
    def cost(annual: str) -> str:
        grown = f"pow(CAST(1 AS DOUBLE) + CAST({annual} AS DOUBLE), greatest(year - 1998, 0))"
        return f"round_even(admissions_proj * ({base} * {grown}), 2)"

    return f"""
admitted AS (
  SELECT region, year, pop_millions, round_even({rate}, 2) AS rate_per_100k,
    CAST(round_even(pop_millions * CAST(1e6 AS DOUBLE) / CAST(1e5 AS DOUBLE) * {rate}, 0) AS BIGINT) AS admissions_proj,
    CAST(year > 1998 AS INTEGER) AS is_projection
  FROM series
),
projection AS (
  SELECT region, year, pop_millions, rate_per_100k, admissions_proj,
    {cost("0")} AS cost_a, {cost("0.0175")} AS cost_b, {cost("0.035")} AS cost_c, is_projection
  FROM admitted
)"""


REGIONAL = f"{ANCHORS}, {SERIES}, {projected()}"
NATIONAL = f"{NATIONAL_ANCHORS}, {SERIES}, {projected()}"
SCENARIOS = """
scenarios(scenario, annual_rate) AS (
  VALUES ('a', CAST(0 AS DOUBLE)), ('b', CAST(0.0175 AS DOUBLE)), ('c', CAST(0.035 AS DOUBLE))
),
long AS (
  SELECT region, year, admissions_proj, scenario, annual_rate,
    round_even(admissions_proj * (CAST(4000 AS DOUBLE) * pow(CAST(1 AS DOUBLE) + annual_rate, greatest(year - 1998, 0))), 2) AS cost
  FROM admitted CROSS JOIN scenarios
)"""


def millions(amount: str, digits: int) -> str:
    return half_up(f"CAST({amount} AS DECIMAL(18,2)) * 100", "100000000", digits)


def growth(first: str, last: str, digits: int = 3) -> str:
    return half_up(f"(({last}) - ({first})) * 100", first, digits)


FIRST = "min_by(admissions_proj, year)"
LAST = "max_by(admissions_proj, year)"


def comma_text(value: str) -> str:
    return f"replace(rtrim(rtrim(CAST(CAST({value} AS DECIMAL(24,2)) AS VARCHAR), '0'), '.'), '.', ',')"


PROFILE = f"""
descriptions(code, description) AS (
  VALUES ('ECO', 'Economy line'), ('LAR', 'Large line'), ('MED', 'Medium line'),
    ('PRO', 'Promotional line'), ('SMA', 'Small line')
),
profile AS (
  SELECT c.code, d.description, c.admissions
  FROM (SELECT upper(substr(DIAG_PRINC, 1, 3)) AS code, count(*) AS admissions FROM raw WHERE {SECONDARY} GROUP BY 1) c
  LEFT JOIN descriptions d ON d.code = c.code
)"""

OBSERVED = """
counted AS (
  SELECT region, year, count(*) FILTER (WHERE age >= 60) AS admissions FROM clean GROUP BY region, year
),
observed AS (
  SELECT c.region, c.year, c.admissions, s.pop_millions,
    round_even(CAST(c.admissions AS DOUBLE) / s.pop_millions * CAST(100000 AS DOUBLE), 2) AS rate_per_100k
  FROM counted c LEFT JOIN series s ON s.region = c.region AND s.year = c.year
)"""

SIX = ("admissions", "population", "stay_days", "total_value", "deaths", "facilities")
TERRITORY = f"""{CLEAN}, {REGIONAL},
totals AS (
  SELECT region, count(*) AS admissions, CAST(sum(stay_days) AS BIGINT) AS stay_days,
    {TOTAL_COST} AS total_value, CAST(sum(death) AS BIGINT) AS deaths, count(DISTINCT facility_id) AS facilities
  FROM clean GROUP BY region
),
measures AS (
  SELECT t.region, t.admissions, p.pop_millions AS population, t.stay_days, t.total_value, t.deaths, t.facilities
  FROM totals t LEFT JOIN projection p ON p.region = t.region AND p.year = 1998
),
logged AS (
  SELECT *, CASE WHEN {" AND ".join(f"{m} > 0" for m in SIX)}
    THEN ({" + ".join(f"ln(CAST({m} AS DOUBLE))" for m in SIX)}) / 6 END AS mean_ln
  FROM measures
),
raw_scored AS (
  SELECT *, round(coalesce(100 * exp(mean_ln - (SELECT max(mean_ln) FROM logged)), 0), 6) AS raw_score FROM logged
),
scored AS (SELECT *, CAST(round(raw_score, 0) AS INTEGER) AS score FROM raw_scored),
growths AS (SELECT region, {growth(FIRST, LAST, 1)} AS growth_pct FROM projection GROUP BY region),
territory AS (
  SELECT s.region, r.r_name AS name, g.growth_pct, {", ".join("s." + m for m in SIX)}, s.raw_score, s.score,
    CASE WHEN s.score >= 90 THEN 'Critical' WHEN s.score >= 80 THEN 'High'
      WHEN s.score >= 72 THEN 'Medium-High' WHEN s.score IS NOT NULL THEN 'Medium' END AS level
  FROM scored s LEFT JOIN growths g ON g.region = s.region LEFT JOIN region r ON r.r_regionkey = s.region
)"""

QUALITY_NUMBER = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def quality(name: str, text: str) -> str:
    readable = f"regexp_matches({text}, '{QUALITY_NUMBER}')"
    number = f"CASE WHEN {readable} THEN CAST({text} AS DOUBLE) END"
    return f"""SELECT '{name}' AS field, count(*) AS rows, count(*) FILTER (WHERE {text} IS NULL) AS missing,
    count(*) FILTER (WHERE {text} IS NOT NULL AND NOT {readable}) AS unreadable,
    count(*) FILTER (WHERE {number} <> floor({number})) AS fractional
  FROM part"""


CHECK_SQL: dict[str, str] = {
    "cohort_filter": f"""WITH {RAW}
  SELECT DIAG_PRINC, MUNIC_RES, ANO_CMPT, VAL_TOT, upper(substr(DIAG_PRINC, 1, 3)) AS diag_group
  FROM raw WHERE {PRINCIPAL}""",
    "cohort_region_filter": f"""WITH {RAW}
  SELECT DIAG_PRINC, MUNIC_RES, ANO_CMPT, VAL_TOT FROM raw WHERE {PRINCIPAL} AND {IN_CITY}""",
    "cohort_retention": f"""WITH {RAW},
  c AS (SELECT count(*) AS rows_read, count(*) FILTER (WHERE {PRINCIPAL}) AS rows_code,
    count(*) FILTER (WHERE {PRINCIPAL} AND {IN_CITY}) AS rows_kept FROM raw)
  SELECT rows_read, rows_code, rows_kept,
    coalesce({half_up("rows_kept * 100", "rows_read", 3)}, 0) AS kept_pct FROM c""",
    "label_distribution": f"""WITH {RAW}, {LABELS}
  SELECT l.ord, l.diag_group, l.diag_label, count(r.DIAG_PRINC) AS admissions
  FROM labels l LEFT JOIN (SELECT * FROM raw WHERE {PRINCIPAL}) r ON upper(substr(r.DIAG_PRINC, 1, 3)) = l.diag_group
  GROUP BY 1, 2, 3""",
    "either_diagnosis_cohort": f"""WITH {RAW}
  SELECT ANO_CMPT, DIAG_PRINC, count(*) AS admissions FROM raw WHERE {PRINCIPAL} OR {SECONDARY} GROUP BY 1, 2""",
    "either_diagnosis_uplift": f"""WITH {RAW},
  c AS (SELECT count(*) FILTER (WHERE {PRINCIPAL}) AS principal, count(*) FILTER (WHERE {SECONDARY}) AS secondary,
    count(*) FILTER (WHERE {PRINCIPAL} OR {SECONDARY}) AS either FROM raw WHERE {IN_CITY})
  SELECT principal, secondary, either, {half_up("either", "principal", 3)} AS uplift FROM c""",
    "enriched_admissions": f"""WITH {CLEAN}
  SELECT * REPLACE (CAST(total_value AS DOUBLE) AS total_value) FROM clean""",
    "renamed_fields": f"""WITH {RAW}
  SELECT DIAG_PRINC AS diag_code, SEXO AS sex_code, count(*) AS admissions, count(DISTINCT CNES) AS facilities
  FROM raw GROUP BY 1, 2""",
    "age_band_counts": f"""WITH {RAW}
  SELECT {BAND} AS age_band, count(*) AS admissions, min(CAST(IDADE AS INTEGER)) AS youngest,
    max(CAST(IDADE AS INTEGER)) AS oldest FROM raw GROUP BY 1""",
    "sex_label_counts": f"""WITH {RAW}, sexes(sex_code, sex_label) AS (VALUES ('1', 'Male'), ('3', 'Female'))
  SELECT r.SEXO AS sex_code, x.sex_label, count(*) AS admissions
  FROM raw r LEFT JOIN sexes x ON x.sex_code = r.SEXO GROUP BY 1, 2""",
    "tolerant_cast_quality": " UNION ALL ".join(
        [
            quality("brand", "p_brand"),
            quality("brand_number", "substr(p_brand, 7, 10)"),
            quality("name_start", "substr(p_name, 1, 3)"),
            quality("half_size", "CAST(p_size / CAST(2 AS DOUBLE) AS VARCHAR)"),
            quality("price", "CAST(p_retailprice AS VARCHAR)"),
        ]
    ),
    "months_union": f"""WITH {RAW}
  SELECT ANO_CMPT, MORTE, count(*) AS admissions, count(DIAG_PRINC) AS coded FROM (
    SELECT DIAG_PRINC, ANO_CMPT FROM raw WHERE CAST(ANO_CMPT AS INTEGER) < 1998
    UNION ALL BY NAME SELECT DIAG_PRINC, ANO_CMPT, MORTE FROM raw WHERE ANO_CMPT IS NULL OR CAST(ANO_CMPT AS INTEGER) >= 1998
  ) GROUP BY 1, 2""",
    "table_conform": f"""WITH {CLEAN}
  SELECT diag_group, year, CAST(NULL AS VARCHAR) AS age_band, count(*) AS admissions,
    count(*) FILTER (WHERE stay_days IS DISTINCT FROM 7 AND total_value IS NOT NULL) AS valued,
    CAST(sum(CASE WHEN stay_days IS DISTINCT FROM 7 THEN total_value END) AS DOUBLE) AS total_cost,
    CAST(sum(stay_days) AS BIGINT) AS stay_days, CAST(0 AS BIGINT) AS death_known
  FROM clean GROUP BY 1, 2""",
    "repeated_keys": f"""WITH {RAW}
  SELECT CNES, ANO_CMPT, MES_CMPT, count(*) AS copies FROM raw GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "admissions_preview": f"""WITH {CLEAN}
  SELECT diag_code, diag_group, diag_label, year, month, stay_days, CAST(total_value AS DOUBLE) AS total_value
  FROM clean ORDER BY clean.total_value DESC NULLS LAST, diag_code NULLS LAST, diag_group NULLS LAST,
    diag_label NULLS LAST, year NULLS LAST, month NULLS LAST, stay_days NULLS LAST LIMIT 5""",
    "facility_labels": f"""WITH {RAW}
  SELECT f.facility_id, s.s_name AS facility, f.admissions
  FROM (SELECT CNES AS facility_id, count(*) AS admissions FROM raw GROUP BY 1) f
  LEFT JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = f.facility_id""",
    "table_labels": f"""WITH {RAW},
  labels AS (SELECT upper(substr(p_type, 1, 3)) AS g, min(p_type) AS l FROM part WHERE p_type IS NOT NULL GROUP BY 1),
  c AS (SELECT upper(substr(DIAG_PRINC, 1, 3)) AS g, count(*) AS n FROM raw WHERE {PRINCIPAL} GROUP BY 1)
  SELECT c.g AS diag_group, l AS diag_label, n AS admissions FROM c LEFT JOIN labels ON labels.g = c.g""",
    "guarded_reads": """SELECT 'part' AS name, count(*) AS rows FROM part
  UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'absent', 0""",
    "parsed_fields": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS INTEGER) END AS whole,
    CAST((p_size + 1) // 2 AS INTEGER) AS nearest, CAST(p_size AS DOUBLE) / 2 AS exact,
    CASE WHEN regexp_matches(substr(p_brand, 7, 10), '^[0-9]+$') THEN CAST(substr(p_brand, 7, 10) AS INTEGER) END AS brand_whole,
    CASE WHEN regexp_matches(p_brand, '^[0-9]+$') THEN CAST(p_brand AS INTEGER) END AS brand_nearest,
    CASE WHEN regexp_matches(substr(p_name, 1, 3), '^[0-9]+$') THEN CAST(substr(p_name, 1, 3) AS DOUBLE) END AS name_exact
  FROM part""",
    "renamed_on_load": f"""WITH {REGIONAL}
  SELECT * REPLACE (CAST(region AS VARCHAR) AS region) FROM projection""",
    "table_profile": f"""WITH {CLEAN} SELECT count(*) AS rows, CAST(15 AS INTEGER) AS columns FROM clean""",
    "grouped_admissions": f"WITH {CLEAN} {GROUPED}",
    "grouped_admissions_by_region": f"""WITH {CLEAN}
  SELECT region, year, diag_group, diag_label, age_band, count(*) AS admissions, {TOTAL_COST} AS total_cost,
    {MEAN_VALUE} AS mean_cost, {MEAN_STAY_1} AS mean_stay, CAST(sum(death) AS BIGINT) AS deaths
  FROM clean GROUP BY region, year, diag_group, diag_label, age_band""",
    "admissions_by_label": f"""WITH {CLEAN}, grouped AS ({GROUPED})
  SELECT diag_label, CAST(sum(admissions) AS BIGINT) AS total FROM grouped GROUP BY 1 ORDER BY total DESC""",
    "yearly_history": f"""WITH {CLEAN}
  SELECT year, count(diag_code) AS admissions, {MEAN_VALUE} AS mean_value, {MEAN_STAY_2} AS mean_stay
  FROM clean WHERE year IS NOT NULL GROUP BY year ORDER BY year""",
    "yearly_history_by_region": f"""WITH {CLEAN}
  SELECT region, year, count(diag_code) AS admissions, CAST(NULL AS DOUBLE) AS mean_value, {MEAN_STAY_2} AS mean_stay
  FROM clean WHERE year IS NOT NULL GROUP BY region, year ORDER BY region, year""",
    "observed_rate": f"WITH {CLEAN}, {ANCHORS}, {SERIES}, {OBSERVED} SELECT * FROM observed",
    "interpolated_series": f"WITH {ANCHORS}, {SERIES} SELECT region, year, pop_millions FROM series",
    "projection_by_region": f"WITH {REGIONAL} SELECT * FROM projection",
    "projection_national": f"WITH {NATIONAL} SELECT * EXCLUDE (region) FROM projection",
    "scenario_costs_wide": f"WITH {REGIONAL} SELECT region, year, cost_a, cost_b, cost_c FROM projection",
    "scenario_costs_long": f"WITH {REGIONAL}, {SCENARIOS} SELECT * FROM long",
    "projection_observed_base": f"""WITH {CLEAN}, {ANCHORS},
  bases AS (SELECT region AS base_region, {MEAN_VALUE} AS base_value FROM clean WHERE year = 1998 GROUP BY region),
  {SERIES}, {projected("coalesce((SELECT base_value FROM bases WHERE base_region = region), 4000)")}
  SELECT region, year, admissions_proj, cost_a, cost_b, cost_c FROM projection""",
    "projection_observed_rate": f"""WITH {CLEAN}, {ANCHORS}, {SERIES}, {OBSERVED},
  rates AS (SELECT s.region, s.year, s.pop_millions, coalesce(o.rate_per_100k, CAST(24.25 AS DOUBLE)) AS rate
    FROM series s LEFT JOIN observed o ON o.region = s.region AND o.year = 1998)
  SELECT region, year, pop_millions, round_even(rate, 2) AS rate_per_100k,
    CAST(round_even(pop_millions * CAST(1e6 AS DOUBLE) / CAST(1e5 AS DOUBLE) * rate, 0) AS BIGINT) AS admissions_proj,
    CAST(year > 1998 AS INTEGER) AS is_projection FROM rates""",
    "projection_milestones": f"""WITH {REGIONAL}
  SELECT region, year, pop_millions, admissions_proj FROM projection WHERE year IN (1995, 1998, 2001)
  ORDER BY region, year""",
    "trend_slope": f"""WITH {REGIONAL}
  SELECT region, round(regr_slope(CAST(admissions_proj AS DOUBLE), CAST(year AS DOUBLE)), 6) AS slope,
    round(regr_intercept(CAST(admissions_proj AS DOUBLE), CAST(year AS DOUBLE)), 3) AS intercept,
    round(regr_r2(CAST(admissions_proj AS DOUBLE), CAST(year AS DOUBLE)), 6) AS r2
  FROM projection GROUP BY region""",
    "growth_endpoints": f"""WITH {REGIONAL}
  SELECT region, min(year) AS first_year, max(year) AS last_year, {FIRST} AS first_value, {LAST} AS last_value,
    {growth(FIRST, LAST)} AS growth_pct FROM projection GROUP BY region""",
    "projection_series": f"""WITH {REGIONAL}
  SELECT region, year, pop_millions, admissions_proj, cost_a, cost_c, {millions("cost_a", 1)} AS cost_a_chart,
    {millions("cost_c", 1)} AS cost_c_chart, is_projection FROM projection ORDER BY region, year""",
    "executive_kpis": f"""WITH {REGIONAL}
  SELECT region, year, admissions_proj AS admissions, {millions("cost_a", 2)} AS cost_a_millions,
    {millions("cost_c", 2)} AS cost_c_millions, rate_per_100k, pop_millions, is_projection
  FROM projection ORDER BY region, year""",
    "kpi_headline": f"""WITH {REGIONAL},
  ends AS (SELECT region, {LAST} AS last_admissions, {growth(FIRST, LAST)} AS growth_pct,
    max_by(pop_millions, year) AS last_pop_millions, max_by(rate_per_100k, year) AS rate_per_100k
    FROM projection GROUP BY region)
  SELECT *, translate(format('{{:,}}', last_admissions), ',', '.') AS admissions_text,
    CASE WHEN floor(growth_pct + 0.5) >= 0 THEN '+' ELSE '' END || CAST(CAST(floor(growth_pct + 0.5) AS BIGINT) AS VARCHAR) || '%' AS growth_text,
    {comma_text("last_pop_millions")} AS pop_text, {comma_text("rate_per_100k")} AS rate_text FROM ends""",
    "year_comparison": f"""WITH {REGIONAL},
  both_years AS (SELECT region, max(CASE WHEN year = 1995 THEN admissions_proj END) AS first_admissions,
    max(CASE WHEN year = 2001 THEN admissions_proj END) AS last_admissions FROM projection GROUP BY region)
  SELECT region, first_admissions, last_admissions, last_admissions - first_admissions AS added,
    {growth("first_admissions", "last_admissions")} AS growth_pct FROM both_years""",
    "scenario_gap_final_year": f"""WITH {REGIONAL}, {SCENARIOS},
  t AS (SELECT sum(CASE WHEN scenario = 'a' THEN CAST(cost AS DECIMAL(18,2)) END) AS f,
    sum(CASE WHEN scenario = 'c' THEN CAST(cost AS DECIMAL(18,2)) END) AS u FROM long WHERE year = 2001)
  SELECT CAST(2001 AS INTEGER) AS year, CAST(f AS DOUBLE) AS frozen_cost, CAST(u AS DOUBLE) AS full_cost,
    CAST(u - f AS DOUBLE) AS gap, round(CAST(u AS DOUBLE) / CAST(f AS DOUBLE), 6) AS ratio FROM t""",
    "ageing_summary": f"""WITH {NATIONAL}
  SELECT max_by(pop_millions, year) AS last_pop_millions, max_by(cost_a, year) AS frozen_cost,
    max_by(cost_c, year) AS full_cost, min(year) AS first_year, max(year) AS last_year,
    {FIRST} AS first_value, {LAST} AS last_value,
    round(regr_slope(CAST(admissions_proj AS DOUBLE), CAST(year AS DOUBLE)), 6) AS slope,
    {growth(FIRST, LAST)} AS growth_pct,
    CAST(CAST(max_by(cost_c, year) AS DECIMAL(18,2)) - CAST(max_by(cost_a, year) AS DECIMAL(18,2)) AS DOUBLE) AS gap
  FROM projection""",
    "secondary_profile": f"""WITH {RAW}, {PROFILE}
  SELECT code, description, admissions, concat_ws(' · ', code, description) AS chart_label
  FROM profile ORDER BY admissions DESC, code""",
    "secondary_top5": f"""WITH {RAW}, {PROFILE}
  SELECT code, description, admissions FROM profile ORDER BY admissions DESC, code LIMIT 5""",
    "territory_score": f"WITH {TERRITORY} SELECT * FROM territory",
    "territory_ranking": f"""WITH {TERRITORY}
  SELECT region, name, growth_pct, score, level, rank() OVER (ORDER BY score DESC) AS rank,
    CAST(CASE WHEN level = 'Critical' THEN 1 WHEN level LIKE 'High%' OR level LIKE 'Medium-High%' THEN 2 ELSE 3 END AS INTEGER) AS tier,
    least(100, score) AS bar_width FROM territory ORDER BY score DESC, region""",
    "territory_top3": f"""WITH {TERRITORY}
  SELECT region, name, score, raw_score, level FROM territory ORDER BY score DESC, raw_score DESC, region LIMIT 3""",
    "dashboard_json": f"""WITH {TERRITORY}, {PROFILE}, grouped AS ({GROUPED}),
  by_label AS (SELECT diag_label, sum(admissions) AS total FROM grouped GROUP BY 1)
  SELECT 'projection' AS section, '{{"region":' || coalesce(CAST(region AS VARCHAR), 'null') || ',"year":' || year
    || ',"pop_millions":' || CAST(pop_millions AS DECIMAL(18,2)) || ',"admissions_proj":' || admissions_proj
    || ',"cost_a":' || CAST(cost_a AS DECIMAL(18,2)) || ',"cost_c":' || CAST(cost_c AS DECIMAL(18,2))
    || ',"is_projection":' || is_projection || '}}' AS body FROM projection
  UNION ALL SELECT 'territory', '{{"region":' || coalesce(CAST(region AS VARCHAR), 'null')
    || ',"name":' || coalesce('"' || name || '"', 'null')
    || ',"growth_pct":' || coalesce(CAST(CAST(growth_pct AS DECIMAL(18,1)) AS VARCHAR), 'null')
    || ',"score":' || score || ',"level":"' || level || '"}}' FROM territory
  UNION ALL SELECT 'conditions', '{{"code":' || coalesce('"' || code || '"', 'null') || ',"description":'
    || coalesce('"' || description || '"', 'null') || ',"admissions":' || admissions || '}}' FROM profile
  UNION ALL SELECT 'labels', '{{"diag_label":' || coalesce('"' || diag_label || '"', 'null')
    || ',"total":' || total || '}}' FROM by_label""",
    "landing_scan": f"""WITH {RAW}
  SELECT region, CAST(ANO_CMPT AS INTEGER) AS year, CASE WHEN CAST(MES_CMPT AS INTEGER) <= 6 THEN 1 ELSE 7 END AS month,
    count(*) AS admissions, count(DIAG_PRINC) AS coded, CAST(sum(CAST(VAL_TOT AS DECIMAL(15,2))) AS DOUBLE) AS total_cost,
    CAST(sum(CASE WHEN CAST(ANO_CMPT AS INTEGER) < 1998 THEN NULL ELSE CAST(MORTE AS INTEGER) END) AS BIGINT) AS deaths
  FROM raw GROUP BY 1, 2, 3""",
    "loaded_increments": f"""WITH {CLEAN}
  SELECT year AS file_year, diag_group, count(*) AS admissions, {TOTAL_COST} AS total_cost, CAST(sum(stay_days) AS BIGINT) AS stay_days,
    CASE WHEN year < 1998 THEN (SELECT count(*) FILTER (WHERE year < 1998) FROM clean)
      ELSE (SELECT count(*) FILTER (WHERE year IS NULL OR year >= 1998) FROM clean) END AS loaded
  FROM clean GROUP BY year, diag_group""",
    "described_columns": f"""WITH {CLEAN},
  history AS (
    SELECT year, count(diag_code) AS admissions, {MEAN_VALUE} AS mean_value, {MEAN_STAY_2} AS mean_stay
    FROM clean WHERE year IS NOT NULL GROUP BY year
  )
  SELECT 'year' AS column, 'int' AS type, 'Year.' AS comment, count(year) AS known FROM history
  UNION ALL SELECT 'admissions', 'bigint', 'Rows with a principal diagnosis.', count(admissions) FROM history
  UNION ALL SELECT 'mean_value', 'decimal(15,2)', 'Sum of total_value over the rows that have one.', count(mean_value) FROM history
  UNION ALL SELECT 'mean_stay', 'decimal(8,2)', 'Sum of stay_days over the rows that have one.', count(mean_stay) FROM history""",
    "csv_round_trip": f"""WITH {CLEAN}
  SELECT region, year, count(diag_code) AS admissions, {MEAN_VALUE} AS mean_value, {MEAN_STAY_2} AS mean_stay
  FROM clean WHERE year IS NOT NULL GROUP BY region, year""",
    "csv_unreadable": """
  SELECT count(*) AS rows, count(*) FILTER (WHERE p_partkey % 7 = 0 AND p_brand IS NOT NULL) AS unreadable_rows,
    CAST(sum(p_size) FILTER (WHERE p_partkey % 7 <> 0) AS BIGINT) AS sizes,
    min(p_partkey || ',' || p_brand) FILTER (WHERE p_partkey % 7 = 0) AS example
  FROM part""",
    "grouped_from_states": f"WITH {CLEAN} {GROUPED}",
    "history_from_states": f"""WITH {CLEAN}
  SELECT year, count(diag_code) AS admissions, {MEAN_VALUE} AS mean_value, {MEAN_STAY_2} AS mean_stay
  FROM clean WHERE year IS NOT NULL GROUP BY year""",
}
