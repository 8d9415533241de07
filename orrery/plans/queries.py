"""Every operator on the supplied tables, with SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import classify, dates, text
from orrery.operators import audit, cadence, cdf, explore, lifetimes, mass, rollup, search, series
from orrery.plans.adapters import SEGMENT_RULES, SQL, SQL_PROVIDER, decays, launches, objects, table
from orrery.sources import catalogs, shared, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What the supplied data has for a payload, a window, a first and a splitting year.
PAYLOAD, START, END, LEAST_YEAR, SPLIT_YEAR, DAY, TODAY = "N", "1997-01-01", "1998-06-30", 1997, 1999, 15_000, 16_000
WITH = f"WITH {SQL}"


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _payloads(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return mass.payloads(objects(spark, sf_dir, *parts), PAYLOAD)


# ---- summaries and mass by key --------------------------------------------------------------------------------
_R = "floor({} + 0.5)::BIGINT"
_MASS = f"{_R.format('sum(coalesce(mass_kg, 0))')} AS mass_kg, count(*) AS count, count(*) FILTER (WHERE object_class = 'N') AS payload_count"


@_query(f"""{WITH} SELECT count(*) AS total_objects, count(*) FILTER (WHERE object_class = 'N') AS total_payloads,
 {_R.format("coalesce(sum(coalesce(mass_kg, 0)) FILTER (WHERE object_class = 'N'), 0)")} AS total_mass_kg,
 count(*) FILTER (WHERE object_class = 'N' AND sat_state IN ('O', 'OX')) AS active_payloads,
 count(*) FILTER (WHERE object_class = 'N' AND sat_state IN ('O', 'OX') AND contains(upper(name), 'GEAR')) AS constellation_active,
 count(DISTINCT owner) AS countries, count(DISTINCT lv) AS launch_vehicles, min(year(ldate::DATE)) AS first_launch_year, max(year(ldate::DATE)) AS last_launch_year FROM objects""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.summary(objects(spark, sf_dir, "part", "owner", "launch"), PAYLOAD, constellation="GEAR")


@_query(ORACLE_SQL["summary"])
def summary_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts by sketches, which are exact for as few owners and vehicles as there are."""
    return mass.summary(objects(spark, sf_dir, "part", "owner", "launch"), PAYLOAD, constellation="GEAR", approximate=True)


@_query(f"{WITH} SELECT ldate[1:4] AS label, {_MASS} FROM objects GROUP BY 1")
def mass_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.mass_by_year(objects(spark, sf_dir, "launch"), PAYLOAD)


@_query(f"{WITH} SELECT coalesce(state, 'Unknown') AS label, {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 1 ORDER BY mass_kg DESC, label LIMIT 3")
def mass_by_country_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.mass_by(_payloads(spark, sf_dir, "owner"), F.col("state"), PAYLOAD, top=3)


@_query(f"{WITH} SELECT coalesce(op_orbit, 'Unknown') AS label, {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 1 HAVING {_R.format('sum(coalesce(mass_kg, 0))')} > 0 ORDER BY mass_kg DESC, label LIMIT 8")
def mass_by_orbit_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.mass_by(_payloads(spark, sf_dir, "part"), F.col("op_orbit"), PAYLOAD, top=8, above=0)


@_query(f"{WITH} SELECT coalesce(op_orbit, 'Unknown') AS label, {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 1 ORDER BY mass_kg DESC, label LIMIT 4")
def mass_by_orbit_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.mass_by(_payloads(spark, sf_dir, "part"), F.col("op_orbit"), PAYLOAD, top=4)


@_query(f"{WITH} SELECT CASE object_class WHEN 'N' THEN 'Payload' WHEN 'R' THEN 'Rocket Body' ELSE object_class END AS label, {_MASS} FROM objects GROUP BY 1")
def mass_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.mass_by_class(objects(spark, sf_dir), PAYLOAD, {"N": "Payload", "R": "Rocket Body"})


@_query(f"{WITH} SELECT coalesce(pl_name, lv) AS label, {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 1 ORDER BY mass_kg DESC, label LIMIT 25")
def mass_by_vehicle_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.mass_by(_payloads(spark, sf_dir, "part", "launch"), F.coalesce("pl_name", "lv"), PAYLOAD, top=25)


_UPMASS = f"""{WITH}, upmass AS (SELECT {SQL_PROVIDER} AS provider, {_R.format("sum(coalesce(mass_kg, 0))")} AS mass_kg, count(*) AS count
 FROM objects WHERE object_class = 'N' AND ldate BETWEEN '{START}' AND '{END}' GROUP BY 1)"""


@_query(f"{_UPMASS} SELECT * FROM upmass")
def upmass_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.upmass_by_provider(objects(spark, sf_dir, "launch"), START, END, SEGMENT_RULES, PAYLOAD)


@_query(f"""{_UPMASS} SELECT '{START}' AS start, '{END}' AS "end", coalesce(sum(mass_kg), 0)::BIGINT AS total_mass_kg, coalesce(sum(count), 0)::BIGINT AS total_count FROM upmass""")
def upmass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.upmass_totals(upmass_by_provider(spark, sf_dir), START, END)


@_query(f"""{WITH} SELECT DISTINCT field, value FROM (SELECT unnest([{{'field': 'owner', 'value': owner}}, {{'field': 'op_orbit', 'value': op_orbit}}, {{'field': 'sat_state', 'value': sat_state}},
 {{'field': 'object_class', 'value': object_class}}], recursive := true) FROM objects) WHERE value IS NOT NULL AND value <> ''""")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.filter_values(objects(spark, sf_dir, "part", "owner"))


@_query(f"{WITH} SELECT year(ldate::DATE) AS year, count(DISTINCT coalesce(lv_family, lv, 'Unknown')) AS vehicles FROM launches WHERE orbital GROUP BY 1")
def vehicles_flown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass.vehicles_flown(launches(spark, sf_dir))


# ---- series ---------------------------------------------------------------------------------------------------
def _sums(segment: str, names: list[str], where: str, bucket: str = "year(ldate::DATE)", counts: bool = False) -> str:
    sums = [f"{_R.format(f'''coalesce(sum(coalesce(mass_kg, 0)) FILTER (WHERE {segment} = '{n}'), 0)''')} AS {n}" for n in names]
    sums += [f"count(*) FILTER (WHERE {segment} = '{n}') AS {n}_count" for n in names if counts]
    return f"SELECT {bucket} AS bucket, {', '.join(sums)} FROM objects WHERE object_class = 'N' AND {where} GROUP BY 1"


_YEAR = "ldate"
_AUTO = "CASE WHEN contains(lower(lv_family), 'auto') THEN 'own' ELSE 'others' END"
_TWO = "CASE WHEN contains(lower(lv_family || ' ' || lv), 'auto') THEN 'first_family' WHEN contains(lower(lv_family || ' ' || lv), 'build') THEN 'second_family' END"
_SITE = "CASE WHEN upper(site) = '1-URGENT' OR starts_with(upper(site), '2') THEN 'cape' WHEN starts_with(upper(site), '3') OR starts_with(upper(site), '4') THEN 'vandenberg' ELSE 'other' END"
_ENTITY = "CASE WHEN contains(upper(name), 'GEAR') THEN 'starlink' WHEN state = 'AMERICA' AND owner IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_7') THEN 'usGov' ELSE 'commercial' END"
SITES = (("cape", ("1-URGENT",), ("2",)), ("vandenberg", (), ("3", "4")))
GOVERNMENT = ("NATION_1", "NATION_2", "NATION_3", "NATION_7")


def _year():
    return dates.year_number(F.col(_YEAR))


@_query(f"{WITH} {_sums(_AUTO, ['own', 'others'], 'true', counts=True)}")
def year_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(classify.holds(F.col("lv_family"), "auto"), "own").otherwise("others")
    return series.segment_series(_payloads(spark, sf_dir, "launch"), _year(), segment, ["own", "others"], counts=True)


@_query(f"{WITH} {_sums(_TWO, ['first_family', 'second_family'], f'({_TWO}) IS NOT NULL AND year(ldate::DATE) >= {LEAST_YEAR}')}")
def two_family_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = classify.vehicle_text(F.col("lv_family"), F.col("lv"))
    segment = F.when(names.contains("auto"), "first_family").when(names.contains("build"), "second_family")
    return series.segment_series(_payloads(spark, sf_dir, "launch"), _year(), segment, ["first_family", "second_family"], least=LEAST_YEAR)


def _own(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return _payloads(spark, sf_dir, "launch", *parts).filter(classify.holds(F.col("lv_family"), "auto"))


_OWN = "contains(lower(lv_family), 'auto')"


@_query(f"{WITH} {_sums(_SITE, ['cape', 'vandenberg', 'other'], f'{_OWN} AND year(ldate::DATE) >= {LEAST_YEAR}')}")
def site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.segment_series(_own(spark, sf_dir), _year(), classify.site_bucket(F.col("site"), SITES), ["cape", "vandenberg", "other"], least=LEAST_YEAR)


@_query(f"""{WITH}, s AS ({_sums(_SITE, ['cape', 'vandenberg', 'other'], f"{_OWN} AND ldate[1:4] = '2001'", 'month(ldate::DATE)')})
SELECT m AS bucket, coalesce(cape, 0) AS cape, coalesce(vandenberg, 0) AS vandenberg, coalesce(other, 0) AS other FROM range(1, 13) r(m) LEFT JOIN s ON m = bucket""")
def site_monthly_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own(spark, sf_dir).filter(dates.year_text(F.col("ldate")) == "2001")
    spine = spark.range(1, 13).select(F.col("id").cast("int").alias("bucket"))
    return series.segment_series(rows, dates.month_number(F.col("ldate")), classify.site_bucket(F.col("site"), SITES), ["cape", "vandenberg", "other"], spine=spine)


@_query(f"{WITH} {_sums(_ENTITY, ['starlink', 'usGov', 'commercial'], f'{_OWN} AND year(ldate::DATE) >= {LEAST_YEAR}')}")
def entity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = classify.customer_segment(F.col("name"), F.col("state"), F.col("owner"), "GEAR", "AMERICA", GOVERNMENT)
    return series.segment_series(_own(spark, sf_dir, "part", "owner"), _year(), segment, ["starlink", "usGov", "commercial"], least=LEAST_YEAR)


_ENTITIES = f"{WITH}, s AS ({_sums(_ENTITY, ['starlink', 'usGov', 'commercial'], f'{_OWN} AND year(ldate::DATE) >= {LEAST_YEAR}')})"


def _share(where: str) -> str:
    return f"""{_ENTITIES}, t AS (SELECT sum(starlink)::BIGINT AS a, sum("usGov")::BIGINT AS b, sum(commercial)::BIGINT AS c FROM s WHERE {where})
SELECT 'starlink' AS segment, a AS total, a::DOUBLE / (a + b + c) AS share FROM t UNION ALL SELECT 'usGov', b, b::DOUBLE / (a + b + c) FROM t UNION ALL SELECT 'commercial', c, c::DOUBLE / (a + b + c) FROM t"""


@_query(_share("true"))
def segment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.segment_share(entity_series(spark, sf_dir), ["starlink", "usGov", "commercial"])


@_query(_share(f"bucket >= {SPLIT_YEAR}"))
def segment_share_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.segment_share(entity_series(spark, sf_dir), ["starlink", "usGov", "commercial"], SPLIT_YEAR)


@_query(f'{_ENTITIES} SELECT *, starlink + "usGov" + commercial AS total, starlink::DOUBLE / (starlink + "usGov" + commercial) AS starlink_share, "usGov"::DOUBLE / (starlink + "usGov" + commercial) AS "usGov_share", commercial::DOUBLE / (starlink + "usGov" + commercial) AS commercial_share FROM s')
def segment_row_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.row_shares(entity_series(spark, sf_dir), ["starlink", "usGov", "commercial"])


_YEARS = f"{WITH}, y AS (SELECT year(ldate::DATE) AS bucket, {_MASS} FROM objects GROUP BY 1)"


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mass_by_year(spark, sf_dir).withColumn("bucket", F.col("label").cast("int"))


@_query(f"{_YEARS} SELECT bucket, mass_kg AS value FROM y ORDER BY mass_kg DESC, bucket LIMIT 1")
def peak_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.peak(_years(spark, sf_dir), "mass_kg")


@_query(f"""{_YEARS}, t AS (SELECT sum(mass_kg) FILTER (WHERE bucket BETWEEN {LEAST_YEAR} AND {SPLIT_YEAR - 1})::BIGINT AS before_total, count(*) FILTER (WHERE bucket BETWEEN {LEAST_YEAR} AND {SPLIT_YEAR - 1}) AS before_buckets,
 sum(mass_kg) FILTER (WHERE bucket >= {SPLIT_YEAR})::BIGINT AS after_total, count(*) FILTER (WHERE bucket >= {SPLIT_YEAR}) AS after_buckets FROM y)
SELECT *, before_total::DOUBLE / before_buckets AS before_mean, after_total::DOUBLE / after_buckets AS after_mean, (after_total::DOUBLE / after_buckets) / (before_total::DOUBLE / before_buckets) AS ratio FROM t""")
def era_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.era_compare(_years(spark, sf_dir), "mass_kg", LEAST_YEAR, SPLIT_YEAR)


@_query(f"{_YEARS} SELECT sum(mass_kg)::BIGINT AS total FROM y")
def series_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.total(_years(spark, sf_dir), "mass_kg")


# ---- cadence --------------------------------------------------------------------------------------------------
_TRIES = f"{WITH}, tries AS (SELECT year(ldate::DATE) AS year, {SQL_PROVIDER} AS provider, coalesce(lv_family, lv, 'Unknown') AS vehicle, lower(lv_family || ' ' || lv) AS text FROM launches WHERE orbital)"
_LATE = f"year >= {LEAST_YEAR}"
_GROUPED = f"""{_TRIES}, g AS (SELECT CASE grouping_id(provider, vehicle) WHEN 3 THEN 'year' WHEN 1 THEN 'provider' WHEN 0 THEN 'provider_vehicle' ELSE 'vehicle' END AS level, year, provider, vehicle, count(*) AS n
 FROM tries WHERE {_LATE} GROUP BY GROUPING SETS ((year), (year, provider), (year, provider, vehicle), (year, vehicle)))"""


@_query(f"{_GROUPED} SELECT * FROM g")
def cadence_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.launch_rate(launches(spark, sf_dir), LEAST_YEAR, SEGMENT_RULES)


@_query(f"{_TRIES} SELECT year, vehicle, count(*) AS n, min(provider) AS provider FROM tries WHERE {_LATE} GROUP BY 1, 2")
def vehicle_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.vehicle_providers(launches(spark, sf_dir), LEAST_YEAR, SEGMENT_RULES)


@_query(f"{WITH}, t AS (SELECT year(ldate::DATE) AS year, {SQL_PROVIDER} AS provider, coalesce(lv_family, lv, 'Unknown') AS vehicle, launch_tag FROM launches WHERE orbital) SELECT year, vehicle, count(*) AS n, arg_min(provider, launch_tag % 1009 * 1000000 + launch_tag) AS provider FROM t WHERE {_LATE} GROUP BY 1, 2")
def vehicle_providers_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider of a vehicle's first launch of a year, where launches have an order."""
    place = F.col("launch_tag") % 1009 * 1_000_000 + F.col("launch_tag")
    return cadence.vehicle_providers(launches(spark, sf_dir).withColumn("pos", place), LEAST_YEAR, SEGMENT_RULES)


@_query(f"""{_TRIES}, v AS (SELECT year, provider, vehicle, count(*) AS n FROM tries WHERE {_LATE} GROUP BY ALL),
p AS (SELECT year, provider, sum(n)::BIGINT AS n, string_agg(vehicle || '=' || n, ',' ORDER BY n DESC, vehicle) AS inner_text FROM v GROUP BY ALL),
w AS (SELECT year, vehicle, sum(n)::BIGINT AS n, min(provider) AS provider FROM v GROUP BY ALL)
SELECT p.year, string_agg(p.provider || ':' || p.n || '(' || inner_text || ')', ';' ORDER BY p.n DESC, p.provider) AS providers,
 (SELECT string_agg(vehicle || '=' || n || '@' || provider, ';' ORDER BY n DESC, vehicle) FROM w WHERE w.year = p.year) AS vehicles, sum(p.n)::BIGINT AS total FROM p GROUP BY p.year""")
def cadence_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form, its arrays written as text so that both engines can be compared."""
    nested = cadence.nested_rate(cadence_grouping_sets(spark, sf_dir), vehicle_providers(spark, sf_dir))
    inner = lambda v: F.concat(v["vehicle"], F.lit("="), v["count"].cast("string"))
    providers = F.transform("providers", lambda p: F.concat(p["provider"], F.lit(":"), p["count"].cast("string"), F.lit("("), F.array_join(F.transform(p["vehicles"], inner), ","), F.lit(")")))
    vehicles = F.transform("vehicles", lambda v: F.concat(inner(v), F.lit("@"), v["provider"]))
    return nested.select("year", F.array_join(providers, ";").alias("providers"), F.array_join(vehicles, ";").alias("vehicles"), "total")


_RANKS = f"""{_TRIES}, c AS (SELECT year, provider, count(*) AS n FROM tries WHERE {_LATE} GROUP BY ALL),
r AS (SELECT year, provider, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, provider) AS rank, n::DOUBLE / sum(n) OVER (PARTITION BY year) AS share, first_value(provider) OVER (PARTITION BY year ORDER BY n DESC, provider) AS leader FROM c)"""


@_query(f"{_RANKS} SELECT * FROM r")
def cadence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.provider_ranks(launches(spark, sf_dir), LEAST_YEAR, SEGMENT_RULES)


@_query(f"{_RANKS} SELECT year, provider, n, rank, share, provider = 'Builders' AS highlight FROM r WHERE rank <= 2")
def cadence_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.top_n(cadence_rank(spark, sf_dir), 2, highlight="Builders")


@_query(f"{_TRIES} SELECT min(year) AS year FROM (SELECT DISTINCT year FROM tries WHERE {_LATE} ORDER BY year DESC LIMIT 2)")
def latest_complete_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.latest_complete_year(launches(spark, sf_dir), LEAST_YEAR)


@_query(f"{_TRIES} SELECT DISTINCT year FROM tries WHERE {_LATE} ORDER BY year DESC LIMIT 3")
def recent_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.recent_years(launches(spark, sf_dir), 3, LEAST_YEAR)


CONTENDERS = ((1, "Carriage", "Carriers", ("automobile", "machin")), (2, "Urgent house", "Homes", ("household 1",)), (3, "Rocket", "Nobody", ("rocket",)), (4, "Low", "Others", ("5-low", "building 4")))


@_query(f"""{_TRIES}, w(ord, vehicle, provider, patterns) AS (VALUES (1, 'Carriage', 'Carriers', ['automobile', 'machin']), (2, 'Urgent house', 'Homes', ['household 1']), (3, 'Rocket', 'Nobody', ['rocket']), (4, 'Low', 'Others', ['5-low', 'building 4']))
SELECT w.ord, w.vehicle, w.provider, CASE WHEN count(t.year) > 0 THEN 'FLYING' ELSE 'AWAITING' END AS status, min(t.year) AS first_year, count(t.year) AS total_launches
FROM w LEFT JOIN tries t ON len(list_filter(w.patterns, lambda p: contains(t.text, p))) > 0 GROUP BY ALL""")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.watchlist(launches(spark, sf_dir), CONTENDERS)


def _programs():
    return {"auto": classify.equals(F.col("lv_family"), "automobile") & (F.col("ldate") < "2000"), "build": classify.equals(F.col("lv_family"), "building") & (F.col("ldate") >= "1998")}


_ALIGNED = f"""{WITH}, n AS (SELECT CASE WHEN lower(lv_family) = 'automobile' AND ldate < '2000' THEN 'auto' WHEN lower(lv_family) = 'building' AND ldate >= '1998' THEN 'build' END AS program, year(ldate::DATE) AS year, count(*) AS n FROM launches WHERE orbital GROUP BY ALL),
s AS (SELECT program, min(year) AS first, max(year) AS last FROM n WHERE program IS NOT NULL GROUP BY 1),
x AS (SELECT s.program, y AS year, y - first + 1 AS program_year, coalesce(n.n, 0) AS n FROM s, range(1900, 2100) r(y) LEFT JOIN n ON n.program = s.program AND n.year = y WHERE y BETWEEN first AND last),
a AS (SELECT program_year, max(year) FILTER (WHERE program = 'auto') AS auto_year, max(n) FILTER (WHERE program = 'auto') AS auto_count, max(year) FILTER (WHERE program = 'build') AS build_year, max(n) FILTER (WHERE program = 'build') AS build_count FROM x GROUP BY 1)"""


@_query(f"{_ALIGNED} SELECT * FROM a")
def program_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.aligned_programs(launches(spark, sf_dir), _programs())


@_query(f"{_ALIGNED} SELECT program, min(year) AS first_year, sum(n)::BIGINT AS total FROM x GROUP BY 1")
def program_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadence.program_totals(launches(spark, sf_dir), _programs())


@_query(f"""{_ALIGNED}, e(program, program_year, calendar_year, label) AS (VALUES ('auto', 1, 1995, 'FIRST'), ('auto', 5, 1999, 'LAST'), ('auto', 6, 2000, 'LATE'), ('build', 2, 1999, 'SECOND'), ('build', 9, 2006, 'NEVER'))
SELECT e.*, CASE program WHEN 'auto' THEN auto_count ELSE build_count END AS value FROM e JOIN a USING (program_year) WHERE CASE program WHEN 'auto' THEN auto_count ELSE build_count END IS NOT NULL""")
def program_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = cadence.cadence_events(spark, [("auto", 1, 1995, "FIRST"), ("auto", 5, 1999, "LAST"), ("auto", 6, 2000, "LATE"), ("build", 2, 1999, "SECOND"), ("build", 9, 2006, "NEVER")])
    return cadence.program_events(program_aligned(spark, sf_dir), events, ["auto", "build"])


# ---- distributions --------------------------------------------------------------------------------------------
def _cdf(rows: str, points: int = 250, least: int = 0) -> str:
    """rows: a query of (grp, m)."""
    return f"""d AS (SELECT grp, m, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n, max(m) OVER (PARTITION BY grp) AS top FROM ({rows}) WHERE grp IS NOT NULL AND m > 0),
q AS (SELECT *, greatest(1, n // {points}) AS step FROM d WHERE n > {least}),
p AS (SELECT grp, i, m, (i + 1)::DOUBLE / n AS f, top, n FROM q WHERE i % step = 0),
z AS (SELECT grp, arg_max(m, i) AS m_last, any_value(top) AS top, any_value(n) AS n FROM p GROUP BY 1),
c AS (SELECT grp, i, m, f FROM p UNION ALL SELECT grp, n - 1, top, 1.0 FROM z WHERE m_last <> top)"""


_Q = "CASE WHEN quantity <> 13 THEN quantity END"
_PRICE = "price::DOUBLE"


def _quantity():
    return F.when(F.col("quantity") != 13, F.col("quantity"))


def _price():
    return F.col("price").cast("double")


@_query(f"{WITH}, {_cdf(f'SELECT 1 AS grp, {_Q} AS m FROM objects')} SELECT * FROM c")
def cdf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.sampled_cdf(objects(spark, sf_dir), F.lit(1), _quantity())


@_query(f"{WITH}, {_cdf(f'SELECT object_class AS grp, {_PRICE} AS m FROM objects', least=20)} SELECT * FROM c")
def cdf_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.sampled_cdf(objects(spark, sf_dir), F.col("object_class"), _price(), least_rows=20)


@_query(f"{WITH}, {_cdf(f'SELECT owner AS grp, {_Q} AS m FROM objects WHERE owner IN (SELECT owner FROM objects WHERE quantity <> 13 GROUP BY owner ORDER BY count(*) DESC, owner LIMIT 7)')} SELECT * FROM c")
def cdf_by_top_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.top_group_cdf(objects(spark, sf_dir, "owner"), F.col("owner"), _quantity())


@_query(f"""{WITH}, {_cdf(f'SELECT object_class AS grp, {_PRICE} AS m FROM objects')},
pts AS (SELECT grp, log10(m) AS x, f, i FROM c), grid AS (SELECT DISTINCT floor(x * 100 + 0.5) / 100 AS x FROM pts), firsts AS (SELECT grp, min(x) AS x0, arg_min(f, i) AS f0 FROM pts GROUP BY 1)
SELECT firsts.grp, grid.x AS log_m, CASE WHEN grid.x <= x0 THEN f0 ELSE (SELECT max(f) FROM pts WHERE pts.grp = firsts.grp AND pts.x <= grid.x) END AS f FROM firsts, grid""")
def cdf_common_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.common_grid(cdf.sampled_cdf(objects(spark, sf_dir), F.col("object_class"), _price()))


_TYPE = "CASE object_class WHEN 'N' THEN 'Payload' ELSE object_class END"


@_query(f"{WITH}, {_cdf(f"SELECT {_TYPE} AS grp, mass_kg::DOUBLE AS m FROM objects WHERE object_class IN ('N', 'R')", least=20)} SELECT * FROM c")
def cdf_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.segmented_cdf(objects(spark, sf_dir), "type", ("N", "R"), {"N": "Payload"})


@_query(f"{WITH}, {_cdf('SELECT state AS grp, mass_kg::DOUBLE AS m FROM objects WHERE state IN (SELECT state FROM objects WHERE mass_kg > 0 GROUP BY state ORDER BY count(*) DESC, state LIMIT 3)')} SELECT * FROM c")
def cdf_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.segmented_cdf(objects(spark, sf_dir, "owner"), "nation", k=3)


@_query(f"{WITH}, {_cdf('SELECT site AS grp, mass_kg::DOUBLE AS m FROM objects WHERE site IN (SELECT site FROM objects WHERE mass_kg > 0 GROUP BY site ORDER BY count(*) DESC, site LIMIT 4)')} SELECT * FROM c")
def cdf_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdf.segmented_cdf(objects(spark, sf_dir, "launch"), "site", k=4)


# ---- joins, audits, reconciliation ----------------------------------------------------------------------------
@_query(f"{WITH}, few AS (SELECT * FROM launches WHERE orbital) SELECT o.jcat, o.launch_tag, o.quantity, f.lv, f.lv_family, f.site FROM objects o LEFT JOIN few f ON o.launch_tag = f.launch_tag")
def enrich_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.enrich(objects(spark, sf_dir).select("jcat", "launch_tag", "quantity"), launches(spark, sf_dir).filter("orbital"))


MEMBERS = ((1, "Brand#1", "First", 81600), (2, "Brand#2", "Second", 79500), (3, "Brand#3", "Third", 78450), (4, "Brand#99", "None", 78000))
_MEMBERS = "m(ord, member, name, published_dry_kg) AS (VALUES (1, 'Brand#1', 'First', 81600), (2, 'Brand#2', 'Second', 79500), (3, 'Brand#3', 'Third', 78450), (4, 'Brand#99', 'None', 78000))"
_AUDIT = f"""{WITH}, {_MEMBERS}, t AS (SELECT coalesce(mass_kg, 0) AS mass, member, published_dry_kg FROM objects LEFT JOIN m ON pl_name = member WHERE object_class = 'N' AND lower(lv_family) = 'automobile'),
u AS (SELECT sum(mass) AS total, sum(mass) FILTER (WHERE member IS NOT NULL) AS own, sum(mass) FILTER (WHERE member IS NULL) AS other, count(member) AS flights, count(*) - count(member) AS cargo_objects, sum(published_dry_kg)::BIGINT AS dry FROM t),
au AS (SELECT {_R.format('total')} AS total_kg, {_R.format('own')} AS orbiter_kg, {_R.format('other')} AS cargo_kg, flights, cargo_objects, dry AS theorized_dry_kg, {_R.format('greatest(0, total - dry)')} AS theorized_delivered_kg,
 own::DOUBLE / total::DOUBLE AS orbiter_share, total::DOUBLE / flights AS mean_kg_per_flight FROM u)"""


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir, "part", "launch").filter(classify.equals(F.col("lv_family"), "automobile"))


@_query(f"{_AUDIT} SELECT * FROM au")
def audit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split(_family(spark, sf_dir), F.col("pl_name"), audit.orbiters(spark, MEMBERS))


@_query(f"{WITH} SELECT {_R.format('sum(coalesce(mass_kg, 0))')} AS total_kg, count(*) AS payload_count FROM objects WHERE object_class = 'N' AND lower(lv_family) = 'building'")
def family_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.family_total(_payloads(spark, sf_dir, "launch"), "building")


@_query(f"""{_AUDIT}, o AS (SELECT {_R.format('sum(coalesce(mass_kg, 0))')} AS right_kg FROM objects WHERE object_class = 'N' AND lower(lv_family) = 'building')
SELECT total_kg AS left_kg, right_kg, greatest(total_kg, right_kg) AS most_kg FROM au, o""")
def compared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.compared_totals(audit_split(spark, sf_dir), family_total(spark, sf_dir))


@_query(f"""{_AUDIT}, k AS (SELECT member, count(*) AS n, sum(mass) AS mass FROM t GROUP BY 1)
SELECT ord, m.member, name, published_dry_kg, coalesce(n, 0) AS flights, {_R.format('coalesce(mass, 0)')} AS mass_kg, coalesce(n, 0) * published_dry_kg AS theorized_dry_total_kg FROM m LEFT JOIN k ON m.member = k.member""")
def audit_per_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.per_member(_family(spark, sf_dir), F.col("pl_name"), audit.orbiters(spark, MEMBERS))


@_query(f"""{_AUDIT}, b AS (SELECT lv_family AS label, {_R.format('sum(coalesce(mass_kg, 0))')} AS mass_kg FROM objects WHERE object_class = 'N' GROUP BY 1)
SELECT label, mass_kg AS delivered_kg, 0::BIGINT AS own_kg, false AS derived FROM b WHERE label <> 'AUTOMOBILE' UNION ALL SELECT 'AUTOMOBILE', cargo_kg, orbiter_kg, false FROM au UNION ALL SELECT 'Automobile (theorized)', theorized_delivered_kg, theorized_dry_kg, true FROM au""")
def split_row_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_label = mass.mass_by(_payloads(spark, sf_dir, "launch"), F.coalesce("lv_family", "lv"), PAYLOAD, top=15)
    return audit.split_row_table(by_label, audit_split(spark, sf_dir), "AUTOMOBILE", "AUTOMOBILE", "Automobile (theorized)")


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as a publisher might give them, from half of the providers' totals, and one that nobody else knows."""
    totals = upmass_by_provider(spark, sf_dir).filter("provider <> 'Carriers'").select("provider", F.when(F.col("provider") == "Builders", F.col("mass_kg") + 1000).otherwise(F.floor(F.col("mass_kg") / 2)).cast("long").alias("kg"))
    return totals.unionByName(spark.createDataFrame([("Space One", 69)], "provider string, kg long"))


_RECONCILED = f"""{_UPMASS}, pub AS (SELECT provider, CASE WHEN provider = 'Builders' THEN mass_kg + 1000 ELSE mass_kg // 2 END AS kg FROM upmass WHERE provider <> 'Carriers' UNION ALL SELECT 'Space One', 69),
j AS (SELECT coalesce(pub.provider, upmass.provider) AS provider, coalesce(kg, 0)::BIGINT AS published_kg, coalesce(mass_kg, 0)::BIGINT AS computed_kg, coalesce(count, 0)::BIGINT AS count FROM pub FULL JOIN upmass ON pub.provider = upmass.provider WHERE kg IS NOT NULL OR mass_kg > 0),
rec AS (SELECT *, computed_kg - published_kg AS delta_kg, CASE WHEN published_kg = 0 AND computed_kg = 0 THEN 'NO DATA' WHEN computed_kg = 0 THEN 'LEFT_ONLY' WHEN published_kg = 0 THEN 'RIGHT_ONLY'
 WHEN computed_kg::DOUBLE / published_kg BETWEEN 0.95 AND 1.05 THEN 'MATCH' WHEN computed_kg::DOUBLE / published_kg BETWEEN 0.8 AND 1.2 THEN 'CLOSE' WHEN computed_kg < published_kg THEN 'LOWER' ELSE 'HIGHER' END AS verdict FROM j)"""


@_query(f"{_RECONCILED} SELECT * FROM rec")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconcile(_published(spark, sf_dir), upmass_by_provider(spark, sf_dir))


@_query(f"""{_RECONCILED}, t AS (SELECT sum(mass_kg)::BIGINT AS total FROM upmass)
SELECT 200000000::BIGINT AS published_total_kg, total AS computed_total_kg, least(total, 200000000)::DOUBLE / greatest(total, 200000000) * 100 AS agreement_pct,
 (SELECT count(*) FROM rec WHERE verdict = 'MATCH') AS matches, (SELECT count(*) FROM rec WHERE published_kg > 0 AND computed_kg = 0) AS gaps FROM t""")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconcile_summary(reconcile(spark, sf_dir), 200_000_000, upmass_totals(spark, sf_dir))


# ---- lifetimes and orbits -------------------------------------------------------------------------------------
_LIVES = f"""{WITH}, days AS (SELECT datediff('day', DATE '1957-01-01', ldate::DATE) AS lday, CASE WHEN sat_state = 'F' THEN datediff('day', DATE '1957-01-01', shipdate::DATE) END AS dday, perigee_km, apogee_km, inc_deg, object_class, sat_state FROM objects),
life AS (SELECT lday, coalesce(dday, -1) AS dday, floor(perigee_km::DOUBLE + 0.5)::BIGINT AS p, floor(apogee_km::DOUBLE + 0.5)::BIGINT AS a, floor(inc_deg * 10 + 0.5) / 10 AS i, object_class AS c FROM days WHERE lday >= 0 AND (sat_state <> 'F' OR (dday BETWEEN 0 AND 30000 AND lday <= dday)))"""


@_query(f"{_LIVES} SELECT * FROM life")
def lifetimes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lives(spark, sf_dir).orderBy("lday")


def _lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.datediff(F.to_date("shipdate"), F.lit(dates.EPOCH).cast("date"))
    return lifetimes.lifetimes(objects(spark, sf_dir, "part", "launch"), decay_day=ship, decays=decays())


QUERIES["lifetimes"], ORACLE_SQL["lifetimes"] = QUERIES.pop("lifetimes_table"), ORACLE_SQL.pop("lifetimes_table")


@_query(f"{_LIVES} SELECT count(*) AS total, count(*) FILTER (WHERE dday >= 0) AS decayed, count(*) FILTER (WHERE dday < 0) AS in_orbit, min(lday) AS day_min, greatest(max(CASE WHEN dday >= 0 THEN dday ELSE lday END), {TODAY}) AS day_max FROM life")
def lifetime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.lifetime_summary(_lives(spark, sf_dir), TODAY)


@_query(f"{_LIVES} SELECT * FROM life WHERE lday <= {DAY} AND (dday < 0 OR dday >= {DAY})")
def active_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.active_on(_lives(spark, sf_dir), DAY)


@_query(f"{_LIVES}, s AS (SELECT lday AS day, 1 AS d FROM life UNION ALL SELECT dday + 1, -1 FROM life WHERE dday >= 0), t AS (SELECT day, sum(d) AS d FROM s GROUP BY 1) SELECT day, (sum(d) OVER (ORDER BY day))::BIGINT AS active FROM t")
def active_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.active_daily(_lives(spark, sf_dir))


_FRAC = f"CASE WHEN dday < 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - ({DAY} - lday)::DOUBLE / greatest(1, dday - lday)) END"
_ALTITUDE = f"{_LIVES}, up AS (SELECT *, {_FRAC} AS frac, p * ({_FRAC}) AS cur_p, a * ({_FRAC}) AS cur_a FROM life WHERE lday <= {DAY} AND (dday < 0 OR dday >= {DAY}))"


@_query(f"{_ALTITUDE} SELECT *, dday >= 0 AND cur_p < 100 AS hot FROM up")
def altitude_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.altitude_on(_lives(spark, sf_dir), DAY)


@_query(f"{_ALTITUDE} SELECT count(*) FILTER (WHERE dday >= 0 AND cur_p < 100) AS near_reentry FROM up")
def near_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.hot_count(_lives(spark, sf_dir), DAY)


@_query(f"""{_LIVES}, changes AS (SELECT lday AS day FROM life UNION SELECT dday + 1 FROM life WHERE dday >= 0),
seen AS (SELECT day, count(*) AS active, count(*) FILTER (WHERE dday >= 0 AND p * greatest(0.0::DOUBLE, 1.0 - (day - lday)::DOUBLE / greatest(1, dday - lday)) < 100) AS near_reentry
 FROM range((SELECT min(day) FROM changes), (SELECT max(day) + 1 FROM changes)) r(day) JOIN life ON lday <= day AND (dday < 0 OR dday >= day) GROUP BY 1)
SELECT * FROM seen""")
def near_reentry_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both numbers on every day of the whole span on which anything is up: days without a change repeat the last ones."""
    steps = lifetimes.near_reentry_daily(_lives(spark, sf_dir))
    following = F.lead("day").over(Window.orderBy("day"))  # a row for each day
    days = steps.withColumn("next", F.coalesce(following, F.col("day") + 1)).filter("active > 0")
    return days.select(F.explode(F.sequence("day", F.col("next") - 1)).alias("day"), "active", "near_reentry")


_MONTHS = f"{_LIVES}, asked AS (SELECT DISTINCT datediff('day', DATE '1957-01-01', date_trunc('month', o_orderdate)::DATE) AS day FROM orders)"
_FRAC_AT = "CASE WHEN dday < 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0 - (day - lday)::DOUBLE / greatest(1, dday - lday)) END"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.datediff(F.to_date(F.date_trunc("month", "o_orderdate")), F.lit(dates.EPOCH).cast("date")).alias("day")).distinct()


@_query(f"""{_MONTHS}, up AS (SELECT day, dday, p * ({_FRAC_AT}) AS cur_p, a * ({_FRAC_AT}) AS cur_a FROM asked JOIN life ON lday <= day AND (dday < 0 OR dday >= day))
SELECT day, count(*) AS active, count(*) FILTER (WHERE dday >= 0 AND cur_p < 100) AS near_reentry, sum(floor(cur_p + 0.5)::BIGINT)::BIGINT AS perigees, max(floor(cur_a + 0.5)::BIGINT) AS highest FROM up GROUP BY 1""")
def altitudes_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitudes of all objects on the first of every month, summed up."""
    up = lifetimes.altitude_at(_lives(spark, sf_dir), _months(spark, sf_dir))
    return up.groupBy("day").agg(F.count("*").alias("active"), F.count_if("hot").alias("near_reentry"), F.sum(text.half_up(F.col("cur_p"))).alias("perigees"), F.max(text.half_up(F.col("cur_a"))).alias("highest"))


@_query(f"{_MONTHS} SELECT day AS from_day, day + 400 AS to_day, c, count(*) AS n, sum(p)::BIGINT AS perigees FROM asked JOIN life ON lday <= day + 400 AND (dday < 0 OR dday >= day) GROUP BY ALL")
def active_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are up at some time in windows of 401 days from the first of every month, by class."""
    windows = _months(spark, sf_dir).select(F.col("day").alias("from_day"), (F.col("day") + 400).alias("to_day"))
    return lifetimes.active_during(_lives(spark, sf_dir), windows).groupBy("from_day", "to_day", "c").agg(F.count("*").alias("n"), F.sum("p").alias("perigees"))


@_query(f"{WITH} SELECT perigee_km AS p, inc_deg AS i, object_class AS c FROM objects")
def orbital_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.orbital_points(objects(spark, sf_dir, "part"))


@_query(f"{WITH} SELECT CASE WHEN object_class IN ('N', 'R') THEN object_class ELSE '_other' END AS bucket, count(*) AS n FROM objects WHERE perigee_km <= 1000 GROUP BY 1")
def low_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.low_points(orbital_points(spark, sf_dir), 1000, ("N", "R")).groupBy("bucket").agg(F.count("*").alias("n"))


@_query(f"""{WITH}, s AS (SELECT DISTINCT perigee_km, apogee_km, inc_deg, apogee_km + 6371.0::DOUBLE AS far, perigee_km + 6371.0::DOUBLE AS near FROM objects)
SELECT perigee_km, apogee_km, inc_deg, (far + near) / 2 AS semi_major_km, (far - near) / 2 AS offset_km, sqrt(greatest(1.0, ((far + near) / 2) * ((far + near) / 2) - ((far - near) / 2) * ((far - near) / 2))) AS semi_minor_km,
 CASE WHEN inc_deg >= 70 THEN 'POLAR' WHEN inc_deg < 20 THEN 'EQUATORIAL' ELSE 'INCLINED' END AS inclination_class FROM s""")
def orbit_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifetimes.orbit_shapes(objects(spark, sf_dir, "part").select("perigee_km", "apogee_km", "inc_deg").distinct())


# ---- explorer -------------------------------------------------------------------------------------------------
_FOUND = "(contains(lower(name), 'gear') OR contains(lower(pl_name), 'gear') OR contains(lower(jcat), 'gear'))"
_EXPLORED = f"{WITH}, found AS (SELECT jcat, satno, name, pl_name, owner, object_class, mass_kg, price FROM objects WHERE {_FOUND} AND object_class = 'N' AND owner = 'NATION_3')"


def _explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir, "part", "owner").select("jcat", "satno", "name", "pl_name", "owner", "object_class", "mass_kg", "price").withColumn("pos", F.struct("jcat", "price"))


def _explore(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return explore.explore(_explored(spark, sf_dir), "GEAR ", {"object_class": "N", "owner": "NATION_3", "sat_state": ""}, "mass_kg", "desc", page="2", limit=20, collation=None)


@_query(f"{_EXPLORED} SELECT * FROM found ORDER BY mass_kg DESC NULLS LAST, jcat, price LIMIT 20 OFFSET 20")
def explore_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explore(spark, sf_dir)[0].drop("pos")


@_query(f"{_EXPLORED} SELECT count(*) AS total, 2 AS page, 20 AS \"limit\", ceil(count(*) / 20.0)::BIGINT AS pages, CASE WHEN count(*) > 20 THEN 21 ELSE 0 END AS first, CASE WHEN count(*) > 20 THEN least(count(*), 40) ELSE 0 END AS last FROM found")
def explore_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explore(spark, sf_dir)[1]


# words of capital letters and digits: there the default collation and code units agree
@_query(f"{WITH} SELECT jcat, owner, price FROM objects WHERE object_class = 'N' ORDER BY owner COLLATE nocase, jcat, price LIMIT 50 OFFSET 100")
def explore_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.explore(_explored(spark, sf_dir), equal={"object_class": "N"}, sort="owner", order="asc", page=3)[0].select("jcat", "owner", "price")


@_query(f"{WITH} SELECT jcat, name, satno FROM objects WHERE contains(lower(name), '3') OR contains(lower(pl_name), '3') OR contains(jcat, '3') OR contains(satno::VARCHAR, '3')")
def explore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.search(_explored(spark, sf_dir), "3").select("jcat", "name", "satno")


#: Names with accents and small letters, by size of a part, in an order that isn't that of code units.
ACCENTED = ("zebra", "Zulu", "éclair", "Eclair", "eclair", "Éclair", "apex", "Ärger", "alpha", "beta")
_ACCENTED = f"{WITH}, named AS (SELECT jcat, price, ([{', '.join(repr(x) for x in ACCENTED)}])[1 + (perigee_km // 40) % 10] AS name FROM objects)"


def _accented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = objects(spark, sf_dir, "part", "owner", "launch").select("jcat", "price", (F.col("perigee_km") / 40).cast("int").alias("size"))
    return rows.select("jcat", "price", F.get(F.array(*map(F.lit, ACCENTED)), F.col("size") % 10).alias("name"), F.struct("jcat", "price").alias("pos"))


@_query(f"{_ACCENTED} SELECT jcat, price, name FROM named ORDER BY name COLLATE en DESC, jcat, price LIMIT 100 OFFSET 2400")
def explore_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page in collated order from a directory of pages."""
    folder = shared.temporary_dir(spark, "pages")
    explore.write_pages(_accented(spark, sf_dir), folder, "name", "desc", each=1000)
    return explore.read_page(spark, folder, "25th", 100)[0].select("jcat", "price", "name")


@_query(f"{_ACCENTED} SELECT jcat, price, name FROM named WHERE name COLLATE en > 'éclair' COLLATE en OR (name = 'éclair' AND jcat > '2') ORDER BY name COLLATE en, jcat, price LIMIT 500")
def explore_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a row, in collated order."""
    last = F.struct(F.lit("2").alias("jcat"), F.lit(0).cast("decimal(18,2)").alias("price"))
    return explore.page_after(_accented(spark, sf_dir), "name", "asc", "éclair", last, 500).select("jcat", "price", "name")


@_query(f"{WITH} SELECT jcat, name, satno FROM objects WHERE contains(lower(name), 'ge gea') OR contains(lower(pl_name), 'ge gea') OR contains(jcat, 'ge gea') OR contains(satno::VARCHAR, 'ge gea')")
def explore_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by an index of trigrams."""
    folder = shared.temporary_dir(spark, "index")
    search.write_index(_explored(spark, sf_dir), folder, each=2000)
    return search.search_index(spark, folder, "GE gea").select("jcat", "name", "satno")


# ---- a rollup, bucketed tables, snapshots ---------------------------------------------------------------------
def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of two parts of the objects, merged."""
    rows = objects(spark, sf_dir, "part", "owner", "launch")
    halves = [rollup.rollup(rows.filter(F.col("launch_tag") % 2 == k), "month", constellation="GEAR") for k in (0, 1)]
    return shared.materialize(rollup.merged(*halves), "rollup")


@_query(ORACLE_SQL["summary"])
def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.summary(_rolled(spark, sf_dir), PAYLOAD)


@_query(f"{WITH} SELECT 'year' AS by, ldate[1:4] AS label, {_MASS} FROM objects GROUP BY 2 UNION ALL SELECT 'state', coalesce(state, 'Unknown'), {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 2 UNION ALL SELECT 'orbit', coalesce(op_orbit, 'Unknown'), {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 2 UNION ALL SELECT 'vehicle', coalesce(lv_family, lv), {_MASS} FROM objects WHERE object_class = 'N' GROUP BY 2")
def rollup_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses by four keys from one rollup: the objects are scanned once for all."""
    rolled = _rolled(spark, sf_dir)
    own = mass.payloads(rolled, PAYLOAD)
    found = [("year", rollup.mass_by_year(rolled, PAYLOAD))] + [(n, rollup.mass_by(own, k, PAYLOAD)) for n, k in (("state", F.col("state")), ("orbit", F.col("op_orbit")), ("vehicle", F.coalesce("lv_family", "lv")))]
    return functools.reduce(DataFrame.unionByName, [x.withColumn("by", F.lit(n)) for n, x in found])


@_query(f"{WITH} {_sums(_SITE, ['cape', 'vandenberg', 'other'], f'{_OWN} AND year(ldate::DATE) >= {LEAST_YEAR}')}")
def rollup_site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mass.payloads(_rolled(spark, sf_dir), PAYLOAD).filter(classify.holds(F.col("lv_family"), "auto"))
    return series.segment_series(rows, _year(), classify.site_bucket(F.col("site"), SITES), ["cape", "vandenberg", "other"], least=LEAST_YEAR)


@_query(f"{WITH}, few AS (SELECT * FROM launches WHERE orbital), o AS (SELECT jcat, CASE WHEN satno <= 2 THEN 1 ELSE launch_tag END AS launch_tag, quantity FROM objects) SELECT o.jcat, o.launch_tag, o.quantity, f.lv, f.lv_family, f.site FROM o LEFT JOIN few f ON o.launch_tag = f.launch_tag")
def enrich_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and launches in buckets of the launch tag, a third of the objects under one tag."""
    rows = objects(spark, sf_dir).select("jcat", F.when(F.col("satno") <= 2, F.lit(1).cast("long")).otherwise(F.col("launch_tag")).alias("launch_tag"), "quantity")
    name = f"orrery_{uuid.uuid4().hex}"
    catalogs.write_bucketed(rows, launches(spark, sf_dir).filter("orbital"), name, shared.temporary_dir(spark, "bucketed"), buckets=16)
    return catalogs.enrich_bucketed(spark, name)


@_query(f"{WITH} SELECT coalesce(ldate[1:4], 'none') AS part, count(*) AS n, sum(price)::DECIMAL(38,2) AS price FROM objects GROUP BY 1")
def snapshot_by_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog without its last two years, then the whole one: the second snapshot writes the new years alone."""
    folder, tag = shared.temporary_dir(spark, "silver"), shared.materialize(launches(spark, sf_dir), "launches")
    rows = shared.materialize(objects(spark, sf_dir, "launch").select("jcat", "launch_tag", "ldate", "price", "object_class"), "objects")
    snapshots.update(rows.filter("ldate < '2000'"), tag, folder)
    snapshots.update(rows, tag, folder)
    part = F.coalesce(dates.year_text(F.col("ldate")), F.lit(snapshots.NO_YEAR))
    return snapshots.read(spark, folder)[0].groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("price").cast("decimal(38,2)").alias("price"))


# ---- scalar functions -----------------------------------------------------------------------------------------
@_query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y') AS year, month(o_orderdate)::INTEGER AS month, datediff('day', DATE '1957-01-01', o_orderdate::DATE)::INTEGER AS day,
 datediff('day', DATE '1957-01-01', o_orderdate::DATE)::INTEGER AS decay_day, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    vague = F.concat(F.date_format("o_orderdate", " yyyy MMM "), F.lpad(F.date_format("o_orderdate", "d"), 2, " "), F.lit(" 1200?\r"))
    iso = dates.iso_date(vague)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", iso.alias("iso"), dates.decay_day_number(vague).alias("decay_day")).withColumn("day", dates.day_number(F.col("iso")))
    return rows.withColumns({"year": dates.year_text(F.col("iso")), "month": dates.month_number(F.col("iso")), "back": dates.day_to_date(F.col("day")).cast("string")})


@_query("SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey <> 0 THEN o_orderkey END AS number, (o_totalprice / 1000) AS tonnes, floor(o_totalprice + 0.5)::BIGINT AS rounded, floor(log10(o_totalprice) * 100 + 0.5) / 100 AS log_mass FROM orders")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = text.number(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("kg\r")))
    key = text.catalog_number(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("X"))).otherwise(F.concat(F.lit("A"), F.col("o_orderkey").cast("string"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("price"), key.alias("number"), text.tonnes(value).alias("tonnes"), F.floor(value + 0.5).alias("rounded"), classify.log_mass(value).alias("log_mass"))


@_query("""WITH c AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'LLEO/I' WHEN 1 THEN 'gto' WHEN 2 THEN 'GEO/S' WHEN 3 THEN 'Molniya' WHEN 4 THEN 'HELIO' WHEN 5 THEN 'SSO' WHEN 6 THEN '-' ELSE 'CLO/E' END AS code, p_brand FROM part)
SELECT p_partkey, code, CASE code WHEN 'LLEO/I' THEN 'LEO' WHEN 'gto' THEN 'GTO' WHEN 'GEO/S' THEN 'GEO' WHEN 'Molniya' THEN 'HEO' WHEN 'HELIO' THEN 'Deep Space' WHEN 'SSO' THEN 'SSO' WHEN 'CLO/E' THEN 'CLO' END AS orbit,
 p_brand[1:1] AS prefix, p_brand[2:] AS rest FROM c""")
def normalise_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ("LLEO/I", "gto", "GEO/S", "Molniya", "HELIO", "SSO", "-", "CLO/E")
    code = F.get(F.array(*map(F.lit, codes)), F.col("p_size") % 8)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), text.orbit_class(code).alias("orbit"), text.key_prefix(F.col("p_brand")).alias("prefix"), text.key_rest(F.col("p_brand")).alias("rest"))


@_query("SELECT p_partkey, p_name AS family, upper(p_type[1:1]) AS class, p_size % 3 <> 2 AS orbital FROM part")
def derive_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(F.lit(" v1.2"), F.lit(" Block 5B"), F.lit(" ECA"), F.lit("")), F.col("p_size") % 4)
    code = F.get(F.array(F.lit("os"), F.lit(" DX"), F.lit("SX")), F.col("p_size") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", text.vehicle_family(F.concat("p_name", tail)).alias("family"), text.object_class(F.lower("p_type")).alias("class"), text.is_orbital(code).alias("orbital"))


@_query(f"{WITH} SELECT launch_tag, {SQL_PROVIDER} AS provider, {_SITE} AS bucket, CASE WHEN orbital THEN 'Operational' ELSE '---' END AS state FROM launches")
def classify_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = launches(spark, sf_dir)
    return rows.select("launch_tag", classify.provider(F.col("lv_family"), F.col("lv"), SEGMENT_RULES).alias("provider"), classify.site_bucket(F.col("site"), SITES).alias("bucket"), classify.state_label(F.when(F.col("orbital"), "O")).alias("state"))


@_query("SELECT o_custkey AS launch_tag, arg_max(o_orderpriority, o_orderkey) AS site, min(o_orderkey) AS pos, max(o_orderkey) AS last FROM orders GROUP BY 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("launch_tag"), F.col("o_orderpriority").alias("site"), F.col("o_orderkey").alias("last"), F.col("o_orderkey").alias("pos"))
    return catalogs.last_wins(rows, "launch_tag")
