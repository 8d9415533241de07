"""Every registered query against its SQL, and the shapes of plans."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.operators import cdf, mass, ranks
from orrery.plans import queries as plans
from orrery.plans.adapters import launches, objects


def plain(row):
    return tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in row)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = oracle.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((plain(r) for r in got.select(*names).collect()), key=key) == sorted((plain(r) for r in want.fetchall()), key=key)


def test_totals_by_provider_and_by_year_agree(spark, sf_dir):
    rows = objects(spark, sf_dir, "launch").withColumn("mass_kg", F.floor("mass_kg"))
    by_provider = mass.upmass_by_provider(rows, "0000", "9999", payload="N").agg(F.sum("mass_kg")).first()[0]
    assert by_provider == mass.mass_by_year(mass.payloads(rows, "N")).agg(F.sum("mass_kg")).first()[0]


@pytest.mark.parametrize("n,values", [(1, "few"), (37, "few"), (777, "few"), (1300, "few"), (1000, "any"), (2777, "wide"), (1500, "close")])
def test_sampled_cdf_against_its_rule(spark, n, values):
    dice = random.Random(n)
    draw = {"few": lambda: float(dice.randint(1, 40)), "any": dice.random, "wide": lambda: 10 ** dice.uniform(-9, 9), "close": lambda: 1e6 + dice.random() * 1e-6}[values]
    masses = sorted(draw() for _ in range(n))
    step = max(1, n // 250)
    want = [(i, masses[i], (i + 1) / n) for i in range(0, n, step)]
    if want[-1][1] != masses[-1]:
        want.append((n - 1, masses[-1], 1.0))
    rows = spark.createDataFrame([("a", m) for m in masses], "g string, m double")
    got = [(r.i, r.m, r.f) for r in cdf.sampled_cdf(rows, F.col("g"), F.col("m")).orderBy("i").collect()]
    assert got == want
    assert all(a[2] <= b[2] <= 1 for a, b in zip(got, got[1:], strict=False))


def test_plans_stay_in_the_engine(spark, sf_dir):
    for name, query in plans.QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name


@pytest.mark.parametrize("spread", ["outlier", "log-uniform"])
def test_no_window_holds_more_than_a_range(spark, spread):
    """However values are spread, a window of the running sums has about as many as a range."""
    dice = random.Random(3)
    values = [dice.uniform(1, 1000) for _ in range(20_000)] + [1e12] if spread == "outlier" else [10 ** dice.uniform(-12, 12) for _ in range(20_000)]
    rows = spark.createDataFrame([("a" if i % 3 else "b", x) for i, x in enumerate(values)], "g string, m double")
    got = cdf.sampled_cdf(rows, F.col("g"), F.col("m"), each=500)
    for g in ("a", "b"):
        own = sorted(x for i, x in enumerate(values) if (i % 3 != 0) == (g == "a"))
        step = len(own) // 250
        want = [(i, own[i]) for i in range(0, len(own), step)]
        assert [(r.i, r.m) for r in got.filter(F.col("grp") == g).orderBy("i").collect()] == want + ([(len(own) - 1, own[-1])] if want[-1][1] != own[-1] else [])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in x for x in plan.split("\n") if "Window" in x and "[m#" in x)
    spread_out = rows.groupBy("g", "m").agg(F.count("*").alias("k")).repartitionByRange(ranks.ranges(20_001, 500), "g", "m")
    assert spread_out.groupBy(F.spark_partition_id(), "g").count().agg(F.max("count")).first()[0] < 1500


def test_ranks_and_running_sums(spark):
    dice = random.Random(8)
    rows = [(dice.choice("ab"), dice.randint(1, 400), i) for i in range(3000)] + [("hot", 7, i) for i in range(3000, 5000)]
    table = spark.createDataFrame(rows, "g string, x int, i int")
    got = ranks.ranked(table, [F.col("x").desc(), F.col("i").asc()], each=256).collect()
    assert [(r.x, r.i) for r in sorted(got, key=lambda r: r.rank)] == sorted(((x, i) for _, x, i in rows), key=lambda r: (-r[0], r[1])) and sorted(r.rank for r in got) == list(range(5000))
    summed = table.groupBy("g", "x").agg(F.count("*").alias("k"))
    for r in ranks.running(summed, "g", "x", "k", each=50).collect():
        own = [x for g, x, _ in rows if g == r.g]
        assert (r.hi, r.total, r.top) == (sum(x <= r.x for x in own), len(own), max(own))
    assert ranks.ranked(table.limit(0), [F.col("x")]).count() == ranks.running(summed.limit(0), "g", "x", "k").count() == 0


def test_small_things(spark, tmp_path):
    from orrery.functions import dates
    from orrery.operators import audit, series
    from orrery.sources import catalogs

    days = spark.createDataFrame([(0,), (9131,), (None,)], "d int").select(dates.day_to_year(F.col("d")).alias("y"))
    assert [r.y for r in days.collect()] == [1957, 1982, None]
    rows = spark.createDataFrame([("a", 5.0, "P"), ("b", 0.0, "P"), ("c", None, "P"), ("d", 7.0, "P")], "k string, mass_kg double, object_class string")
    assert [r.label for r in mass.mass_by(rows, F.col("k"), top=3, above=0).collect()] == ["d", "a"]
    one = lambda x: spark.createDataFrame([(x,)], "total_kg long")
    assert tuple(audit.compared_totals(one(3), one(4)).first()) == (3, 4, 4)
    wide = spark.createDataFrame([(1, 2, 3)], "bucket int, a int, b int")
    assert sorted(map(tuple, series.long_form(wide, ["a", "b"]).collect())) == [(1, "a", 2), (1, "b", 3)]
    catalogs.write_json(rows, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 4


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    plan = launches(spark, sf_dir).filter("site = '5-LOW'").select("launch_tag", "lv_family")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,5-LOW)" in plan and "o_totalprice" not in plan


def test_snapshots_join_once(spark, sf_dir, monkeypatch):
    """Each update reads tables in files: the joins behind objects and launches run once."""
    seen, real = [], plans.snapshots.update
    monkeypatch.setattr(plans.snapshots, "update", lambda *a: seen.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in a[:2]) or real(*a))
    plans.snapshot_by_difference(spark, sf_dir)
    assert len(seen) == 4 and not any("Join" in x for x in seen)
