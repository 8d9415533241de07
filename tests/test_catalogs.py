"""The hand-made catalogs through reading and every step behind it."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import cadence, explore, lifetimes, mass, rollup, search
from orrery.sources import catalogs, snapshots

NAMES = "JCAT Satcat Launch_Tag Type Name PLName LDate DDate Status Owner State Mass Perigee Apogee Inc OpOrbit".split()
OBJECTS = """S1|1|L1|P|STARLINK-1|-|2026 Jan  5|-|O|SPX|US|575.5|540|560|53.05|LLEO/I
S2|2|L1|P|-|-|2026 Jan  5|-|OX|NASA|US|-|500|-|51.6|LEO/I
S3|A0001|L2|R2|STAGE|-|1998 Feb 10|1998 Mar|R|X|SU|12.5kg|200|300|65|GTO
# a comment
S4|0|L9|-|JUNK|-|1998 Feb 10|-|-|-|-|-|-|-|-|-
S5|5|L3|P|SHUTTLE|OV-102|1981 Apr 12|1981 Apr 14|D|NASA|US|96163|240|251|40.3|LLEO/I
S6|6|L3|P|CARGO|CARGO-1|1981 Apr 12|1981 Apr 13|D|NASA|US|1000|240|251|40.3|LLEO/I
S7|7|L2|D|DEB|-|1998 feb 10|2001 Feb 31|D|Y|SU|0|700|720|98.6|SSO
|8|L2|D|NOKEY|-|1998 Feb 10|-|D|Y|SU|0|700|720|98.6|SSO
S9|9|L2|D|SHORT|-|1998 Feb 10|-|D"""
LAUNCHES = """L1|Falcon 9 v1.2|CC|2026 Jan  5 0127|OS
L2|Soyuz-U|NIIP5|1998 Feb 10|OM
L3|Space Shuttle|KSC|1981 Apr 12|OV
L2|Proton-K|NIIP5|1998 Feb 10|OM
L4|Falcon 9 Block 5B|VSFBS4E|2025 Dec 31|SX
L5|Zhuque-3|JQ|2025 Dec  3|OC
L6|Ariane 5 ECA|CSG|2005 Feb 12|OG
L7|Chang Zheng 2D|TYSC|2024 May  1|OC
L8|-|XX|-|O"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("catalogs")
    tabbed = lambda s: s.replace("|", "\t")
    (folder / "objects.tsv").write_text("# Updated\n#" + "\t".join(NAMES) + "\r\n" + tabbed(OBJECTS) + "\n", newline="")
    (folder / "launches.tsv").write_text("#Launch_Tag\tLV_Type\tLaunch_Site\tLaunch_Date\tLaunchCode\n" + tabbed(LAUNCHES) + "\n")
    launches = catalogs.read_launches(spark, str(folder / "launches.tsv"))
    return catalogs.enrich(catalogs.read_objects(spark, str(folder / "objects.tsv")), launches).cache(), launches.cache()


def test_objects(tables):
    got = {r.jcat: r for r in tables[0].collect()}
    assert sorted(got) == ["S1", "S2", "S3", "S4", "S5", "S6", "S7"]
    assert (got["S1"].op_orbit, got["S1"].lv_family, got["S1"].site, got["S1"].ldate) == ("LEO", "Falcon 9", "CC", "2026-01-05")
    assert (got["S2"].name, got["S2"].mass_kg, got["S2"].apogee_km) == ("S2", None, None)
    assert (got["S3"].satno, got["S3"].mass_kg, got["S3"].lv) == (None, 12.5, "Proton-K")
    assert (got["S4"].object_class, got["S4"].obj_type, got["S4"].satno, got["S4"].lv) == ("-", None, None, None)
    assert got["S7"].ldate is None
    assert [got[k].pos for k in sorted(got)] == list(range(7))


def test_launches_keep_last_content_and_first_place(tables):
    rows = tables[1].orderBy("pos").collect()
    assert [r.launch_tag for r in rows] == ["L1", "L2", "L3", "L4", "L5", "L6", "L7", "L8"]
    assert rows[1].lv == "Proton-K" and rows[3].orbital is False and rows[5].lv_family == "Ariane 5"


def test_files_of_a_catalog_follow_each_other(spark, tmp_path):
    head = "#Launch_Tag\tLV_Type\tLaunch_Site\tLaunch_Date\tLaunchCode\n"
    for name, vehicle in (("a.tsv", "First"), ("b.tsv", "Second"), ("c.tsv", "Third")):
        (tmp_path / name).write_text(head + "".join(f"L{k}\t{vehicle}\tX\t-\tO\n" for k in range(5)))
    rows = catalogs.read_launches(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.launch_tag, r.lv) for r in rows] == [(f"L{k}", "Third") for k in range(5)]


def test_positions_over_splits_and_compressed_files(spark, tmp_path):
    """0 to n - 1 in the order of files and lines, whatever splits Spark reads, and the same when read again."""
    head = "#Launch_Tag\tLV_Type\tLaunch_Site\tLaunch_Date\tLaunchCode\n"
    lines = [f"L{k}\tV\tX\t-\tO\n" if k % 7 else "# comment\n" for k in range(4000)]
    (tmp_path / "b").mkdir()
    (tmp_path / "a.tsv").write_text(head + "".join(lines[:1500]))
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write(head + "".join(lines[1500:2000]))
    (tmp_path / "c.tsv").write_text(head + "".join(lines[2000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = catalogs.read_launches(spark, str(tmp_path / "*.tsv*")).select("pos", "launch_tag").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(i, x.split("\t")[0]) for i, x in enumerate(x for x in lines if x[0] != "#")]
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, catalogs.read_launches(spark, str(tmp_path / "*.tsv*")).select("pos", "launch_tag").collect())) == want
    plan = catalogs.read_objects(spark, str(tmp_path / "a.tsv"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in x or "block#" in x for x in plan.split("\n") if "Window" in x)


def test_missing_column_and_missing_header(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#JCAT\tX1\tX2\tX3\tX4\tX5\tX6\tX7\tX8\tX9\nS1" + "\t1" * 9 + "\n")
    row = catalogs.read_objects(spark, str(tmp_path / "a.tsv")).first()
    assert row.jcat == "S1" and row.owner is None and row.name == "S1"
    (tmp_path / "b.tsv").write_text("S1" + "\t1" * 9 + "\n")
    assert catalogs.read_objects(spark, str(tmp_path / "b.tsv")).count() == 0


def test_summary(tables):
    row = mass.summary(tables[0]).first().asDict()
    assert row == {"total_objects": 7, "total_payloads": 4, "total_mass_kg": 97739, "active_payloads": 2, "constellation_active": 1, "countries": 4, "launch_vehicles": 3, "first_launch_year": 1981, "last_launch_year": 2026}


def test_lifetimes(tables):
    got = [tuple(r) for r in lifetimes.lifetimes(tables[0]).orderBy("lday", "dday").collect()]
    assert [(r[0], r[1], r[5]) for r in got] == [(8867, 8868, "P"), (8867, 8869, "P"), (25206, -1, "P"), (25206, -1, "P")]
    assert {r[3] for r in got if r[1] == -1} == {560, 500}


def test_deltas_agree_with_days(tables):
    table = lifetimes.lifetimes(tables[0])
    daily = {r.day: r.active for r in lifetimes.active_daily(table).collect()}
    for day in daily:
        assert lifetimes.active_on(table, day).count() == daily[day]


def test_explorer(tables):
    page, total = explore.explore(tables[0], sort="name", order="asc", page="x", limit=0)
    assert [r.name for r in page.collect()] == ["CARGO", "DEB", "JUNK", "S2", "SHUTTLE", "STAGE", "STARLINK-1"]
    assert total.first().asDict() == {"total": 7, "page": 1, "limit": 50, "pages": 1, "first": 1, "last": 7}
    assert explore.explore(tables[0], page=3, limit=5)[0].count() == 0
    assert [r.jcat for r in explore.search(tables[0], "%").collect()] == []
    assert sorted(r.jcat for r in explore.search(tables[0], "5").collect()) == ["S5"]
    by_mass = explore.ordered(tables[0], "mass_kg", "asc").collect()
    assert [r.mass_kg for r in by_mass][-2:] == [None, None]


def test_pages_partition_the_result(tables):
    whole = [r.jcat for r in explore.ordered(tables[0], "mass_kg", "desc", collation=None).collect()]
    paged = [r.jcat for k in (1, 2, 3, 4) for r in explore.explore(tables[0], sort="mass_kg", page=k, limit=2, collation=None)[0].collect()]
    assert paged == whole
    after = tables[0].filter(F.col("jcat") == whole[1]).first()
    assert [r.jcat for r in explore.page_after(tables[0], "mass_kg", "desc", after.mass_kg, after.pos, 2).collect()] == whole[2:4]


NAMED = ["É", "b", "A", "a", "Z", None, "B", "e", "a", None, "é", "zz", "E"]


def test_pages_after_a_row_partition_the_result(spark):
    """For every sortable column, both directions, nulls and ties included."""
    rows = spark.createDataFrame([(i, x, float(i % 4) if i % 5 else None) for i, x in enumerate(NAMED)], "pos long, name string, mass_kg double").withColumn("ldate", F.col("name")).cache()
    for field in ("name", "mass_kg", "ldate"):
        for order in ("asc", "desc"):
            whole = explore.ordered(rows, field, order).collect()
            paged = explore.explore(rows, sort=field, order=order, limit=3)[0].collect()
            while len(page := explore.page_after(rows, field, order, paged[-1][field], paged[-1].pos, 3).collect()) > 0:
                paged += page
            assert [r.pos for r in paged] == [r.pos for r in whole], (field, order)


def test_directory_of_pages(spark, tmp_path):
    rows = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(NAMED * 20)], "pos long, name string, place string").withColumn("ldate", F.lit(None).cast("string"))
    for order in ("asc", "desc"):
        explore.write_pages(rows, str(tmp_path / order), "name", order, each=50)
        whole = [r.pos for r in explore.ordered(rows, "name", order).collect()]
        pages = [explore.read_page(spark, str(tmp_path / order), k, 30) for k in range(1, 11)]
        assert [r.pos for page, _ in pages for r in page.collect()] == whole
        assert [t.first().asDict() for _, t in pages[::8]] == [explore.explore(rows, sort="name", order=order, page=k, limit=30)[1].first().asDict() for k in (1, 9)]
    page = explore.read_page(spark, str(tmp_path / "asc"), 3, 20)[0]
    page.collect()
    assert files_read(page) == 2 and len(list((tmp_path / "asc" / "rows").glob("file=*/*.parquet"))) == 6


def test_pages_of_a_long_table_are_in_few_files(spark, tmp_path, monkeypatch):
    """However few rows a file is to hold, there are MOST_FILES at most, and any page is the same."""
    monkeypatch.setattr(explore, "MOST_FILES", 4, raising=False)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(NAMED * 20)], "pos long, name string")
    explore.write_pages(rows, str(tmp_path / "pages"), "name", "asc", each=2)
    assert len(list((tmp_path / "pages" / "rows").glob("file=*/*.parquet"))) == 4
    pages = [explore.read_page(spark, str(tmp_path / "pages"), k, 30) for k in range(1, 11)]
    assert [r.pos for page, _ in pages for r in page.collect()] == [r.pos for r in explore.ordered(rows.withColumn("ldate", F.lit("")), "name", "asc").collect()]
    assert pages[8][1].first().asDict() == {"total": 260, "page": 9, "limit": 30, "pages": 9, "first": 241, "last": 260}


def files_read(df):
    """Of the scans of a plan that has run."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numFiles").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_search_by_index_equals_the_scan(spark, tmp_path):
    dice = random.Random(2)
    letters = "abCÉß%_\u0130\U0001f680 -9"
    word = lambda n: "".join(dice.choice(letters) for _ in range(dice.randint(0, n)))
    rows = [(i, f"S{i}", word(12), word(9) if i % 3 else None, i if i % 4 else None) for i in range(900)]
    rows[700] = (700, "S700", "only here: quartz", None, 5)
    objects = spark.createDataFrame(rows, "pos long, jcat string, name string, pl_name string, satno long").withColumn("block", F.lit("clash"))
    search.write_index(objects, str(tmp_path / "index"), each=100)
    needles = ["", "  ", "é", "ab", "quartz", "S700", "s70", "zzzz", "%_%", "123", "\U0001f680 -"] + [word(5) for _ in range(6)]
    for needle in needles:
        want = sorted(r.pos for r in explore.search(objects, needle).collect())
        assert sorted(r.pos for r in search.search_index(spark, str(tmp_path / "index"), needle).collect()) == want, needle
    found, scan = search.search_index(spark, str(tmp_path / "index"), "quartz"), search.search_index(spark, str(tmp_path / "index"), "qu")
    assert len(found.collect()) == len(scan.collect()) == 1
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_index_of_a_long_table_has_few_blocks(spark, tmp_path, monkeypatch):
    """However few rows a block is to hold, there are MOST_BLOCKS at most, and a search finds the same."""
    monkeypatch.setattr(search, "MOST_BLOCKS", 5, raising=False)
    rows = [(i, f"S{i}", f"name {i % 7}", "pay" if i % 3 else None, i if i % 4 else None) for i in range(300)]
    objects = spark.createDataFrame(rows, "pos long, jcat string, name string, pl_name string, satno long")
    search.write_index(objects, str(tmp_path), each=3)
    assert len(list((tmp_path / "rows").glob("block=*"))) == 5
    for needle in ("S29", "name 3", "PAY", "123", "e 6", "none"):
        assert sorted(r.pos for r in search.search_index(spark, str(tmp_path), needle).collect()) == sorted(r.pos for r in explore.search(objects, needle).collect()), needle


def test_interval_join_against_all_pairs(spark):
    dice = random.Random(6)
    lives = [(i, a, dice.choice([-1, a, a + dice.randint(0, 900)]), dice.choice([40, 90, 500, 0, -3])) for i in range(200) for a in [dice.randint(0, 2000)]] + [(200, 0, 29_000, 120), (201, 5, -1, 80), (202, 5, 5, 80)]
    table = spark.createDataFrame(lives, "k long, lday int, dday int, p long").withColumn("a", F.col("p") + 10)
    days = [(0,), (5,), (1999,), (1999,), (2500,), (28_000,), (None,)]
    up = lambda r, d: r[1] <= d and (r[2] < 0 or r[2] >= d)
    want = sorted((r[0], d) for r in lives for (d,) in days if d is not None and up(r, d))
    for width, salts in ((16, 1), (512, 8), (100_000, 3)):
        got = lifetimes.active_at(table, spark.createDataFrame(days, "day int"), width, salts)
        assert got.columns == ["k", "lday", "dday", "p", "a", "day"] and sorted((r.k, r.day) for r in got.collect()) == want
    windows = [(0, 10), (50, 700), (600, 600), (10, 5), (3000, 20_000)]
    got = lifetimes.active_during(table, spark.createDataFrame(windows, "from_day int, to_day int"), 64, 2)
    assert sorted((r.k, r.from_day, r.to_day) for r in got.collect()) == sorted((r[0], a, b) for r in lives for a, b in windows if a <= b and r[1] <= b and (r[2] < 0 or r[2] >= a))
    hot = {d: lifetimes.hot_count(table, d).first()[0] for d in (0, 5, 6, 1999, 2500, 28_000)}
    many = {r.day: r.n for r in lifetimes.altitude_at(table, spark.createDataFrame([(d,) for d in hot], "day int")).groupBy("day").agg(F.count_if("hot").alias("n")).collect()}
    assert many == hot
    daily = {r.day: (r.active, r.near_reentry) for r in lifetimes.near_reentry_daily(table).collect()}
    for d in [*list(daily)[::40], 28_999, 28_800]:
        last = max(x for x in daily if x <= d)
        assert daily[last] == (lifetimes.active_on(table, d).count(), lifetimes.hot_count(table, d).first()[0]), d
    assert lifetimes.near_reentry_daily(table.limit(0)).count() == 0 and lifetimes.active_at(table, spark.createDataFrame([], "day int")).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        lifetimes.near_reentry_daily(table, 0)


def test_collation_and_page_arguments(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["É", "b", "A", "a", "Z"])], "pos long, name string")
    assert [r.name for r in explore.ordered(rows.withColumn("ldate", F.lit(None).cast("string")), "name", "asc").collect()] == ["a", "A", "b", "É", "Z"]
    assert explore.page_arguments(-1, 9999) == (1, 500) and explore.page_arguments("2", "-3") == (2, 1)
    assert explore.page_arguments("2x", "20abc") == (2, 20) and explore.page_arguments(" +3.9", "0x10") == (3, 50) and explore.page_arguments("x2", None) == (1, 50)


def test_watchlist_and_nested_cadence(tables):
    got = {r.vehicle: (r.status, r.first_year, r.total_launches) for r in cadence.watchlist(tables[1]).collect()}
    assert got["Zhuque-3"] == ("FLYING", 2025, 1) and got["Neutron"] == ("AWAITING", None, 0) and len(got) == 9
    rate = cadence.launch_rate(tables[1])
    nested = cadence.nested_rate(rate, cadence.vehicle_providers(tables[1])).collect()
    flat = {(n.year, p.provider, v.vehicle, v["count"]) for n in nested for p in n.providers for v in p.vehicles}
    assert flat == {(r.year, r.provider, r.vehicle, r.n) for r in rate.filter("level = 'provider_vehicle'").collect()}


def test_aligned_programs_need_both(tables):
    both = {"shuttle": F.col("lv_family") == "Space Shuttle", "falcon9": F.col("lv_family") == "Falcon 9"}
    rows = cadence.aligned_programs(tables[1], both).collect()
    assert [(r.program_year, r.shuttle_count, r.falcon9_count) for r in rows] == [(1, 1, 1)]
    with pytest.raises(ValueError, match="nova"):
        cadence.aligned_programs(tables[1], both | {"nova": F.col("lv_family") == "Nova"})


def test_bucketed_enrichment_shuffles_nothing(spark, tmp_path):
    """A third of the objects under one tag: the same rows as the plain join, no exchange, and no bucket with all of them."""
    dice = random.Random(4)
    rows = [(f"S{i}", "hot" if i % 3 == 0 else dice.choice(["a", "b", "c", "d", None, "lost"])) for i in range(3000)]
    objects = spark.createDataFrame(rows, "jcat string, launch_tag string").withColumn("tag_part", F.lit("clash"))
    launches = spark.createDataFrame([(t, f"lv {t}", None, "x") for t in ("hot", "a", "b", "c", "d", "e")], "launch_tag string, lv string, lv_family string, site string")
    catalogs.write_bucketed(objects, launches, "bucketed_test", str(tmp_path / "tables"), buckets=8, hot=0.2, parts=16)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalogs.enrich_bucketed(spark, "bucketed_test")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = catalogs.enrich(objects.drop("tag_part"), launches)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spread = spark.table("bucketed_test_objects").filter("launch_tag = 'hot'").groupBy("tag_part").count().collect()
    assert len(spread) == 16 and max(r["count"] for r in spread) < 150
    spark.sql("DROP TABLE bucketed_test_objects")
    spark.sql("DROP TABLE bucketed_test_launches")


def test_snapshots_write_what_changed(spark, tables, tmp_path, monkeypatch):
    folder, (objects, launches) = str(tmp_path / "silver"), tables
    files = lambda: sorted(str(p) for p in (tmp_path / "silver").rglob("*.parquet"))
    rows = lambda df: sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.read(spark, folder)
    assert snapshots.update(objects, launches, folder)["added"] == ["1981", "1998", "2026", "launches", "none"]
    first, name = files(), snapshots.current(spark, folder)
    assert rows(snapshots.read(spark, folder)[0].select(objects.columns)) == rows(objects) and rows(snapshots.read(spark, folder)[1].select(launches.columns)) == rows(launches)
    assert not any(snapshots.update(objects.repartition(3), launches, folder).values()) and files() == first
    after = objects.withColumn("owner", F.when(F.col("jcat") == "S5", F.lit("NEW")).otherwise(F.col("owner"))).filter("ldate is null or ldate < '2000'")
    with monkeypatch.context() as m:  # killed before the pointer moves
        m.setattr(snapshots, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            snapshots.update(after, launches, folder)
    assert snapshots.current(spark, folder) == name and rows(snapshots.read(spark, folder)[0].select(objects.columns)) == rows(objects)
    between = files()
    assert snapshots.update(after, launches, folder) == {"changed": ["1981"], "added": [], "removed": ["2026"]}
    assert {p.split("part=")[1].split("/")[0] for p in files() if p not in between and "part=" in p} == {"1981"}
    assert rows(snapshots.read(spark, folder)[0].select(objects.columns)) == rows(after)
    assert rows(snapshots.read(spark, folder, name=name)[0].select(objects.columns)) == rows(objects)
    assert [r.jcat for r in snapshots.read(spark, folder, ["1998"])[0].orderBy("jcat").collect()] == ["S3", "S4"]
    assert snapshots.read(spark, folder, ["1900"])[0].count() == 0
    got = {r.jcat: r.change for r in snapshots.changes(objects, after.unionByName(objects.limit(1).withColumn("jcat", F.lit("S99")))).collect()}
    assert got == {"S5": "changed", "S1": "removed", "S2": "removed", "S99": "added"}


def test_rollup_gives_what_the_objects_give(tables):
    objects = tables[0].withColumn("mass_kg", F.col("mass_kg").cast("decimal(18,4)"))
    for period in ("day", "month", "year"):
        rolled = rollup.merged(rollup.rollup(objects.filter("pos % 2 = 0"), period), rollup.rollup(objects.filter("pos % 2 = 1"), period)).cache()
        assert rollup.summary(rolled).first().asDict() == mass.summary(objects).first().asDict()
        assert rollup.mass_by_year(rolled).collect() == mass.mass_by_year(objects).collect()
        assert rollup.mass_by(mass.payloads(rolled), F.col("op_orbit"), top=2).collect() == mass.mass_by(mass.payloads(objects), F.col("op_orbit"), top=2).collect()
    assert rollup.summary(rollup.rollup(objects.limit(0))).first().asDict() == mass.summary(objects.limit(0)).first().asDict()
    assert mass.summary(objects, approximate=True).first().asDict() == mass.summary(objects).first().asDict()


def test_silver_and_json(spark, tables, tmp_path):
    catalogs.write_silver(tables[0], tables[1], str(tmp_path))
    objects, launches = catalogs.read_silver(spark, str(tmp_path))
    assert objects.filter("launch_year = 1981").count() == 2 and launches.count() == 8
    doc = catalogs.document(explore.explore(tables[0], page=1, limit=2)[0].select("jcat")).first().json
    assert [sorted(x) for x in json.loads(doc)["data"]] == [["jcat"], ["jcat"]]
