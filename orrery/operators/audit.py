"""Mass audits that split a group in two, and reconciliation with a published table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import classify, rules
from orrery.functions.text import half_up
from orrery.operators.mass import known


def orbiters(spark, table: Sequence[tuple] = rules.ORBITERS) -> DataFrame:
    return spark.createDataFrame(list(table), "ord int, member string, name string, published_dry_kg long")


def split(rows: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """One row: masses and numbers of rows whose key is a member's and of the others, and the split that the members'
    published masses give: rows times published mass, and what the total leaves beyond it (0 at least).

    members (member, published_dry_kg, ...) has a row for each member.
    """
    data = rows.select(key.alias("member"), known(F.col("mass_kg")).alias("mass")).join(members.select("member", "published_dry_kg"), "member", "left")
    is_member = F.col("published_dry_kg").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = data.agg(
        zero(F.sum("mass")).alias("total"),
        zero(F.sum(F.when(is_member, F.col("mass")))).alias("own"),
        zero(F.sum(F.when(~is_member, F.col("mass")))).alias("other"),
        F.count_if(is_member).alias("flights"),
        F.count_if(~is_member).alias("cargo_objects"),
        zero(F.sum("published_dry_kg")).alias("dry"),
    )
    return out.select(
        half_up(F.col("total")).alias("total_kg"),
        half_up(F.col("own")).alias("orbiter_kg"),
        half_up(F.col("other")).alias("cargo_kg"),
        "flights",
        "cargo_objects",
        F.col("dry").alias("theorized_dry_kg"),
        half_up(F.greatest(F.lit(0), F.col("total") - F.col("dry"))).alias("theorized_delivered_kg"),
        F.try_divide(F.col("own").cast("double"), F.col("total").cast("double")).alias("orbiter_share"),
        F.try_divide(F.col("total").cast("double"), F.col("flights").cast("double")).alias("mean_kg_per_flight"),
    )


def per_member(rows: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Every member, those without rows too, with its rows and masses; most rows first, then as declared."""
    sums = rows.groupBy(key.alias("member")).agg(F.count("*").alias("n"), F.sum(known(F.col("mass_kg"))).alias("mass"))
    out = members.join(sums, "member", "left")
    flights = F.coalesce("n", F.lit(0))
    out = out.select("ord", "member", "name", "published_dry_kg", flights.alias("flights"), half_up(F.coalesce("mass", F.lit(0))).alias("mass_kg"), (flights * F.col("published_dry_kg")).alias("theorized_dry_total_kg"))
    return out.orderBy(F.col("flights").desc(), "ord")


def split_row_table(by_label: DataFrame, audit: DataFrame, label: str, actual: str, theorized: str) -> DataFrame:
    """(label, delivered_kg, own_kg, derived): by_label with the row `label` replaced by the audit's two splits."""
    plain = by_label.filter(F.col("label") != label).select("label", F.col("mass_kg").alias("delivered_kg"), F.lit(0).cast("long").alias("own_kg"), F.lit(False).alias("derived"))
    there = by_label.filter(F.col("label") == label).select(F.lit(1).alias("one"))
    pair = F.explode(
        F.array(
            F.struct(F.lit(actual).alias("label"), F.col("cargo_kg").alias("delivered_kg"), F.col("orbiter_kg").alias("own_kg"), F.lit(False).alias("derived")),
            F.struct(F.lit(theorized).alias("label"), F.col("theorized_delivered_kg").alias("delivered_kg"), F.col("theorized_dry_kg").alias("own_kg"), F.lit(True).alias("derived")),
        )
    )
    two = audit.withColumn("one", F.lit(1)).join(there, "one").select(pair.alias("x")).select("x.*")
    return plain.unionByName(two)


def family_total(rows: DataFrame, family: str) -> DataFrame:
    """One row (total_kg, payload_count) of the rows of a vehicle family, the name compared without case."""
    own = classify.equals(F.col("lv_family"), family)
    return rows.agg(half_up(F.coalesce(F.sum(F.when(own, known(F.col("mass_kg")))), F.lit(0))).alias("total_kg"), F.count_if(own).alias("payload_count"))


def compared_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (left_kg, right_kg, most_kg) of two one-row tables with total_kg: both totals and the larger one."""
    pair = left.select(F.col("total_kg").alias("left_kg"), F.lit(1).alias("one")).join(right.select(F.col("total_kg").alias("right_kg"), F.lit(1).alias("one")), "one")
    return pair.select("left_kg", "right_kg", F.greatest("left_kg", "right_kg").alias("most_kg"))


VERDICTS = {"none": "NO DATA", "left": "LEFT_ONLY", "right": "RIGHT_ONLY", "match": "MATCH", "close": "CLOSE", "lower": "LOWER", "higher": "HIGHER"}


def verdict(published: Column, computed: Column, match: tuple[float, float] = (0.95, 1.05), close: tuple[float, float] = (0.8, 1.2), names: dict[str, str] = VERDICTS) -> Column:
    """How a computed figure stands to a published one; bounds of the ratio are included."""
    ratio = F.try_divide(computed.cast("double"), published.cast("double"))
    return (
        F.when((published == 0) & (computed == 0), names["none"])
        .when((published > 0) & (computed == 0), names["left"])
        .when((computed > 0) & (published == 0), names["right"])
        .when(ratio.between(*match), names["match"])
        .when(ratio.between(*close), names["close"])
        .when(computed < published, names["lower"])
        .otherwise(names["higher"])
    )


def reconcile(published: DataFrame, computed: DataFrame) -> DataFrame:
    """(provider, published_kg, computed_kg, count, delta_kg, verdict): every published row, and computed rows of a
    mass above 0 that it lacks; the largest figure first. Inputs: (provider, kg) and (provider, mass_kg, count)."""
    right = computed.select(F.col("provider"), F.col("mass_kg").alias("computed_kg"), "count")
    out = published.select("provider", F.col("kg").alias("published_kg")).join(right, "provider", "full_outer")
    out = out.filter(F.col("published_kg").isNotNull() | (F.col("computed_kg") > 0))
    out = out.select("provider", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("published_kg", "computed_kg", "count")])
    out = out.withColumn("delta_kg", F.col("computed_kg") - F.col("published_kg")).withColumn("verdict", verdict(F.col("published_kg"), F.col("computed_kg")))
    return out.orderBy(F.greatest("published_kg", "computed_kg").desc(), "provider")


def reconcile_summary(reconciled: DataFrame, published_total: int, computed_total: DataFrame) -> DataFrame:
    """One row: both totals, agreement (smaller to larger, in percent; 0 without computed mass), matches and gaps.
    computed_total has one row (total_mass_kg), of all providers."""
    sums = reconciled.agg(F.count_if((F.col("published_kg") > 0) & (F.col("computed_kg") > 0) & (F.col("verdict") == VERDICTS["match"])).alias("matches"), F.count_if((F.col("published_kg") > 0) & (F.col("computed_kg") == 0)).alias("gaps"))
    total, own = F.col("total_mass_kg").cast("double"), F.lit(float(published_total))
    agreement = F.when(total > 0, F.try_divide(F.least(total, own), F.greatest(total, own)) * 100).otherwise(F.lit(0.0))
    one = sums.withColumn("one", F.lit(1)).join(computed_total.select("total_mass_kg", F.lit(1).alias("one")), "one")
    return one.select(F.lit(published_total).cast("long").alias("published_total_kg"), F.col("total_mass_kg").cast("long").alias("computed_total_kg"), agreement.alias("agreement_pct"), "matches", "gaps")


def published_upmass(spark, table: Sequence[tuple[str, int]] = rules.PUBLISHED_UPMASS) -> DataFrame:
    return spark.createDataFrame(list(table), "provider string, kg long")
