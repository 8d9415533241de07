"""Classes of objects, vehicles and orbits as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import rules
from orrery.functions.text import half_up_at

EARTH_RADIUS_KM = 6371


def vehicle_text(family: Column, vehicle: Column) -> Column:
    """Family and vehicle as one lower-case text, null as nothing."""
    return F.lower(F.concat_ws(" ", F.coalesce(family, F.lit("")), F.coalesce(vehicle, F.lit(""))))


def first_rule(text: Column, ordered: Sequence[rules.Rule], blank: str = "Unknown", none: str = "Other") -> Column:
    """Label of the first rule of which text holds a part or begins with a start; blank text and no rule have labels."""
    out = F.lit(none)
    for rule in reversed(ordered):
        tests = [text.contains(x) for x in rule.contains] + [text.startswith(x) for x in rule.starts]
        fits = tests[0]
        for t in tests[1:]:
            fits = fits | t
        out = F.when(fits, F.lit(rule.label)).otherwise(out)
    return F.when(F.trim(text) == "", F.lit(blank)).otherwise(out)


def provider(family: Column, vehicle: Column, ordered: Sequence[rules.Rule] = rules.PROVIDERS) -> Column:
    return first_rule(vehicle_text(family, vehicle), ordered)


def holds(c: Column, part: str) -> Column:
    """Whether a text holds a part, case ignored; null doesn't."""
    return F.lower(F.coalesce(c, F.lit(""))).contains(part)


def equals(c: Column, value: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))) == value


def site_bucket(site: Column, buckets: Sequence[tuple[str, Sequence[str], Sequence[str]]] = rules.SITE_BUCKETS, none: str = "other") -> Column:
    """Bucket of a site: equal to a code or beginning with one, case ignored."""
    upper, out = F.upper(F.coalesce(site, F.lit(""))), F.lit(none)
    for label, equal, starts in reversed(buckets):
        fits = upper.isin(*equal) if equal else F.lit(False)
        for s in starts:
            fits = fits | upper.startswith(s)
        out = F.when(fits, F.lit(label)).otherwise(out)
    return out


def customer_segment(name: Column, state: Column, owner: Column, constellation: str = "STARLINK", home: str = "US", government: Sequence[str] = rules.US_GOV_OWNERS) -> Column:
    """starlink by name, usGov by state and owner, else commercial."""
    return (
        F.when(F.upper(F.coalesce(name, F.lit(""))).contains(constellation), "starlink")
        .when((F.coalesce(state, F.lit("")) == home) & F.coalesce(owner, F.lit("")).isin(*government), "usGov")
        .otherwise("commercial")
    )


def labelled(code: Column, labels: Mapping[str, str], none: str | None = None) -> Column:
    """A code's label, or the code itself; null is `none`."""
    out = code
    for key, label in labels.items():
        out = F.when(code == key, F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(none)) if none is not None else out


def class_label(code: Column) -> Column:
    return labelled(F.coalesce(code, F.lit("-")), rules.CLASS_LABELS)


def state_label(code: Column) -> Column:
    return labelled(code, rules.STATE_LABELS, "---")


def explorer_label(code: Column) -> Column:
    return labelled(F.nullif(code, F.lit("")), rules.EXPLORER_LABELS, "N/A")


def orbit_shape(apogee: Column, perigee: Column, inclination: Column) -> dict[str, Column]:
    """semi_major_km, offset_km, semi_minor_km and inclination_class; nulls are 500 km, 300 km and 0 degrees."""
    far = F.coalesce(apogee, F.lit(500)).cast("double") + EARTH_RADIUS_KM
    near = F.coalesce(perigee, F.lit(300)).cast("double") + EARTH_RADIUS_KM
    a, c = (far + near) / 2, (far - near) / 2
    inc = F.coalesce(inclination, F.lit(0)).cast("double")
    return {
        "semi_major_km": a,
        "offset_km": c,
        "semi_minor_km": F.sqrt(F.greatest(F.lit(1.0), a * a - c * c)),
        "inclination_class": F.when(inc >= 70, "POLAR").when(inc < 20, "EQUATORIAL").otherwise("INCLINED"),
    }


def log_mass(mass: Column) -> Column:
    """log10 to two decimals."""
    return half_up_at(F.log10(mass), 2)
