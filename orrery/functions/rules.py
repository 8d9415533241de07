"""Tables that a user may replace. The values are facts of the catalogs' domain that results depend on."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    contains: tuple[str, ...]
    starts: tuple[str, ...] = ()


# Launch providers by what a vehicle's name holds, in the order in which the rules apply.
PROVIDERS = (
    Rule("SpaceX", ("falcon", "starship")),
    Rule("Blue Origin", ("new glenn", "new shepard")),
    Rule("Arianespace", ("ariane", "vega")),
    Rule("ULA", ("vulcan", "atlas", "delta iv", "delta 4")),
    Rule("Rocket Lab", ("electron", "neutron")),
    Rule("Relativity Space", ("terran", "relativity")),
    Rule("Stoke Space", ("nova", "stoke")),
    Rule("Firefly Aerospace", ("firefly",)),
    Rule("Space One", ("kairos",)),
    Rule("ISRO", ("pslv", "gslv", "sslv", "lvm3", "lvm-3")),
    Rule("Roscosmos", ("soyuz", "proton", "angara", "rokot", "dnepr")),
    Rule("CAS Space", ("lijian", "kinetica")),
    Rule("Galactic Energy", ("gushenxing", "ceres", "pallas")),
    Rule("Chinarocket Co. Ltd.", ("jielong", "smart dragon")),
    Rule("ExPace", ("kuaizhou",)),
    Rule("LandSpace", ("zhuque",)),
    Rule("iSpace", ("hyperbola", "shuang quxian")),
    Rule("CASC", ("chang zheng", "long march", " cz-"), ("cz-", "cz ")),
)

# Shuttle orbiters with published dry masses in kg.
ORBITERS = (
    (1, "OV-102", "Columbia", 81600),
    (2, "OV-099", "Challenger", 79500),
    (3, "OV-103", "Discovery", 78450),
    (4, "OV-104", "Atlantis", 78020),
    (5, "OV-105", "Endeavour", 78000),
)

# Contenders and what their vehicles' names hold.
WATCHLIST = (
    (1, "Starship", "SpaceX", ("starship",)),
    (2, "New Glenn (NG 7x2 / 9x4)", "Blue Origin", ("new glenn",)),
    (3, "Vulcan", "ULA", ("vulcan",)),
    (4, "Neutron", "Rocket Lab", ("neutron",)),
    (5, "Terran R", "Relativity Space", ("terran r", "terran-r")),
    (6, "Nova", "Stoke Space", ("stoke", "nova")),
    (7, "Zhuque-3", "LandSpace", ("zhuque-3", "zhuque 3")),
    (8, "Long March 10B", "CASC", ("long march 10", "chang zheng 10", "cz-10")),
    (9, "Cowboy Space (TBD)", "Cowboy Space", ("cowboy",)),
)

# Events of two programs by year since first flight.
CADENCE_EVENTS = (
    ("shuttle", 1, 1981, "STS-1"),
    ("shuttle", 5, 1985, "PEAK: 10 FLIGHTS"),
    ("shuttle", 6, 1986, "CHALLENGER"),
    ("shuttle", 8, 1988, "RETURN TO FLIGHT"),
    ("shuttle", 23, 2003, "COLUMBIA"),
    ("shuttle", 31, 2011, "STS-135 / RETIRED"),
    ("falcon9", 1, 2010, "F9 FLIGHT 1"),
    ("falcon9", 6, 2015, "CRS-7 FAILURE"),
    ("falcon9", 7, 2016, "AMOS-6"),
    ("falcon9", 8, 2017, "FIRST REFLIGHT"),
    ("falcon9", 10, 2019, "STARLINK BEGINS"),
    ("falcon9", 15, 2024, "OUT-LAUNCHES NATIONS"),
)

# Owners that count as the United States government.
US_GOV_OWNERS = ("NASA", "USAF", "USSF", "USN", "USA", "NRO", "NOAA", "USGS", "NSF", "DARPA", "DOD", "USDOD", "AFRL", "MDA", "USDOE", "USCG")

# Published upmass of the first quarter of 2026 by provider, in kg.
PUBLISHED_UPMASS = (
    ("SpaceX", 556057),
    ("CASC", 40980),
    ("Roscosmos", 19980),
    ("Arianespace", 18415),
    ("CAS Space", 4400),
    ("ULA", 1900),
    ("Galactic Energy", 1485),
    ("Chinarocket Co. Ltd.", 1400),
    ("Firefly Aerospace", 1100),
    ("ExPace", 575),
    ("ISRO", 573),
    ("Rocket Lab", 478),
    ("Space One", 69),
)

# Labels of classes and of states.
CLASS_LABELS = {"P": "Payload", "R": "Rocket Body", "D": "Debris", "C": "Component", "Z": "Other"}
STATE_LABELS = {"O": "Operational", "OX": "Operational (Extended)", "D": "Decayed / Re-entered", "AB": "Aborted", "NEA": "No Longer Exists", "R": "Retired"}
EXPLORER_LABELS = {"P": "PAYLOAD", "R": "ROCKET BODY", "D": "DEBRIS", "U": "UNKNOWN"}

# Launch sites by bucket: (bucket, equal to, begins with).
SITE_BUCKETS = (("cape", ("CC",), ("KSC",)), ("vandenberg", (), ("VSFB", "VAFB")))
