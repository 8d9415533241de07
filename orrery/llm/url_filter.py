"""URL filters: ordered host and path rules, and a blocked Bloom filter before an exact join with listed URLs.

All in DataFrame operations. The filter is a small table of blocks of eight 32-bit words; a listed URL sets one bit
in each word of its block. Pages whose eight bits are all set are possible hits, and only they are hashed to the
join with the list, which removes the false positives. The others never leave their partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower, materialize

#: Odd multipliers of split-block Bloom filters as published in the Parquet format's specification.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Rows of the filter at most: 40 bytes each, made for some 12 million URLs.
MOST_BLOCKS = 1 << 20
#: Listed URLs (some 60 bytes each) that are broadcast.
BROADCAST_ROWS = 200_000
#: Query parameters that name a visit and not a page.
VISIT = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host without www. or m., path without its last / or .html, and the query's parameters but for visits, sorted."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(VISIT)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], field: str) -> Column:
    """field (rule or verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.host + r.path if field == "rule" else r.verdict)).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    low = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits, so that products fit
    at = [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
    return [F.call_function("shiftleft", F.lit(1), x) for x in at]


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w7): at most `blocks` rows of 40 bytes, whatever the number of keys."""
    bits = _bits(F.col(key))
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(bits))])


def filter_blocks(n_keys: int) -> int:
    """Blocks for so many keys: a power of two with some twelve keys each, MOST_BLOCKS at most."""
    return min(MOST_BLOCKS, 1 << max(6, (n_keys // 12).bit_length()))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url_col: str = "url", listed_col: str = "url", blocks: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with host, path, rule, listed (boolean) and verdict (block or allow).

    The longest fitting rule decides; without one, a page is blocked if its canonical URL is that of a listed URL.
    listed may repeat URLs or hold nulls (they list nothing). Null and odd URLs have an empty host and path, fit no
    rule and are allowed. Columns of pages named like an output are replaced; any other name may occur. Empty tables
    are fine on either side.

    The filter that is broadcast is sized by a count of the list and has MOST_BLOCKS rows at most; with a longer list
    more pages reach the exact join, and the verdicts stay the same. A list of `broadcast_rows` URLs at most is joined
    by broadcast in the same scan; a longer one by a shuffle of the possible hits alone, which takes a second scan of
    the pages, so that the others never leave their partition. A URL that many pages share is one row of the list, and
    Spark may split its pages.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    known = materialize(listed.select(canonical_url(F.col(listed_col)).alias("_known")).filter("_known is not null").distinct(), "listed-urls")
    n_listed = known.count()
    blocks = blocks or filter_blocks(n_listed)
    rows = pages.select(F.struct("*").alias("_page"), pages[url_col].cast("string").alias("_url"))
    seen = rows.withColumn("_canon", canonical_url(F.col("_url")))
    seen = seen.withColumn("_at", F.coalesce(_block(F.col("_canon"), blocks), F.lit(-1)))
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("_canon"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(b) == b)
    seen = seen.join(F.broadcast(bloom_table(known, "_known", blocks)), F.col("_at") == F.col("block"), "left")
    seen = seen.select("_page", "_url", F.when(F.coalesce(hit, F.lit(False)), F.col("_canon")).alias("_maybe"))
    same = F.col("_maybe") == F.col("_known")
    if n_listed <= broadcast_rows:
        out = seen.join(F.broadcast(known), same, "left")
    else:
        maybe = seen.filter("_maybe is not null").join(known, same, "left")
        out = maybe.unionByName(seen.filter("_maybe is null").withColumn("_known", F.lit(None).cast("string")))
    out = out.select("_page", F.col("_known").isNotNull().alias("listed"), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(host, path, rules, "verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(*[F.col("_page")[c].alias(c) for c in keep], "host", "path", rule_of(host, path, rules, "rule").alias("rule"), "listed", verdict.alias("verdict"))
