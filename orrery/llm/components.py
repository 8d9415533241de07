"""Connected components of links that Spark holds, by stars that grow and shrink (large-star, small-star)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize


#: Keys with more rows than this share of all (and a thousand) are joined by broadcast: HOT of them at most, whatever
#: the table.
HOT = 20_000


def hot_rows(rows: int) -> int:
    """How many rows of one key make it hot."""
    return max(1000, rows // HOT)


def handed(rows: DataFrame, found: DataFrame, key: str, many: int) -> DataFrame:
    """rows with m of found (u, m, n), u being the key and n how many rows of the table have it; rows of other keys go.

    The few keys of more than `many` rows are broadcast, so that no task gets all rows of one: Spark can't split a join
    that comes right after an aggregation by the same key.
    """
    hot = found.filter(F.col("n") > many).select(F.col("u").alias("_hot"), F.col("m").alias("_m"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    few = marked.filter("_hot is null").select(*rows.columns).join(found.filter(F.col("n") <= many).select("u", "m"), F.col(key) == F.col("u")).select(*rows.columns, "m")
    return marked.filter("_hot is not null").select(*rows.columns, F.col("_m").alias("m")).unionByName(few)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the smallest id reachable.

    Self links and repeated links do no harm; nulls are left out. In each round every id hands the smallest of its
    neighbours to the others; the rounds needed grow with the logarithm of a component's width, and more than `rounds`
    raise an error. Links stay in tables in the shared folder between rounds. An id with very many links is reduced to
    its smallest neighbour before the shuffle, and what hands it back is a broadcast of the few such ids.
    """
    a, b = F.col("a"), F.col("b")
    now = links.filter("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, before = materialize(now, "links"), None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        before, many = tuple(mark), hot_rows(mark[0])
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy(a.alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = handed(both.filter("b > a"), least, "a", many).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(handed(now, least, "a", many).select("a", F.col("m").alias("b")))
        large = materialize(large.filter("a <> b").distinct(), "large")
        low = large.groupBy(a.alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = handed(large, low, "a", many).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = materialize(small.filter("a <> b").distinct(), "links")
        discard(now, large)
        now = after
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(linked, label, n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Forest:
    """Union of indexes, the smallest as root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hooks of the larger root to the smaller, for all pairs at once, until none differ."""
        while len(a):
            ra, rb = self.settled()[a], self.up[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def settled(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up
