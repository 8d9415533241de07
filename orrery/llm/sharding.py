"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A ring of SLOTS places holds the virtual nodes of all shards. A document's key hashes to a place and belongs to the next
virtual node clockwise; documents come in the order of a second hash, and one that meets a full shard continues to the
next virtual node of a shard that isn't. Capacities add up to the whole, so balance is guaranteed, and a shard more or
less moves the documents of its own arcs and those that overflow.

That order makes it a job of a few passes: a shard that fills stays full, so it has one last position in the order that
it takes, and where a document goes follows from its place and from which shards have filled before it. Loads are summed
by (block of positions, arc); the driver runs over blocks until one fills a shard, asks for finer blocks of that one
alone, and at last for its rows: never more than BLOCKS x arcs sums or LAST rows at once, whatever the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize
from orrery.operators.ranks import ranked

#: Places of the ring.
SLOTS = 1 << 16
#: Virtual nodes of a shard.
NODES = 256
#: Blocks of positions that are summed at once; rows of a block that the driver reads one by one.
BLOCKS, LAST = 512, 1 << 15
#: Positions numbered together when rows of a shard are counted.
RUN = 1 << 17


class Ring(NamedTuple):
    """owner: the shard of each virtual node, clockwise; arc: the virtual node that a place belongs to."""

    owner: np.ndarray
    arc: np.ndarray


def ring(shards: int, nodes: int = NODES) -> Ring:
    """The ring of shards 0 to shards - 1: a shard's virtual nodes lie where they lie in any other ring."""
    if shards * nodes > SLOTS // 2:
        raise ValueError(f"{shards} x {nodes} virtual nodes don't fit into a ring of {SLOTS} places")
    places: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}:{node}".encode(), digest_size=8).digest(), "big") % SLOTS
            while at in places:  # an earlier shard has it
                at = (at + 1) % SLOTS
            places[at] = shard
    sites = np.array(sorted(places))
    return Ring(np.array([places[x] for x in sites.tolist()]), np.searchsorted(sites, np.arange(SLOTS)) % len(sites))


def owners(of: Ring, shut: Sequence[int]) -> np.ndarray:
    """For each arc the next shard clockwise that isn't shut."""
    n = len(of.owner)
    open_ = np.flatnonzero(~np.isin(of.owner, list(shut)))
    return of.owner[open_[np.searchsorted(open_, np.arange(n)) % len(open_)]]


def capacities(total: int, shards: int) -> list[int]:
    """Whole numbers that add up to the total, one apart at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, size, text_crc32, place, order, other, kept) of every row: place on the ring and order are hashes of the id;
    rows of one id follow each other by their text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(docs[id_col], F.lit("place")), 48).cast("int").alias("place"),
        F.xxhash64(docs[id_col], F.lit("order")).alias("order"),
        F.xxhash64(docs[text_col]).alias("other"),
        (F.struct(*[docs[c] for c in keep]) if keep else F.lit(0)).alias("kept"),
    )


def _sums(rows: DataFrame, low: int, end: int, each: int, weight: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, arc, weight) over positions from low to below end, in blocks of `each`."""
    held = rows.filter((F.col("at") >= low) & (F.col("at") < end))
    block = F.floor((F.col("at") - low) / F.lit(each)).cast("int")
    table = held.groupBy(block.alias("block"), "arc").agg(F.sum(weight).alias("w")).toArrow()
    return table["block"].to_numpy(), table["arc"].to_numpy(), table["w"].to_numpy()


def fillings(rows: DataFrame, of: Ring, limits: Sequence[int], weight: Column, n: int, blocks: int = BLOCKS, last: int = LAST) -> list[tuple[int, int]]:
    """(position, shard) in order: the shard is full from the row behind that position on. rows: (at, arc, size).

    A shard is full when its load reaches its limit; limits of 0 are full from the start. When the last shard that is
    open fills, nothing is left.
    """
    load, shards = np.zeros(len(limits), np.int64), len(limits)
    shut = [s for s in range(shards) if limits[s] <= 0]
    out = [(-1, s) for s in shut]

    def walk(low: int, end: int) -> None:
        """Rows from low to below end, by blocks."""
        nonlocal load
        each = -(-(end - low) // blocks)
        count = -(-(end - low) // each)
        table = np.zeros((count, len(of.owner)), np.int64)
        block, arc, w = _sums(rows, low, end, each, weight)
        np.add.at(table, (block, arc), w)
        for b in range(count):
            if len(shut) == shards - 1:
                return  # the last open shard takes all that come
            add = np.bincount(owners(of, shut), weights=table[b], minlength=shards).astype(np.int64)
            full = load + add >= np.array(limits)
            full[shut] = False
            if full.any():
                dealt(low + b * each, min(low + (b + 1) * each, end))
            else:
                load = load + add

    def dealt(low: int, end: int) -> None:
        if end - low > max(last, 1):
            walk(low, end)
        else:
            exact(low, end)

    def exact(low: int, end: int) -> None:
        nonlocal load
        own = rows.filter((F.col("at") >= low) & (F.col("at") < end)).select("at", "arc", weight.alias("w")).toArrow().sort_by("at")
        at, arc, w = (own[c].to_numpy() for c in ("at", "arc", "w"))
        i = 0
        while i < len(at) and len(shut) < shards - 1:
            goes = owners(of, shut)[arc[i:]]
            first = len(goes)
            who = -1
            for s in set(range(shards)).difference(shut):
                mine = np.flatnonzero(goes == s)
                over = np.searchsorted(load[s] + np.cumsum(w[i:][mine]), limits[s])
                if over < len(mine) and mine[over] < first:
                    first, who = int(mine[over]), s
            upto = slice(0, first + 1)
            load = load + np.bincount(goes[upto], weights=w[i:][upto], minlength=shards).astype(np.int64)
            if who >= 0:
                shut.append(who)
                out.append((int(at[i + first]), who))
            i += first + 1

    if n:
        dealt(0, n)
    return out


def _ring_table(spark: SparkSession, of: Ring) -> DataFrame:
    """(slot, arc), a row for each place of the ring: SLOTS rows, whatever is dealt."""
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(SLOTS, dtype=np.int32), "arc": of.arc.astype(np.int32)}), "slot int, arc int")


def assign(docs: DataFrame, shards: int = 8, law: str = "rows", slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), nodes: int = NODES, blocks: int = BLOCKS, last: int = LAST) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot, home, position, *keep) of every row of docs.

    size: UTF-8 bytes of the text (null: none) and 1. law `rows`: capacities are whole numbers of rows, one apart at most,
    that add up to all rows, so that shards hold exactly them. law `bytes`: a shard is full when its bytes reach (1 +
    slack) of its share, so none exceeds that by more than its last document. slot: 0, 1, ... in each shard, in the order
    in which documents came. home: the shard of the ring alone; a row whose shard isn't its home overflowed.

    Null ids share a place, and rows that are alike in id and text too; they overflow as any others, so a key, text or
    group that holds a third of all rows is no larger than its shards. Empty and very long texts are rows like others
    (only sizes and hashes of texts are moved, and what `keep` names). An empty table gives an empty one. Names in keep
    that are outputs are left out. Reruns agree: order and place are hashes of id and text, and rows alike in both are
    interchangeable.
    """
    spark, of = docs.sparkSession, ring(shards, nodes)
    keep = [c for c in keep if c not in (id_col, "size", "text_crc32", "shard", "slot", "home", "position")]
    # rows that are alike lie apart when ranges are cut
    rows = keyed(docs, id_col, text_col, keep).withColumn("apart", F.monotonically_increasing_id())
    dealt = ranked(rows, [F.col("order"), F.col("other"), F.col("size"), F.col("apart")], name="at").drop("order", "other", "apart")
    dealt = dealt.join(F.broadcast(_ring_table(spark, of)), F.col("place") == F.col("slot")).drop("place", "slot")
    dealt = materialize(dealt, "placed")
    total = dealt.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if law == "rows":
        weight, limits = F.lit(1).cast("long"), capacities(total["n"], shards)
    elif law == "bytes":
        weight, limits = F.col("size"), [int(np.ceil(x * (1 + slack))) for x in capacities(total["bytes"], shards)]
    else:
        raise ValueError(f"no law {law!r}: rows or bytes")
    filled = fillings(dealt.select("at", "arc", "size"), of, limits, weight, total["n"], blocks, last)
    stages = [owners(of, [s for _, s in filled[:k]]) for k in range(min(len(filled), shards - 1) + 1)]
    phase = sum([(F.col("at") > at).cast("int") for at, _ in filled[: shards - 1]], F.lit(0))
    # a row for each virtual node, with its shard by how many shards have filled
    targets = spark.createDataFrame([(i, [int(x[i]) for x in stages], int(of.owner[i])) for i in range(len(of.owner))], "node int, goes array<int>, home int")
    out = dealt.join(F.broadcast(targets), F.col("arc") == F.col("node")).withColumn("shard", F.get("goes", phase))
    out = materialize(out.select("id", "size", "text_crc32", "shard", "home", "at", "kept"), "sharded")
    return numbered(out).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "home", F.col("at").alias("position"), *[F.col("kept")[c].alias(c) for c in keep])


def numbered(rows: DataFrame, run: int = RUN) -> DataFrame:
    """rows (shard, at, ...) with slot, the position of a row in its shard by `at`. Positions `at` have no gaps, so a run
    of them holds `run` rows at most; running sums over a shard's runs, a row for each, are the offsets."""
    rows = rows.withColumn("run", F.floor(F.col("at") / F.lit(run)))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("shard").alias("_shard"), F.col("run").alias("_run"), (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("at")) - 1
    out = rows.withColumn("inside", inside).join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("run") == F.col("_run")))
    return out.withColumn("slot", F.col("before") + F.col("inside")).drop("_shard", "_run", "before", "inside", "run")


def write_shards(docs: DataFrame, folder: str, shards: int = 8, law: str = "rows", slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text", each: int = RUN) -> None:
    """The rows of docs as Parquet in folder/shard=k, in files of some `each` rows in the order of their slots."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    out = assign(docs, shards, law, slack, id_col, text_col, keep=names)
    out = out.select(*[c for c in names if c in out.columns], "shard", "slot")
    part = F.floor(F.col("slot") / F.lit(each))
    out.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
