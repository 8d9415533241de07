"""Near duplicates by MinHash with tensored banding.

Two collections of a few bands each are computed; a table's key is a band of the first with one of the second, so m
bands a collection serve m * m tables, and the hashing is that of 2 m bands. A key can only be shared where both of its
bands are, so bands that one document alone has are left out first, and most documents form few keys or none. Documents
that share a key form a candidate group; groups that overlap are united, each candidate's full set is sent to its group
once, and links are confirmed there on full sets (of 64-bit hashes of the shingles).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WORD, discard, enter, materialize, memory_of, partitions
from orrery.llm.components import components, handed, hot_rows, roots
from orrery.llm.segment_ids import by_bytes

WORDS = 5
#: Bands in each of the two collections, and hashes in a band. Two sets of similarity s share a key with probability
#: (1 - (1 - s ** HASHES) ** BANDS) ** 2: 0.9998 at 0.85, 0.9965 at 0.8, 0.16 at 0.5, 0.02 at 0.4.
BANDS, HASHES = 16, 5
#: Documents and bytes of their sets that a group brings to one task; larger groups are cut into blocks, and blocks
#: meet in pairs.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Rows of ids that are broadcast to the documents (some 40 bytes each); with more, both sides are shuffled by id.
BROADCAST_ROWS = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


@cache
def _hashes() -> _Hashes:
    return _Hashes()


memory_of("minhash", _hashes.cache_clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `words` words, A-Z lower-cased; fewer words are one run; none: empty."""
    own = text.encode().lower().split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, own), np.uint64, len(own))
    n = max(len(h) - words + 1, 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(words, len(h))):
        out = out * _P + h[i : i + n]
    return np.unique(_mixed(out))


def bands(sets: list[np.ndarray], count: int = 2 * BANDS, hashes: int = HASHES) -> np.ndarray:
    """A row of bands for each non-empty set: each band is a hash of the least values of `hashes` orders of the set."""
    data = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    random = np.random.default_rng(20240229)
    out = np.zeros((len(sets), count), np.uint64)
    for k in range(count):
        for _ in range(hashes):
            mask, odd = random.integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
            out[:, k] = out[:, k] * _P + np.minimum.reduceat((data ^ mask) * odd, starts)
    return _mixed(out)


def signatures(docs: DataFrame, words: int, n_bands: int, hashes: int) -> DataFrame:
    """(id, n, digest, first, second) of rows (id, text): the set's size, 128 bits of it, and its bands."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("minhash")
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 21)):
            sets = [shingles(x, words) for x in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            own = np.zeros((len(sets), 2 * n_bands), np.uint64)
            if full:
                own[full] = bands([sets[i] for i in full], 2 * n_bands, hashes)
            flat = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(own[:, at : at + n_bands]).view(np.int64).ravel()), n_bands).cast(pa.list_(pa.int64())) for at in (0, n_bands)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *flat], names=["id", "n", "digest", "first", "second"])

    return docs.mapInArrow(run, f"id {id_type}, n long, digest binary, first array<long>, second array<long>")


def near_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union, as a matrix."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    data = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(data, kind="stable")
    data, row = data[order], row[order]
    new = np.r_[True, data[1:] != data[:-1]]
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1  # what one set alone has is in no intersection
    column, row = column[common], row[common]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    shared, width = np.zeros((n, n), np.float32), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, int(column[hi - 1]) - at + 1)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    shared = shared.astype(np.int64)
    return 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)


def _confirmed(percent: int):
    def run(block: pa.Table) -> pa.Table:
        ids, groups = block["id"].to_numpy(), block["component"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in block["members"].to_pylist()]
        order = np.lexsort((ids, groups))
        cuts = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0, True])
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            if len(own) > 1:
                root = roots(near_links([sets[i] for i in own], percent))
                child = np.flatnonzero(root != np.arange(len(own)))
                a.append(ids[own[child]])
                b.append(ids[own[root[child]]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": join(a), "b": join(b)})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 80, n_bands: int = BANDS, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs.

    Links are pairs with 100 * intersection >= percent * union of their sets of word runs; component_id is the
    smallest id reachable and kept marks that row. Texts without words (null, empty) have no set and link with nothing.
    Rows that share an id are one document with the links of each (without_near_duplicates tells them apart); null ids
    have a null component and aren't kept.

    Equal sets are one class from the start, however many copies there are. A group of different texts of any size is
    cut into blocks of `block` documents; a task gets two blocks and returns a link to a root for each document, never
    all pairs. A group of n such texts costs n * n / block rows: exact, and quadratic only in texts that are all alike
    and yet all different.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sets = materialize(signatures(rows, words, n_bands, hashes), "signatures")
    whole = sets.filter("n > 0 and id is not null")
    classes = materialize(whole.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    one = whole.join(classes, (whole["digest"] == classes["digest"]) & (whole["id"] == classes["rep"]), "left_semi").select("id", "first", "second")
    each = one.select("id", F.posexplode(F.concat("first", "second")).alias("b", "value")).withColumn("band", F.xxhash64("b", "value"))
    common = each.groupBy(F.col("band").alias("u")).agg(F.min("id").alias("m"), F.max("id").alias("z"), F.count("*").alias("n")).filter("m < z").select("u", "m", "n")
    own = handed(each.select("id", "b", "band"), common, "band", hot_rows(2 * n_bands * classes.count())).groupBy("id").agg(F.collect_list(F.when(F.col("b") < n_bands, F.col("band"))).alias("first"), F.collect_list(F.when(F.col("b") >= n_bands, F.col("band"))).alias("second"))
    keyed = own.select("id", F.explode("first").alias("f"), "second").select("id", "f", F.explode("second").alias("s")).select("id", F.xxhash64("f", "s").alias("key"))
    keyed = materialize(keyed, "keys")
    center = keyed.groupBy(F.col("key").alias("u")).agg(F.min("id").alias("m"), F.max("id").alias("z"), F.count("*").alias("n")).filter("m < z").select("u", "m", "n")
    stars = handed(keyed, center, "key", hot_rows(keyed.count())).filter("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct()
    groups = materialize(components(stars), "groups")
    discard(keyed)
    return _resolve(rows, sets, classes, groups, words, percent, block, id_col)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs less the rows whose text is that of another row or near it: of each group that near_duplicates links, the
    row of the smallest id stays. Texts without words (null, empty) stay, however often they occur.

    A row goes because of its text alone: rows that share an id, and those of a null id, are told apart by their texts,
    and come after all other ids.
    """
    plain = docs.select(F.struct("*").alias("_row"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    own = F.xxhash64("text")
    groups = plain.groupBy("id").agg(F.count("*").alias("n"), F.min(own).alias("a"), F.max(own).alias("z"))
    repeated = materialize(groups.filter("n > 1 or id is null").select("id", (F.col("id").isNull() | (F.col("a") != F.col("z"))).alias("differ")), "repeated")
    rows = plain
    if any_repeated := not repeated.isEmpty():
        last = plain.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        texts = plain.join(repeated.filter("differ").select(F.col("id").alias("again")), F.col("id").eqNullSafe(F.col("again")), "left_semi").select(F.col("id").alias("of"), own.alias("h")).distinct()
        named = materialize(texts.select("of", "h", (F.monotonically_increasing_id() + F.lit(last + 1)).alias("name")), "names")
        rows = plain.join(named, F.col("id").eqNullSafe(F.col("of")) & (own == F.col("h")), "left").select("_row", F.coalesce("name", "id").alias("id"), "text")
    found = near_duplicates(rows, "id", "text", **options)
    gone = materialize(found.filter(~F.col("kept")).select(F.col("id").alias("_gone")).distinct(), "dropped")
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("id") == F.col("_gone"), "left_anti")
    if not any_repeated:
        return left.select("_row.*")
    # copies of a text under one id: one stays, of those that have words
    again = repeated.select(F.col("id").alias("again")).unionByName(named.select(F.col("name").alias("again")))
    several = left.join(again, F.col("id") == F.col("again"), "left_semi")
    words_in = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(WORD))
    rest = several.filter(words_in).groupBy("id").agg(F.min_by("_row", F.struct("text")).alias("_row"))
    once = left.join(again, F.col("id") == F.col("again"), "left_anti").select("_row")
    return once.unionByName(rest.select("_row")).unionByName(several.filter(~words_in).select("_row")).select("_row.*")


def _resolve(rows: DataFrame, sets: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int, block: int, id_col: str) -> DataFrame:
    sized = groups.join(sets.filter("id is not null").groupBy("id").agg((8 * F.sum("n")).alias("bytes")), "id")
    size = sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(block), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    placed = materialize(groups.join(size.select("component", "bytes", blocks.alias("blocks")), "component"), "placed")
    n, total = placed.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("bytes"))), F.lit(0))).first()
    small_bins = partitions(groups, max(n // (2 * block), total // BLOCK_BYTES) + 1, 1)
    held = rows.join(F.broadcast(placed) if n <= BROADCAST_ROWS else placed, "id").select("id", "component", "blocks", "text")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("minhash")
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 21)):
            own = pa.array([shingles(x, words).tobytes() for x in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own], names=["id", "component", "blocks", "members"])

    full = held.mapInArrow(members, "id long, component long, blocks int, members binary").filter(F.octet_length("members") > 0)
    many = F.col("blocks") > 1
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # block k of n meets each other block once: as the lower or the higher of the pair
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = full.withColumn("pair", F.explode(F.when(many, pair).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))))
    task = F.when(many, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(small_bins)))
    dealt = dealt.select("id", "component", "members", task.alias("task"), F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    links = dealt.groupBy("task", "i", "j").applyInArrow(_confirmed(percent), "a long, b long")
    linked = materialize(components(links), "linked").withColumnRenamed("id", "member")
    named = classes.join(linked, F.col("rep") == F.col("member"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("id", "n", "digest").join(named, (F.col("digest") == F.col("_digest")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
