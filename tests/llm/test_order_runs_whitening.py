"""Shards, periodic runs and whitening against plain versions, on odd rows, and as queries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import periodic, queries, sharding, whitening
from orrery.llm.common import materialize


# ---- shards
@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"text {i % 7} " * (i % 13)) for i in range(700)] + [(i, "one text of many") for i in range(700, 1050)]
    rows += [(5, "text 5 " * 5), (5, "text 5 " * 5), (6, "another"), (None, "a"), (None, None), (2000, None), (2001, ""), (2002, "é" * 50_000)]
    rows += [(None, "b")] * 400
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("size", "slot", "shard", "at", "arc", "kept", "_none", "run")})


def plain_shards(keys, of, limits, weight):
    """One row after another: clockwise from its place to the first shard that isn't full."""
    load, out = [0] * len(limits), {}
    for r in sorted(keys, key=lambda r: r.at):
        arc = int(of.arc[r.place])
        while load[of.owner[arc]] >= limits[of.owner[arc]] and any(x < y for x, y in zip(load, limits, strict=True)):
            arc = (arc + 1) % len(of.owner)
        load[of.owner[arc]] += weight(r)
        out[r.at] = int(of.owner[arc])
    return out


@pytest.mark.parametrize(("law", "slack", "shards", "last"), [("rows", 0.0, 8, 1 << 15), ("rows", 0.0, 8, 5), ("bytes", 0.1, 5, 9), ("bytes", 0.0, 8, 1 << 15), ("rows", 0.0, 1, 9)])
def test_shards_against_one_row_after_another(texts, law, slack, shards, last):
    of = sharding.ring(shards, 16)
    got = sharding.assign(texts, shards, law, slack, keep=["text", "kept", "slot"], nodes=16, blocks=6, last=last).collect()
    assert len(got) == texts.count() and "kept" in got[0].__fields__
    assert sorted(r.position for r in got) == list(range(len(got)))
    place = {r.id: r.place for r in sharding.keyed(texts).select("id", "place").distinct().collect()}
    keys = [type("Row", (), {"at": r.position, "place": place[r.doc_id], "size": r.size}) for r in got]
    total = len(got) if law == "rows" else int(sum(r.size for r in got) * (1 + slack))
    limits = sharding.capacities(len(got), shards) if law == "rows" else [int(np.ceil(x * (1 + slack))) for x in sharding.capacities(sum(r.size for r in got), shards)]
    assert sum(limits) >= total
    want = plain_shards(keys, of, limits, (lambda r: 1) if law == "rows" else (lambda r: r.size))
    assert {r.position: r.shard for r in got} == want
    assert all(r.home == of.owner[of.arc[place[r.doc_id]]] and r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    if law == "rows":
        sizes = [sum(r.shard == s for r in got) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1


def test_shards_of_few_rows_and_reruns(spark, texts):
    assert sharding.assign(texts.limit(0)).count() == 0
    few = sharding.assign(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")).collect()
    assert len(few) == 3 and len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    rows = lambda df: sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in sharding.assign(df).collect())
    assert rows(texts) == rows(texts.repartition(3))


def test_one_shard_more_moves_little(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before, after = ({r.doc_id: r.shard for r in sharding.assign(docs, n).collect()} for n in (8, 9))
    moved = sum(before[i] != after[i] for i in before) / len(before)
    assert 1 / 9 <= moved < 0.25


def test_rows_numbered_in_runs(spark):
    rows = spark.range(1000).select(F.col("id").alias("at"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("shard"))
    got = sharding.numbered(rows, run=64).collect()
    for s in range(3):
        assert [r.slot for r in sorted(got, key=lambda r: r["at"]) if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def test_written_shards(spark, texts, tmp_path):
    sharding.write_shards(texts, str(tmp_path / "shards"), each=50)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == texts.count() and back.filter("shard = 3").count() in (texts.count() // 8, texts.count() // 8 + 1)


def test_sharding_query(spark, sf_dir):
    rows = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op11_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == rows and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    counts = [sum(r.shard == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and {(r.shard, r.slot) for r in got} == {(s, k) for s in range(8) for k in range(counts[s])}


# ---- periodic runs
def plain_runs(words, least=24, times=3):
    """Every period on its own: maximal stretches, without those that have a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            e = i
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - (i - q) >= max(least, times * q):
                found.setdefault((i - q, e - i + q), q)
            i = e
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_kept(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


def odd_texts():
    own = random.Random(9)
    draw = lambda n, k: [own.choice("abcdefghij"[:k]) for _ in range(n)]
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, ["a", "b"] * 12, draw(23, 1), ["x"] + ["a", "b", "c"] * 8 + ["a", "y"]]
    for n in (30, 200, 700):
        for k in (1, 2, 3, 10):
            out.append(draw(n, k))
    for p in (1, 2, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100):
        root = draw(p, 10)
        body = (root * 6)[: 3 * p + own.randint(0, 2 * p)]
        out += [draw(own.randint(0, 40), 10) + body + draw(own.randint(0, 40), 10), body * 2, body[:-1]]
    inner = ["a"] * 30 + ["b"]
    out += [inner * 4, (inner * 3 + ["c"]) * 3, (["a", "b"] * 15 + ["c"]) * 5 + ["a", "b"] * 40, ["a"] * 200 + ["b"] + ["a"] * 200 + ["b"] + ["a"] * 300]
    return out


def test_runs_against_every_period():
    texts = odd_texts()
    numbers = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for x in texts for w in x], np.int64)
    sizes = np.array([len(x) for x in texts])
    own, *rest = periodic.find_runs(words, sizes)
    got = [[] for _ in texts]
    for k, s, m, q in zip(own.tolist(), *(x.tolist() for x in rest), strict=True):
        got[k].append((s, m, q))
    for k, x in enumerate(texts):
        assert got[k] == plain_runs(x), x
        assert [x[i] for i in np.flatnonzero(periodic.kept_words(len(x), *(np.array([r[c] for r in got[k]], np.int64) for c in range(3))))] == plain_kept(x, got[k])
    with pytest.raises(ValueError, match="three periods"):
        periodic.find_runs(words, sizes, times=2)


def test_runs_of_a_text_of_one_word_are_found_quickly():
    own, start, length, period = periodic.find_runs(np.zeros(200_000, np.int64), np.array([200_000]))
    assert [x.tolist() for x in (own, start, length, period)] == [[0], [0], [200_000], [1]]


def test_runs_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 20), (4, "a b " * 20), (None, "x y\tz\n" * 30 + "end"), (5, "é ñ " * 3 + "word " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "n": F.lit(1)})
    out = periodic.collapsed(docs)
    assert out.columns == ["doc_id", "text", "n", "runs", "collapsed"]
    for r in out.collect():
        w = (r.text or "").split()
        want = plain_runs(w)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == " ".join(plain_kept(w, want))
    assert periodic.collapsed(docs.limit(0)).count() == 0


def test_periodic_query_against_every_period(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    n_runs = 0
    for i, text in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 4000 and h % 10:
            continue
        runs = plain_runs(w)
        n_runs += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        want = (len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(plain_kept(w, runs)).encode()).hexdigest())
        assert tuple(got[i])[1:] == want, i
    assert n_runs > 10


# ---- whitening
def plain_whitening(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in rows], np.int64)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(1), centred, values[::-1], vectors[:, ::-1]


def held_against_plain(got, ids, rows, k):
    n, deviation, centred, values, vectors = plain_whitening(rows)
    assert len(got) == k * len(rows) and {r.n for r in got} == ({n} if k else set())
    of = {}
    for r in got:
        of.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    for c in range(1, k + 1):
        own = [of[c][i].pop() for i in ids]
        z = np.array([r.whitened for r in own])
        want = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-7
        assert [r.deviation for r in own] == deviation.tolist()
        assert all(abs(r.explained / (values[c - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in own)


def test_whitening_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((300, 20)) * np.linspace(3, 0.5, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    bad = [(1000, None), (1001, []), (1002, [None, *[1.0] * 19]), (1003, [float("nan")] * 20), (1004, [float("inf")] * 20), (1005, [1.0] * 7)]
    table = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumns({"component": F.lit(1), "raw": F.lit(2), "n": F.lit(3)})
    held_against_plain(whitening.whiten(table).collect(), range(300), data, 8)
    held_against_plain(whitening.whiten(table, wanted=3, whole=4).collect(), range(300), data, 3)


def test_whitening_of_few_and_equal_rows(spark):
    make = lambda rows: spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == whitening.whiten(make([[1.0, 2.0]])).count() == whitening.whiten(make([[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(make([])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = [[float(i), 2.0 * i, 5.0] for i in range(9)]
    held_against_plain(whitening.whiten(make(line)).collect(), range(9), line, 1)
    cross = [[s if j == k else 0.0 for j in range(4)] for k in range(4) for s in (1.0, -1.0)]  # all deviations are equal
    got = whitening.whiten(make(cross)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(abs(r.explained - 0.25) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_bidiagonal_matrix_is_that_of_the_rows():
    x = np.random.default_rng(4).standard_normal((50, 12))
    v, b = whitening.bidiagonal(lambda w, c: ((x @ c).T @ (x @ w), x.T @ (x @ w), float((x @ w) @ (x @ w))), 12, 8)
    assert np.abs(v.T @ v - np.eye(12)).max() < 1e-13 and np.count_nonzero(np.triu(b, 2)) == np.count_nonzero(np.tril(b, -1)) == 0
    assert np.abs(np.linalg.svd(b)[1] - np.linalg.svd(x)[1]).max() < 1e-12


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    held_against_plain(materialize(queries.op13_whitening(spark, sf_dir), "whitened").collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)
