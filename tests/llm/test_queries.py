"""The registered queries on the smallest tables: those with SQL against it, the others' written forms against plain ones."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

from orrery.llm import queries
from tests.llm.test_small import plain_spans


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    got, want = queries.QUERIES[name](spark, sf_dir), oracle.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert set(names) <= set(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_pii_query(spark, sf_dir, texts):
    for r in queries.op2_pii(spark, sf_dir).collect():
        base = plain_spans(texts[r.doc_id])
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert {x for x in written.split(",") if x} <= set(r.spans.split(","))


def test_token_file_query(spark, sf_dir, texts):
    library, start = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in queries.op7_token_files(spark, sf_dir).collect()}
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_byte_bpe_query(spark, sf_dir, texts):
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in queries.op10_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)
