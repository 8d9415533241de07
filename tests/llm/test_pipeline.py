"""The pipeline stage by stage on the smallest documents, each stage against what its operator's rule gives."""

import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from orrery.llm import byte_bpe, mixing, pii, quality
from orrery.llm.common import materialize, released
from tests.llm.test_small import brute_components

QUALITY, NEAR, PII, MIX, IDS = (f for _, f in corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = stage(spark, docs, sf_dir).cache()
    return [*out, docs]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "source mix", "token ids"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_quality(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(stages[0], keep=["doc_id"], labels=labels).collect() if r.kept}
    assert {r.doc_id for r in stages[1].collect()} == kept
    rows = {r.doc_id: r for r in stages[0].collect()}
    assert all(rows[i] == r for r in stages[1].collect() for i in [r.doc_id])


def test_quality_counts_all_good_texts(spark, sf_dir, stages, monkeypatch):
    """What the stage's models count is every different labelled good text of 50 words and more."""
    counted, real = [], quality.ngram_counts
    monkeypatch.setattr(quality, "ngram_counts", lambda docs, *a: counted.extend(r[0] for r in docs.select(a[0]).collect()) or real(docs, *a))
    QUALITY(spark, stages[0], sf_dir).count()
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert sorted(counted) == sorted({r.text for r in stages[0].collect() if r.doc_id in good and len(r.text.encode().split()) >= 50})


def test_near_duplicates(stages):
    sets = {}
    for r in stages[1].collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, c in brute_components(sets, 80).items() if i == c)


def test_personal_data(spark, stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        spans, text = pii.base_spans(before[r.doc_id]), before[r.doc_id]
        assert r.n_chars == len(r.text)
        assert not any(text[s.start : s.end] in r.text for s in spans)
        if not re.search(r"[0-9@\[]", text):
            assert r.text == text


def test_mix(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    seen = {}
    for r in stages[4].collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {k: v for k, v in copies.items() if v}


def test_ids(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r.round_trip and r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def run_stages(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        with released() as keep:
            out.append(keep(materialize(stage(spark, out[-1], ""), "stage")))
    return out


def test_nulls_clashing_columns_and_repeated_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ("_row", "_text", "kept", "w0", "pii", "ids", "size", "_id", "component", "lang_", "n", "taken", "log_ppl")
    odd = spark.createDataFrame([(None, None, None, None, None), (7_000_001, "", "en", "web", 0), (7_000_002, "x" * 300_000, "en", None, 1), (7_000_002, "word " * 60, None, "web", 2)], docs.schema)
    extra = docs.unionByName(odd).unionByName(docs.limit(5)).withColumns({n: F.lit(1) for n in names})
    steps = run_stages(spark, extra)
    assert all(s.columns == extra.columns for s in steps[1:5])
    assert steps[5].filter("round_trip").count() == steps[5].count() > 0
    kept = [r.doc_id for r in steps[2].collect()]
    assert len(kept) == len(set(kept))


def test_nulls_pass_every_stage(spark):
    """Each stage alone on rows of nulls: quality drops texts without words, the others keep them."""
    docs = spark.createDataFrame([(1, None, None, None, None), (None, None, "en", "web", 0), (2, "", None, "web", None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert QUALITY(spark, docs, "").count() == 0
    assert NEAR(spark, docs, "").count() == 3 and PII(spark, docs, "").count() == 3
    assert MIX(spark, docs, "").columns == docs.columns
    assert sorted(r.n_tokens for r in IDS(spark, docs, "").collect()) == [0, 0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert [s.count() for s in run_stages(spark, docs)] == [0] * 6


def test_run_leaves_one_table(spark, sf_dir):
    from orrery.llm import common

    before = set(common._TABLES)
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(common._TABLES) - before == {out._table_path} and out.count() > 0


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from orrery.llm import common

    settings = {"spark.master": "spark://host:7077"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session, "x")
    settings["spark.master"] = "local[4]"
    assert common.shared_dir(session, "x").startswith("file:///tmp/")


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
