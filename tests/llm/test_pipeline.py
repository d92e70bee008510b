"""The pipeline's stages, each against what it should keep and change."""

import hashlib
import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from geolode.llm import bpe, mixing, partenum, quality, secrets
from tests.conftest import DATA


def test_stages_in_order(spark):
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.good_quality, corpus_pipeline.near_distinct, corpus_pipeline.without_secrets, corpus_pipeline.mixed_sources, corpus_pipeline.token_ids]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, DATA).cache()
    scores = {r.doc_id: r.predicted for r in quality.op1_quality(spark, DATA).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in scores.items() if v)
    distinct = corpus_pipeline.near_distinct(spark, kept, DATA).cache()
    assert sorted(r.doc_id for r in distinct.collect()) == sorted({r.component_id for r in partenum.jaccard_components(kept).collect()})
    clean = corpus_pipeline.without_secrets(spark, distinct, DATA).cache()
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == distinct.count()
    from pyspark.sql import functions as F

    assert secrets.scan(clean).where(F.size("base") > 0).count() == 0
    before = {r.doc_id: r.text for r in distinct.collect()}
    assert all(r.n_chars == len(r.text) and (r.text == before[r.doc_id] or "[SECRET]" in r.text) for r in clean.collect())
    mix = corpus_pipeline.mixed_sources(spark, clean, DATA).cache()
    _, plan, _ = mixing.mix_plan(clean, mixing.cycled_weights)
    took = {}
    for r in mix.collect():
        took[r.source] = took.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in plan.collect():
        longest = max(len(re.findall(r"[^\x20\x09-\x0D]+", x.text)) for x in clean.where(F.col("source") == r.source).collect())
        assert abs(took.get(r.source, 0) - r.target) <= longest
    out = corpus_pipeline.token_ids(spark, mix, DATA).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    text = {r.doc_id: r.text for r in mix.collect()}
    assert len(out) == mix.count()
    for r in out:
        assert r.ids == enc.encode_ordinary(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0
