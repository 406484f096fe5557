import base64
import hashlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import tiktoken
import pytest
from edge_cases import ROWS
from oracle import assert_same
from pyspark.sql import functions as F
from test_neardup_substrings import brute_components
from test_shards_licenses_decontam import brute

from tamarisk.llm import pii, quality
from tamarisk.llm.queries import ORACLE, PSEUDONYM_KEY, QUERIES, crc32_mod


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf_dir):
    assert_same(QUERIES[name], ORACLE[name], spark, sf_dir)


def test_pipeline_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc32_mod("doc_id", 4) != 2)
    rows = [(r.doc_id, r.text) for r in quality.score_texts(docs, model).where(F.col("score") >= 0.7).collect()]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    kept = {i for i, _, _, k in brute_components(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {i for i, n, hit, _ in brute(rows, items) if hit and 20 * hit >= n}
    rows = [(i, pii.replace(t, pii.find(t, PSEUDONYM_KEY))) for i, t in rows if i not in dirty]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (np.array(encoding.encode_ordinary(t), "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    got = {r.doc_id: (bytes(r.token_ids), r.decoded_sha256) for r in cp.run(spark, sf_dir).collect()}
    assert got == want and dirty


def test_stages_on_edges(spark, docs, empty, sf_dir):
    frame = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, f in cp.STAGES:
        assert f(spark, frame.where("false"), sf_dir).count() == 0
        out = f(spark, frame, sf_dir)
        assert name == "tokens" or out.columns == frame.columns
        assert len(out.collect()) == len(ROWS) or name in ("near_duplicates", "quality")
    long = frame.limit(1).withColumn("text", F.concat(F.lit("name "), F.repeat(F.lit("abc"), 5000), F.lit("@mail.example.com")))
    hidden = cp.pseudonyms(spark, long, sf_dir).first().text
    assert len(hidden) == 5 + 15_000 + 17 and "abcabcabc" not in hidden
    once = cp.one_of_each(spark, frame, sf_dir).collect()
    assert sum(r.doc_id == 13 for r in once) == 0 and sum(r.doc_id == 1 for r in once) == 1
