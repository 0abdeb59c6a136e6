"""The registered queries beside their SQL, and the pipeline beside a plain version of its stages."""

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from keyweave.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(q.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted(repr([r[x] for x in columns]) for r in df.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_sentencepiece_queries_are_the_library(spark, texts):
    import hashlib

    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=q.PIECES)
    ids = {i: sp.encode(t) for i, t in texts.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    both = {i: [sp.bos_id(), *x, sp.eos_id()] for i, x in ids.items()}
    got = {tuple(r) for r in q.op2_sentencepiece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(i, len(x), sha(np.array(x, dtype="<u4").tobytes()), sha(sp.decode(x).encode())) for i, x in both.items()}
    got = {tuple(r) for r in q.op8_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {(i, len(texts[i].encode()), len(x), len(x) > 4096) for i, x in ids.items()}


def test_token_files_query_is_the_library(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    tokens, start, want = Tokenizer.from_file(q.WORDS), 0, set()
    for i in sorted(texts):
        ids = [*tokens.encode(texts[i], add_special_tokens=False).ids, 2]
        want.add((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert {tuple(r) for r in q.op10_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_suffix_dedup_query_is_brute_force(spark, texts):
    from test_edges import brute_kept

    got = sorted((tuple(r) for r in q.op4_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute_kept(texts.items())


def test_sharding_query(spark, texts):
    import zlib
    from collections import defaultdict

    rows = q.op6_sharding(spark, SF).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert set(shards) <= set(range(24)) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    # greedy packing by size: no shard is above the mean by more than the largest slot
    loads = [sum(r.size for r in x) for x in shards.values()]
    assert max(loads) <= sum(loads) / 24 + max(r.size for r in rows) * 2


def test_ten_operators():
    names = [n.split("_")[0] for n in q.queries()]
    assert names == [f"op{k}" for k in range(1, 11)]


def test_native_operators_run_no_python(spark):
    for name in ("op1_chat_format", "op6_sharding"):
        plan = q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark):
    from test_edges import brute_classes, brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, at = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == columns
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 1 for i in kept["quality"])
    assert sum(i in kept["quality"] for i, good in labels.items() if good) >= 0.98 * sum(labels.values())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i in sorted(kept["quality"]):
        first.setdefault(norm(kept["quality"][i]), i)
    assert set(kept["exact_dedup"]) == set(first.values())
    assert set(kept["near_dedup"]) == {c for _, _, c in brute_classes(list(kept["exact_dedup"].items()), 5, 80)}
    assert not any(r[-1] for r in brute_hits([(i, t) for i, t in kept["decontaminate"].items()], items))
    dirty = {r[0] for r in brute_hits(list(kept["near_dedup"].items()), items) if r[-1]}
    assert {i: t for i, t in kept["near_dedup"].items() if i not in dirty} == {i: t for i, t in kept["decontaminate"].items() if i not in dirty}
    assert corpus_pipeline.run(spark, SF).count() == len(kept["decontaminate"])
