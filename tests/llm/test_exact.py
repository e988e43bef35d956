"""Exact dedup: against grouping by text, with weak keys, overfull buckets and odd rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = lambda i: (i is not None, i or 0)
    return sorted(((i, max(groups[t or ""], key=low), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def found(out):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str)


def test_odd_rows(docs_of, edge):
    out = exact_dedup.deduplicate(docs_of(edge)).collect()
    assert found(out) == brute(edge)
    kept = [(r["text_sha256"]) for r in out if r["kept"]]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in edge})


def test_empty_table(docs_of):
    out = exact_dedup.deduplicate(docs_of([(1, "a")]).limit(0))
    assert out.collect() == [] and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("key", [lambda t: F.lit(7).cast("long"), lambda t: F.length(t).cast("long"), lambda t: F.xxhash64(F.substring(t, 1, 2))])
def test_keys_that_collide_are_chained(docs_of, key):
    rows = [(i, f"text {i % 40}" + "x" * (i % 7)) for i in range(400)] + [(500 + i, None) for i in range(5)]
    docs = docs_of(rows)
    index = exact_dedup.build(docs, bucket_bytes=2000, key=key)
    assert found(exact_dedup.deduplicate(docs, index).collect()) == brute(rows)
    assert index.entries.agg(F.max("chain")).first()[0] > 1


def test_directory_doubles_where_buckets_are_overfull(docs_of):
    rows = [(i, f"document number {i} " + "word " * (i % 50)) for i in range(2000)]
    docs = docs_of(rows)
    index = exact_dedup.build(docs, bucket_bytes=14_000)
    pointers = {r["pointer"]: r["bucket"] for r in index.directory.collect()}
    assert set(pointers) == set(range(1 << index.depth))  # every pointer leads to a bucket
    assert len(set(pointers.values())) < len(pointers)  # some buckets kept their depth
    loads = defaultdict(int)
    for r in index.entries.select("bucket", F.octet_length("text").alias("b")).collect():
        loads[r["bucket"]] += r["b"] + exact_dedup.ROW_BYTES
    assert max(loads.values()) <= 14_000
    assert found(exact_dedup.deduplicate(docs, index).collect()) == brute(rows)


def test_hot_text_is_combined_before_the_shuffle(docs_of):
    rows = [(i, "the same text over and over " * 4) for i in range(3000)] + [(9000 + i, f"own {i}") for i in range(500)]
    docs = docs_of(rows)
    index = exact_dedup.build(docs, bucket_bytes=10_000)
    assert found(exact_dedup.deduplicate(docs, index).collect()) == brute(rows)
    assert index.entries.count() == 501


def test_one_exchange_of_the_texts(spark, sf, capsys):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), F.lit(1).alias("bucket")).repartition("bucket").groupBy("bucket", "key", "text").agg(F.count("*"))
    t.explain()
    assert capsys.readouterr().out.count("Exchange") == 1
