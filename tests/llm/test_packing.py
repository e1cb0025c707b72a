import random
from collections import Counter, defaultdict

import pytest

from driftline.llm import packing, tokens
from pyspark.sql import functions as F

DOCS = "doc_id bigint, lang string, n_tokens bigint"
SPECS = "pack_id string, lang string, capacity_tokens int"


def check(packed, docs, specs):
    """Every token of every document of a pack exactly once, nothing too full, no needless split."""
    fill, parts = Counter(), defaultdict(list)
    capacity = {s[0]: s[2] for s in specs}
    for r in packed:
        fill[r.pack_id, r.container] += r.n_tokens
        parts[r.pack_id, r.doc_id].append((r.start_token, r.n_tokens))
    assert all(n <= capacity[k[0]] for k, n in fill.items())
    for pack, lang, cap in specs:
        for doc, dl, n in docs:
            if cap > 0 and (lang is None or lang == dl):
                p = sorted(parts.pop((pack, doc)))
                assert len(p) == max(1, -(-n // cap))
                at = 0
                for start, size in p:
                    assert start == at
                    at += size
                assert at == n
    assert not parts
    return Counter(k[0] for k in fill)


def test_random(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["en", "de", None]), int(rng.paretovariate(1.1) * 40) if i % 50 else 0) for i in range(2000)]
    specs = [("all", None, 512), ("de", "de", 300), ("none", "xx", 10), ("bad", None, 0)]
    sized = spark.createDataFrame(docs, DOCS).withColumn("capacity", F.lit("clash"))
    packed = packing.pack(sized.repartition(20), spark.createDataFrame(specs, SPECS))
    n = check(packed.collect(), docs, specs)
    for pack, lang, cap in specs[:2]:
        least = -(-sum(d[2] for d in docs if lang is None or d[1] == lang) // cap)
        assert n[pack] <= 1.02 * least + 1
    report = {r.pack_id: r for r in packing.container_report(packed).collect()}
    assert report["all"].containers == n["all"] and report["all"].unused_share < 0.02


def test_edges(spark):
    specs = spark.createDataFrame([("p", None, 10)], SPECS)
    assert packing.pack(spark.createDataFrame([], DOCS), specs).collect() == []
    assert packing.pack(spark.createDataFrame([(1, "en", 3)], DOCS), specs.where("false")).collect() == []
    docs = [(1, None, 10), (2, "x", 25), (3, "x", 0), (4, "x", 5), (4, "x", 5)]
    got = packing.pack(spark.createDataFrame(docs, DOCS), specs).collect()
    assert sorted((r.doc_id, r.part, r.n_tokens) for r in got) == [(1, 0, 10), (2, 0, 10), (2, 1, 10), (2, 2, 5), (3, 0, 0), (4, 0, 5), (4, 0, 5)]


def test_only_empty_texts(spark):
    specs = [("p", None, 10)]
    docs = [(1, "x", 0), (2, "x", None), (3, None, 0)]
    got = packing.pack(spark.createDataFrame(docs, DOCS), spark.createDataFrame(specs, SPECS)).collect()
    assert sorted((r.doc_id, r.container, r.n_tokens) for r in got) == [(1, "0", 0), (2, "0", 0), (3, "0", 0)]


def test_merges_in_stages(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 2)
    monkeypatch.setattr(packing, "OPEN", 4)
    rng = random.Random(9)
    docs = [(i, "en", rng.randint(1, 90)) for i in range(3000)]
    specs = [("p", None, 100), ("q", "en", 1000)]
    packed = packing.pack(spark.createDataFrame(docs, DOCS).repartition(24), spark.createDataFrame(specs, SPECS))
    n = check(packed.collect(), docs, specs)
    assert n["p"] <= 1.15 * sum(d[2] for d in docs) / 100  # four windows only


def test_best_fit_emits_the_fullest():
    fit = packing.BestFit(10, 2)
    item = lambda k: k
    assert fit.place(6, item("a")) is None and fit.place(7, item("b")) is None
    assert fit.place(3, "c") == ["b", "c"]
    assert fit.place(8, "d") is None
    assert fit.place(9, "e") == ["d"]
    assert fit.place(10, "f") == ["f"]


def test_token_counts(spark):
    texts = ["Hello world", "", None, "á" * 1000, ("word " * 60_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.n_tokens for r in tokens.with_token_counts(df, F.col("text"), ["id"]).collect()}
    assert (got[0], got[1], got[2]) == (2, 0, 0) and got[3] > 0
    assert [got[i] for i in (3, 4)] == [len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(texts[i])) for i in (3, 4)]


def test_specs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SPECS", 1)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", None, 1), ("b", None, 1)], SPECS))
