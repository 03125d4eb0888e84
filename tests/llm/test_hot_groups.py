"""Hot keys, hubs and small limits: what production sizes never reach in the other tests."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemql.llm import chat, common, components, decontam, mixing, neardup, topk


def clusters(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0]


@pytest.mark.parametrize("block", [2, 128])
def test_near_duplicates_in_one_large_mixed_bucket(spark, monkeypatch, block):
    """Texts that share a long passage and differ in the rest: many classes of many components in the same buckets."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rnd = random.Random(block)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = []
    for family in range(30):
        own = [f"f{family}w{i}" for i in range(22)]
        for _ in range(rnd.randrange(1, 6)):
            words = own.copy()
            for _ in range(rnd.randrange(0, 3)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            texts.append(f"{shared} {' '.join(words)}")
    texts += [texts[0]] * 40 + ["", "   ", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    links = brute(texts, 4, 80)
    root = clusters(links)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, k=4).collect()}
    assert got == {i: root.get(i, i) for i in range(len(texts))}
    assert 10 < len(set(got.values())) < len(texts) - 40


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rnd = random.Random(1)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5000 + i) for i in rnd.sample(range(1, 900), 200)] + [(399, 5899)]
    links = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in links]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.component for r in components.components(df).collect()} == clusters(links)


def test_join_of_hot_keys(spark, monkeypatch):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {how: sorted(map(tuple, rows.join(table, "k", how).select("k", "id", "v").collect()), key=repr) for how in ("inner", "left")}
    for least in (10, 1 << 16):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        for few in (0, 100):
            monkeypatch.setattr(common, "BROADCAST_ROWS", few)
            for how, expected in want.items():
                assert sorted(map(tuple, common.join_hot(rows, table, "k", how).select("k", "id", "v").collect()), key=repr) == expected


def test_mixing_with_small_buckets_keeps_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rnd = random.Random(4)
    rows = [(i, "a" if i % 3 else rnd.choice("bcd"), " ".join(["w"] * rnd.randrange(0, 40))) for i in range(600)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), [5.0, 2.0, 1.0]).collect()
    assert len(plan) == 600
    for source in "abcd":
        own = [r for r in plan if rows[r.doc_id][1] == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 2
        assert all(0 <= r.taken <= 3 * r.size for r in own)


def test_a_long_conversation_in_small_chunks(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} <s>") for i in range(200)] + [(2, 0, "user", None), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = sorted(map(tuple, chat.digest(chat.format_chat(chat.message_events(df))).collect()))
    monkeypatch.setattr(chat, "CHUNK", 7)
    assert sorted(map(tuple, chat.digest(chat.format_chat(chat.message_events(df))).collect())) == whole


def test_top_k_over_small_shards_with_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    vectors = [(i, rng.integers(-2, 3, 6).tolist()) for i in range(400)] + [(7, [2.0] * 6)] * 3 + [(50, [1.0] * 6)] * 2
    df = spark.createDataFrame([(i, [float(x) for x in v], "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, score string, rank int").repartition(9)
    got = {}
    for r in topk.top_k_embeddings(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = {}
    for i, v in vectors:
        asked.setdefault(i, []).append(v)
    assert set(got) == {i for i in asked if i % 50 == 0}
    for q, found in got.items():
        options = []
        for mine in asked[q]:  # a repeated query id is asked by one of its rows
            scored = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(mine, v, strict=True)), i) for i, v in vectors if i != q)[:5]
            options.append([(n + 1, i, -s) for n, (s, i) in enumerate(scored)])
        assert sorted(found) in options


def test_top_k_of_scores_beyond_doubles(spark):
    big = float(1 << 22)
    vectors = [(0, [big, 1.0]), (1, [big, 3 / 256]), (2, [big, 2 / 256]), (3, [big, 2 / 256]), (4, [-big, 1.0]), (5, [big - 1 / 256, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    scored = sorted((-sum(a * b for a, b in zip(whole[0], v, strict=True)), i) for i, v in whole.items() if i != 0)
    assert abs(scored[0][0]) > 2**53
    assert [(r.vec_id, r.score) for r in topk.top_k_embeddings(df).orderBy("rank").collect()] == [(i, -s) for s, i in scored]


def test_decontamination_in_groups_of_parts(spark, monkeypatch):
    """Many parts, few together in a pass, repeated items and documents: as with one index."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(8, 40))) + ".") for i in range(40)]
    items += [(100, items[0][1]), (101, None), (102, ""), (103, "  ")]
    docs = [(i, " ".join(rnd.choices(words, k=30)) + " " + (items[i % 40][1] if i % 3 == 0 else "") + " " + " ".join(rnd.choices(words, k=5000 if i == 3 else 20))) for i in range(60)]
    docs += [docs[0], (99, None), (98, "")]
    schema = "doc_id long, text string, score int, item_id string"
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in decontam.contaminated(df, bench).collect())
    clean = sorted(r.doc_id for r in decontam.drop_contaminated(df, bench).collect())
    assert {d for d, *_ in one} >= {i for i in range(0, 60, 3)} and len(clean) == len(docs) - len({d for d, *_ in one}) - 1
    monkeypatch.setattr(decontam, "MAX_ITEMS", 6)
    monkeypatch.setattr(decontam, "TOGETHER", 3)
    assert sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in decontam.contaminated(df, bench).collect()) == one
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df, bench).collect()) == clean
