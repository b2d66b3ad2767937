"""Vector bin packing against a plain greedy pass, its law, its groups and ties; held-out toxicity."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.queries import QUERIES
from tidemark.llm.sharding import EMPHASIS, place, shard


def plain_greedy(items, residual, capacity):
    left = [[r / c for r, c in zip(row, capacity)] for row in residual]
    demand = [[x / c for x, c in zip(row, capacity)] for row in items]
    root = [w ** 0.5 for w in EMPHASIS]
    where = {}
    for i in sorted(range(len(items)), key=lambda i: (-max(r * x for r, x in zip(root, demand[i])), i)):
        gain = [sum(w * a * b for w, a, b in zip(EMPHASIS, row, demand[i])) for row in left]
        best = max(range(len(left)), key=lambda s: (gain[s], -s))
        left[best] = [a - b for a, b in zip(left[best], demand[i])]
        where[i] = best
    return [where[i] for i in range(len(items))]


@pytest.mark.parametrize("ties", [False, True])
def test_placing_equals_a_plain_greedy_pass(ties):
    rng = np.random.default_rng(2)
    # powers of two keep ties exact
    items = 2.0 ** rng.integers(0, 4, (60, 1)) * np.ones(3) if ties else rng.uniform(1, 50, (60, 3))
    capacity = np.full(3, 128.0) if ties else items.sum(axis=0) / 5
    residual = np.tile(capacity, (5, 1))
    assert place(items, residual.copy(), capacity).tolist() == plain_greedy(items.tolist(), residual.tolist(), capacity.tolist())


def test_law_groups_slots_and_ties(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words, int(rng.integers(3, 60)))) for _ in range(2500)]
    texts += [texts[i] for i in rng.integers(0, 40, 300)] + ["same size"] * 20 + ["size same"] * 20 + ["", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shard(frame.repartition(3)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    homes, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        homes[data].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(len(h) == 1 for h in homes.values()) and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) < 1.03 * sum(loads.values()) / 16 and min(loads.values()) > 0.97 * sum(loads.values()) / 16
    assert sorted(shard(frame.repartition(7)).collect()) == sorted(rows)


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf_dir).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    bad = np.array([r["score"] for r in rows if labels[r["doc_id"]]])
    good = np.array([r["score"] for r in rows if not labels[r["doc_id"]]])
    wins = (bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean()
    assert len(bad) > 20 and wins > 0.93
