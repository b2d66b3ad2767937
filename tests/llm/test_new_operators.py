"""Repeated windows, filter orders and importance resampling against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.filter_audit import audit_filters, failure_masks, removal_intervals
from tidemark.llm.importance import feature_crcs, ranked, resample, words_of
from tidemark.llm.window_dedup import COVERS, Words, cover_for, remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "a few plain words here", "s1"), (2, "a few  plain\nwords here", "s1"), (3, None, None), (4, "", "s2"), (5, LONG, "s2"),
    (6, LONG, None), (7, "x", "s3"), (7, "x", "s3"), (None, "a few plain words here", "s1"), (8, "   \t\n", ""), (9, "é ü € 漢字 text", "s4"),
    (10, "SHOUT " * 30, "s4"), (11, "a $ here", "s4"), (12, "x" * 5000 + " y", "s4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    names = ("part", "block", "prints", "bits", "n", "good", "toxic", "digest", "mask", "rank", "step", "score", "features", "weight", "place", "_text")
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit("?") for c in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# repeated windows


def cut_by_hand(rows, window):
    places, words = {}, [WORD.findall(t or "") for _, t, *_ in rows]
    for d, w in enumerate(words):
        for p in range(len(w) - window + 1):
            places.setdefault(tuple(w[p:p + window]), []).append((d, p))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for d, p in found:
                gone[d].update(range(p, p + window))
    return sorted(
        (str(r[0]), len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for r, w, g in zip(rows, words, gone)
    )


def cut(df, **options):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeated_windows(df, **options).collect())


@pytest.mark.parametrize("period", COVERS)
def test_any_two_places_have_a_common_shift_onto_the_cover(period):
    cover = set(COVERS[period])
    for p in range(period):
        for q in range(period):
            assert any((p + s) % period in cover and (q + s) % period in cover for s in range(period))


def test_anchor_lies_in_the_window():
    for window in range(1, 80):
        period, _, anchor = cover_for(window)
        assert anchor >= 1 and period - 1 + anchor == window


def test_words_are_hashed_alike_wherever_they_stand():
    texts = [b"one two", b"", b" \t", b"two  one\x0btwo \xc3\xa9", b"x" * 300 + b" " + b"x" * 301]
    one, other = Words(texts, 1), Words([b"zzz zz", *texts[::-1]], 1)
    assert np.diff(one.bounds).tolist() == [2, 0, 0, 4, 2]
    flat = [w for t in texts for w in t.split()]
    hashes = one.window_hashes(np.arange(one.size)).tolist()
    assert len(set(hashes)) == len(set(flat))
    there = other.window_hashes(np.arange(other.size)).tolist()
    turned = [w for t in [b"zzz zz", *texts[::-1]] for w in t.split()]
    assert {w: h for w, h in zip(flat, hashes)}.items() <= {w: h for w, h in zip(turned, there)}.items()


def test_words_in_slices(monkeypatch):
    texts = [f"w{i} same words again {i % 7}".encode() for i in range(200)]
    whole = Words(texts, 3)
    monkeypatch.setattr("tidemark.llm.window_dedup.SLICE", 64)
    sliced = Words(texts, 3)
    assert (whole.bounds == sliced.bounds).all()
    assert (whole.window_hashes(whole.starts) == sliced.window_hashes(sliced.starts)).all()


@pytest.mark.parametrize("window", [1, 2, 5, 12, 35])
def test_windows_equal_brute_force(spark, window):
    rng = random.Random(window)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(window, 4 * window + 2))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice("klmnop") + str(rng.randrange(4000)) for _ in range(rng.randrange(3 * window + 1)))]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared).split()
            at = rng.randrange(len(passage))
            parts.append(rng.choice([" ", "\n", " \t"]).join(passage[at:] + passage[:at] if rng.random() < 0.3 else passage))
            parts.append(f"u{i}-{rng.randrange(10**6)}")
        rows.append((i, "  ".join(parts), "s"))
    rows += [(60, rows[3][1], "s"), (61, "r " * (2 * window + 3), "s"), (62, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = cut_by_hand(rows, window)
    assert cut(df, window=window, block_bytes=300, part_bytes=500) == want
    assert cut(df, window=window) == want
    assert any(r[2] for r in want)


def test_windows_on_awkward_rows(docs, none):
    assert cut(docs) == cut_by_hand(ROWS, 35)
    assert cut(docs, window=3, block_bytes=1 << 12) == cut_by_hand(ROWS, 3)
    assert remove_repeated_windows(none).count() == 0


# filter orders


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_intervals_name_the_first_failing_filter(filters):
    orders = list(permutations(range(filters)))
    found = {}
    for mask, first, stop, step in removal_intervals(filters):
        for rank in range(first, stop):
            assert (mask, rank) not in found
            found[mask, rank] = step
    for mask in range(1, 1 << filters):
        for rank, order in enumerate(orders):
            assert found[mask, rank] == 1 + next(i for i, f in enumerate(order) if mask >> f & 1)


def audit_by_hand(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, _ in texts:
        w = WORD.findall(t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        })
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    out, removed_by = {}, {}
    for part in {s for _, _, s in texts}:
        members = [(i, f) for (i, _, s), f in zip(texts, fails) if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(members)
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if m[1][letter]]
                left = [m for m in left if not m[1][letter]]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(f[letter] for _, f in members) - len(gone),
                    sum(f[letter] and sum(f.values()) == 1 for _, f in members),
                    sum(i is not None and i in good for i, _ in gone), sum(i is not None and i in toxic for i, _ in gone),
                )
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, None), (5, None, 1), (9, 0, 1), (7, 0, 0), (7, 1, 0), (None, 1, 1)]


def audited(df, labels):
    got = audit_filters(df, labels).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in got}


def test_orders_equal_brute_force(spark, docs, none):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    assert audited(docs, labels) == audit_by_hand(ROWS, LABELS)
    assert audit_filters(none, labels).count() == 0
    assert audited(docs, labels.limit(0)) == audit_by_hand(ROWS, [])


def test_copies_across_parts(spark):
    text = " ".join(f"w{i}" for i in range(250))
    rows = [(i, text if i % 3 else text + f" {i % 2}", f"p{i % 4}") for i in range(50, 0, -1)] + [(1, text, "p9"), (None, text, "p1")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(40)]
    got = audited(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int"))
    assert got == audit_by_hand(rows, labels)


def test_masks_hold_one_row_a_part_and_mask(docs, spark):
    masks = failure_masks(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    rows = masks.groupBy("part", "mask").count()
    assert rows.filter("count > 1").count() == 0


# importance resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_by_hand(text):
    w = TOKEN.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def drawn_by_hand(rows, target):
    s, t, docs = [0] * 10000, [0] * 10000, [(i, *features_by_hand(x)) for i, x, *_ in rows]
    for _, _, f in docs:
        for b in f:
            s[b] += 1
    for x in target:
        for b in features_by_hand(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(sum(s) + 10000) / ((s[b] + 1) * float(sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, w, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    placed = fit[:25 * len(fit) // 100]
    return sorted((str(r[0]), *r[1:], rank) for rank, r in enumerate(placed, 1)), sorted(
        (str(r[0]), *r[1:]) for r in [x for x in out if x[1] < 20] + fit[25 * len(fit) // 100:]
    )


def check_drawn(df, target, rows, texts):
    got = resample(df, target).collect()
    names = ("n_words", "n_features", "weight", "score")
    drawn = sorted((str(r["doc_id"]), *[r[c] for c in names], r["rank"]) for r in got if r["rank"] is not None)
    rest = sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in got if r["rank"] is None)
    assert (drawn, rest) == drawn_by_hand(rows, texts)


def test_drawing_equals_brute_force(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) + rng.choice(["", ".", "É", "-Z9"]) for _ in range(rng.randrange(60))), "s") for i in range(300)]
    rows += [(5, rows[5][1], "s"), (None, rows[7][1], "s"), (900, LONG, "s")]
    texts = ["aa bb Cc", "ÉÉ x", None, "", "d-d d_d"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    check_drawn(spark.createDataFrame(rows, SCHEMA).repartition(4), target, rows, texts)
    check_drawn(docs, target, ROWS, texts)
    check_drawn(docs, target.limit(0), ROWS, [])
    assert resample(none, target).count() == 0


def test_ranks_of_equal_scores_and_blocks(spark):
    rng = random.Random(1)
    rows = [(i, 20, 1, 0, rng.choice([-70000, -1, 0, 1, 255, 256, 257, 90000])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    got = {r["doc_id"]: r["rank"] for r in ranked(df, percent=60).collect()}
    want = {r[0]: n if n <= 240 else None for n, r in enumerate(sorted(rows, key=lambda r: (-r[4], r[0])), 1)}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ09 _-é\x00\x7f\x80K\n"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(1, 9))
def test_words_and_runs_of_any_text(text, chunk):
    want, buckets = features_by_hand(text)
    lowered = text.translate(LOWER)
    found = words_of(text, chunk)
    assert [w for w, _ in found] == want and all(lowered[s:e] == w for w, (s, e) in found)
    assert [c % 10000 for c in feature_crcs(found)] == buckets
