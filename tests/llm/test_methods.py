"""The methods against brute force, exact round trips and held-out rows."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, near_dedup, suffix_dedup
from tidemark.llm.common import QUERIES
from tidemark.llm.components import components, local_roots
from tidemark.llm.embeddings import ProductIndex, link_embeddings
from tidemark.llm.near_dedup import WordHash, dart_signatures, drop_near, near_classes, shingles, weighted_jaccard
from tidemark.llm.packing import Encoder, best_cuts, candidates, padding
from tidemark.llm.quality import FactorisationMachine
from tidemark.llm.sharding import place
from tidemark.llm.suffix_dedup import anchors, remove_repeats
from tidemark.llm.toxicity import BREAK, INSULT, NEGATES, OTHER, REPORTS, TARGETS, grammar

SF_DIR = "/root/testdata/sf0.001"


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(20, 60)} == {7} and 5 not in got
    assert local_roots(5, np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def brute_repeats(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs.items()):
        grams = [text[i:i + 50] for i in range(len(text) - 49)]
        gone = np.zeros(len(text), dtype=bool)
        for i, g in enumerate(grams):
            if g in seen:
                gone[i:i + 50] = True
        seen.update(grams)
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        runs = sum(1 for flag, _ in itertools.groupby(gone.tolist()) if flag)
        out[doc] = (len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_repeats_equal_brute_force(spark, batches):
    rng = np.random.default_rng(3)
    line = bytes(rng.integers(97, 123, 120))
    docs = {}
    for i in range(60):
        own = bytes(rng.integers(97, 101, rng.integers(0, 400)))
        docs[i] = own[:150] + line[int(rng.integers(0, 40)):int(rng.integers(60, 120))] + own[150:] + b"z" * int(rng.integers(0, 130))
    docs[60], docs[61] = docs[3], docs[3][:49]
    frame = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame, batches=batches).collect()}
    assert got == brute_repeats(docs)


def test_a_hot_anchor_is_not_held_by_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 123, n))
    rule, tails = b"-" * 8 + letters(24) + b"-" * 8, [letters(60) for _ in range(40)]
    docs = {i: letters(int(rng.integers(30, 90))) + rule + tails[i % 40 if i % 3 else 0][:int(rng.integers(0, 60))] + letters(40) for i in range(300)}
    docs[300] = b"".join(letters(20) + rule for _ in range(200))
    docs[301] = letters(9) + docs[300][777:3333]
    frame = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "HOT", 250)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4096)
    seen, masks = spark.sparkContext.accumulator(0), suffix_dedup._masks
    largest = spark.sparkContext.accumulator(0)

    def counted(key, rows, blocks):
        if key[0] == "asked":
            around = suffix_dedup._asked(rows["a"].tolist())[1]
            prefixes = [bytes(r[suffix_dedup.BEFORE:suffix_dedup.BEFORE + suffix_dedup.PREFIX]) for r in around]
            largest.add(sum(n > 250 for n in Counter(prefixes).values()))
        seen.add(len(rows) if key[0] == "hot" else 0)
        return masks(key, rows, blocks)

    monkeypatch.setattr(suffix_dedup, "_masks", counted)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame).collect()}
    assert got == brute_repeats(docs)
    assert largest.value == 0 and seen.value > 1


@pytest.mark.parametrize("hot", [1 << 14, 3])
def test_two_texts_under_one_id_are_cut_each_by_itself(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(6)
    letters = lambda n: bytes(rng.integers(97, 123, n))
    first, second = letters(700), letters(700)
    rows = [(1, first), (2, second), (5, letters(500) + first[40:300]), (5, first[:90]), (5, second[10:90] + letters(20)), (6, letters(80) + first[500:])]
    rows += [(7, b"n" + letters(60)), (7, letters(40))] + [(8 + i, letters(30) + first[300:340] + letters(30)) for i in range(9)]
    frame = spark.createDataFrame([(k, v.decode()) for k, v in rows], "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame).collect())
    want = []
    for doc, text in rows:
        # the other texts of the id are not there for this one
        want.append((doc, *brute_repeats({**{i: t for i, (d, t) in enumerate(rows) if d < doc}, 1000: text})[1000]))
    assert got == sorted(want)


def test_batches_grow_with_the_bytes_and_levels_merge(spark, monkeypatch):
    rng = np.random.default_rng(9)
    shared = bytes(rng.integers(97, 123, 90))
    docs = {i: bytes(rng.integers(97, 123, 110)) + shared[i % 7:] for i in range(50)}
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", sum(map(len, docs.values())) // 4)
    occupied, add = [], suffix_dedup.SuffixLevels.add

    def watched(self, batch, last=False):
        add(self, batch, last)
        occupied.append([level is not None for level in self.levels])

    monkeypatch.setattr(suffix_dedup.SuffixLevels, "add", watched)
    frame = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame).collect()}
    assert got == brute_repeats(docs)
    assert occupied[:4] == [[True], [False, True], [True, True], [False, False, True]]


def test_messages_to_blocks_do_not_grow_with_the_frames_of_the_input(spark, monkeypatch):
    rng = np.random.default_rng(13)
    letters = lambda n: bytes(rng.integers(97, 123, n))
    shared = letters(90)
    docs = {i: letters(60) + shared + letters(40) for i in range(1600)}
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", sum(map(len, docs.values())) // 8)
    monkeypatch.setattr(suffix_dedup, "HOT", 250)
    family, add = [], suffix_dedup.SuffixLevels.add

    def watched(self, batch, last=False):
        add(self, batch, last)
        family[:] = [self]

    monkeypatch.setattr(suffix_dedup.SuffixLevels, "add", watched)
    frame = spark.createDataFrame([(k, v.decode()) for k, v in docs.items()], "doc_id long, text string").repartition(100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(frame, batches=2).collect()}
    assert got == brute_repeats(docs)
    told = sum(table.filter("kind = 'told'").count() for table in family[0].found)
    # a pack a block from each part, and from each of the 16 tasks of a batch that gather
    assert 0 < told <= (family[0].parts + 2 * 16) * family[0].blocks


def test_hashes_equal_in_their_upper_bits_only_are_told_apart():
    h, docs = np.array([16, 17, 16, 17, 18], dtype=np.uint64) << np.uint64(3), np.array([1, 2, 3, 4, 0])
    assert suffix_dedup._later(h + np.uint64(0), h, docs).tolist() == [False, False, True, True, False]
    h = np.array([16, 17, 16, 17, 18], dtype=np.uint64)
    assert suffix_dedup._later(h, h, docs).tolist() == [False, False, True, True, False]
    assert suffix_dedup._later(np.zeros(5, dtype=np.int64), h, docs).tolist() == [False, False, True, True, False]


def test_parts_and_groups_grow_where_packs_would_be_many():
    parts = [suffix_dedup._number(n << 30, 1 << 23, 256, 4) for n in (0, 1, 2, 8, 16, 64)]
    assert parts == [1, 128, 256, 256, 512, 2048]
    assert suffix_dedup._number(5, 2) == 3


def test_anchors_looked_at_in_parts_give_the_same_windows(monkeypatch):
    rng = np.random.default_rng(17)
    text = bytes(rng.integers(97, 123, 4000))
    rows = [(i, 0, text[n:n + 300 + 7 * i] + bytes(rng.integers(97, 123, 40))) for i, n in enumerate(rng.integers(0, 3000, 40).tolist())]
    texts = pd.DataFrame(rows, columns=["doc_id", "text_key", "_bytes"])
    every = np.unique(np.concatenate([anchors(np.frombuffer(t, dtype=np.uint8))[1] for _, _, t in rows]))
    # each text a block of its own, so that nothing is decided before
    told = pd.DataFrame({"kind": ["told"], "block": [0], "a": [suffix_dedup._packed(every, np.ones(len(every), dtype=np.int64))]})
    asked = pd.concat([suffix_dedup._contexts(texts.iloc[[i]], told, np.zeros(0, dtype=np.uint64), 1, 1) for i in range(len(texts))])
    masks = []
    for together in (1 << 16, 5):
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        out = suffix_dedup._masks(("asked", 0), asked, 1)
        masks.append(sorted(zip(*suffix_dedup._unpacked(out["a"].tolist(), 4).tolist())))
    assert masks[0] == masks[1] and len(masks[0]) > 50


@pytest.mark.parametrize("turn", [7, 24])
def test_every_window_holds_an_anchor_that_depends_on_it_alone(monkeypatch, turn):
    monkeypatch.setattr(suffix_dedup, "_POSITION", np.uint64((1 << turn) - 1))
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 4, 700), np.zeros(200), rng.integers(0, 4, 300)]).astype(np.uint8)
    found = set(anchors(data)[0].tolist())
    for start in range(0, len(data) - 50):
        alone = {start + p for p in anchors(data[start:start + 50])[0].tolist()}
        assert alone <= found and alone


def test_signatures_estimate_weighted_jaccard():
    words = WordHash()
    text = " ".join(f"w{i % 230}" for i in range(600))
    a, b = shingles(text, words), shingles(text + " " + " ".join(f"v{i}" for i in range(150)), words)
    signs = dart_signatures([np.sort(a + np.uint64(i)) for i in range(40)] + [np.sort(b + np.uint64(i)) for i in range(40)])
    share = np.mean([(signs[i] == signs[40 + i]).mean() for i in range(40)])
    assert share == pytest.approx(weighted_jaccard(a, b), abs=0.04)


def test_near_classes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice([f"t{i}" for i in range(500)], 200)) for _ in range(12)]
    texts = []
    for i in range(150):
        words = base[i % 12].split()
        for j in rng.choice(200, int(rng.integers(0, 12)), replace=False):
            words[j] = f"x{i}-{j}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(frame).collect()}
    words = WordHash()
    sets = [shingles(t, words) for t in texts]
    links = [(a, b) for a in range(150) for b in range(a) if weighted_jaccard(sets[a], sets[b]) >= 0.8]
    root = local_roots(150, *map(np.array, zip(*links)))
    assert [got[i] for i in range(150)] == root.tolist()


def test_pairs_are_ruled_out_by_their_sets_not_by_signatures(spark, monkeypatch):
    def unlike(sets):
        # all share the first band only, though their texts are alike
        sign = np.arange(len(sets) * near_dedup.COORDINATES, dtype=np.uint32).reshape(len(sets), -1)
        sign = sign + np.array([len(s) * 100_003 + int(s[0] % np.uint64(1 << 20)) if len(s) else 0 for s in sets], dtype=np.uint32)[:, None]
        sign[:, :near_dedup.ROWS] = 7
        return sign

    texts = [" ".join(f"{g}w{i}" for i in range(100 + extra)) for g, extra in [("c", 0), ("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 3)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "dart_signatures", unlike)
    got = {r["doc_id"]: r["class_id"] for r in near_classes(frame).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 0}


def test_probes_reach_similar_vectors_that_vary_in_few_directions():
    rng = np.random.default_rng(12)
    scale = np.where(np.arange(64) < 6, 1.0, 0.02)
    rows = rng.normal(size=(4000, 64)) * scale
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = ProductIndex.fit(rows, 120)
    own, probed = index.place(rows, 0.9)
    a, b = np.nonzero(rows @ rows.T >= 0.9)
    assert len(a) > 2 * len(rows) and probed[a, own[b]].mean() > 0.9999


def test_each_pair_of_lists_is_looked_at_once_and_a_sketch_says_no_less_than_the_cosine():
    every = np.arange(9)
    asks = embeddings.asks_for(every[:, None], every)
    assert ((asks ^ asks.T) | np.eye(9, dtype=bool)).all() and asks.diagonal().all()
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(900, 20)) * np.linspace(2, 0.2, 20)
    rows = np.concatenate([rows, rows[:300] + 0.1 * rng.normal(size=(300, 20))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = ProductIndex.fit(rows, 30)
    side = embeddings.Side(rows, index.sketch(rows))
    assert (side.sketch @ side.sketch.T >= rows @ rows.T - 1e-5).all()
    assert len(set(index.group.tolist())) <= embeddings.GROUPS


def test_links_across_small_blocks_count_once_at_both_ends(spark, monkeypatch):
    """Blocks of 256 rows, folds of few links, copies, and vectors of a second length."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 16))
    rows = [*np.repeat(base, 5, axis=0) + 0.15 * rng.normal(size=(2000, 16)), *base[:30], *base[:30]]
    other = rng.normal(size=(40, 6))
    short = [*other, *(other + 0.05 * rng.normal(size=other.shape))]
    monkeypatch.setattr(embeddings, "NUMBERS", 1)
    monkeypatch.setattr(embeddings, "PAIRS", 1000)
    monkeypatch.setattr(embeddings, "LINKS", 50)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*rows, *short])], "vec_id long, embedding array<double>")
    got = link_embeddings(frame.repartition(4)).toPandas().sort_values("vec_id")
    n = len(rows) + len(short)
    near = np.zeros((n, n), dtype=bool)
    for lo, part in ((0, rows), (len(rows), short)):
        unit = np.array(part) / np.linalg.norm(part, axis=1, keepdims=True)
        near[lo:lo + len(part), lo:lo + len(part)] = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 1000 and got["n_links"].tolist() == near.sum(axis=1).tolist()
    assert got["component_id"].tolist() == local_roots(n, *np.nonzero(near)).tolist()


def test_smaller_ids_are_found_without_sorting_by_both_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    h, docs = rng.integers(0, 300, 500).astype(np.uint64), rng.integers(0, 40, 500)
    for g in (h * np.uint64(7), rng.integers(0, 2, 500).astype(np.uint64)):
        least = {}
        for key, doc in zip(zip(h.tolist(), g.tolist()), docs.tolist()):
            least[key] = min(doc, least.get(key, doc))
        want = [least[key] < doc for key, doc in zip(zip(h.tolist(), g.tolist()), docs.tolist())]
        assert suffix_dedup._later(h, g, docs).tolist() == want
    monkeypatch.setattr(np, "lexsort", None)
    assert suffix_dedup._later(h, h, docs).sum() == sum(docs[i] > docs[h == h[i]].min() for i in range(500))
    assert suffix_dedup._later(h[:0], h[:0], docs[:0]).tolist() == []
    known = np.array([2, 5, 9], dtype=np.uint64)
    assert suffix_dedup._among(np.array([9, 1, 5, 11], dtype=np.uint64), known).tolist() == [True, False, True, False]
    assert not suffix_dedup._among(known, known[:0]).any()


def test_anchors_are_the_least_hash_of_each_window_also_where_places_start_anew(monkeypatch):
    text = np.random.default_rng(4).integers(97, 100, 900).astype(np.uint8)
    key = suffix_dedup.prefix_hashes(text) & ~suffix_dedup._POSITION
    last = [s + suffix_dedup.PLACES - 1 - int(np.argmin(key[s:s + suffix_dedup.PLACES][::-1])) for s in range(len(text) - suffix_dedup.LENGTH + 1)]
    found, prints = anchors(text)
    assert found.tolist() == sorted(set(last))
    assert (suffix_dedup.prefix_hashes(text[3:]) == suffix_dedup.prefix_hashes(text)[3:]).all()
    monkeypatch.setattr(suffix_dedup, "_POSITION", np.uint64(255))
    again, _ = anchors(text)
    for s in range(len(text) - suffix_dedup.LENGTH + 1):
        assert ((again >= s) & (again < s + suffix_dedup.PLACES)).any()


def test_queue_finds_the_cheapest_cuts():
    rng = np.random.default_rng(4)
    for _ in range(30):
        places = np.unique(rng.integers(1, 60, 14))
        cost = rng.choice([0.0, 3.0, 9.0], len(places))
        cost[-1] = 0.0
        window = int(max(np.diff(np.concatenate([[0], places])).max(), rng.integers(12, 30)))
        price = lambda cuts: sum(window - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(cost[places.tolist().index(c)] for c in cuts)
        inner = places[:-1].tolist()
        fits = [
            [*c, int(places[-1])] for k in range(len(inner) + 1) for c in itertools.combinations(inner, k)
            if max(np.diff([0, *c, int(places[-1])])) <= window
        ]
        assert price(best_cuts(places, cost, window)) == min(map(price, fits))


def test_hard_cuts_keep_long_runs_feasible():
    ids = np.zeros(20_000, dtype=np.uint32)
    places, cost = candidates(ids, np.array([20_000]), np.zeros(1, dtype=bool))
    cuts = best_cuts(places, cost)
    assert max(np.diff([0, *cuts])) <= 4096 and cuts[-1] == 20_000
    assert padding(1024) == 0 and padding(1000) == 3096


def test_ids_equal_the_tokenizer():
    tokens = pytest.importorskip("public_tokenizers")
    encoder = Encoder(tokens.path("word_bpe_49k.json"))
    texts = [
        "It's a test, isn't it?  They'LL see 'sts 12.5%", "Größe ÄÖÜ ß naïve café ñandú ŉ İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "漢字 かな　x", "",
        "a\x0bb\x0c\r\n\tc\x1cd", "é combining", "under_score __x__ $$$%%% ''s", "x" * 300, "“quote” — dash… €5",
    ]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(spark):
    tokens = pytest.importorskip("public_tokenizers")
    encoder = Encoder(tokens.path("word_bpe_49k.json"))
    rows = QUERIES["op5_packing"](spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    at = dict.fromkeys(docs, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.append(encoder.tokenizer.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2).astype("<u4")
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert sum(at.values()) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    lengths = {}
    for r in rows:
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert sum(map(padding, lengths.values())) < 0.05 * sum(lengths.values())


def test_factorisation_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    places, values = np.array([0, 4, 7, 8]), rng.normal(size=4)
    pairs = sum(model.factors[places[i]] @ model.factors[places[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    want = 0.3 + model.linear[places] @ values + pairs
    assert model.margin(places, values, np.array([0]))[0] == pytest.approx(want)


def test_grammar_marks_what_it_should():
    machine = grammar()

    def run(*symbols):
        state, out = 0, []
        for s in symbols:
            state, o = machine.step(state, s)
            out.append(o)
        return out

    assert run(INSULT) == [INSULT]
    assert run(TARGETS, OTHER, INSULT)[-1] == (INSULT, ("targeted",))
    assert run(NEGATES, INSULT)[-1] == (INSULT, ("negated",)) and run(NEGATES, OTHER, OTHER, OTHER, INSULT)[-1] == INSULT
    assert run(REPORTS, OTHER, TARGETS, NEGATES, INSULT)[-1] == (INSULT, ("negated", "reported", "targeted"))
    assert run(REPORTS, TARGETS, BREAK, INSULT)[-1] == INSULT


def test_place_prefers_room():
    residual = np.full((3, 3), 10.0)
    where = place(np.array([[9.0, 9, 9], [5, 5, 5], [5, 5, 5], [8, 8, 8]]), residual, np.full(3, 10.0))
    assert len({where[0], where[3], where[1]}) == 3 and where[1] == where[2]


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in rows if labels[r["doc_id"]]]
    bad = [r["score"] for r in rows if not labels[r["doc_id"]]]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and not math.isnan(sum(good))


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 24))
    rows = np.concatenate([base, base[:120] + 0.08 * rng.normal(size=(120, 24)), base[:40] * 3])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    from tidemark.llm.embeddings import link_embeddings

    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_embeddings(frame.select("*", F.lit("x").alias("code"))).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    root = local_roots(len(rows), *np.nonzero(linked))
    found = sum(n for n, _ in got.values())
    assert found >= 0.999 * linked.sum() and found <= linked.sum()
    assert np.mean([got[i] == (linked[i].sum(), root[i]) for i in range(len(rows))]) > 0.99


def test_texts_under_one_id_have_their_own_fates(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    near = [*base[:150], "changed", *base[151:]]
    other = [f"u{i}" for i in rng.integers(0, 5000, 200)]
    rows = [(1, " ".join(base)), (7, " ".join(near)), (7, " ".join(other)), (9, " ".join(other[:199])), (None, " ".join(base)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in near_classes(df).collect())
    assert got == sorted([("1", "1", True), ("7", "1", False), ("7", "7", True), ("9", "7", False), ("None", "None", True), ("3", "3", True)])
    left = sorted((str(r["doc_id"]), r["text"]) for r in drop_near(df).collect())
    assert left == sorted([("1", rows[0][1]), ("7", rows[2][1]), ("None", rows[4][1]), ("3", None)])


def test_vectors_of_any_size_keep_all_links(spark):
    """Planted groups in few directions, with recall against brute force through the whole query."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 32)) * np.linspace(3, 0.1, 32)
    rows = np.repeat(centres, 4, axis=0) + rng.normal(size=(1200, 32)) * 0.12
    rows = np.concatenate([rows, rng.normal(size=(1800, 32))])
    scale = np.ones(len(rows))
    scale[[5, 400, 2000]] = 1e-200
    scale[[6, 401, 2001]] = 1e200
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, (r * k).tolist()) for i, (r, k) in enumerate(zip(rows, scale))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in link_embeddings(df.repartition(5)).collect()}
    want = near.sum(axis=1)
    assert want.sum() > 1000
    assert all(got[i] <= want[i] for i in range(len(rows))) and sum(got.values()) >= 0.99 * want.sum()
    assert all(got[i] == want[i] for i in (5, 6, 400, 401))
