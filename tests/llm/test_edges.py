"""Every operator and stage on awkward rows: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.chat import format_preferences
from tidemark.llm.embeddings import link_embeddings
from tidemark.llm.exact_dedup import drop_exact, exact_groups
from tidemark.llm.mixing import mix_sources, mixed_rows
from tidemark.llm.near_dedup import near_classes
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_quality, score_quality, train_quality
from tidemark.llm.sharding import shard
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.toxicity import score_toxicity, train_toxicity

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "a few plain words here", "en", "s1", 5), (2, "a few  plain\nwords here", "en", "s1", 5), (3, None, None, None, None),
    (4, "", "en", "s2", 0), (5, LONG, "en", "s2", 1), (6, LONG, "en", None, 1), (7, "x", "de", "s3", 1), (7, "x", "de", "s3", 1),
    (None, "a few plain words here", "en", "s1", 5), (8, "   \t\n", "en", "s3", 4), (9, "é ü € 漢字 text", "fr", "s4", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    # columns named like those that operators add
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(
        {"size": F.lit("s"), "copies": F.lit(-1), "score": F.lit("?"), "_text": F.lit(0), "block": F.lit("b"), "kept": F.lit("k"),
         "shard": F.lit("z"), "_hash": F.lit(1.5), "target": F.lit("t"), "rep": F.lit("r"), "_row": F.lit(0), "_u": F.lit("u")}
    )


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, None), (5, None, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_exact(docs, none):
    got = by_id(exact_groups(docs), "keep_id", "group_size", "kept")
    assert got[1] == [(1, 3, True)] and got[2] == [(1, 3, False)] and got[None] == [(1, 3, False)]
    assert got[3] == [(3, 2, True)] and got[4] == [(3, 2, False)]
    assert got[5] == [(5, 2, True)] and got[6] == [(5, 2, False)]
    assert got[7] == [(7, 2, True)] * 2
    assert sorted(r["doc_id"] or 0 for r in drop_exact(docs).collect()) == [0, 1, 3, 5, 7, 7, 8, 9]
    assert drop_exact(docs).columns == docs.columns
    assert exact_groups(none).count() == 0 and drop_exact(none).count() == 0


def test_exact_hash_is_of_the_collapsed_text(docs):
    got = {r["doc_id"]: r["text_sha256"] for r in exact_groups(docs).collect()}
    assert got[2] == hashlib.sha256(b"a few plain words here").hexdigest() and got[8] == hashlib.sha256(b" ").hexdigest()


def test_mixing(docs, none):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["copies"] <= 3
        if r["doc_id"] in (3, 4, 8):
            assert r["size"] == 0
    assert {r["source"]: r["source_size"] for r in rows}[None] == 60_000
    total = sum(r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(total)
    assert all(r["target"] <= 3 * r["source_size"] for r in rows)
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.filter("size <> 's'").count() == 0
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mix_sources(none).count() == 0 and mixed_rows(none).count() == 0


def test_sharding(docs, none):
    rows = shard(docs, shards=4).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert shard(none).count() == 0


def test_packing(docs, none):
    rows = pack(docs).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert whole[3] == [(0, 1, 1)] and whole[4] == [(0, 1, 1)] and len(whole[7]) == 2
    at = 0
    for start, length, tokens in sorted(whole[5]):
        assert start == at
        at += length
    assert at == tokens
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(none).count() == 0


def test_scores(docs, none, labels):
    use = F.lit(True)
    model = train_quality(docs.select("doc_id", "text"), labels, use)
    assert all(0 <= r["score"] <= 1 for r in score_quality(docs, model).collect())
    assert score_quality(docs, model).count() == len(ROWS) and score_quality(none, model).count() == 0
    detector = train_toxicity(docs.select("doc_id", "text"), labels, use)
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(docs, detector).collect())
    assert score_toxicity(docs, detector).count() == len(ROWS) and score_toxicity(none, detector).count() == 0
    assert keep_quality(docs, labels.limit(0)).columns == docs.columns
    assert train_toxicity(none, labels.limit(0), use).score(None) == pytest.approx(0.5)
    assert keep_quality(none, labels).count() == 0


def test_near(docs, none):
    got = by_id(near_classes(docs), "class_id", "kept")
    assert got[1] == [(1, True)] and got[2] == [(1, False)] and got[None] == [(None, True)]
    assert got[3] == [(3, True)] and got[4] == [(4, True)] and got[8] == [(8, True)]
    assert got[5] == [(5, True)] and got[6] == [(5, False)] and got[7] == [(7, True)] * 2
    assert near_classes(none).count() == 0


def test_repeats(docs, none):
    got = by_id(remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3] == [(0, 0, 0, empty)] and got[4] == [(0, 0, 0, empty)]
    size = len(LONG.encode())
    assert got[6] == [(size, size, 1, empty)] and got[5][0][1] == 0
    assert got[7] == [(1, 0, 0, hashlib.sha256(b"x").hexdigest())] * 2 and got[None][0][1] == 0
    assert remove_repeats(none).count() == 0


def test_embeddings(spark):
    rows = [
        (1, [1.0, 0.0], 3), (2, [2.0, 0.01], 3), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1),
        (8, [float("inf"), 1.0], 1), (9, [1.0, 0.0], 9), (10, [0.0, 1.0], 9), (None, [1.0, 0.0], 9), (11, [1.0, 1.0, 1.0], 9), (12, [1.0, 1.0, 0.9], 9),
        (13, [0.0, -1.0], 2),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in link_embeddings(vectors).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False)
    assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 13)) and got[None] == (0, None, True)
    assert link_embeddings(vectors.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, "chosen", 0, "user", "hi", 0), (1, "chosen", 1, "assistant", "yes", 0), (1, "rejected", 0, "user", "hi", 0),
        (1, "rejected", 1, "assistant", "no", 0), (1, "rejected", 2, None, None, 0), (2, "chosen", 0, "user", None, 0), (2, "rejected", 0, "user", None, 0),
        (3, "chosen", 0, "user", "alone", 0), (None, "chosen", 0, "user", "x", 0), (4, "other", 0, "user", "x", 0),
        (5, "chosen", None, "user", "t", 0), (5, "chosen", None, "user", "t", 0), (5, "rejected", None, "user", "t", 0),
    ]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt int")
    got = {r["pair_id"]: r for r in format_preferences(turns).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["shared_turns"] == 1
    chosen, (start, end) = got[1]["chosen"], map(int, got[1]["chosen_spans"].split(":"))
    assert chosen == "<|assistant|>\nyes<|end|>\n" and chosen[start:end] == "yes<|end|>\n"
    assert got[1]["rejected"].endswith("<|unknown|>\n<|end|>\n") and got[1]["rejected_spans"].count(":") == 1
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["shared_turns"] == 1
    assert got[3]["prompt"] == "" and got[3]["rejected"] == "" and got[5]["shared_turns"] == 1 and got[5]["chosen"] != ""
    assert format_preferences(turns.limit(0)).count() == 0


def test_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, none):
        rows = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            out.write.parquet(path := str(tmp_path / f"{name}-{given is docs}"))
            rows = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == given.columns
