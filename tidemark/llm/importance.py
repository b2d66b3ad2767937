"""Importance resampling towards a target distribution: hashed features of words and word pairs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

BUCKETS = 10_000
#: runs of 1 to so many words are features
RUN = 2
#: documents of fewer words are scored but not drawn, and of all others so many in a hundred are
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: characters given to the pre-tokenizer at once, cut between words (its offsets cost more than in proportion)
CHUNK = 1 << 12
#: scores within one block of so many are ranked together
SCORE_BLOCK = 256

_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


@cache
def splitter():
    """The untrained pre-tokenizer: words are what the pattern matches, all else is dropped."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "removed", invert=True)


def words_of(text: str, chunk: int = CHUNK) -> list[tuple[str, tuple[int, int]]]:
    """Words of an ASCII-lowered text with their offsets in it."""
    lowered = text.encode().lower().decode()
    split = splitter().pre_tokenize_str
    if len(lowered) <= chunk:
        return split(lowered)
    out, at = [], 0
    while at < len(lowered):
        cut = _SEPARATOR.search(lowered, min(at + chunk, len(lowered)))
        end = cut.end() if cut else len(lowered)
        out += [(w, (s + at, e + at)) for w, (s, e) in split(lowered[at:end])]
        at = end
    return out


def feature_crcs(words: list[tuple[str, tuple[int, int]]], run: int = RUN) -> list[int]:
    """CRC-32 of every run of 1 to ``run`` consecutive words, joined by one space.

    The words are laid out with one space between them; a run is then the window from the start of
    its first word to the end of its last, an offset pair into these bytes.
    """
    parts = [w.encode() for w, _ in words]
    view, crc = memoryview(b" ".join(parts)), zlib.crc32
    ends = list(accumulate([len(p) + 1 for p in parts]))
    starts = [0, *ends[:-1]]
    return [crc(view[s:e - 1]) for n in range(run) for s, e in zip(starts, ends[n:])]


def feature_table(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, features``: the buckets of a document's features, sorted, as little-endian numbers."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                piece = batch.slice(begin, 200)
                out = []
                for text in piece.column(1):
                    words = words_of(text.as_py() or "")
                    ids = np.array(feature_crcs(words), dtype=np.uint32) % buckets
                    out.append((len(words), len(ids), np.sort(ids).astype(width).tobytes()))
                yield pa.record_batch([piece.column(0), *[pa.array(c) for c in zip(*out)]], schema=schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_features long, features binary")


def histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often each bucket occurs. A task adds up its own counts first."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                counts += np.bincount(np.frombuffer(packed.as_buffer(), dtype=width), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    return features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths of a natural logarithm, add-one smoothed, rounded down.

    Two histograms of ``buckets`` entries come to the driver, however large the tables are.
    """
    counts = []
    for table in (source, target):
        n = np.zeros(buckets)
        for row in table.collect():
            n[row["bucket"]] = row["n"]
        counts.append(n)
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Standard Gumbel noise in thousandths, from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(features: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``: mean gain of the features, and the same with noise."""
    width = "<u2" if len(gains) <= 1 << 16 else "<u4"
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(2).to_pylist()
            weights = [
                int(gains[np.frombuffer(packed.as_buffer(), dtype=width)].sum()) // n if n else 0
                for packed, n in zip(batch.column(3), sizes)
            ]
            scores = [w + gumbel(i, seed) for w, i in zip(weights, ids.to_pylist())]
            yield pa.record_batch([ids, batch.column(1), batch.column(2), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], schema=schema)

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """All rows with ``rank``: place by falling score, then id, of the drawn ones; null for the others.

    A score's first place is the number of higher scores, summed in two levels from counts of equal
    scores; rows of equal score are then ordered among themselves. Noise spreads scores, so such a
    group holds well under a thousandth of all documents, whatever the documents are.
    """
    fit = scored.filter(F.col("n_words") >= least_words)
    counts = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    blocked = counts.withColumn("block", F.floor(F.col("score") / SCORE_BLOCK))
    coarse = blocked.groupBy("block").agg(F.sum("n").alias("n"))
    # a row per SCORE_BLOCK thousandths of the range of scores: some hundreds
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = coarse.select(
        "block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start"),
        F.sum("n").over(Window.partitionBy()).alias("fit"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = blocked.join(starts, "block").select(
        "score", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"),
        F.expr(f"fit * {percent} div 100").alias("quota"),
    )
    equal = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    placed = fit.join(places, "score").withColumn("place", F.col("start") + F.row_number().over(equal))
    drawn = placed.withColumn("rank", F.when(F.col("place") <= F.col("quota"), F.col("place")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with its weight towards the texts of ``target``, its score, and its rank if it is drawn.

    Each text is split once; the sorted buckets of its features are written to the shared folder and
    read for the histogram and again for the scores. Scoring is Gumbel top-k: without replacement, by weight.

    Null and empty texts have no features, weight 0, and are never drawn (``least_words`` of 1 or more).
    Very long texts are split in pieces that end between words. Rows repeated under one id share their
    score and each has a place of its own; ties go to the smaller id, null ids come last and are
    hashed as an empty string. An empty target gives all buckets their smoothed count; no documents, no rows.
    Other columns are ignored.
    """
    features = materialise(feature_table(docs, buckets, id_col, text_col), "features")
    wanted = feature_table(target.select(F.lit(None).cast("long").alias("_id"), F.col(target_col).alias("_text")), buckets, "_id", "_text")
    gains = bucket_gains(histogram(features, buckets), histogram(wanted, buckets), buckets)
    scored = materialise(score_documents(features, gains, seed), "scores")
    return ranked(scored, least_words, percent)
