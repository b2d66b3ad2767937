"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_ids

#: hashed words have this many places; structure statistics follow behind them
PLACES = 1 << 14
#: at most so many labelled rows are fitted on, chosen by a hash of the id
FIT_ROWS = 12_000
THRESHOLD = 0.3

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Buckets(dict):
    """Place of a token; remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        place = zlib.crc32(token.encode("utf-8", "surrogatepass")) % PLACES
        if len(self) < 300_000:
            self[token] = place
        return place


#: cut points of each structure statistic; a statistic is given as the interval it lies in
CUTS: dict[str, tuple[float, ...]] = {
    "log2 of words": (1, 3, 5, 7, 9, 11, 13),
    "letters a word": (2, 3, 4, 5, 6, 8, 12),
    "share of signs among tokens": (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6),
    "share of capitals among letters": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8),
    "share of different words": (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95),
    "share of repeated lines": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "share of digits": (0.01, 0.03, 0.08, 0.2, 0.4),
    "signs a run": (1.01, 1.2, 1.5, 2, 2.5, 3),
    "words a line": (1.5, 3, 6, 12, 25, 50, 100),
    "share of the commonest sign": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
}
_STARTS = np.cumsum([0, *[len(c) + 1 for c in CUTS.values()]])
SIZE = PLACES + int(_STARTS[-1])


def _statistics(text: str, tokens: list[str]) -> list[float]:
    words = [t for t in tokens if t[0].isalpha()]
    signs = [t for t in tokens if not t[0].isalnum()]
    letters = sum(map(len, words))
    lines = text.split("\n")
    n = max(1, len(tokens))
    common = max((text.count(s) for s in "|!%#$&*.,;:-=_~+<>/?"), default=0)
    return [
        np.log2(len(words) + 1.0),
        letters / max(1, len(words)),
        len(signs) / n,
        sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text))) / max(1, letters),
        len(set(words)) / max(1, len(words)),
        1 - len(set(lines)) / len(lines),
        sum(len(t) for t in tokens if t[0].isdigit()) / max(1, len(text)),
        sum(map(len, signs)) / max(1, len(signs)),
        len(words) / len(lines),
        common / max(1, len(text)),
    ]


def features(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-zero features of a whole text; both parts have length 1."""
    text = text or ""
    tokens = _TOKEN.findall(text)
    counts = np.bincount(np.fromiter(map(buckets.__getitem__, map(str.lower, tokens)), dtype=np.int64, count=len(tokens)), minlength=1)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at])
    norm = np.sqrt((value * value).sum())
    value = value / norm if norm else value
    stats = [start + np.searchsorted(cut, v, side="right")
             for start, cut, v in zip(_STARTS, CUTS.values(), _statistics(text, tokens))]
    places = np.concatenate([at, PLACES + np.array(stats)]).astype(np.int32)
    return places, np.concatenate([value, np.full(len(stats), len(stats) ** -0.5)]).astype(np.float32)


@dataclass
class FactorisationMachine:
    """``b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``: linear in the non-zero x."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, places: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of several rows at once; ``rows``: where each row's features start (every row has some)."""
        vx = self.factors[places] * values[:, None]
        sums = np.add.reduceat(vx, rows, axis=0)
        squares = np.add.reduceat(vx * vx, rows, axis=0)
        line = np.add.reduceat(self.linear[places] * values, rows)
        return self.bias + line + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, places: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(places, values, rows), -30, 30)))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 6, steps: int = 600,
        batch: int = 256, rate: float = 0.08, decay: float = 2e-5, seed: int = 5) -> FactorisationMachine:
    """AdaGrad on the logistic loss. Without both labels the model is the smoothed share of label 1."""
    share = (labels.sum() + 1.0) / (len(labels) + 2.0) if len(labels) else 0.5
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank)))
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    order = np.zeros(0, dtype=np.int64)
    for _ in range(steps):
        if len(order) < min(batch, len(samples)):
            order = np.concatenate([order, rng.permutation(len(samples))])
        part, order = order[:batch], order[batch:]
        sizes = np.array([len(samples[i][0]) for i in part])
        places = np.concatenate([samples[i][0] for i in part])
        values = np.concatenate([samples[i][1] for i in part]).astype(float)
        rows = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        error = (model.score(places, values, rows) - labels[part]) / len(part)
        step = np.repeat(error, sizes) * values
        vx = model.factors[places] * values[:, None]
        sums = np.repeat(np.add.reduceat(vx, rows, axis=0), sizes, axis=0)
        slope = step[:, None] * (sums - vx)
        order_p = np.argsort(places, kind="stable")
        used, first = np.unique(places[order_p], return_index=True)
        g_w = np.add.reduceat(step[order_p], first) + decay * model.linear[used]
        g_v = np.add.reduceat(slope[order_p], first, axis=0) + decay * model.factors[used]
        seen_w[used] += g_w * g_w
        seen_v[used] += g_v * g_v
        model.linear[used] -= rate * g_w / np.sqrt(seen_w[used])
        model.factors[used] -= 0.5 * rate * g_v / np.sqrt(seen_v[used])
        g_b = error.sum()
        seen_b += g_b * g_b
        model.bias -= rate * g_b / np.sqrt(seen_b)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, use: Column, label_col: str = "quality", limit: int = FIT_ROWS) -> FactorisationMachine:
    """Fit on at most ``limit`` labelled documents for which ``use`` holds (null labels are left out).

    Their features, not their texts, come to the driver: about 2 kB a document.
    """
    ids = kept_ids(docs.select("doc_id"), labels.select("doc_id", F.col(label_col).alias("_label")), use & F.col("_label").isNotNull(), limit)

    def featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for frame in frames:
            made = [features(t, buckets) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "label": frame["_label"].astype(float),
                "places": [p.tobytes() for p, _ in made], "values": [v.tobytes() for _, v in made],
            })

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``limit`` ids
    rows = chosen.mapInPandas(featurise, "doc_id long, label double, places binary, values binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    samples = [(np.frombuffer(p, dtype=np.int32), np.frombuffer(v, dtype=np.float32)) for p, v in zip(rows["places"], rows["values"])]
    return fit(samples, rows["label"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: FactorisationMachine, out: str = "score", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` and the score (0 to 1) of every row's whole text; null and empty texts have one too.

    A text's features are its words and its form, nothing else of the row. Repeated rows score
    alike. No rows give no rows. The model travels once to each executor; its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, machine = Buckets(), shared.value
        for frame in frames:
            if not len(frame):
                continue
            made = [features(t, buckets) for t in frame["_text"]]
            rows = np.concatenate([[0], np.cumsum([len(p) for p, _ in made])[:-1]])
            score = machine.score(np.concatenate([p for p, _ in made]), np.concatenate([v for _, v in made]), rows)
            yield frame.drop(columns="_text").assign(**{out: score})

    kept = docs.select(*id_cols, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return kept.mapInPandas(run, f"{schema}, {out} double")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns.

    Scored in one pass beside the row: nothing is joined back.
    """
    model = train_quality(docs, labels, bucket_of(F.col("doc_id"), 5) != 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, machine = Buckets(), shared.value
        for texts in frames:
            made = [features(t, buckets) for t in texts]
            if not made:
                yield pd.Series([], dtype=float)
                continue
            rows = np.concatenate([[0], np.cumsum([len(p) for p, _ in made])[:-1]])
            yield pd.Series(machine.score(np.concatenate([p for p, _ in made]), np.concatenate([v for _, v in made]), rows))

    score = F.pandas_udf(run, "double")
    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= threshold)
