"""Near-duplicate documents: DartMinHash signatures, banded joining, exact weighted Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
#: bands of coordinates; a pair at the threshold shares no band with probability (1 - 0.8^4)^20 < 3e-5
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: darts that a document keeps before the earliest per coordinate is taken
DARTS = COORDINATES * (math.log(COORDINATES) + 4)
#: members of a bucket that meet another such block of it in one task, and rows of buckets that share a task
BLOCK, CELL = 1500, 2000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 400_000:
            self[word] = value
        return value


def shingles(text: str | None, words: WordHash) -> np.ndarray:
    """Sorted hashes of all runs of five lower-case words, repeats included; a shorter text is one run."""
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(w) - SHINGLE + 1)
    total = np.full(n, np.uint64(len(w) if len(w) < SHINGLE else SHINGLE))
    for i in range(min(SHINGLE, len(w))):
        total = _mixed(total * _STEP + w[i:i + n])
    return np.sort(total)


def layers(run: np.ndarray) -> np.ndarray:
    """How many equal elements stand before each one of a sorted array."""
    if len(run) < 2:
        return np.zeros(len(run), dtype=np.uint64)
    new = np.concatenate([[True], run[1:] != run[:-1]])
    if new.all():
        return np.zeros(len(run), dtype=np.uint64)
    at = np.arange(len(run))
    return (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)


def dart_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """DartMinHash of weighted sets, given as sorted arrays with repeats: (sets x coordinates) of uint32.

    An element of weight w owns the region [0, w) x [0, reach) of weight and rank, cut in layers of weight 1.
    In each layer hashed darts fall as a Poisson process of density 1, so the same darts lie in the
    same layer of every set; a set of weight W looks at ranks up to DARTS / W and thus sees about
    DARTS darts, however large it is. A dart belongs to a hashed coordinate, which keeps its earliest.
    Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
    A coordinate without a dart (rare) is 0.
    """
    best = np.full(len(sets) * COORDINATES, np.inf)
    value = np.zeros(len(sets) * COORDINATES, dtype=np.uint32)
    filled = [s for s in sets if len(s)]
    if not filled:
        return value.reshape(len(sets), COORDINATES)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = _mixed(np.concatenate(filled) + np.concatenate([layers(s) for s in filled]) * _M1)
    reach = np.repeat(DARTS / np.maximum(sizes, 1), sizes)
    rank = np.zeros(len(x))
    turn = 0
    kept_at, kept_rank, kept_value = [], [], []
    while len(x):
        turn += 1
        h = _mixed(x + np.uint64(turn * int(_STEP) % (1 << 64)))
        rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        inside = rank <= reach
        x, owner, reach, rank, h = x[inside], owner[inside], reach[inside], rank[inside], h[inside]
        g = _mixed(h ^ _STEP)
        kept_at.append(owner * COORDINATES + ((g >> np.uint64(40)) % np.uint64(COORDINATES)).astype(np.int64))
        kept_rank.append(rank)
        kept_value.append((g & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    at, rank, got = np.concatenate(kept_at), np.concatenate(kept_rank), np.concatenate(kept_value)
    np.minimum.at(best, at, rank)
    first = rank == best[at]
    value[at[first]] = got[first]
    return value.reshape(len(sets), COORDINATES)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted arrays with repeats: shared over all, by multiplicity."""
    if not len(a) or not len(b):
        return 0.0
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = int(np.minimum(na[i], nb[j]).sum())
    return shared / (len(a) + len(b) - shared)


def _sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHash()
    for frame in frames:
        for lo in range(0, len(frame), 500):
            part = frame.iloc[lo:lo + 500]
            sets = [shingles(t, words) for t in part["_text"]]
            sign = dart_signatures(sets)
            yield pd.DataFrame({
                "_id": part["_id"], "_hash": part["_hash"],
                "_key": pd.Series([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], part.index, dtype=object),
                "_words": [len(s) for s in sets],
                "_sign": pd.Series([r.astype(">u4").tobytes() for r in sign], part.index, dtype=object),
            })


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordHash()
    for frame in frames:
        yield pd.DataFrame({
            "doc_id": frame["doc_id"],
            "_set": pd.Series([shingles(t, words).tobytes() for t in frame["_text"]], frame.index, dtype=object),
        })


def _check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        near = [
            weighted_jaccard(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)) >= SIMILAR
            for a, b in zip(frame["_sa"], frame["_sb"])
        ]
        yield frame.loc[near, ["a", "b"]]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar by their whole shingle sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("_set").alias("_sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("_set").alias("_sb"))
    return materialise(pairs.join(left, "a").join(right, "b").mapInPandas(_check, "a long, b long"), "near-links")


def _counted(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    keys, counts = np.unique(run, return_counts=True)
    return keys, counts, len(run)


def _similar(a: tuple, b: tuple) -> bool:
    """Whether two counted sets reach the threshold."""
    if min(a[2], b[2]) < SIMILAR * max(a[2], b[2]):
        return False
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared >= SIMILAR * (a[2] + b[2] - shared)


def _joined(band: int, docs: np.ndarray, label: np.ndarray, sign: np.ndarray, sets: list, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Links that join the classes of a bucket's members, between its blocks ``left`` and ``right`` (positions).

    Of a pair that shares several bands only the first bucket decides. A member is held against others of
    other classes, the likeliest first, exactly, until it is in their class or they are used up; so members of
    a class cost few comparisons, and no link that would join two classes is left out.
    """
    counted: dict[int, tuple] = {}

    def of(i: int) -> tuple:
        if i not in counted:
            counted[i] = _counted(np.frombuffer(sets[i], dtype=np.uint64))
        return counted[i]

    found = []
    diagonal = len(left) == len(right) and bool((left == right).all())
    for n, x in enumerate(left.tolist()):
        others = right[n + 1:] if diagonal else right
        others = others[label[others] != label[x]]
        equal = sign[others] == sign[x]
        share = equal.mean(axis=1)
        earlier = equal[:, :band * ROWS].reshape(len(others), band, ROWS).all(axis=2).any(axis=1)
        fresh = np.flatnonzero(~earlier)
        for y in others[fresh[np.argsort(-share[fresh], kind="stable")]].tolist():
            if label[x] != label[y] and _similar(of(x), of(y)):
                found.append((docs[x], docs[y]))
                label[label == label[y]] = label[x]
    return found


def _across(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The links of all buckets (or pairs of their blocks) of a cell."""
    frame = frame.sort_values(["bucket", "i", "j", "doc_id"], kind="stable")
    unit = frame[["bucket", "i", "j"]].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1, [len(unit)]])
    docs, blocks, bands = frame["doc_id"].to_numpy(), frame["block"].to_numpy(), frame["band"].to_numpy()
    _, label = np.unique(frame["class"].to_numpy(), return_inverse=True)
    sign = np.frombuffer(b"".join(frame["_sign"]), dtype=">u4").astype(np.uint32).reshape(len(frame), -1)
    sets = frame["_set"].tolist()
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = np.arange(lo, hi)
        left, right = at[blocks[at] == unit[lo, 1]], at[blocks[at] == unit[lo, 2]]
        if len(left) and len(right):
            # classes joined in one bucket are known in the next ones of the cell as well
            out += _joined(int(bands[lo]), docs, label, sign, sets, left, right)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (the smallest id of its class) and ``kept``.

    A document is an id with its text: different texts under one id are told apart and have fates of their own.

    Documents whose shingles are equal are one class from the start; only its smallest id goes on.
    Buckets are bands of the signature. First every member of a bucket is held against the bucket's
    smallest id: a large group of near copies is joined by as many pairs as it has members. Buckets in
    which classes are left apart then go, block against block, to tasks that hold members of different
    classes against each other and return the links that join classes, fewer than members; pairs of a bucket are
    never emitted. Every link is decided by the exact weighted Jaccard similarity of the whole
    texts' shingles.

    Null and empty texts have no shingles and each is its own class; so is a row without an id
    (``class_id`` null). Texts of fewer than five words are one shingle. Rows repeated under one id with
    the same text share their fate. No rows give no rows. Other columns are ignored.
    """
    none = docs.filter(F.col(id_col).isNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")
    )
    return _classes(docs, id_col, text_col).select(F.col("_id").alias("doc_id"), "class_id", "kept").unionByName(none)


def _text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _hash, class_id, kept`` of every row with an id. ``doc_id`` is the row's number from here on."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), _text_hash(F.col(text_col)).alias("_hash")
    )
    numbered = rows.mapInPandas(_sign, "_id long, _hash binary, _key binary, _words long, _sign binary")
    signed = materialise(numbered.withColumn("doc_id", F.monotonically_increasing_id()), "near-signatures")
    compared = signed.filter("_words > 0")
    copies = materialise(
        compared.groupBy("_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "near-copies"
    )
    same = compared.select("doc_id", "_key").join(copies, "_key").select("doc_id", "rep").filter("doc_id <> rep").distinct()
    same = materialise(same, "near-same")
    single = compared.join(same, "doc_id", "left_anti")

    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("_sign", i * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )
    bands = single.select("doc_id", F.posexplode(keys).alias("band", "bucket"))
    firsts = bands.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialise(bands.join(firsts, "bucket"), "near-buckets")
    involved = single.select("doc_id", "_id", "_hash").join(shared.select("doc_id").distinct(), "doc_id", "left_semi")
    held = rows.join(involved, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    sets = materialise(held.select("doc_id", "_text").mapInPandas(_runs, "doc_id long, _set binary"), "near-sets")

    signs = single.select("doc_id", "_sign")
    stars = shared.filter("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    # sets whose sizes differ too much cannot be similar; all others are compared
    words = single.select("doc_id", "_words")
    near = (
        stars.join(words.select(F.col("doc_id").alias("a"), F.col("_words").alias("_na")), "a")
        .join(words.select(F.col("doc_id").alias("b"), F.col("_words").alias("_nb")), "b")
        .filter(5 * F.least("_na", "_nb") >= 4 * F.greatest("_na", "_nb")).select("a", "b")
    )
    links = _verified(near, sets)
    classes = materialise(components(links), "near-class")
    own = shared.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("component", "doc_id"))
    apart = own.groupBy("bucket").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi")).filter("_lo <> _hi").select("bucket")
    # the bucket's first member has been held against all others
    rest = own.join(apart, "bucket", "left_semi").filter("first <> doc_id")
    count = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = rest.withColumn("_blocks", count).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    met = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "bucket", "band", F.least("block", "_k").alias("i"), F.greatest("block", "_k").alias("j"), "block", "doc_id", "class"
    )
    met = materialise(met, "near-met")
    cells = max(1, -(-met.count() // CELL))
    cell = F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(cells)).alias("cell")
    found = met.join(signs, "doc_id").join(sets, "doc_id").groupBy(cell).applyInPandas(_across, "a long, b long")
    links = links.unionByName(materialise(found, "near-rest"))
    classes = components(links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    placed = signed.select("doc_id", "_id", "_hash").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("_id").alias("_least"))
    out = placed.join(least, "component", "left")
    class_id = F.coalesce("_least", "_id")
    return out.select("_id", "_hash", class_id.alias("class_id"), (class_id == F.col("_id")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their class, with all their columns.

    The verdict travels by id and hash of the text; rows without an id stay.
    """
    lost = _classes(docs, id_col, text_col).filter("NOT kept").select(F.col("_id").alias("_lost"), F.col("_hash").alias("_lost_hash")).distinct()
    return docs.join(lost, (docs[id_col] == lost["_lost"]) & (_text_hash(docs[text_col]) == lost["_lost_hash"]), "left_anti")
