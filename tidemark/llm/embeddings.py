"""Near duplicates among embeddings: inverted lists, residual product codes, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.components import components, local_roots

#: the index is fitted on at most so many vectors, chosen by a hash of the id; every vector is indexed
FIT_ROWS = 8192
LISTS = 512
PARTS, WORDS = 8, 256
#: how many standard deviations of a random displacement the probes allow for
REACH = 5.0
#: groups of lists, the unit of the shuffle
GROUPS = 8
#: members, or queries, that meet in one task: so many or, of more vectors, one in ``SHARE``, but not more numbers than fit
MEMBERS, SHARE, NUMBERS = 8192, 32, 1 << 21
#: pairs looked at together, and links found that are folded together
PAIRS, LINKS = 1 << 20, 1 << 18


def _means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Plain k-means; an empty cluster keeps its centre."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


@dataclass
class ProductIndex:
    """Coarse centres and, for what is left of a vector after its centre, a code word per part."""

    centres: np.ndarray
    words: list[np.ndarray]
    cuts: np.ndarray
    #: lists that lie together share a group, the unit of the shuffle
    group: np.ndarray
    #: covariance of what is left of a vector after its centre, with trace 1
    spread: np.ndarray | None = None
    #: orthonormal directions, as columns, in which the vectors extend most
    axes: np.ndarray | None = None

    @classmethod
    def fit(cls, rows: np.ndarray, lists: int, seed: int = 11) -> ProductIndex:
        rng = np.random.default_rng(seed)
        centres = _means(rows, lists, 12, rng)
        rest = rows - centres[np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)]
        cuts = np.linspace(0, rows.shape[1], min(PARTS, rows.shape[1]) + 1).astype(int)
        words = [_means(rest[:, a:b], WORDS, 8, rng) for a, b in zip(cuts[:-1], cuts[1:])]
        heart = _means(centres, max(1, min(GROUPS, lists // 16)), 12, rng)
        group = np.argmax(centres @ heart.T - 0.5 * (heart * heart).sum(axis=1), axis=1)
        spread = rest.T @ rest
        axes = np.linalg.eigh(rows.T @ rows)[1][:, ::-1][:, :max(1, rows.shape[1] // 2)]
        return cls(centres, words, cuts, group, spread / max(np.trace(spread), 1e-300), np.ascontiguousarray(axes))

    @cached_property
    def apart(self) -> np.ndarray:
        """For each two lists, one standard deviation of a unit displacement along the line of their centres."""
        out = np.stack([np.linalg.norm(self.centres - c, axis=1) for c in self.centres])
        out /= math.sqrt(max(1, self.centres.shape[1] - 1))
        if self.spread is not None:
            turned = self.centres @ self.spread
            own = np.einsum("ij,ij->i", turned, self.centres)
            along = own[:, None] + own[None] - 2 * turned @ self.centres.T
            out = np.maximum(out, np.sqrt(np.maximum(along, 0.0)))
        return out

    def place(self, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector, and for each list whether it is to be probed.

        A vector at the threshold is ``threshold`` times this one plus a displacement orthogonal to
        it. A list is probed if the displacement may bring the vector closer to its centre than to this
        one's with ``REACH`` standard deviations, along the line of the centres: those of a random
        direction, or of the residuals of the fitting sample if they spread more along that line.
        """
        half = 0.5 * (self.centres * self.centres).sum(axis=1)
        own, probed = np.zeros(len(rows), dtype=np.int64), np.zeros((len(rows), len(half)), dtype=bool)
        every = np.arange(len(half))
        for lo in range(0, len(rows), 1024):
            part = rows[lo:lo + 1024]
            own[lo:lo + 1024] = np.argmax(part @ self.centres.T - half, axis=1)
            probed[lo:lo + 1024] = self.probes(part, own[lo:lo + 1024], every, threshold)
        return own, probed

    def probes(self, rows: np.ndarray, own: np.ndarray, lists: np.ndarray, threshold: float) -> np.ndarray:
        """Which of some lists each vector, whose own list is known, has to probe."""
        off = math.sqrt(max(0.0, 1 - threshold * threshold))
        half = 0.5 * (self.centres * self.centres).sum(axis=1)
        lead = np.einsum("ij,ij->i", rows, self.centres[own])[:, None] - rows @ self.centres[lists].T
        # over all displacements up to the threshold's, the margin is least at one of the two ends
        near = np.minimum(lead, threshold * lead) - (half[own][:, None] - half[lists])
        return near <= REACH * off * self.apart[np.ix_(own, lists)] + 1e-12

    def encode(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each vector is from what its code says."""
        rest = rows - self.centres[own]
        codes = np.zeros((len(rows), len(self.words)), dtype=np.uint8)
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            w = self.words[m]
            codes[:, m] = np.argmax(rest[:, a:b] @ w.T - 0.5 * (w * w).sum(axis=1), axis=1)
            rest[:, a:b] -= w[codes[:, m]]
        return codes, np.linalg.norm(rest, axis=1)

    def sketch(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors along ``axes``, and the length of what is left: products of these are never below the cosine's."""
        if self.axes is None:
            return rows.astype(np.float32)
        inside = rows @ self.axes
        left = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", inside, inside)))
        return np.concatenate([inside, left[:, None]], axis=1).astype(np.float32)

    def similar(self, queries: Side, members: Side, codes: np.ndarray, error: np.ndarray, at: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) positions with cosine at or over the threshold, a chunk of queries at a time.

        Where the sketches leave a cosine possible, it is summed from one table per part of the query (asymmetric distance). As a
        member is at most its code error away from its code, and a sketch never says too little, no similar pair
        fails these tests; what passes is measured exactly.
        """
        chunk = max(1, PAIRS // max(1, len(members.unit)))
        # what single precision may take from a product of unit vectors
        least = threshold - 1e-5 - 1e-7 * members.sketch.shape[1]
        for lo in range(0, len(queries.unit), chunk):
            possible = queries.sketch[lo:lo + chunk] @ members.sketch.T >= least
            rows = np.flatnonzero(possible.any(axis=1))
            if not len(rows):
                continue
            columns = np.flatnonzero(possible[rows].any(axis=0))
            part = queries.unit[lo + rows]
            rough = np.repeat((part @ self.centres[at])[:, None], len(columns), axis=1)
            for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
                table = part[:, a:b] @ self.words[m].T
                rough += table[:, codes[columns, m]]
            maybe = rough >= threshold - error[None, columns] - 1e-9
            r, c = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if not len(r):
                continue
            exact = part[r] @ members.unit[columns[c]].T
            q, m = np.nonzero((exact >= threshold) & maybe[np.ix_(r, c)])
            yield lo + rows[r[q]], columns[c[m]]


@dataclass
class Side:
    """Unit vectors and their sketches."""

    unit: np.ndarray
    sketch: np.ndarray

    def __getitem__(self, which) -> Side:
        return Side(self.unit[which], self.sketch[which])


def asks_for(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Of two lists, or groups, whether the first asks the second; each pair is looked at from one side only."""
    return (a == b) | (((a + b) % 2 == 1) == (a < b))


def _unit(frame: pd.Series) -> np.ndarray:
    rows = np.array(frame.tolist(), dtype=np.float64)
    # the largest component becomes 1 first: squares of tiny or huge ones would leave the range of doubles
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    """Not null or empty, all components there and finite, some of them not zero; of any size."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def link_embeddings(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Equal vectors are one class: only its smallest id is searched, weighted by its copies. Every
    class is indexed and asks the lists that may hold something similar; of two lists one asks the other, and what is
    found counts at both ends. Lists that lie together form a group;
    groups of any size are cut in blocks of members and of queries, each pair of blocks a task; a task returns counts and one link of
    each node to the smallest node it reaches there, never pairs. Components come from these links.

    A vector that is null, empty, zero, or holds null or non-finite components, and one without an
    id, links with nothing and is kept. Vectors of another length than most are compared exactly with
    those of their length. Repeated rows are copies. No rows give no rows. Other columns
    (labels) are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_v"))
    usable = rows.filter(_usable(F.col("_v")) & F.col("vec_id").isNotNull())
    classes = materialise(
        usable.groupBy("_v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes"
    )
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("_v").toPandas()["_v"]
    lengths = sample.map(len)
    dim = int(lengths.mode().iloc[0]) if len(sample) else 1
    fitted = _unit(sample[lengths == dim]) if len(sample) else np.ones((1, 1))
    lists = max(1, min(LISTS, len(fitted), len(fitted) // 16, round(2 * math.sqrt(n))))
    shared = spark.sparkContext.broadcast(ProductIndex.fit(fitted, lists))

    columns = ["rep", "copies", "_v", "list", "own", "asks", "code", "error"]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for frame in frames:
            usual = frame["_v"].map(len) == dim
            out = frame[~usual].copy()
            if len(out):
                out["list"] = [-len(v) for v in out["_v"]]
                out["own"] = out["list"]
                out["asks"], out["code"], out["error"] = pd.Series([[x] for x in out["list"]], out.index), b"", 0.0
                yield out[columns]
            part = frame[usual].copy()
            if len(part):
                unit = _unit(part["_v"])
                own, probed = index.place(unit, threshold)
                codes, error = index.encode(unit, own)
                of_group = index.group[:, None] == np.arange(index.group.max() + 1)
                asked = (probed.astype(np.float32) @ of_group.astype(np.float32) > 0) & asks_for(index.group[own][:, None], np.arange(of_group.shape[1]))
                asks = [np.flatnonzero(g) for g in asked]
                part["list"], part["own"], part["asks"] = own, index.group[own], pd.Series(asks, part.index, dtype=object)
                part["code"], part["error"] = pd.Series([c.tobytes() for c in codes], part.index, dtype=object), error
                yield part[columns]

    kind = dict(classes.dtypes)["_v"]
    indexed = materialise(
        classes.mapInPandas(assign, f"rep long, copies long, _v {kind}, list int, own int, asks array<int>, code binary, error double"),
        "vector-index",
    )
    # blocks of a group of lists, from its size
    sizes = indexed.groupBy(F.col("own").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    asked = indexed.select(F.explode("asks").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("q"))
    width = F.when(F.col("group") < 0, -F.col("group")).otherwise(dim)
    block = F.greatest(F.lit(256.0), F.least(F.lit(NUMBERS) / width, F.lit(float(max(MEMBERS, n // SHARE)))))
    blocks = sizes.join(asked, "group").select(
        "group", F.ceil(F.col("n") / block).cast("int").alias("_mb"), F.ceil(F.col("q") / block).cast("int").alias("_qb")
    )
    salt = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    members = indexed.withColumn("group", F.col("own")).join(blocks, "group").select(
        "group", salt("_mb").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)).alias("qb"),
        F.lit(True).alias("member"), "rep", "copies", "_v", "list", "code", "error",
    )
    queries = indexed.withColumn("group", F.explode("asks")).join(blocks, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("_mb") - 1)).alias("mb"), salt("_qb").alias("qb"),
        F.lit(False).alias("member"), "rep", "copies", "_v", "list", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"),
    )

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        index, group = shared.value, int(key[0])
        inside = frame["member"].to_numpy()
        mine, asks = frame[inside].sort_values(["list", "rep"]), frame[~inside].sort_values("rep")
        nothing = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        if not len(mine) or not len(asks):
            return nothing
        if group < 0:
            width = len(mine["_v"].iloc[0])
            index = ProductIndex(np.zeros((1, width)), [], np.array([0]), np.array([0]))
        m, q = (Side(unit, index.sketch(unit)) for unit in (_unit(mine["_v"]), _unit(asks["_v"])))
        m_id, q_id, m_copies, q_copies = (x.to_numpy() for x in (mine["rep"], asks["rep"], mine["copies"], asks["copies"]))

        def links_found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if group < 0:
                for a, b in index.similar(q, m, np.zeros((len(m_id), 0), np.uint8), np.full(len(m_id), 2.0), 0, threshold):
                    once = q_id[a] < m_id[b]
                    yield a[once], b[once]
                return
            codes = np.frombuffer(b"".join(mine["code"]), dtype=np.uint8).reshape(len(m_id), -1)
            error, lists_of, from_list = mine["error"].to_numpy(), mine["list"].to_numpy(), asks["list"].to_numpy()
            here = np.unique(lists_of)
            probed = index.probes(q.unit, from_list, here, threshold)
            outside = index.group[from_list] != group
            for column, at in enumerate(here.tolist()):
                lo, hi = np.searchsorted(lists_of, [at, at + 1])
                asking = np.flatnonzero(probed[:, column] & (outside | asks_for(from_list, at)))
                for a, b in index.similar(q[asking], m[lo:hi], codes[lo:hi], error[lo:hi], at, threshold):
                    a, b = asking[a], lo + b
                    once = (from_list[a] != at) | (q_id[a] < m_id[b])
                    yield a[once], b[once]

        ids = np.union1d(m_id, q_id)
        m_at, q_at = np.searchsorted(ids, m_id), np.searchsorted(ids, q_id)
        links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            a, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            np.add.at(links, q_at[a], m_copies[b])
            np.add.at(links, m_at[b], q_copies[a])
            moved = np.flatnonzero(root != np.arange(len(ids)))
            root[:] = local_roots(len(ids), np.concatenate([moved, q_at[a]]), np.concatenate([root[moved], m_at[b]]))

        for pair in links_found():
            held.append(pair)
            if sum(len(a) for a, _ in held) >= LINKS:
                fold()
        if held:
            fold()
        told = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pd.DataFrame({"rep": ids[told], "links": links[told], "root": ids[root[told]]})

    found = materialise(
        members.unionByName(queries).groupBy("group", "mb", "qb").applyInPandas(compare, "rep long, links long, root long"),
        "vector-links",
    )
    linked = found.groupBy("rep").agg(F.sum("links").alias("_links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.join(linked, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .filter("copies > 1 OR _links IS NOT NULL")
        .select("_v", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    )
    good = rows.withColumn("_key", F.when(_usable(F.col("_v")) & F.col("vec_id").isNotNull(), F.col("_v")))
    result = good.join(of_class.withColumnRenamed("_v", "_key"), "_key", "left")
    component = F.coalesce("_c", "vec_id")
    return result.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
