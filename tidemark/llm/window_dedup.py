"""Removal of repeated runs of words, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.session import scratch_path

WINDOW = 35
#: bytes of text of a block of documents, bytes of hashes that meet in one task, blocks of one file
BLOCK_BYTES, PART_BYTES, BLOCKS_A_FILE = 1 << 21, 1 << 23, 4
#: files of the blocked table at most
FILES = 20_000
#: perfect difference sets: every difference modulo the period is one of two members
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: text that is hashed at once, and the length from which a word is hashed by itself
SLICE, LONG_WORD = 1 << 22, 256

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype="<u8")
_LOW48 = np.uint64((1 << 48) - 1)


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """``period, positions, anchor``: the cover used for runs of ``window`` words and the words of an anchor.

    Two places have a common shift below the period that puts both on the cover; an anchor that
    starts there still lies inside both runs.
    """
    period = max(p for p in COVERS if p == 1 or 5 * p <= 3 * window)
    return period, COVERS[period], window - period + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of ``values[i] * base**i`` (one more than values) and the inverse powers."""
    n = len(values)
    power, inverse = np.full(n, base, dtype=np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
    power[:1] = inverse[0] = 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * np.cumprod(power), out=sums[1:])
    return sums, np.cumprod(inverse)


def _words_of_slice(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of some bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sums, inverse = _prefix(_LETTERS[data], _BASES[0])
    hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return starts, hashes


class Words:
    """Hashed words of the texts of one block; ``bounds``: where each text's words begin, and their end."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.window, (self.period, cover, self.anchor) = window, cover_for(window)
        hashes, counts, held, size = [], [], [], 0
        for i, text in enumerate([*texts, None]):
            if text is None or size + len(text) > SLICE and held:
                raw = b"\n".join(held)
                begins = np.cumsum([0, *[len(t) + 1 for t in held[:-1]]]) if held else np.zeros(0, dtype=np.int64)
                starts, found = _words_of_slice(raw)
                hashes.append(found)
                counts.append(np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
                held, size = [], 0
            if text is not None:
                held.append(text)
                size += len(text) + 1
        words = np.concatenate(hashes)
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
        n, lengths = len(words), np.diff(self.bounds)
        index = np.arange(n)
        position = index - np.repeat(self.bounds[:-1], lengths)
        left = np.repeat(self.bounds[1:], lengths) - index
        long = np.repeat(lengths >= window, lengths)
        on_cover = np.zeros(self.period, dtype=bool)
        on_cover[list(cover)] = True
        self.anchors = np.flatnonzero(on_cover[position % self.period] & (left >= self.anchor) & long)
        self.starts = np.flatnonzero(left >= window)
        self.size = n
        self._lanes = [_prefix(w, b) for w, b in zip((words, _mixed(words ^ np.uint64(_BASES[1]))), _BASES)]

    def _runs(self, at: np.ndarray, length: int, lane: int) -> np.ndarray:
        sums, inverse = self._lanes[lane]
        return _mixed((sums[at + length] - sums[at]) * inverse[at])

    def anchor_hashes(self) -> np.ndarray:
        """48 bits of each anchor: equal ones may be equal, others differ."""
        return self._runs(self.anchors, self.anchor, 0) & _LOW48

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor which occurs elsewhere; no other window is repeated."""
        marks = np.zeros(self.size + self.period + 1, dtype=np.int64)
        marks[self.anchors[shared] + 1] = 1
        upto = np.cumsum(marks)
        return self.starts[upto[self.starts + self.period] > upto[self.starts]]

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        """96 bits of each window as (64, 32): they decide whether windows are equal."""
        out = np.empty(len(at), dtype=[("a", "<u8"), ("b", "<u4")])
        out["a"], out["b"] = self._runs(at, self.window, 0), self._runs(at, self.window, 1) >> np.uint64(32)
        return out

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which words a repeated window covers."""
        edges = np.zeros(self.size + 1, dtype=np.int64)
        edges[repeated] += 1
        np.subtract.at(edges, repeated + self.window, 1)
        return np.cumsum(edges[:-1]) > 0


class Prints:
    """Hashes of one block, sorted and each once, cut into parts by their value."""

    def __init__(self, hashes: np.ndarray, parts: int):
        if hashes.dtype.names:
            order = np.lexsort((hashes["b"], hashes["a"]))
            lead = hashes["a"] >> np.uint64(32)
        else:
            order = np.argsort(hashes, kind="stable")
            lead = hashes >> np.uint64(16)
        ordered = hashes[order]
        new = np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]
        group = np.cumsum(new) - 1
        self.unique = ordered[new]
        #: place among the distinct ones, for each hash as given
        self.place = np.empty(len(hashes), dtype=np.int64)
        self.place[order] = group
        self.repeated = np.bincount(group, minlength=len(self.unique)) > 1
        part = (lead[order][new] * np.uint64(parts)) >> np.uint64(32)
        self.cuts = np.searchsorted(part, np.arange(parts + 1))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for part in np.flatnonzero(np.diff(self.cuts)):
            yield int(part), _packed(self.unique[self.cuts[part]:self.cuts[part + 1]])

    def shared(self, told: dict[int, bytes]) -> np.ndarray:
        """For each hash as given: does it occur again, in this block or, as the parts tell, in another?"""
        found = self.repeated.copy()
        for part, bits in told.items():
            low, high = self.cuts[part], self.cuts[part + 1]
            found[low:high] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=high - low).astype(bool)
        return found[self.place]


def _packed(hashes: np.ndarray) -> bytes:
    """Twelve bytes a window; six an anchor."""
    if hashes.dtype.names:
        return hashes.tobytes()
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    if kind == "window":
        return np.frombuffer(data, dtype=[("a", "<u8"), ("b", "<u4")])
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


_SENT = "part int, block int, prints binary"
_TOLD = "kind string, part int, block int, bits binary"


def _sent(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("prints", pa.binary())])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 3, schema)], schema=schema)


def _meet(kind: str):
    """Which hashes of a part stand in more than one block; a block has sent each of its hashes once."""
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        arrays = [_unpacked(b, kind) for b in group.column("prints").to_pylist()]
        hashes = np.concatenate(arrays)
        order = np.lexsort((hashes["b"], hashes["a"])) if kind == "window" else np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(hashes), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        cuts = np.cumsum([len(a) for a in arrays])[:-1]
        marks = np.split(again, cuts)
        told = pa.array([i for i, m in enumerate(marks) if m.any()], pa.int64())
        columns = [
            pa.array([kind] * len(told), pa.string()), group.column("part").take(told).combine_chunks(), group.column("block").take(told).combine_chunks(),
            pa.array([np.packbits(marks[i]).tobytes() for i in told.to_pylist()], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _texts(block: pa.Table) -> list[bytes]:
    return [(t or "").encode() for t in block.column("text").to_pylist()]


def _told(table: pa.Table, kind: str) -> dict[int, bytes]:
    return {r["part"]: r["bits"] for r in table.to_pylist() if r["kind"] == kind}


def _windows(words: Words, told: pa.Table, parts: tuple[int, int]) -> tuple[np.ndarray, Prints]:
    """Candidate windows of a block and their hashes; the same whenever it is asked."""
    at = words.candidates(Prints(words.anchor_hashes(), parts[0]).shared(_told(told, "anchor")))
    return at, Prints(words.window_hashes(at), parts[1])


def blocked(docs: DataFrame, size: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, doc_id, text`` as a table bucketed by block, so that no later step moves the texts again."""
    blocks = max(8, -(-size // block_bytes))
    files = min(FILES, max(8, blocks // BLOCKS_A_FILE))
    path = scratch_path(docs.sparkSession, "blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    placed = docs.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    placed.repartition(files, "block").write.bucketBy(files, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name)


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                            block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: every text without the words of repeated windows.

    A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document. It is repeated if the
    same words start anywhere else in the table, in the same document too; all words that a repeated
    window covers go, and the others are joined by one space.

    Texts are dealt into blocks of about ``block_bytes`` and stay there. A block sends the hashes of its
    anchors, each once, to the parts that own them; the parts answer with one bit a hash. Only
    windows around shared anchors are then hashed whole and compared in the same way. An anchor or
    window of any number of places thus counts once a block, and a task holds about ``part_bytes`` of
    hashes. Equal hashes of 96 bits, over 64 bits a word, count as equal windows.

    Null and empty texts have no words. Repeated rows, under one id or several, are repeats of each
    other; ids may be null or repeated and are only carried along. Texts of any length are whole
    documents in their block. An empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # an anchor takes six bytes for some four words, a window twelve; about a third of windows are expected
    parts = tuple(max(32, int(size * share / part_bytes)) for share in (0.25, 0.75))
    table = blocked(plain, size, block_bytes)
    by_block = table.groupBy("block")

    def anchors(key: tuple, block: pa.Table) -> pa.Table:
        prints = Prints(Words(_texts(block), window).anchor_hashes(), parts[0])
        return _sent([(part, key[0].as_py(), data) for part, data in prints.rows()])

    def windows(key: tuple, block: pa.Table, told: pa.Table) -> pa.Table:
        _, prints = _windows(Words(_texts(block), window), told, parts)
        return _sent([(part, key[0].as_py(), data) for part, data in prints.rows()])

    def cut(block: pa.Table, told: pa.Table) -> pa.Table:
        texts = _texts(block)
        words = Words(texts, window)
        at, prints = _windows(words, told, parts)
        keep = ~words.covered(at[prints.shared(_told(told, "window"))])
        kept, removed = [], []
        for text, begin, end in zip(texts, words.bounds[:-1], words.bounds[1:]):
            stays = keep[begin:end]
            gone = int(end - begin - np.count_nonzero(stays))
            kept.append(b" ".join(compress(text.split(), stays.tolist()) if gone else text.split()).decode())
            removed.append(gone)
        return pa.table({
            "doc_id": block.column("doc_id"), "n_words": pa.array(np.diff(words.bounds)),
            "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
        })

    sent = by_block.applyInArrow(anchors, _SENT)
    told = materialise(sent.groupBy("part").applyInArrow(_meet("anchor"), _TOLD), "anchors")
    sent = by_block.cogroup(told.groupBy("block")).applyInArrow(windows, _SENT)
    more = materialise(sent.groupBy("part").applyInArrow(_meet("window"), _TOLD), "windows")
    verdict = told.unionByName(more)
    return by_block.cogroup(verdict.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
