"""Removal of long repeated strings by sparse suffix arrays kept in a logarithmic family of levels.

A suffix array of every position would be many times the corpus. Here only anchors have a suffix in the
array: the positions whose 16-byte prefix has the least hash in some window, so that any string of
``LENGTH`` bytes holds an anchor at the same place wherever it stands. A suffix is ordered by the
hash of its prefix and cut after it; what it stands in is compared later, around anchors that more than
one document has. So no pair of occurrences is ever formed: repeated strings are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

LENGTH = 50
PREFIX = 16
#: places in a window of LENGTH bytes where a prefix can begin
PLACES = LENGTH - PREFIX + 1
#: one anchor in so many ends a chunk; equal chunks are settled as a whole
CHUNK = 12
#: bytes of text that a part of the index, a block of documents or a group of contexts stands for
PART_BYTES, BLOCK_BYTES, GROUP_BYTES = 1 << 23, 1 << 23, 1 << 21
#: blocks send a pack to each part and group, so from these numbers on parts and groups first grow to so many times their bytes
MOST_PARTS, PART_GROWTH = 256, 4
MOST_GROUPS, GROUP_GROWTH = 512, 8
#: bytes of text whose messages to blocks are gathered in one task, and are a pack a block from there
DEAL_BYTES = 1 << 25
#: anchors that go to the index at once, and anchors of a group that are looked at together
RUN, TOGETHER = 1 << 20, 1 << 16
#: parts of the index that meet in one task as chunks
CHUNK_PARTS = 8
#: bytes of text of a batch of the index, which grows from this number of batches on; levels of equal size merge
BATCH_BYTES, MOST_BATCHES = 1 << 31, 4
#: documents of one run that hold an anchor; from more, only the first and last go to the index
HELD = 4
#: an anchor that stands in more places than this is hot: its windows meet by their own hash, not by the anchor; grows with the groups
HOT = 1 << 14
#: counters of the first look for hot anchors, and windows of hot anchors that meet in one task
COUNTERS, WINDOWS = 1 << 18, 1 << 20

_POSITION = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Hash of every run of ``length`` along the last axis of bytes, from hashes of powers of two."""
    count = data.shape[-1] - length + 1
    power, level, size = base % (1 << 64), data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if length & size:
            piece = level[..., done:done + count]
            out = piece if out is None else out * np.uint64(power) + piece
            done += size
        if size * 2 > length:
            return _mixed(out)
        level = level[..., :-size] * np.uint64(power) + level[..., size:]
        power, size = power * power % (1 << 64), size * 2


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = least(values[:-size], values[size:]), size * 2
    rest = width - size
    return least(values[:-rest], values[rest:]) if rest else values


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash, in its upper 40 bits, of every run of ``PREFIX`` bytes, read as two words of eight bytes."""
    data = np.ascontiguousarray(data)
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,)).copy()
    out = words[:-8] * np.uint64(_BASES[0])
    out += words[8:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(_BASES[1])
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 40-bit hashes of the anchors of a document (none below LENGTH bytes).

    Of equal hashes in a window the last counts: the position is packed below the hash. Where the packed
    position starts anew (every 16 MB) all positions near are anchors, so that no choice is missed.
    """
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    key = prefix_hashes(data)
    key &= ~_POSITION
    if len(key) <= int(_POSITION):
        low = _sliding(key | np.arange(int(_POSITION), int(_POSITION) - len(key), -1, dtype=np.uint64), PLACES, np.minimum)
        # the place of the least value only moves on, and its value holds the place
        low = low[_changes(low)]
        return (_POSITION - (low & _POSITION)).astype(np.int64), _mixed(low & ~_POSITION) >> np.uint64(24)
    at = np.arange(len(key), dtype=np.uint64)
    low = _sliding(key | (_POSITION - (at & _POSITION)), PLACES, np.minimum)
    # the position of each window's least value: the packed one, in the turn in which the window lies
    inside = (_POSITION - (low & _POSITION)).astype(np.int64)
    start = np.arange(len(low), dtype=np.int64)
    found = start - (start & int(_POSITION)) + inside
    found = np.unique(np.where(found < start, found + int(_POSITION) + 1, found))
    turns = np.arange(int(_POSITION) + 1, len(key), int(_POSITION) + 1)
    if len(turns):
        near = (turns[:, None] + np.arange(-LENGTH, LENGTH)).ravel()
        found = np.unique(np.concatenate([found, near[(near >= 0) & (near < len(key))]]))
    # the least hashes of windows crowd near zero: mixed again they are even, and so are the parts of the index
    return found, _mixed(key[found]) >> np.uint64(24)


def chunk_ends(found: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray:
    """Where chunks end: at anchors chosen by their hash, and at the end of the text."""
    picked = found[(prints % np.uint64(CHUNK)) == 0]
    return np.append(picked[picked > 0], size)


def _array(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.uint8)


_ZSTD = pa.Codec("zstd", compression_level=2)


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _opened(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def _pack(prints: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted run of the index: differences of the hashes, and documents as places in a table."""
    table, place = np.unique(docs, return_inverse=True)
    steps = np.diff(prints, prepend=np.uint64(0)).astype(np.uint64)
    width = np.uint32 if not len(steps) or steps.max() < (1 << 32) else np.uint64
    places = place.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32)
    head = np.array([len(prints), len(table), width().itemsize, places.itemsize], dtype=np.int64)
    return _pressed(head.tobytes() + steps.astype(width).tobytes()), _pressed(table.astype(np.int64).tobytes() + places.tobytes())


def _unpack(first: bytes, second: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, second = _opened(first), _opened(second)
    n, size, step_bytes, place_bytes = np.frombuffer(first[:32], dtype=np.int64)
    prints = np.cumsum(np.frombuffer(first[32:], dtype=np.uint32 if step_bytes == 4 else np.uint64).astype(np.uint64), dtype=np.uint64)
    table = np.frombuffer(second[:8 * size], dtype=np.int64)
    places = np.frombuffer(second[8 * size:], dtype=np.uint16 if place_bytes == 2 else np.uint32)
    return prints, table[places]


_RUN = "kind string, key int, a binary, b binary"


def _runs(frame_rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(frame_rows, columns=["kind", "key", "a", "b"])
    return frame.astype({"kind": object, "key": "int32", "a": object, "b": object})


def _told(prints: np.ndarray, docs: np.ndarray, blocks: int) -> list[tuple]:
    """Rows that tell blocks of documents which anchors others have too: each once, with the number of documents."""
    keys = np.sort(doc_blocks(docs, blocks).astype(np.uint64) << np.uint64(40) | prints)
    begin = np.flatnonzero(_changes(keys)) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(keys)))
    block, prints = (keys[begin] >> np.uint64(40)).astype(np.int64), keys[begin] & np.uint64((1 << 40) - 1)
    return [("told", k, _packed(prints[lo:hi], n[lo:hi]), None) for k, lo, hi in _spans(block)]


def doc_blocks(docs: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each document, by a hash of its id."""
    return (_mixed(docs.astype(np.int64).view(np.uint64) + np.uint64(_BASE)) % np.uint64(blocks)).astype(np.int64)


class SuffixLevels:
    """The logarithmic family: level k holds the suffix arrays of about 2^k batches, or nothing.

    ``add`` makes the suffix array of a new batch and merges it, part by part, with the levels 0, 1, ... that
    are occupied, up to the first free one, where the merged array goes. A batch is thus rewritten
    log2(batches) times. With the last batch all levels meet and are scanned for common anchors, each told
    once. Levels are tables in the shared folder; a part is one range of hashes.
    """

    def __init__(self, parts: int, blocks: int, deals: int = 16):
        """``deals``: tasks of a batch that gather what goes to the blocks without a scan."""
        self.parts, self.blocks, self.deals = parts, blocks, deals
        self.levels: list[DataFrame | None] = []
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """``batch``: ``doc_id``, ``_bytes``. After the ``last`` batch no level is written."""
        parts, blocks = self.parts, self.blocks
        free = next((k for k, level in enumerate(self.levels) if level is None), len(self.levels))

        def run(docs: list[int], prints: list[np.ndarray]) -> pd.DataFrame:
            table, place = np.unique(np.array(docs, dtype=np.int64), return_inverse=True)
            # sorted by anchor and document: 40 bits of the one, the place of the other below
            key = np.sort(np.concatenate(prints) << np.uint64(24) | np.repeat(place.astype(np.uint64), [len(p) for p in prints]))
            begin = np.flatnonzero(_changes(key))  # a document may come twice, and hold an anchor twice
            more = np.diff(np.append(begin, len(key))) - 1
            key = key[begin]
            p, d = key >> np.uint64(24), table[(key & np.uint64((1 << 24) - 1)).astype(np.int64)]
            rows = []
            if more.any():  # places of an anchor beyond one a document, for the count of its places
                rows.append(("often", 0, _packed(p[more > 0], more[more > 0]), None))
            # of an anchor that many documents of this run share, two stand for all
            begin = np.flatnonzero(_changes(p))
            sizes = np.diff(np.append(begin, len(p)))
            many = np.repeat(sizes > HELD, sizes)
            if many.any():
                rows.append(("many", 0, *_pack(p[many], d[many])))
                ends = np.zeros(len(p), dtype=bool)
                ends[begin] = True
                ends[np.append(begin, len(p))[1:] - 1] = True
                p, d = p[~many | ends], d[~many | ends]
            part = (p * np.uint64(parts)) >> np.uint64(40)
            return _runs(rows + [("new", k, *_pack(p[lo:hi], d[lo:hi])) for k, lo, hi in _spans(part)])

        def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            docs, prints, size = [], [], 0
            for frame in _parts(frames):
                for doc, text in zip(frame["doc_id"], frame["_bytes"]):
                    _, p = anchors(_array(text))
                    if len(p):
                        docs.append(doc)
                        prints.append(p)
                        size += len(p)
                if size >= RUN:
                    yield run(docs, prints)
                    docs, prints, size = [], [], 0
            if size:
                yield run(docs, prints)

        rows = batch.mapInPandas(index, _RUN)
        for k, level in enumerate(self.levels):
            if level is not None and (last or k < free):
                rows = rows.unionByName(level)

        def scan(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            if key[1]:  # known to be common already: only to be dealt out; or counts
                many = frame["kind"] == "many"
                runs = [_unpack(a, b) for a, b in zip(frame["a"][many], frame["b"][many])]
                told = _told(*(np.concatenate(x) for x in zip(*runs)), blocks) if runs else []
                return pd.concat([_runs(told), frame.loc[~many, ["kind", "key", "a", "b"]]])
            runs = [_unpack(a, b) for a, b in zip(frame["a"], frame["b"])]
            p, d = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(p, kind="stable")
            p, d = p[order], d[order]
            if not last:
                return _runs([("level", int(key[0]), *_pack(p, d))])
            begin = np.flatnonzero(_changes(p))
            common = np.repeat(np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin), np.diff(np.append(begin, len(p))))
            return _runs(_told(p[common], d[common], blocks))

        pass_ = F.col("kind").isin("many", "often").alias("pass")
        key = F.when(pass_, F.pmod(F.xxhash64("a"), F.lit(self.deals)).cast("int")).otherwise(F.col("key")).alias("key")
        done = materialise(rows.select("kind", key, "a", "b").groupBy("key", pass_).applyInPandas(scan, _RUN), "suffix-level")
        self.found.append(done.filter("kind IN ('told', 'often')").select("kind", "key", "a"))
        self.levels += [None] * (free + 1 - len(self.levels))
        self.levels[:free] = [None] * free
        self.levels[free] = done.filter("kind = 'level'")

    def hot(self, bound: int) -> tuple[np.ndarray, int]:
        """The anchors with more than ``bound`` places, sorted, and how many places they have in all.

        Places are first counted by a part of the hash; only where such a count is above the bound are
        the anchors themselves counted. So what is exchanged does not grow with the number of anchors.
        """
        runs = self.found[0]
        for table in self.found[1:]:
            runs = runs.unionByName(table)
        runs, slices = runs.select("a"), 16

        def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros(COUNTERS, dtype=np.int64)
            for frame in frames:
                p, n = _unpacked(frame["a"].tolist(), 2)
                np.add.at(counts, p % COUNTERS, n)
            if counts.any():
                yield pd.DataFrame([(k, _pressed(x.tobytes())) for k, x in enumerate(np.split(counts, slices))], columns=["slice", "counts"])

        def above(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(_opened(c), dtype=np.int64) for c in frame["counts"])
            return pd.DataFrame({"counter": np.flatnonzero(total > bound) + int(key[0]) * (COUNTERS // slices)}).astype("int64")

        counters = runs.mapInPandas(tally, "slice int, counts binary").groupBy("slice").applyInPandas(above, "counter long").toPandas()["counter"]
        if not len(counters):
            return np.zeros(0, dtype=np.uint64), 0
        busy = np.zeros(COUNTERS, dtype=bool)
        busy[counters.to_numpy(dtype=np.int64)] = True

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                p, n = _unpacked(frame["a"].tolist(), 2)
                here = busy[p % COUNTERS]
                p, at = np.unique(p[here], return_inverse=True)
                yield pd.DataFrame({"print": p, "n": np.bincount(at, weights=n[here], minlength=len(p)).astype(np.int64)})

        found = runs.mapInPandas(count, "print long, n long").groupBy("print").agg(F.sum("n").alias("n")).filter(F.col("n") > bound).toPandas()
        return np.sort(found["print"].to_numpy(dtype=np.int64)).astype(np.uint64), int(found["n"].sum())


def _number(total: int, size: int, most: int = 0, growth: int = 1) -> int:
    """How many of ``size`` bytes ``total`` makes, one at least; beyond ``most`` they first grow to ``growth`` times that size."""
    return max(1, min(-(-total // size), most), -(-total // (size * growth)))


def _spans(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs of equal keys."""
    if not len(keys):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    return [(int(keys[lo]), int(lo), int(hi)) for lo, hi in zip(cuts[:-1], cuts[1:])]


def _parts(frames: Iterator[pd.DataFrame], size: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows, fewer at once."""
    for frame in frames:
        for lo in range(0, len(frame), size):
            yield frame.iloc[lo:lo + size]


_PACK = "kind string, key int, a binary"


def _packs(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "a"]).astype({"kind": object, "key": "int32", "a": object})


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the bytes of one weight together: small numbers take little."""
    return _pressed(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def _unpacked(packs: list[bytes], width: int) -> np.ndarray:
    """The columns of packs, one after the other, as signed numbers."""
    out = [np.zeros((width, 0), dtype=np.int64)]
    for a in packs:
        planes = np.frombuffer(_opened(a), dtype=np.uint8).reshape(width, 8, -1)
        out.append(np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[..., 0])
    return np.concatenate(out, axis=1)


def _dealt(kind: str, keys: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """The rows of columns as one pack a key."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    return [(kind, k, _packed(*(c[lo:hi] for c in columns))) for k, lo, hi in _spans(keys)]


def _chunks(frames: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """Hash and place of every chunk together with the bytes that windows starting in it reach into.

    Copies of a chunk within these rows are settled here; only those of the smallest id ask the others.
    """
    for frame in _parts(frames, 4000):
        prints, rows = [], []
        for doc, text_key, block, text in zip(frame["doc_id"], frame["text_key"], frame["block"], frame["_bytes"]):
            if len(text) < LENGTH:
                continue
            ends = chunk_ends(*anchors(_array(text)), len(text))
            begins = np.concatenate([[0], ends[:-1]])
            held = begins + LENGTH <= len(text)
            begins, ends = begins[held], ends[held]
            prints += [xxhash.xxh3_128_digest(text[lo:hi]) for lo, hi in zip(begins.tolist(), (ends + (LENGTH - 1)).tolist())]
            rows.append((*(np.full(len(ends), x, dtype=np.int64) for x in (doc, text_key, block)), begins, ends))
        if rows:
            h, g = np.frombuffer(b"".join(prints), dtype=np.uint64).reshape(-1, 2).T
            docs, keys, blocks, begins, ends = (np.concatenate(x) for x in zip(*rows))
            later = _later(h, g, docs)
            out = [("found", int(h[0] % np.uint64(parts)), _packed(*(x[later] for x in (blocks, docs, keys, begins, ends))))] if later.any() else []
            part = (h % np.uint64(parts)).astype(np.int64)
            yield _packs(out + _dealt("asked", part[~later], *(x[~later] for x in (h, g, docs, keys, blocks, begins, ends))))


def _settle(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Tells the blocks which of their chunks a smaller id has too."""
    if key[0] == "found":  # settled already: only to be dealt out
        blocks, *columns = _unpacked(frame["a"].tolist(), 5)
        return _packs(_dealt("settled", blocks, *columns))
    h, g, docs, keys, blocks, begins, ends = _unpacked(frame["a"].tolist(), 7)
    later = _later(h, g, docs)
    return _packs(_dealt("settled", blocks[later], *(x[later] for x in (docs, keys, begins, ends))))


def _by_text(packs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The last two of four columns for each pair of values of the first two."""
    docs, which, x, y = _unpacked(packs, 4)
    order = np.lexsort((which, docs))
    docs, which, x, y = docs[order], which[order], x[order], y[order]
    begin = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (which[1:] != which[:-1])])) if len(docs) else order
    ends = np.append(begin, len(docs))[1:]
    return {(d, w): (x[lo:hi], y[lo:hi]) for d, w, lo, hi in zip(docs[begin].tolist(), which[begin].tolist(), begin, ends)}


def _settled(size: int, spans: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Which window starts are known to be repeated, from begins and ends of spans of starts."""
    edge = np.zeros(size + 1, dtype=np.int64)
    if spans is not None:
        np.add.at(edge, np.minimum(spans[0], size), 1)
        np.add.at(edge, np.minimum(spans[1], size), -1)
    known = np.cumsum(edge[:-1]) > 0
    known[max(0, size - LENGTH + 1):] = False
    return known


def _numbered(texts: pd.DataFrame) -> list[tuple[int, int, int, bytes]]:
    """Id, key, number (by key, among the texts of the id) and bytes of each different text of a block.

    A block holds all texts of an id, so the number, mostly 0, can go where the key would cost a hash a row.
    """
    each = texts.drop_duplicates(["doc_id", "text_key"]).sort_values(["doc_id", "text_key"])
    return list(zip(each["doc_id"].tolist(), each["text_key"].tolist(), each.groupby("doc_id").cumcount().tolist(), each["_bytes"]))


#: bytes that windows around an anchor reach before it, and the width of what stands around it
BEFORE = PLACES - 1
AROUND = BEFORE + LENGTH


def _surroundings(text: bytes, at: np.ndarray) -> np.ndarray:
    """A row of ``AROUND`` bytes for each anchor, which begins at ``BEFORE``; zeros where the text is over."""
    padded = np.zeros(len(text) + AROUND, dtype=np.uint8)
    padded[BEFORE:BEFORE + len(text)] = _array(text)
    return padded[at[:, None] + np.arange(AROUND)]


def _row_hashes(around: np.ndarray, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row of bytes and of its extent."""
    words = np.zeros((len(around), -(-AROUND // 8) * 8), dtype=np.uint8)
    words[:, :AROUND] = around
    words = words.view(np.uint64)
    out = []
    for base in _BASES:
        h = _mixed(extent.astype(np.uint64) + np.uint64(base))
        for j in range(words.shape[1]):
            h = (_mixed(h ^ words[:, j])) * np.uint64(base | 1)
        out.append(_mixed(h))
    return out[0], out[1]


def _extent(at: np.ndarray, size: int) -> np.ndarray:
    """First and last column of a row of ``_surroundings`` that lie in the text, in one number."""
    return (BEFORE - np.minimum(at, BEFORE)) * 256 + np.minimum(AROUND, BEFORE + size - at)


def _whole(extent: np.ndarray) -> np.ndarray:
    """As bits, all windows that a row holds: bit o stands for the one that begins o bytes before the anchor."""
    start, end = extent // 256, extent % 256
    lowest = np.maximum(0, AROUND - end)
    return (np.int64(1) << np.maximum(lowest, BEFORE - start + 1)) - (np.int64(1) << lowest)


def _contexts(texts: pd.DataFrame, told: pd.DataFrame, hot: np.ndarray, hot_groups: int, groups: int) -> pd.DataFrame:
    """The surroundings of the anchors of a block's documents that other documents have too, in packs a group.

    Around ``hot`` anchors (sorted) the windows themselves go on, by their hash. What a smaller id of the block
    has is ``decided``.
    """
    heard, settled = told["kind"] == "told", told["kind"] == "settled"
    others = np.sort(_unpacked(told["a"][heard].tolist(), 2)[0].astype(np.uint64))
    spans = _by_text(told["a"][settled].tolist())
    windows, rows, around = [], [], []
    for doc, text_key, nth, text in _numbered(texts):
        found, prints = anchors(_array(text))
        shared = _among(prints, others)
        if not shared.any():
            continue
        known = np.concatenate([[0], np.cumsum(~_settled(len(text), spans.get((doc, text_key))))])
        first = np.maximum(found - (PLACES - 1), 0)
        last = np.minimum(found + 1, max(0, len(text) - LENGTH + 1))
        open_ = shared & (last > first) & (known[np.maximum(last, first)] > known[first])
        dense = open_ & _among(prints, hot)
        if dense.any():
            edge = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(edge, first[dense], 1)
            np.add.at(edge, last[dense], -1)
            # a window known to be repeated has a smaller id that sends it
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (np.diff(known) > 0))
            h, g = (window_hashes(_array(text), LENGTH, base)[at] for base in _BASES)
            windows.append((h, g, *(np.full(len(at), x, dtype=np.int64) for x in (doc, nth)), at))
            open_ &= ~dense
        at = found[open_]
        if len(at):
            rows.append((prints[open_], *(np.full(len(at), x, dtype=np.int64) for x in (doc, nth)), at, _extent(at, len(text))))
            around.append(_surroundings(text, at))
    out = []
    if rows:
        prints, docs, nths, at, extent = (np.concatenate(x) for x in zip(*rows))
        around = np.concatenate(around)
        # a smaller id of this block stands for this one: all its windows here are repeats
        later = _later(*_row_hashes(around, extent), docs)
        if later.any():
            out.append(("decided", int(told["block"].iloc[0]), _packed(docs[later], nths[later], at[later], _whole(extent[later]))))
        part = (_mixed(prints) % np.uint64(groups)).astype(np.int64)
        order = np.flatnonzero(~later)
        order = order[np.argsort(part[order], kind="stable")]
        for k, lo, hi in _spans(part[order]):
            mine = order[lo:hi]
            head = _packed(docs[mine], nths[mine], at[mine], extent[mine])
            out.append(("asked", k, len(head).to_bytes(4, "little") + head + _pressed(around[mine].tobytes())))
    if windows:
        h, g, docs, nths, at = (np.concatenate(x) for x in zip(*windows))
        # as with contexts, only the smallest id of the block asks the others
        later = _later(h, g, docs)
        met = _bits(docs[later], nths[later], at[later])
        if len(met[0]):
            out.append(("decided", int(told["block"].iloc[0]), _packed(*met)))
        out += _dealt("hot", (h[~later] % np.uint64(hot_groups)).astype(np.int64), *(x[~later] for x in (h, g, docs, nths, at)))
    return _packs(out)


def _later(h: np.ndarray, g: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows, by their two hashes, a document with a smaller id has too."""
    out = np.zeros(len(h), dtype=bool)
    # sorted by the upper bits of the hash, with the place below
    bits = np.uint64(max(1, len(h) - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = np.sort(h.astype(np.uint64) & ~low | np.arange(len(h), dtype=np.uint64))
    upper = key >> bits
    again = upper[1:] == upper[:-1]
    if not again.any():
        return out
    many = np.zeros(len(h), dtype=bool)
    many[1:] = again
    many[:-1] |= again
    order, fresh = (key[many] & low).astype(np.int64), _changes(upper[many])
    if (_changes(h[order]) & ~fresh).any():  # equal in those bits only
        order = order[np.argsort(h[order])]
        fresh = _changes(h[order])
    if (_changes(g[order]) & ~fresh).any():  # equal in the first hash only
        order = order[np.lexsort((g[order], h[order]))]
        fresh = _changes(h[order]) | _changes(g[order])
    begin, d = np.flatnonzero(fresh), docs[order]
    out[order] = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(d)))) < d
    return out


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value is not the one before it; the first counts."""
    return np.concatenate([[True], values[1:] != values[:-1]])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bits(docs: np.ndarray, nths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts of windows as columns document, text, place, mask: bit o stands for the window o bytes before."""
    place = at // PLACES * PLACES + PLACES - 1
    order = np.lexsort((at, nths, docs))
    docs, nths, at, place = docs[order], nths[order], at[order], place[order]
    if not len(at):
        return docs, nths, place, at
    begin = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (nths[1:] != nths[:-1]) | (place[1:] != place[:-1])]))
    return docs[begin], nths[begin], place[begin], np.bitwise_or.reduceat(np.int64(1) << (place - at), begin)


def _asked(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents, texts, places and extents, and the bytes around, of packed anchors."""
    size = [int.from_bytes(a[:4], "little") for a in packs]
    head = _unpacked([a[4:4 + n] for a, n in zip(packs, size)], 4)
    around = b"".join(_opened(a[4 + n:]) for a, n in zip(packs, size))
    return head, np.frombuffer(around, dtype=np.uint8).reshape(-1, AROUND)


def _met(docs: np.ndarray, extent: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For rows of bytes around anchors, as bits, the windows that a document with a smaller id has at the same place."""
    later = _later(*_row_hashes(around, extent), docs)
    mask = np.where(later, _whole(extent), 0)
    rest = np.flatnonzero(~later)
    hashes = np.zeros((2, PLACES, len(rest)), dtype=np.uint64)
    for lo in range(0, len(rest), 2048):
        for n, base in enumerate(_BASES):
            hashes[n, :, lo:lo + 2048] = window_hashes(around[rest[lo:lo + 2048]], LENGTH, base).T
    start, end = extent[rest] // 256, extent[rest] % 256
    for back in range(PLACES):
        # the window begins ``back`` bytes before the anchor, that is in this column
        column = BEFORE - back
        row = np.flatnonzero((start <= column) & (column + LENGTH <= end))
        hit = rest[row[_later(hashes[0, column, row], hashes[1, column, row], docs[rest[row]])]]
        mask[hit] |= np.int64(1) << np.int64(back)
    return mask


def _masks(key: tuple, frame: pd.DataFrame, blocks: int) -> pd.DataFrame:
    """For each anchor, as bits, the windows around it that a document with a smaller id has.

    Equal windows hold the anchor at the same place, so one place is looked at after the other; windows meet by
    their hash, and a second hash has to agree as well. Of equal surroundings only the smallest id's are looked at.
    What is decided already passes; windows of hot anchors meet by both hashes.
    """
    packs = frame["a"].tolist()
    if key[0] == "decided":
        return frame.assign(kind="mask")
    if key[0] == "hot":
        h, g, docs, nths, at = _unpacked(packs, 5)
        later = _later(h.view(np.uint64), g.view(np.uint64), docs)
        docs, nths, at, mask = _bits(docs[later], nths[later], at[later])
    else:
        (docs, nths, at, extent), around = _asked(packs)
        mask = np.zeros(len(docs), dtype=np.int64)
        # anchors that are equal, and some others, are looked at together
        prefix = np.ascontiguousarray(around[:, BEFORE:BEFORE + PREFIX]).view(np.uint64)
        some = _mixed(_mixed(prefix[:, 0]) ^ prefix[:, 1]) % np.uint64(-(-len(docs) // TOGETHER))
        order = np.argsort(some, kind="stable")
        for _, lo, hi in _spans(some[order]):
            own = order[lo:hi]
            mask[own] = _met(docs[own], extent[own], around[own])
    hit = mask != 0
    return _packs(_dealt("mask", doc_blocks(docs[hit], blocks), *(x[hit] for x in (docs, nths, at, mask))))


def _cut(key: tuple, texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """What is removed from, and left of, each document of a block."""
    masked = known["kind"] == "mask"
    spans, masks = _by_text(known["a"][~masked].tolist()), _by_text(known["a"][masked].tolist())
    rows = []
    number = {(doc, text_key): nth for doc, text_key, nth, _ in _numbered(texts)}
    back = np.arange(PLACES)
    for doc, text_key, text in texts[["doc_id", "text_key", "_bytes"]].itertuples(index=False):
        starts = _settled(len(text), spans.get((doc, text_key)))
        if (doc, number[doc, text_key]) in masks:
            at, mask = masks[doc, number[doc, text_key]]
            starts[(at[:, None] - back)[(mask[:, None] >> back) & 1 > 0]] = True
        at = np.flatnonzero(starts)
        edge = np.zeros(len(text) + 1, dtype=np.int64)
        edge[at] += 1
        edge[at + LENGTH] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = _array(text)[~gone].tobytes()
        rows.append((doc, len(text), int(gone.sum()), len(runs) // 2, hashlib.sha256(kept).hexdigest(), runs.astype(np.int64).tolist(), kept))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    return out.astype({"doc_id": "int64", "n_bytes": "int64", "n_removed": "int64", "n_spans": "int64", "kept_sha256": object, "spans": object, "kept": object})


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"


def remove_repeats(docs: DataFrame, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``.

    A byte goes if a string of ``LENGTH`` bytes over it also begins in a document with a smaller
    id; strings are judged on the input. ``spans`` lists begin and end of each removed run, ``kept`` is
    what is left. Documents come to the index in ``batches`` (unless given, one for ``BATCH_BYTES``, two at
    least and ``MOST_BATCHES`` at most) by a hash of their id; as the smaller id is looked up at the end, their order
    does not matter.

    1. Chunks cut at content-defined places are hashed, with what windows starting in them reach into:
       a chunk that a smaller id has too is settled, and so are its copies however many.
    2. The suffix levels tell every block of documents which of its anchors several documents have.
    3. For those anchors, where not all is settled, the bytes around them are grouped by anchor, and the
       smallest id found there, first of the whole surroundings, then of each window. Windows of one text
       are only met at their anchors. Around an anchor with more than ``HOT`` places the windows are grouped
       by their own hash instead, each block sending a window once; so no task holds all places of an anchor.

    What is exchanged goes in packs: one compressed row for what a block sends to a part, or a task that has
    gathered for ``DEAL_BYTES`` sends to a block. As their number is a product, parts and groups become larger
    with the corpus, and batches not more than a few.

    Null and empty texts give zero counts and the digest of no bytes; so do null ids (whose texts are kept and
    not compared). Rows under one id, equal or not, are not repeats of each other, and each text
    has its own spans. No rows give no rows. Other columns are ignored. Long texts are whole in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes"))
    known = rows.filter("doc_id IS NOT NULL")
    total = known.agg(F.coalesce(F.sum(F.octet_length("_bytes")), F.lit(0))).first()[0]
    blocks, groups = _number(total, BLOCK_BYTES), _number(total, GROUP_BYTES, MOST_GROUPS, GROUP_GROWTH)
    batches = batches or min(MOST_BATCHES, max(2, _number(total, BATCH_BYTES)))
    levels = SuffixLevels(max(16, _number(total, PART_BYTES, MOST_PARTS, PART_GROWTH)), blocks, max(16, _number(total, DEAL_BYTES * batches)))
    for i in range(batches):
        mine = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(batches)) == i)
        levels.add(mine, last=i == batches - 1)

    def place(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in frames:
            yield pd.Series(doc_blocks(ids.to_numpy(dtype=np.int64), blocks).astype(np.int32))

    blocked = known.withColumn("block", F.pandas_udf(place, "int")("doc_id")).withColumn("text_key", F.xxhash64("_bytes"))
    parts = max(16, _number(total, CHUNK_PARTS * PART_BYTES))
    chunks = blocked.mapInPandas(lambda frames: _chunks(frames, parts), _PACK)
    settled = materialise(chunks.groupBy("kind", "key").applyInPandas(_settle, _PACK), "suffix-settled").withColumnRenamed("key", "block")

    told = levels.found[0]
    for more in levels.found[1:]:
        told = told.unionByName(more)
    told = told.filter("kind = 'told'").withColumnRenamed("key", "block").unionByName(settled)
    texts = blocked.select("block", "doc_id", "text_key", "_bytes").groupBy("block")
    # larger groups hold more places of one anchor
    hot, places = levels.hot(HOT * max(1, total // (groups * GROUP_BYTES)))
    hot_groups = max(1, -(-places * PLACES // WINDOWS))

    def around(key: tuple, block: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        return _contexts(block, heard, hot, hot_groups, groups)

    contexts = texts.cogroup(told.groupBy("block")).applyInPandas(around, _PACK)
    masks = contexts.groupBy("kind", "key").applyInPandas(lambda key, frame: _masks(key, frame, blocks), _PACK)
    everything = masks.withColumnRenamed("key", "block").unionByName(settled)
    result = texts.cogroup(everything.groupBy("block")).applyInPandas(_cut, _RESULT)
    nameless = rows.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length("_bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("_bytes", 256).alias("kept_sha256"),
        F.array().cast("array<bigint>").alias("spans"), F.col("_bytes").alias("kept"),
    )
    return result.unionByName(nameless)
