"""Packing documents into windows of a fixed number of tokens, keeping their order."""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
#: what a cut inside a document costs, in tokens of padding: at a sentence end, and anywhere else
SENTENCE_CUT, HARD_CUT = 24.0, 96.0
#: without a sentence end for this long, a hard cut is offered
STRIDE = 256
#: tokens that are planned at once; the last windows of a plan are planned again with what follows
PLAN = 64 * WINDOW
END_ID = 2
#: entries kept with their ids in a worker; what comes after is computed each time
REMEMBERED = 400_000

#: letters and signs for which Python's case folding and classes agree with the tokenizer's
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž–—‘-”…€]*")
_WORD = re.compile(r"[a-zß-öø-įĲ-ňŊ-ž]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-įĲ-ňŊ-ž]+")


class WordIds(dict):
    """Little-endian ids of what stands between white space, in lower case, computed on first sight.

    The tokenizer never joins over white space and treats each word in between alone, so the ids
    are those of the words in turn, by the tokenizer's own model.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.alone: dict[str, bytes] = {}
        # the 256 printable stand-ins of byte-level models: printable Latin-1 keeps its place
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in kept]
        self.signs = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join([self.alone.get(word) or self._first(word) for word in _WORD.findall(chunk)])
        if len(self) < REMEMBERED:
            self[chunk] = packed
        return packed

    def _first(self, word: str) -> bytes:
        raw = word if word.isascii() else "".join([self.signs[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(raw)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.alone) < REMEMBERED:
            self.alone[word] = packed
        return packed


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    The tokenizer splits a text into words and treats each alone, so ids of words can be
    remembered. Texts outside plain Latin script, or with a special token's name in them,
    go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordIds(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        enders = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            if re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*</w>", piece):
                enders[i] = True
        self.enders = enders

    def encode(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


@cache
def encoder_at(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def padding(length: int, window: int = WINDOW) -> int:
    """Tokens of padding in a sequence; a power of two needs none."""
    return 0 if length & (length - 1) == 0 else window - length


def candidates(ids: np.ndarray, ends: np.ndarray, enders: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end (token offsets, increasing, last = all) and their penalties.

    ``ends``: offsets at which documents end. Document ends are free; a sentence end inside a document
    and, where no other place comes for ``stride`` tokens, a hard cut cost their penalty.
    """
    total = len(ids)
    price = np.full(total + 1, np.inf)
    price[np.flatnonzero(enders[ids]) + 1] = SENTENCE_CUT
    price[ends] = 0.0
    places = np.flatnonzero(price < np.inf)
    begin = np.concatenate([[0], places[:-1]])
    for i in np.flatnonzero(places - begin > stride):
        price[begin[i] + stride:places[i]:stride] = HARD_CUT
    price[0] = np.inf
    places = np.flatnonzero(price < np.inf)
    return places, price[places]


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Window ends among ``places`` with the least padding plus cut penalties.

    ``best[j] = cost[j] + window - places[j] + min(best[i] + places[i])`` over all i < j that are at
    most a window away. The minimum slides along with j, so a queue whose values increase
    holds it at its head: linear time. A shorter window of a power of two needs no padding either
    and is tried where there is such a place, at a small price for one more sequence.
    """
    at = [0, *places.tolist()]
    pen = [0.0, *cost.tolist()]
    index = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(10, window.bit_length()) if 1 << k < window]
    best = [0.0] * len(at)
    back = [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0][1]] > window:
            queue.popleft()
        low, i = queue[0]
        value, source = low + window - here, i
        for power in powers:
            k = index.get(here - power)
            if k is not None and best[k] + window * 0.001 < value:
                value, source = best[k] + window * 0.001, k
        value += pen[j]
        best[j], back[j] = value, source
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = []
    j = len(at) - 1
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def _pieces(plan: list[tuple], cuts: list[int], base: int, first: int) -> list[tuple]:
    """Rows of the windows that end at ``cuts`` (offsets in the plan's tokens); ``base``: where the plan starts."""
    out = []
    d, begin = 0, 0
    for n, cut in enumerate(cuts):
        at = begin
        while at < cut:
            doc_id, ids, skipped, start = plan[d]
            stop = min(cut, start + len(ids))
            if stop <= at:
                d += 1
                continue
            part = ids[at - start:stop - start]
            out.append((doc_id, skipped + at - start, len(part), zlib.crc32(part.tobytes()), skipped + len(ids),
                        (first << 32) + base + n, at - begin))
            at = stop
        begin = cut
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in windows of at most ``window`` tokens, in the order of the input.

    A document is its tokens and the end id. Each input partition is packed on its own, as a
    stream: a plan covers about ``PLAN`` tokens, all its windows but the last few are final, and
    the rest is planned again with what follows; so memory is bounded by a plan and a document,
    no shuffle is needed, and a partition that is computed again gives the same rows. Only
    the last window of a partition is left to padding.

    Null and empty texts are the end id alone. A null id is carried as null. Repeated rows are packed as
    often as they are there. An empty table gives no rows. Other columns are ignored. Very long
    documents fill many windows.

    ``tokenizer_path``: by default the public word-level BPE file, found on each worker by its package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encoder = encoder_at(path)
        context = TaskContext.get()
        first = context.partitionId() if context else 0
        end = np.array([END_ID], dtype="<u4")
        waiting: list[tuple] = []  # (doc_id, ids, tokens of the document before them)
        held, made = 0, 0

        def planned(last: bool) -> list[tuple]:
            nonlocal waiting, held, made
            plan, at = [], 0
            for doc_id, ids, skipped in waiting:
                plan.append((doc_id, ids, skipped, at))
                at += len(ids)
            ids = np.concatenate([w[1] for w in waiting])
            ends = np.cumsum([len(w[1]) for w in waiting])
            cuts = best_cuts(*candidates(ids, ends, encoder.enders), window)
            if not last:
                cuts = cuts[:-4] or cuts[:1]
            rows = _pieces(plan, cuts, made, first)
            made += len(cuts)
            done = cuts[-1]
            waiting = [
                (doc_id, part[max(0, done - start):], skipped + max(0, done - start))
                for doc_id, part, skipped, start in plan if start + len(part) > done
            ]
            held = sum(len(w[1]) for w in waiting)
            return rows

        def arrow(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in zip(*rows)], schema=_ARROW
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encoder.encode(text), end])
                waiting.append((doc_id, ids, 0))
                held += len(ids)
                while held >= PLAN:
                    yield arrow(planned(False))
        if waiting:
            yield arrow(planned(True))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
