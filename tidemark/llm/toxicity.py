"""Toxicity: a weighted finite-state grammar of insult, threat, target, negation and reported speech."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept_ids, materialise

THRESHOLD = 0.3
#: at most so many toxic rows, and four times as many others, are learnt from, chosen by a hash of the id
FIT_ROWS = 4_000
#: at most so many insult stems are kept, the surest first
LEXICON = 4_000
#: stems of fewer documents are not looked at; an insult stem is so many times likelier in toxic ones
SUPPORT, ODDS = 3, 20.0

# Closed word classes of the four languages.
TARGET = "you your yours u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
NEGATION = "not no never neither nor cannot isn aren wasn nicht kein keine nie niemals ne non jamais aucun nunca jamás tampoco ni".split()
REPORTED = "said says say wrote writes quoted quote reported claims claimed called sagte sagt schrieb zitierte meinte dit écrit disait cité dijo dice escribió citó".split()
THREAT = "kill hurt destroy beat punish stab shoot crush töten schlagen vernichten verletzen tuer frapper détruire blesser matar golpear destruir herir".split()

OTHER, INSULT, HARM, TARGETS, NEGATES, REPORTS, BREAK = range(7)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[(state, symbol)] = (next state, output)``; a missing arc copies the symbol and keeps the state."""

    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, alphabet: set) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``: the product of what can be reached from (0, 0)."""
    arcs, todo, seen = {}, [(0, 0)], {(0, 0)}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            a, middle = first.step(state[0], symbol)
            b, out = second.step(state[1], middle)
            arcs[(state, symbol)] = ((a, b), out)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    number = {state: i for i, state in enumerate(sorted(seen, key=repr))}
    zero = number[(0, 0)]
    swap = {zero: 0, 0: zero}
    number = {s: swap.get(i, i) for s, i in number.items()}
    return Transducer({(number[s], x): (number[t], out) for (s, x), (t, out) in arcs.items()})


def _kinds(symbols) -> list:
    """Insults and threats, plain or already marked by an earlier machine."""
    return [s for s in symbols if s in (INSULT, HARM) or isinstance(s, tuple)]


def _marked(symbol, mark: str) -> tuple:
    kind, marks = symbol if isinstance(symbol, tuple) else (symbol, ())
    return (kind, tuple(sorted({*marks, mark})))


def scope(opens: int, mark: str, reach: int | None, symbols: set) -> Transducer:
    """Marks what an opening symbol governs: the next ``reach`` tokens, or (None) the rest of the clause."""
    last = reach or 1
    arcs = {}
    for state in range(last + 1):
        arcs[(state, opens)] = (last, opens)
        arcs[(state, BREAK)] = (0, BREAK)
        if not state:
            continue
        after = state - 1 if reach else state
        for symbol in symbols - {opens, BREAK}:
            arcs[(state, symbol)] = (after, _marked(symbol, mark) if symbol in _kinds(symbols) else symbol)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Negation, reported speech and target, composed into one machine over the word classes."""
    machine, symbols = Transducer(), {OTHER, INSULT, HARM, TARGETS, NEGATES, REPORTS, BREAK}
    inputs = set(symbols)
    for opens, mark, reach in ((NEGATES, "negated", 3), (REPORTS, "reported", None), (TARGETS, "targeted", None)):
        machine = compose(machine, scope(opens, mark, reach, symbols), inputs)
        symbols = symbols | {_marked(s, mark) for s in _kinds(symbols)}
    return machine


@dataclass
class Detector:
    """Word classes, the grammar and its weights."""

    stems: dict[str, float]
    weights: dict[tuple, float]
    nothing: float
    prior: float

    def __post_init__(self):
        self.machine = grammar()
        closed = ((TARGET, TARGETS), (NEGATION, NEGATES), (REPORTED, REPORTS), (THREAT, HARM))
        self.closed = {w: symbol for words, symbol in closed for w in words}
        self.longest = max([0, *map(len, self.stems)])
        self.classes: dict[str, int] = {}

    def strength(self, word: str) -> float:
        """Of the surest stem that the word is or begins with; 0 if there is none."""
        found = [self.stems.get(f"{word}$", 0.0)]
        found += [self.stems.get(word[:n], 0.0) for n in range(3, min(self.longest, len(word)) + 1)]
        return max(found)

    def symbol(self, token: str) -> int:
        known = self.classes.get(token)
        if known is None:
            if not token[0].isalpha():
                known = BREAK
            elif self.strength(token):
                known = INSULT
            else:
                known = self.closed.get(token, OTHER)
            if len(self.classes) < 300_000:
                self.classes[token] = known
        return known

    def matches(self, text: str | None) -> list[tuple[tuple, float]]:
        """(pattern, strength) of every matched clause part of a whole text."""
        tokens = _TOKEN.findall((text or "").lower())
        symbols = list(map(self.symbol, tokens))
        if INSULT not in symbols and HARM not in symbols:
            return []
        found, state = [], 0
        for token, symbol in zip(tokens, symbols):
            state, out = self.machine.step(state, symbol)
            kind, marks = out if isinstance(out, tuple) else (out, ())
            if kind == INSULT:
                found.append(((kind, marks), self.strength(token)))
            elif kind == HARM:
                found.append(((kind, marks), 1.0))
        return found

    def score(self, text: str | None) -> float:
        """The strongest matched pattern decides, further ones add a little; without any, what its absence says."""
        margin = self.prior
        found = [self.weights.get(pattern, 0.0) * strength for pattern, strength in self.matches(text)]
        raising = [w for w in found if w > 0]
        margin += max(raising) + 0.1 * math.log(len(raising)) if raising else self.nothing
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, margin))))


def stems_of(text: str | None) -> set[str]:
    """The words of a text, ended by ``$``, and their beginnings of 4 to 8 letters."""
    words = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if len(w) > 2}
    return {f"{w}$" for w in words} | {w[:n] for w in words for n in range(4, min(8, len(w)) + 1)}


def choose_stems(counts: pd.DataFrame, toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Insult stems and their strength (0 to 1) from ``stem, toxic, clean`` document counts.

    Among ``tried`` stems some lean to the toxic side by chance: the log-likelihood ratio against
    chance has to exceed ``log(tried) + 1``, so that less than one stem is expected to pass wrongly.
    """
    odds = (counts["toxic"] / (toxic + 1)) / ((counts["clean"] + 0.5) / (clean + 1))
    n, base = counts["toxic"] + counts["clean"], toxic / max(1, toxic + clean)
    t, c = counts["toxic"], counts["clean"]
    ratio = t * np.log((t / n).clip(lower=1e-12) / base) + c * np.log((c / n).clip(lower=1e-12) / (1 - base))
    sure = counts[(odds >= ODDS) & (ratio >= math.log(max(1, tried)) + 1)].assign(odds=odds)
    strength = [min(1.0, 0.6 + 0.1 * math.log10(max(1.0, o)) + 0.02 * math.log2(n)) for o, n in zip(sure["odds"], sure["toxic"])]
    return dict(zip(sure["stem"], strength))


def text_sign(text: str | None) -> int:
    """The smallest hash of five words in a row: equal for copies, and mostly for near copies."""
    words = (text or "").split()
    runs = [" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
    return min(zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs)


def independent(found: list[tuple[int, list[str]]], sure: dict[str, float], odds: dict[str, float], least: int) -> dict[str, float]:
    """The sure stems that stand on their own. ``found``: sign and sure stems of each toxic document.

    Stems are tried by their odds, of equal ones the longest first. One is taken if ``least``
    documents of different signs have it that have no stem taken before of which it is a beginning or
    a longer form, and if these alone make it likely enough. So rare words of a document that was copied, and variants of a stem, add nothing.
    """
    holders: dict[str, set[int]] = {}
    for i, (_, stems) in enumerate(found):
        for stem in stems:
            holders.setdefault(stem, set()).add(i)
    chosen: dict[str, float] = {}
    for stem in sorted(holders, key=lambda s: (-odds[s], -len(s), s)):
        kin = [c for c in chosen if c.startswith(stem) or stem.startswith(c)]
        own = holders[stem].difference(*[holders[c] for c in kin])
        likelier = odds[stem] * len(own) / len(holders[stem])
        if likelier >= ODDS and len({found[i][0] for i in own}) >= least and len(chosen) < LEXICON:
            chosen[stem] = sure[stem]
    return chosen


def train_toxicity(docs: DataFrame, labels: DataFrame, use: Column, limit: int = FIT_ROWS) -> Detector:
    """Learn insult stems and pattern weights from at most ``limit`` toxic and ``4 * limit`` other documents where ``use`` holds.

    Document counts of stems are summed inside each batch, then by Spark; only stems that pass
    the support come to the driver. Without both labels the lexicon is empty and every text gets the
    smoothed share of toxic rows.
    """
    known = labels.select("doc_id", F.col("toxic").alias("_label")).filter(use & F.col("_label").isNotNull())
    shares = dict(known.groupBy("_label").count().collect())
    n_toxic, n_clean = shares.get(1, 0), shares.get(0, 0)
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    ids = kept_ids(docs.select("doc_id"), known, F.col("_label") == 1, limit).unionByName(
        kept_ids(docs.select("doc_id"), known, F.col("_label") == 0, 4 * limit)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most five times ``limit`` ids

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())
        for frame in frames:
            for text, label in zip(frame["text"], frame["_label"]):
                by[int(label)].update(stems_of(text))
                by[int(label)][""] += 1
        stems = sorted(set(by[0]) | set(by[1]))
        yield pd.DataFrame({"stem": pd.Series(stems, dtype=object), "toxic": [by[1][s] for s in stems], "clean": [by[0][s] for s in stems]})

    totals = materialise(
        chosen.mapInPandas(count, "stem string, toxic long, clean long").groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") + F.col("clean") >= SUPPORT) | (F.col("stem") == "")),
        "toxic-stems",
    )
    tried = totals.count()
    leaning = totals.filter("toxic >= 3 AND toxic > 3 * clean AND stem <> ''").orderBy(F.desc("toxic"), "stem").limit(20 * LEXICON)
    leaning = leaning.toPandas().sort_values("stem")
    seen = totals.filter("stem = ''").toPandas()
    toxic, clean = (int(seen["toxic"].sum()), int(seen["clean"].sum())) if len(seen) else (0, 0)
    sure = choose_stems(leaning, toxic, clean, tried) if toxic and clean else {}

    odds = {r.stem: (r.toxic / (toxic + 1)) / ((r.clean + 0.5) / (clean + 1)) for r in leaning.itertuples()}

    def sure_stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"sign": [text_sign(t) for t in frame["text"]],
                                "stems": [sorted(stems_of(t) & sure.keys()) for t in frame["text"]]})

    # at most ``limit`` toxic documents
    rows = chosen.filter("_label = 1").mapInPandas(sure_stems, "sign long, stems array<string>").collect()
    share = (toxic + 1) / (toxic + clean + 2)
    least = max(SUPPORT, math.ceil((math.log(max(1, tried)) + 1) / -math.log(share)))
    stems = independent([(r["sign"], r["stems"]) for r in rows], sure, odds, least)
    detector = Detector(stems, {}, 0.0, prior)

    def patterns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, label in zip(frame["text"], frame["_label"]):
                found = {p for p, _ in detector.matches(text)}
                rows += [(int(label), repr(p)) for p in found] or [(int(label), "")]
            yield pd.DataFrame(rows, columns=["label", "pattern"])

    counted = chosen.mapInPandas(patterns, "label int, pattern string").groupBy("label", "pattern").count().collect()
    by = {(r["label"], r["pattern"]): r["count"] for r in counted}

    def weight(pattern: str) -> float:
        return math.log((by.get((1, pattern), 0) + 0.5) / (toxic + 1)) - math.log((by.get((0, pattern), 0) + 0.5) / (clean + 1))

    marks = [(), *{m for (_, s) in detector.machine.arcs.values() if isinstance(s, tuple) for m in [s[1]]}]
    for kind in (INSULT, HARM):
        plain = weight(repr((kind, ())))
        for m in marks:
            seen_often = by.get((1, repr((kind, m))), 0) + by.get((0, repr((kind, m))), 0) >= SUPPORT
            softer = 0.5 * ("negated" in m) + 0.5 * ("reported" in m) - 0.5 * ("targeted" in m)
            detector.weights[(kind, m)] = weight(repr((kind, m))) if seen_often else plain - softer
    detector.nothing = weight("") if toxic and clean else 0.0
    return detector


def score_toxicity(docs: DataFrame, detector: Detector, out: str = "score", id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_cols`` and the score (0 to 1) of every row's whole text, null and empty texts included.

    Only the text is looked at. Repeated rows score alike; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = shared.value
        for frame in frames:
            yield frame.drop(columns="_text").assign(**{out: np.array([judge.score(t) for t in frame["_text"]], dtype=float)})

    kept = docs.select(*id_cols, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")
    return kept.mapInPandas(run, f"{schema}, {out} double")
