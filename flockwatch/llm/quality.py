"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers look at a text's words, lines and marks and vote good (+), bad (-) or nothing
(0), or cannot look at so short a text (.). Expectation-maximisation over the votes of all documents estimates each labeller's
accuracy and the share of good documents, without any label. As labellers look for different junk, bad
documents are a mixture of kinds, one begun from each labeller; a kind has its own chance of
each vote of each labeller, and all numbers are what the votes say (one count is added to each).
The posteriors that follow train a linear scorer on hashed character-class sequences and bucketed
statistics, which decides: documents that score under `THRESHOLD` go.

Scale: votes are a string of nine signs, so all documents reduce to at most 4^9 counted
patterns, combined before the shuffle; EM runs on those on the driver. The scorer is fitted
on the `SAMPLE` different texts of least hash (a documented bound), however often each occurs.
Scoring has no shuffle; the model is `BINS` numbers.

Defined results: a null or empty text has no votes and scores the prior of EM (it stays if
most documents do); without documents the prior is one half. A task holds a text whole, and its words. Further columns pass through; the query
takes columns named like its results only if they are not asked to be kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_of

BINS = 2048
SAMPLE = 4000
THRESHOLD = 0.5
LABELLERS = ("marks", "capitals", "shouts", "variety", "cells", "function_words", "punctuation", "lines", "runs")

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = [w.encode() for w in (
    "the of and to in is that it was for on are as with at be by this from or "
    "le la les de des et en un une est que qui dans pour pas sur au du par "
    "der die das und ist von zu den mit nicht ein eine auf für im dem sich "
    "el los las y se del una por con para no lo su es al como").split()]  # fmt: skip
FUNCTION_WORDS += [w.decode().capitalize().encode() for w in FUNCTION_WORDS]

_upper = bytes(range(65, 91))
_lower = bytes(range(97, 123))
_marked = re.compile(rb"[*#$%&@^~=_+<>\\]{2,}(?=\s|\Z)")
#: Character classes: letters by case, digits, space, line end, and some marks of their own.
_classes = bytearray(16 for _ in range(256))
for _k, _set in enumerate((b" \t", b"\n\r", _lower + bytes(range(128, 256)), _upper, b"0123456789", b".", b",", b"!", b"?", b"|", b"*#", b"$%&", b"-", b"'\"", b":;", b"/\\")):
    for _b in _set:
        _classes[_b] = _k
_classes = bytes(_classes)


def statistics(raw: bytes) -> list[float]:
    """Words; then shares: marked words, capitals, shouts, commonest word, cells, function words, sentence marks, repeated lines, words that repeat the one before."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * 10
    counts = Counter(words)
    upper = len(raw) - len(raw.translate(None, _upper))
    lower = len(raw) - len(raw.translate(None, _lower))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(n),
        len(_marked.findall(raw)) / n,
        upper / max(1, upper + lower),
        raw.count(b"!!") / n,
        max(counts.values()) / n,
        counts[b"|"] / n,
        sum(counts[w] for w in FUNCTION_WORDS) / n,
        (raw.count(b". ") + raw.count(b", ") + raw.count(b".\n") + raw.endswith(b".")) / n,
        1 - len(set(lines)) / len(lines) if len(lines) > 2 else -1.0,
        sum(map(eq, words, words[1:])) / n,
    ]


def votes(s: list[float]) -> list[int | None]:
    """One vote a labeller: most look for one kind of junk, two for ordinary prose; None where there is too little text."""
    n, marks, capitals, shouts, commonest, cells, function, stops, lines, runs = s
    if not n:
        return [None] * len(LABELLERS)
    if n < 20:
        return [-(marks >= 0.2), None, -(shouts >= 0.2), None, -(cells >= 0.2), None, None, None, None]
    return [
        -(marks >= 0.2),
        -(capitals >= 0.5),
        -(shouts >= 0.2),
        -(commonest >= 0.3),
        -(cells >= 0.2),
        1 if function >= 0.08 else -(function <= 0.01),
        1 if 0.03 <= stops <= 0.5 else -(stops <= 0.01),
        -(lines >= 0.5) if lines >= 0 else None,
        -(runs >= 0.2),
    ]


def pattern(v: list[int | None]) -> str:
    return "".join("." if x is None else "-0+"[x + 1] for x in v)


@dataclass
class WeakModel:
    """Shares of good documents and of each kind of bad ones, and for each of these the chance of each vote (bad, none, good) of each labeller."""

    share: np.ndarray  # kind, good being the first
    chance: np.ndarray  # kind, labeller, vote

    @classmethod
    def fit(cls, counted: dict[str, int], rounds: int = 300, added: float = 1.0) -> "WeakModel":
        """EM over counted vote patterns, begun from which labellers find junk."""
        k = len(LABELLERS)
        if not sum(counted.values()):
            return cls(np.array([0.5, *[0.5 / k] * k]), np.full((k + 1, k, 3), 1 / 3))
        keys = sorted(counted)
        n = np.array([counted[key] for key in keys], dtype=float)
        said = np.stack([_votes_of(key) for key in keys])
        junk = said[:, :, 0]
        found = junk.sum(1, keepdims=True)
        of = np.concatenate([np.where(found > 0, 0.1, 0.9), np.where(found > 0, 0.9 * junk / np.maximum(found, 1), 0.1 / k)], 1)
        for _ in range(rounds):
            weight = n[:, None] * of
            share = weight.sum(0) + added
            chance = np.einsum("ic,ijv->cjv", weight, said) + added
            model = cls(share / share.sum(), chance / chance.sum(2, keepdims=True))
            new = model.kinds(said)
            if np.abs(new - of).max() < 1e-9:
                break
            of = new
        return model

    @property
    def prior(self) -> float:
        return float(self.share[0])

    def kinds(self, said: np.ndarray) -> np.ndarray:
        """Chance of each kind given votes (a row each); a labeller that couldn't look counts for nothing."""
        log = np.log(self.share) + np.einsum("ijv,cjv->ic", said, np.log(self.chance))
        likely = np.exp(log - log.max(1, keepdims=True))
        return likely / likely.sum(1, keepdims=True)

    def posterior(self, key: str) -> float:
        """Chance that a document with these votes is good."""
        return float(self.kinds(_votes_of(key)[None])[0, 0])

    def accuracies(self) -> dict[str, float]:
        """Chance that a labeller's vote is right, where it votes."""
        by = self.share[:, None, None] * self.chance
        right = by[1:, :, 0].sum(0) + by[0, :, 2]
        return dict(zip(LABELLERS, (right / (by[:, :, 0] + by[:, :, 2]).sum(0)).tolist()))


def _votes_of(key: str) -> np.ndarray:
    """labeller, vote: 1 for what was voted."""
    return np.array([[c == x for x in "-0+"] for c in key], dtype=float)


def hashed(raw: bytes, s: list[float]) -> np.ndarray:
    """Features of a text: hashed sequences of four character classes, and bucketed statistics; length one."""
    c = np.frombuffer(raw.translate(_classes), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(BINS, dtype=np.float64)
    half = BINS // 2
    if len(c) >= 4:
        code = ((c[:-3] * 17 + c[1:-2]) * 17 + c[2:-1]) * 17 + c[3:]
        out[:half] = np.bincount((code * np.uint32(2654435761)) >> np.uint32(22), minlength=half)
        np.log1p(out, out)
        out /= max(1e-9, np.sqrt((out * out).sum()))
    for k, value in enumerate(s[1:]):
        out[half + ((k * 64 + int(min(20, max(-1, value * 20)) + 1)) * 40503) % half] += 1.0
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps; the last weight is the offset."""
    w = v = np.zeros(x.shape[1] + 1)
    step = 4.0 / (1.0 + float(np.einsum("ij,ij->i", x, x).mean()))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1].astype(x.dtype) + v[-1], -30, 30)))
        error = ((p - y) / len(y)).astype(x.dtype)
        new = v - step * (np.append(error @ x, error.sum()) + ridge * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class QualityModel:
    weak: WeakModel
    weights: np.ndarray

    def score(self, raw: bytes, s: list[float]) -> float:
        if not s[0]:
            return self.weak.prior
        return float(1 / (1 + np.exp(-np.clip(hashed(raw, s) @ self.weights[:-1] + self.weights[-1], -30, 30))))


def train(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Votes of all documents for EM, and a bounded sample for the scorer."""

    def make():
        return lambda texts: [[pattern(votes(statistics(t))) for t in texts]]

    counted = {r.votes: r.n for r in map_texts(docs.select("text"), [], "votes string", make).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    weak = WeakModel.fit(counted)
    texts = docs.select(text_of().alias("text"), F.xxhash64(text_of(), F.lit("quality")).alias("draw"))
    last = texts.select("draw").distinct().orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    some = texts.where(F.col("draw") <= F.lit(last)).select("text").distinct()

    def vectors():
        def work(texts):
            found = [(pattern(votes(s)), hashed(t, s).astype("<f4").tobytes()) for t in texts for s in [statistics(t)]]
            return [[f[0] for f in found], [f[1] for f in found]]

        return work

    rows = map_texts(some, [], "votes string, vector binary", vectors).collect()
    rows = sorted(((r.votes, bytes(r.vector)) for r in rows))
    if not rows:
        return QualityModel(weak, np.zeros(BINS + 1))
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype="<f4").reshape(len(rows), BINS)
    return QualityModel(weak, fit_scorer(x, np.array([weak.posterior(r[0]) for r in rows])))


def score(docs: DataFrame, model: QualityModel, keep: list[str], prefix: str = "") -> DataFrame:
    """`keep` and quality, weak_label, votes, kept (names with `prefix`)."""
    posterior: dict[str, float] = {}

    def make():
        def work(texts):
            rows = []
            for raw in texts:
                s = statistics(raw)
                key = pattern(votes(s))
                if key not in posterior:
                    posterior[key] = model.weak.posterior(key)
                q = model.score(raw, s)
                rows.append((q, posterior[key], key, q >= THRESHOLD))
            return list(zip(*rows))

        return work

    fields = ", ".join(f"`{prefix}{f}` {t}" for f, t in (("quality", "double"), ("weak_label", "double"), ("votes", "string"), ("kept", "boolean")))
    return map_texts(docs, keep, fields, make)
