"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text accepts every string that occurs in
it. A text is parsed into phrases, each the longest match from where the last one ended;
the language whose automaton needs the fewest phrases wins, counted in bits a symbol
(phrases times the bits that name a place in the language's sample, by symbols).

Texts are seen as lower-case letters with one gap for anything else between them. A text of
any length has one parse: blocks of `BLOCK` symbols are walked in step as one array operation,
each as if a phrase began there; then each block's last phrase is followed into the next blocks up
to where a phrase begins in both parses, from which on they are the same. What a block guessed
before that place doesn't count.

Scale: the automata are built from whole texts of at most `SAMPLE_ROWS` rows a language, drawn
by the hash of doc_id, `SAMPLE_SYMBOLS` in all (documented bounds; what is broadcast is those
texts; rows that don't fit are passed over, unless none does: then the shortest counts). Languages
are counted (a row each) and rows are chosen where they are read; classifying has no shuffle. A
task holds some 20 bytes for each symbol of `AT_ONCE` symbols, or of the longest text.

Defined results: `und` and score 0 for a null text, one without letters, or if nothing
could be learned; score is 1 - best / second best (1 if one language was learned). Rows
whose doc_id is null count as held out. Ties go to the language first by code point. Further
columns of the input are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_of

SAMPLE_ROWS, SAMPLE_SYMBOLS = 60, 40_000
BLOCK, AT_ONCE = 512, 8_000_000
FOLDS = 5
GAP, OTHER = 0, 1


def fold():
    """crc32 of doc_id as text, modulo FOLDS; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def normal(text: str) -> str:
    """Lower-case letters, each run of anything else one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def draw(docs: DataFrame, rows: int = SAMPLE_ROWS, symbols: int = SAMPLE_SYMBOLS) -> dict[str, str]:
    """Sample text by language, from rows outside the held-out fold.

    Rows are chosen by a hash of doc_id at a rate set from each language's count, then
    by that hash's order; only their lengths are looked at until it is clear which are taken.
    """
    draw_ = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    learn = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", text_of().alias("body"), draw_.alias("draw"))
    counts = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    near = [(F.col("lang") == lang) & (F.col("draw") < int(min(1.0, 4.0 * rows / n) * (1 << 30))) for lang, n in sorted(counts.items())]
    if not near:
        return {}
    lettered = learn.where(reduce(or_, near)).where(F.col("body").rlike(r"\p{L}"))
    candidates = lettered.select("lang", "draw", F.length("body").alias("n")).distinct().collect()
    chosen: dict[str, list[int]] = {}
    for lang in sorted({r.lang for r in candidates}):
        own = sorted((r.draw, r.n) for r in candidates if r.lang == lang)
        left = symbols
        for at, n in own:
            if n < left and len(chosen.get(lang, ())) < rows:
                chosen.setdefault(lang, []).append(at)
                left -= n + 1
        chosen.setdefault(lang, [min(own, key=lambda x: (x[1], x[0]))[0]])
    taken = lettered.where(reduce(or_, [(F.col("lang") == lang) & F.col("draw").isin(at) for lang, at in chosen.items()])) if chosen else lettered
    found: dict[str, list[str]] = {}
    for row in taken.distinct().orderBy("lang", "draw", "body").collect():
        found.setdefault(row.lang, []).append(normal(row.body))
    return {lang: " ".join(dict.fromkeys(parts)) for lang, parts in sorted(found.items())}


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Moves of the smallest automaton that accepts every substring of `text`; state 0 is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        now = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return moves


class Parser:
    """All languages' automata in one move table, walked by many texts at a time."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        alphabet = sorted({c for _, text in samples for c in text if c != " "})
        code = {c: k + 2 for k, c in enumerate(alphabet)} | {" ": GAP}
        self.width = len(alphabet) + 2
        tables, ends, offset = [], [], 0
        for _, text in samples:
            moves = suffix_automaton(text)
            table = np.full((len(moves) + 1, self.width), -1, dtype=np.int32)  # the last state has no moves
            for state, out in enumerate(moves):
                for c, to in out.items():
                    table[state, code[c]] = to + offset
            offset += len(moves) + 1
            tables.append(table)
            ends.append(offset - 1)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        # parsing begins, and goes on after a symbol that a language never saw (a phrase of its own), where no move is left
        self.ended = np.array(ends, dtype=np.int32)[:, None]
        self.again = np.stack([t[0] for t in tables]) if tables else np.zeros((0, self.width), np.int32)
        self.again = np.where(self.again < 0, self.ended, self.again).astype(np.int32)
        self.bits = np.array([math.log2(len(text) + 1) for _, text in samples])
        self.symbol = _symbols(tuple(code.items()))

    def _walk(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol each, and where a phrase began with it."""
        to = self.table[state * self.width + symbol]
        began = to < 0
        return np.where(began, self.again[lang, symbol], to), began

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, symbols by text, and whether a text has letters."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.symbol[points]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        keep = np.ones(len(symbols), dtype=bool)
        if len(symbols):
            keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP) | (owner[1:] != owner[:-1])
        symbols, owner = symbols[keep], owner[keep]
        n = np.bincount(owner, minlength=len(texts))
        letters = np.bincount(owner[symbols != GAP], minlength=len(texts)) > 0
        blocks = -(-n // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)  # text of each block
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(n) - n, blocks) + nth * BLOCK
        size = np.minimum(BLOCK, np.repeat(n, blocks) - nth * BLOCK)
        stop = np.repeat(np.cumsum(n), blocks)  # end of the block's text
        began, state = self._blocks(symbols, begin, size)
        total = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        before = np.zeros(len(symbols) + 1, dtype=np.int64)
        met, more = self._followed(state, symbols, began, begin + size, stop)
        for lang in range(len(self.langs)):
            np.cumsum(began[lang], out=before[1:])
            total[lang] = self._counted(of, begin, size, met[lang], more[lang], stop, before, len(texts))
        return total, n, letters

    def _blocks(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin in each language's parse of each block, and the state at the block's end."""
        langs = np.arange(len(self.langs))[:, None]
        began = np.zeros((len(self.langs), len(symbols)), dtype=bool)
        order = np.argsort(-size, kind="stable")
        first, long = begin[order], size[order]
        state = np.broadcast_to(self.ended, (len(self.langs), len(begin))).copy()
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")
        for t, k in enumerate(active):
            place = first[:k] + t
            state[:, :k], began[:, place] = self._walk(state[:, :k], langs, symbols[place])
        out = np.empty_like(state)
        out[:, order] = state
        return began, out

    def _followed(self, state: np.ndarray, symbols: np.ndarray, began: np.ndarray, end: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each block's parses beyond its end: where they meet those of a later block (or the text ends), and phrases begun until then."""
        met = np.tile(end, (len(self.langs), 1))
        more = np.zeros(met.shape, dtype=np.int64)
        lang, block = np.nonzero(met < stop)
        state, place = state[lang, block], met[lang, block]
        while len(block):
            state, mine = self._walk(state, lang, symbols[place])
            same = mine & began[lang, place]
            more[lang, block] += mine & ~same
            place = place + ~same
            met[lang, block] = place
            go = ~same & (place < stop[block])
            lang, block, state, place = lang[go], block[go], state[go], place[go]
        return met, more

    def _counted(self, of, begin, size, met, more, stop, before, texts: int) -> np.ndarray:
        """Phrases by text: of each block that the parse passes, those from where it is met, and those begun beyond it."""
        last = begin + size == stop
        enter, passed = begin.copy(), np.ones(len(of), dtype=bool)
        goes = np.flatnonzero(~last)
        enter[goes + 1] = met[goes]
        far = np.unique(of[goes[met[goes] >= (begin + size)[goes + 1]]])  # texts where a phrase spans a block
        for text in far.tolist():
            own = np.flatnonzero(of == text)
            passed[own] = False
            at, place = own[0], begin[own[0]]
            while True:
                passed[at], enter[at] = True, place
                place = met[at]
                if last[at] or place >= stop[at]:
                    break
                at = own[(place - begin[own[0]]) // BLOCK]
        number = before[begin + size] - before[enter] + more
        return np.bincount(of[passed], number[passed], texts).astype(np.int64)

    def classify(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        parts, begin, held = [], 0, 0
        for k, text in enumerate([*texts, None]):  # so many texts at a time
            if k > begin and (text is None or held + len(text) > AT_ONCE // len(self.langs)):
                parts.append(self.phrases(texts[begin:k]))
                begin, held = k, 0
            held += len(text or "")
        total, n, letters = (np.concatenate(x, axis=-1) for x in zip(*parts))
        cost = total * self.bits[:, None] / np.maximum(n, 1)
        best = np.argmin(cost, axis=0)
        low = np.sort(cost, axis=0)
        score = 1 - low[0] / np.maximum(low[1], 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], [float(s) if ok else 0.0 for s, ok in zip(score, letters)]


@lru_cache(maxsize=4)
def _symbols(code: tuple[tuple[str, int], ...]) -> np.ndarray:
    """Symbol of every code point: its lower-case letter's, OTHER for letters not seen, else GAP."""
    known = dict(code)
    out = np.zeros(0x110000, dtype=np.int16)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            out[point] = known.get(c.lower(), OTHER)
    return out


@lru_cache(maxsize=2)
def parser_of(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    fixed = tuple(samples.items())

    def make():
        parser = parser_of(fixed)

        def work(texts):
            return parser.classify([t.decode() for t in texts])

        return work

    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out"], "lang_pred string, score double", make)
