"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines over the tropical semiring (weights add along a path, the least path counts, and
infinity is no path) are composed with each input:

- the normaliser, compiled from the model's rules: a space becomes the word mark, one mark
  is put in front, and where the model says so outer spaces go and runs of them shrink;
- the pieces: a trie that reads characters and emits a piece at the piece's weight;
- byte fallback: a character that is no piece is read whole and emitted as its bytes;
- for models that merge by rank, an acceptor over neighbouring pieces: (a, b) weighs nothing
  where merging the characters of a and b by rank gives back a and b, and infinity else. A
  sequence of pieces is what merging the whole text gives exactly if it weighs less than that.

A piece weighs the negative of its score in a unigram model (a fallback character ten more
than the dearest piece), and one in a model that merges by rank. Least weights are relaxed
over states (position, last piece) from left to right; the path back from the cheapest final
state is the encoding.

No piece holds a mark after another character, nor any two characters that stand side by side
in no piece, so every path passes through the places between them. Texts are cut there, and
the different stretches of a batch are composed once each, all in step: arcs by one walk of
the trie from every place, then one relaxation for each distance from a stretch's start. With
an acceptor only one last piece is left at any place, as the prefix up to there is merged in
one way; stretches with rare characters, or where that should ever fail, are relaxed one by
one over all states. Pieces are gathered by array operations; decoding is a gather of the
bytes that each piece stands for.

Scale: no shuffle; texts are encoded where they are read, about `AT_ONCE` bytes at a time.
The model (half a MB, of fixed size) travels with the function. Defined results: a null or
empty text has no pieces and round-trips; a text that holds the word mark itself does not
round-trip; bytes that are no UTF-8 count as U+FFFD. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, utf8

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, RANKED = 1, 2
#: Pairs of pieces whose weight a process remembers, bytes of text that are encoded together, and characters of a stretch composed in step.
KEEP_PAIRS, AT_ONCE, IN_STEP = 2_000_000, 1 << 20, 100
#: Code points below this, and the mark, have a column in the trie's table.
DENSE = 0x100
#: What a fallback character weighs beyond the dearest piece of a unigram model: a fixed value of the format.
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message."""
    i, end = 0, len(raw)

    def varint(i):
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    while i < end:
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        else:
            size, i = (8, i) if wire == 1 else (4, i) if wire == 5 else varint(i)
            value, i = raw[i : i + size], i + size
        yield tag >> 3, value


def read_model(raw: bytes) -> tuple[list[tuple[str, float, int]], dict]:
    """(text, score, kind) of each piece, and the model's kind and what its normaliser does."""
    pieces, spec = [], {"kind": UNIGRAM, "name": "", "rules": b"", "prefix": True, "trim": True, "fallback": False}
    for number, value in _fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            own = dict(_fields(value))
            spec |= {"kind": own.get(3, UNIGRAM), "fallback": bool(own.get(35, 0))}
        elif number == 3:
            own = dict(_fields(value))
            spec |= {"name": own.get(1, b"").decode(), "rules": own.get(2, b""), "prefix": bool(own.get(3, 1)), "trim": bool(own.get(4, 1))}
    return pieces, spec


class Normaliser:
    """The rewriting machine of weight 0, compiled to moves on bytes: all but spaces emit themselves."""

    def __init__(self, prefix: bool, trim: bool):
        self.prefix, self.trim, self.mark = prefix, trim, MARK.encode()

    def __call__(self, raw: bytes) -> bytes:
        if self.trim:
            raw = self.trimmed(raw)
        return self.mark * (self.prefix and bool(raw)) + raw.replace(b" ", self.mark)

    @staticmethod
    def trimmed(raw: bytes) -> bytes:
        return b" ".join(x for x in raw.split(b" ") if x)


class Codec:
    """The composed machines of one model."""

    def __init__(self, raw: bytes):
        import pyarrow as pa

        pieces, spec = read_model(raw)
        if spec["rules"] or spec["kind"] not in (UNIGRAM, RANKED) or not spec["fallback"]:
            raise ValueError("only unigram and merging models with byte fallback and without character rules are compiled")
        self.normal = Normaliser(spec["prefix"], spec["trim"])
        self.ranked = spec["kind"] == RANKED
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.rank = {text: -score for text, score, kind in pieces if kind in (NORMAL, USER)}
        self.text = [text for text, _, _ in pieces]
        self.weight = [1.0 if self.ranked else -score for _, score, _ in pieces]
        self.bytes = [0] * 256
        self.emit = []
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
                self.emit.append(bytes([int(text[3:5], 16)]))
            else:
                self.emit.append(text.encode() if kind in (NORMAL, USER) else b"")
        self.emitted = pa.array(self.emit, type=pa.large_binary())
        self.fallback = np.zeros(len(pieces), dtype=bool)
        self.fallback[self.bytes] = True
        dearest = max((self.weight[i] for i in self.ids.values()), default=0.0)
        self.unknown = lambda out: float(len(out)) if self.ranked else dearest + UNKNOWN_PENALTY
        if any(re.search(f"[^{MARK}]{MARK}", text) for text in self.ids):
            raise ValueError("a piece holds a mark after another character")
        # no path crosses a place between two characters that no piece holds side by side
        self.inside = {text[k - 1 : k + 1] for text in self.ids for k in range(1, len(text))}
        self.apart = np.zeros((256, 256), dtype=bool)
        self.apart[:128, :128] = True
        for a, b in self.inside:
            if ord(a) < 128 and ord(b) < 128:
                self.apart[ord(a), ord(b)] = False
        # the trie: every prefix of a piece is a state, a piece's state emits it
        self.states = {text[:k]: -1 for text in self.ids for k in range(1, len(text))} | self.ids
        self._dense()
        self.weights = np.array(self.weight)
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.new_pairs: dict[int, bool] = {}

    def _dense(self) -> None:
        """The trie as a table, for pieces of characters that have a column; state 0 is none, 1 the start, and states with moves come first."""
        columns = {c: k for k, c in enumerate(sorted({c for text in self.ids for c in text if ord(c) < DENSE or c == MARK}))}
        self.symbol = np.full(0x110000, len(columns), dtype=np.int16)
        for c, k in columns.items():
            self.symbol[ord(c)] = k
        own = [x for x in self.states if all(c in columns for c in x)]
        inner = {x[:-1] for x in own}
        number = {"": 1} | {x: k for k, x in enumerate(sorted(own, key=lambda x: (x not in inner, x)), 2)}
        self.inner = 1 + len(inner | {""})
        self.moves = np.zeros((self.inner, len(columns) + 1), dtype=np.int32)
        self.piece_of = np.full(len(own) + 2, -1, dtype=np.int32)
        for x in own:
            self.moves[number[x[:-1]], columns[x[-1]]] = number[x]
            self.piece_of[number[x]] = self.states[x]

    def pair_weight(self, left: int, right: int) -> float:
        """What the acceptor adds where piece `right` follows `left`; -1 stands for the start and for bytes."""
        key = (left + 1) << 32 | right + 1
        found = self.new_pairs.get(key)
        if found is None:
            first = self.text[left] if left >= 0 else ""
            found = self.new_pairs[key] = self._stay(list(first + self.text[right]), len(first))
        return 0.0 if found else math.inf

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Which pairs (left + 1) << 32 | right + 1 weigh nothing."""
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
        known = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)
        ok = np.zeros(len(keys), dtype=bool)
        ok[known] = self.pair_ok[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            different, back = np.unique(keys[rest], return_inverse=True)
            ok[rest] = np.array([self.pair_weight((k >> 32) - 1, (k & 0xFFFFFFFF) - 1) == 0 for k in different.tolist()], dtype=bool)[back]
        return ok

    def _remember(self) -> None:
        """Put pairs met lately among the sorted ones."""
        if len(self.pair_keys) + len(self.new_pairs) > KEEP_PAIRS:
            self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        keys = np.concatenate([self.pair_keys, np.fromiter(self.new_pairs.keys(), np.int64, len(self.new_pairs))])
        ok = np.concatenate([self.pair_ok, np.fromiter(self.new_pairs.values(), bool, len(self.new_pairs))])
        order = np.argsort(keys, kind="stable")
        keys, ok = keys[order], ok[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.pair_keys, self.pair_ok = keys[first], ok[first]
        self.new_pairs.clear()

    def _stay(self, parts: list[str], border: int) -> bool:
        """Whether characters joined pair by pair, best rank and then leftmost first, end as the two pieces beside the border."""
        rank = self.rank.get
        ranks = [rank(a + b, 1e30) for a, b in zip(parts, parts[1:])]
        least = 1 + (border > 0)
        while len(parts) > least:
            best = min(ranks)
            at = ranks.index(best)
            if best == 1e30 or at == border - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], 1e30)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], 1e30)
            if at < border:
                border -= 1
        return not ranks or min(ranks) == 1e30

    def arcs(self, stretch: str, i: int) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """What the pieces and byte fallback can read at `i`: end, piece or -1, weight, emitted."""
        states, weight, out = self.states, self.weight, []
        for j in range(i + 1, len(stretch) + 1):
            state = states.get(stretch[i:j])
            if state is None:
                break
            if state >= 0:
                out.append((j, state, weight[state], (state,)))
        if stretch[i] not in self.ids:
            emitted = tuple(self.bytes[b] for b in stretch[i].encode())
            out.append((i + 1, -1, self.unknown(emitted), emitted))
        return out

    def shortest(self, stretch: str) -> tuple[int, ...]:
        """The least path of the composition with one stretch, by relaxing states (position, last piece) in order."""
        n, ranked = len(stretch), self.ranked
        least: list[dict] = [{} for _ in range(n + 1)]  # position -> last piece -> (weight, state before, emitted)
        least[0][-1] = (0.0, None, ())
        for i in range(n):
            here = least[i]
            if not here:
                continue
            for end, piece, weight, emitted in self.arcs(stretch, i):
                there, name = least[end], piece if ranked else -1
                for last, (so_far, _, _) in here.items():
                    total = so_far + weight
                    if ranked and piece >= 0:
                        total += self.pair_weight(last, piece)
                        if total == math.inf:
                            continue
                    old = there.get(name)
                    if old is None or total < old[0]:
                        there[name] = (total, (i, last), emitted)
        state = (n, min(least[n], key=lambda last: least[n][last][0]))
        out = []
        while state is not None:
            _, before, emitted = least[state[0]][state[1]]
            out.append(emitted)
            state = before
        return tuple(x for emitted in reversed(out) for x in emitted)

    def path(self, stretch: bytes) -> tuple[int, ...]:
        """The least path of a stretch, by way of the places in it that every path passes through."""
        text, inside = stretch.decode("utf-8", "replace"), self.inside
        cuts = [k for k, (a, b) in enumerate(zip(text, text[1:]), 1) if a + b not in inside]
        return tuple(x for a, b in zip([0, *cuts], [*cuts, len(text)]) for x in self.shortest(text[a:b]))

    def paths(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The least path of each stretch: how many pieces, and all pieces one after another."""
        found: list = [None] * len(stretches)
        plain = [k for k, s in enumerate(stretches) if len(s) <= IN_STEP]
        done = np.zeros(len(stretches), dtype=bool)
        owner, pieces = self._in_step([stretches[k] for k in plain])
        plain = np.array(plain, dtype=np.int64)
        owner = plain[owner]
        done[owner] = True
        for k in np.flatnonzero(~done).tolist():
            found[k] = self.path(stretches[k])
        rest = [(k, x) for k in np.flatnonzero(~done).tolist() for x in found[k]]
        owner = np.concatenate([owner, np.array([k for k, _ in rest], dtype=np.int64)])
        pieces = np.concatenate([pieces, np.array([x for _, x in rest], dtype=np.int32)])
        order = np.argsort(owner, kind="stable")
        self._remember()
        return np.bincount(owner, minlength=len(stretches)), pieces[order]

    def _in_step(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Owner and piece of every piece of the stretches' paths, in order; stretches that need relaxing one by one have none."""
        if not stretches:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        texts = [s.decode("utf-8", "replace") for s in stretches]
        sizes = np.array([len(t) for t in texts], dtype=np.int32)
        symbols = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
        begin = np.cumsum(sizes, dtype=np.int32) - sizes
        each = np.arange(len(texts), dtype=np.int32)
        owner = np.repeat(each, sizes)
        room = np.repeat(begin + sizes, sizes) - np.arange(len(symbols), dtype=np.int32)  # characters left, this one included
        # arcs: the trie is walked from every place at once
        place, state, arcs = np.arange(len(symbols), dtype=np.int32), np.ones(len(symbols), dtype=np.int32), []
        step = 0
        while len(place):
            state = self.moves[state, symbols[place + step]]
            step += 1
            piece = self.piece_of[state]
            ends = (state > 0) & (piece >= 0)
            arcs.append((place[ends], np.full(ends.sum(), step, dtype=np.int32), piece[ends]))
            on = (state > 0) & (state < self.inner) & (room[place] > step)
            place, state = place[on], state[on]
        place, long, piece = (np.concatenate(x) for x in zip(*arcs))
        offset = place - begin[owner[place]]
        order = np.argsort(offset.astype(np.int16), kind="stable")  # offsets are under IN_STEP
        place, long, piece = place[order], long[order], piece[order]
        bounds = np.searchsorted(offset[order], np.arange(sizes.max() + 1))
        # relaxation: a stretch has a node for each place and one for its end
        nodes = len(symbols) + len(texts)
        least, last, back = np.full(nodes, np.inf), np.zeros(nodes, dtype=np.int32), np.zeros(nodes, dtype=np.int32)
        least[begin + each] = 0.0
        doubtful = np.zeros(len(texts), dtype=bool)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = owner[place[a:b]]
            u, x = place[a:b] + own, piece[a:b]
            v = u + long[a:b]
            on = least[u] < np.inf
            if self.ranked:
                on[on] = self.passes(last[u[on]].astype(np.int64) << 32 | x[on] + 1)
                doubtful[own[on & (least[v] < np.inf)]] = True
            total = least[u] + self.weights[x]
            on &= total < least[v]  # arcs from places at one distance end at different nodes
            least[v[on]], last[v[on]], back[v[on]] = total[on], x[on] + 1, u[on]
        final = begin + sizes + each
        mine = np.flatnonzero((least[final] < np.inf) & ~doubtful)
        at, first, found = final[mine], (begin + each)[mine], []
        while len(mine):
            found.append((mine, last[at] - 1))
            at = back[at]
            on = at > first
            mine, at, first = mine[on], at[on], first[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        mine, pieces = (np.concatenate(x[::-1]) for x in zip(*found))
        order = np.argsort(mine, kind="stable")
        return mine[order], pieces[order].astype(np.int32)

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of UTF-8 texts: the pieces of all, how many each has, and whether decoding them gives it back."""
        import pyarrow as pa

        normal = [self.normal(t) for t in texts]
        sizes = np.array([len(t) for t in normal], dtype=np.int64)
        data = np.frombuffer(b"".join(normal), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.array([not t for t in texts], dtype=bool)
        ends = np.cumsum(sizes)
        begins = self._cuts(data, (ends - sizes)[sizes > 0])
        offsets = np.append(begins, len(data))
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = stretches.dictionary_encode()
        counts, pieces = self.paths(coded.dictionary.to_pylist())
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pieces)
        at = coded.indices.to_numpy()
        ids = lists.take(coded.indices).flatten().to_numpy()
        before = np.concatenate([[0], np.cumsum(counts[at])])  # pieces before each stretch
        upto = before[np.searchsorted(begins, ends)]
        n_pieces = np.diff(upto, prepend=0)
        return ids, n_pieces, self._same(ids, data, ends, sizes, texts)

    def _cuts(self, data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where stretches begin: texts, marks after anything else, and ASCII characters that no piece holds side by side."""
        a, b, c = self.normal.mark
        mark = np.zeros(len(data) + 3, dtype=bool)
        mark[3 : len(data) + 1] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
        begin = mark[3:] & ~mark[:-3]
        begin[1:] |= self.apart[data[:-1], data[1:]]
        begin[firsts] = True
        return np.flatnonzero(begin)

    def _same(self, ids: np.ndarray, data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether decoding, a gather of what pieces stand for, gives each text back."""
        raw = np.frombuffer(self.emitted.take(ids).buffers()[2], dtype=np.uint8)
        lost = np.array([self.normal.mark in t or (self.normal.trim and t != self.normal.trimmed(t)) for t in texts], dtype=bool)
        if len(raw) == len(data):
            wrong = np.concatenate([[0], np.cumsum(raw != data)])
            return (wrong[ends] == wrong[ends - sizes]) & ~lost
        return np.array([self.decode(self.encode(t.decode("utf-8", "replace"))).encode() == t for t in texts], dtype=bool)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text.encode()])[0].tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.emit.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.normal.prefix and text[:1] == " " else text


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def codec_of(raw: bytes) -> Codec:
    """One codec a process, so that tasks after the first find paths and pairs of earlier ones."""
    return Codec(raw)


def encoded(docs: DataFrame, keep: list[str], model: bytes) -> DataFrame:
    """`keep` and n_pieces, n_fallback, ids_sha256, roundtrip, ids."""
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    inner = docs.select(*[F.col(f"`{c}`") for c in keep], utf8().alias("_utf8"))
    added = StructType.fromDDL("n_pieces long, n_fallback long, ids_sha256 string, roundtrip boolean, ids array<int>")
    schema = StructType(inner.schema.fields[:-1] + added.fields)

    def part(codec, columns, texts):
        import pyarrow as pa

        ids, counts, same = codec.encode_all(texts)
        ends = np.cumsum(counts)
        low = np.concatenate([[0], np.cumsum(codec.fallback[ids])])
        flat = np.ascontiguousarray(ids.astype("<i4"))
        digests = [hashlib.sha256(flat[e - n : e]).hexdigest() for e, n in zip(ends.tolist(), counts.tolist())]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
        found = [pa.array(counts), pa.array(low[ends] - low[ends - counts]), pa.array(digests, pa.string()), pa.array(same), lists]
        return pa.RecordBatch.from_arrays([*columns, *found], names=schema.names)

    def run(batches):
        codec = codec_of(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            begin = size = 0
            for k, text in enumerate([*texts, None]):
                if k > begin and (text is None or size + len(text) > AT_ONCE):
                    columns = [batch.column(c).slice(begin, k - begin) for c in range(batch.num_columns - 1)]
                    yield part(codec, columns, texts[begin:k])
                    begin, size = k, 0
                size += len(text or b"")
        tidy()

    return inner.mapInArrow(run, schema)
