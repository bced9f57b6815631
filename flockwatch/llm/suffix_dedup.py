"""Suffix-array dedup: remove bytes covered by a string of `LENGTH` bytes that starts elsewhere too.

Every window of `LENGTH` bytes has an anchor, the least hash of the strings of `gram` bytes
in it, leftmost first. Equal windows have equal anchors at equal places in them, so windows
are dealt out by anchor and never need to meet others. Consecutive windows with one anchor
form a segment of text:

1. a text that occurs twice is covered whole, and so is a segment that does; equal ones are
   known by 128 bits of a hash, which two different ones share with a chance of 2^-128;
2. an anchor with one segment has no repeat;
3. else the different segments of an anchor are sorted by the difference-cover algorithm:
   triples at two of three places are sorted and named, the names are sorted in turn where
   they are not all different, the remaining suffixes follow from them by merging, and
   neighbours in the suffix array compare their first `LENGTH` bytes.

Segments of an anchor that come to more than `BYTES` are compared by a sparse suffix array of the
anchors' places (`compare_aligned`), as equal windows have their anchors at equal places. An anchor
of more than `ONE_TASK` bytes is sorted by the difference cover across tasks (`across_tasks`): triples of all its sampled places are range-sorted and named, triples
of these names are sorted and named again, and any two windows meet where a shift of at
most two steps brings both to sampled places. No group of segments is held by one task.

Scale: about one row in 125 bytes moves, once, as eight numbers; of segments that a task
meets again only the first goes to the shuffle. Texts move twice, each at most once a task
(to cut segments that need comparing, and to cut the result); texts that occur twice and texts
that lose nothing give their result where they are read.

Defined results: a null or empty text has nothing to remove and hashes as no bytes; texts
shorter than `LENGTH` keep all; rows that repeat are copies like any other. Texts of any
length are read in stretches of `STRETCH` windows, some 100 bytes for each in a task. Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, cut, join_by_size, small_batches, tidy, utf8

LENGTH, GRAM = 400, 128
#: Bits of a place in a stretch; hashes are compared by the bits above them.
PLACE = 23
STRETCH = 1 << 22
#: Bytes of segments that one suffix array takes, and that an anchor may have in one task (some six times that in memory).
BYTES, ONE_TASK = 400_000, 48_000_000
#: Segments and texts that a task remembers to have met.
KNOWN = 200_000


def gram_of(length: int) -> int:
    """The longest power of two up to a third of the length, `GRAM` at most."""
    return min(GRAM, 1 << max(0, (length // 3).bit_length() - 1))


def _hashes(raw: bytes, gram: int) -> np.ndarray:
    """A hash of every string of `gram` bytes (a power of two), built by doubling."""
    h = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    span = 1
    while span < gram:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + (h[span:] ^ (h[span:] >> np.uint64(29)))
        span *= 2
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = _hashes(raw, gram)
    least = (h & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int32)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return first, last, h[at[first]].view(np.int64)


def anchors(raw: bytes, length: int = LENGTH, gram: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: first and last window, and the hash of the anchor they share.

    Segments end where a stretch does; any division of an anchor's windows gives the same result.
    """
    gram = gram or gram_of(length)
    parts = [
        [x + begin if k < 2 else x for k, x in enumerate(_anchors(raw[begin : begin + STRETCH + length - 1], length, gram))]
        for begin in range(0, len(raw) - length + 1, STRETCH)
    ]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of `s` (numbers from 1), by a difference cover of two places in three."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int32)
    t = np.concatenate([s, [0, 0, 0]]).astype(np.int64)
    base = int(t.max()) + 1
    place = np.arange(n + (n % 3 == 1), dtype=np.int32)
    one, two = place[1::3], place[2::3]
    sample = np.concatenate([one, two])
    if base < 1 << 21:
        triple = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
        order = np.argsort(triple, kind="stable").astype(np.int32)
        new = np.diff(triple[order]) != 0
    else:
        order = np.lexsort((t[sample + 2], t[sample + 1], t[sample])).astype(np.int32)
        a = sample[order]
        new = (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])
    names = np.empty(len(sample), dtype=np.int32)
    names[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    if names[order[-1]] < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = place[0:n:3]
    size = n + 4
    key_of_one = lambda i: t[i] * size + rank[i + 1]
    zero = zero[np.argsort(key_of_one(zero), kind="stable")]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(key_of_one(ones), key_of_one(zero))
    if base * base * size < 1 << 62:
        key_of_two = lambda i: (t[i] * base + t[i + 1]) * size + rank[i + 2]
        before = before + np.searchsorted(key_of_two(twos), key_of_two(zero))
    else:
        both = np.concatenate([twos, zero])
        late = np.concatenate([np.zeros(len(twos), np.int8), np.ones(len(zero), np.int8)])
        merged = np.lexsort((late, rank[both + 2], t[both + 1], t[both]))
        at = np.flatnonzero(merged >= len(twos))
        count = np.empty(len(zero), dtype=np.int64)
        count[merged[at] - len(twos)] = at - np.arange(len(at))
        before = before + count
    out = np.empty(n, dtype=np.int32)
    mine = np.arange(len(zero)) + before
    free = np.ones(n, dtype=bool)
    free[mine] = False
    out[mine] = zero
    out[free] = sorted_sample
    return out


def repeated_windows(text: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which places of `text` start a valid window whose bytes start a valid window elsewhere too."""
    order = suffix_array(text.astype(np.int32) + 1)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    if length >= 8:
        words = np.zeros(len(text), dtype=np.uint64)
        for k in range(8):
            words[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
        for k in [*range(0, length - 7, 8), length - 8]:
            same = words[a + k] == words[b + k]
            a, b = a[same], b[same]
    else:
        for k in range(length):
            same = text[a + k] == text[b + k]
            a, b = a[same], b[same]
    out = np.zeros(len(text), dtype=bool)
    out[a] = out[b] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def compare_segments(segments: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Runs of repeated windows of each segment."""
    text = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes) - sizes
    valid = np.ones(len(text), dtype=bool)
    for b, n in zip(begin.tolist(), sizes.tolist()):
        valid[b + n - length + 1 : b + n] = False
    flags = repeated_windows(text, valid, length)
    return [_runs(flags[b : b + n - length + 1]) for b, n in zip(begin.tolist(), sizes.tolist())]


def _anchor_places(segments: list[bytes], length: int, gram: int) -> np.ndarray:
    """Where the anchor of its windows begins in each segment."""
    out = []
    for k in range(0, len(segments), 1000):
        some = segments[k : k + 1000]
        h = _hashes(b"".join(some), gram) & ~np.uint64((1 << PLACE) - 1)
        begin = np.cumsum([0, *map(len, some[:-1])]).tolist()
        out += [h[b : b + length - gram + 1].argmin() for b in begin]
    return np.array(out, dtype=np.int64)


def _sorted_bytes(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of `rows` (padded with zeros), and how many bytes each has in common with the one before in that order."""
    padded = np.zeros((len(rows), -(-width // 8) * 8), dtype=np.uint8)
    for k, row in enumerate(rows):
        padded[k, : len(row)] = np.frombuffer(row, dtype=np.uint8)
    order = np.lexsort(padded.view(">u8").astype(np.uint64).T[::-1])
    common = np.full(len(rows), -1)
    for k in range(1, len(rows), 10_000):
        differ = padded[order[k : k + 10_000]] != padded[order[k - 1 : k - 1 + len(order[k : k + 10_000])]]
        common[k : k + 10_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def compare_aligned(segments: list[bytes], length: int = LENGTH, gram: int | None = None) -> list[list[tuple[int, int]]]:
    """What `compare_segments` gives, for segments of one anchor: a suffix array of the anchors' places only.

    The suffixes that begin with the anchors are sorted, and so are the bytes before them, read
    backwards; neighbours tell how much they have in common. Windows with d bytes before
    their anchor are equal if and only if these d bytes are, and the length - d bytes after them.
    """
    gram = gram or gram_of(length)
    n, sizes = len(segments), np.array([len(s) for s in segments])
    place = _anchor_places(segments, length, gram)
    after, common_after = _sorted_bytes([s[p : p + length] for s, p in zip(segments, place.tolist())], length)
    before, common_before = _sorted_bytes([s[:p][::-1] for s, p in zip(segments, place.tolist())], length - gram)
    flags = np.zeros((n, int(sizes.max()) - length + 1), dtype=bool)
    key, run = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(length - gram + 1):
        own = np.flatnonzero((d <= place) & (length - d <= sizes - place))
        if len(own) < 2:
            continue
        key[before] = np.cumsum(common_before < d)
        run[after] = np.cumsum(common_after < length - d)
        _, which, times = np.unique(key[own] * (n + 1) + run[own], return_inverse=True, return_counts=True)
        own = own[times[which] > 1]
        flags[own, place[own] - d] = True
    return [_runs(flags[k, : size - length + 1]) for k, size in enumerate(sizes.tolist())]


def cover(n: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of the bytes in `ranges`."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        high = min(high, n)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _key(raw: bytes) -> tuple[int, int]:
    return struct.unpack(">qq", hashlib.sha256(raw).digest()[:16])


class _Met:
    """What a task has met lately."""

    def __init__(self):
        self.of: dict = {}

    def first(self, key, value=True):
        """None the first time, else what was put there."""
        found = self.of.get(key)
        if found is None:
            if len(self.of) >= KNOWN:
                self.of.clear()
            self.of[key] = value
        return found


#: A row is a segment (0), a sign that a task met the segment of an equal row again (1), or a range that goes for sure (2).
SEGMENT, AGAIN, RANGE = 0, 1, 2
_ROW = "anchor long, s1 long, s2 long, k1 long, k2 long, low int, high int, kind int"


def _segments(length: int):
    """Texts to rows of `_ROW`."""

    def rows(batches):
        from xxhash import xxh3_128_digest

        texts, met = _Met(), _Met()
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if len(text) < length:
                    continue
                key = _key(text)
                if texts.first(key):
                    continue
                first, last, anchor = anchors(text, length)
                for low, high, name in zip(first.tolist(), last.tolist(), anchor.tolist()):
                    s = struct.unpack("<qq", xxh3_128_digest(text[low : high + length]))
                    mine = (name, *s, *key, low, high)
                    before = met.first(mine[:3], mine)
                    if before is None:
                        out.append((*mine, SEGMENT))
                    else:  # covered at once; the first need only be told
                        out.append((key[0], 0, 0, *key, low, high, RANGE))
                        if before != AGAIN:
                            out.append((*before, AGAIN))
                            met.of[mine[:3]] = AGAIN
            yield arrow_batch(_ROW, out)
        tidy()

    return rows


def _sift(length: int):
    """Rows sorted by all columns to ranges that go (want = 0), and one row of each segment that needs comparing (want = 1).

    What is carried from batch to batch is the first row of the last anchor and of the last
    segment, with signs of what they gave already, so an anchor of any size streams.
    """
    names = ("anchor", "s1", "s2", "k1", "k2", "low", "high", "kind")

    def work(c, ranged, wanted, weight):
        """c: columns in order; of rows carried along: whether they gave a range or a want, and how often their segment was met."""
        differ = lambda *cols: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in cols], axis=0)])
        own = c["kind"] == SEGMENT
        same = ~differ(c["anchor"], c["s1"], c["s2"], c["k1"], c["k2"], c["low"], c["kind"]) & own  # copies of a text from other tasks
        weight = np.where(own & ~same, weight, c["kind"] == AGAIN)
        head = differ(c["anchor"], c["s1"], c["s2"], c["kind"] == RANGE) & (c["kind"] != RANGE)
        group = np.cumsum(head) - 1
        met = np.bincount(np.maximum(group, 0), weight, max(1, head.sum()))
        whole = (met[np.maximum(group, 0)] >= 2) & (c["kind"] != RANGE)
        part = np.cumsum(differ(c["anchor"])) - 1
        several = np.bincount(part, head)[part] >= 2
        ranges = np.flatnonzero((whole & own & ~same & ~ranged) | (c["kind"] == RANGE))
        wants = np.flatnonzero(head & several & ~wanted)
        pick = np.concatenate([ranges, wants])
        want = np.concatenate([np.zeros(len(ranges), np.int32), np.ones(len(wants), np.int32)])
        high = (c["high"][pick] + np.where(want == 0, length, 0)).astype(np.int32)
        out = [c["anchor"][pick], c["k1"][pick], c["k2"][pick], c["low"][pick], high, whole[pick].astype(np.int32), want]
        heads = np.flatnonzero(head)
        keep = np.zeros(0, np.int64)
        if len(heads):
            here = heads[c["anchor"][heads] == c["anchor"][heads[-1]]]
            keep = np.unique([here[0], here[-1]])
        carry = {n: c[n][keep] for n in names}
        marks = (ranged | whole)[keep], (wanted | (head & several))[keep], np.where(whole[keep], 2, weight[keep])
        return out, (carry, *marks)

    def sift(batches):
        import pyarrow as pa

        state, held, rows = None, [], 0

        def flush():
            nonlocal state, held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            c = {n: table.column(n).to_numpy() for n in names}
            n = len(c["kind"])
            marks = [np.zeros(n, bool), np.zeros(n, bool), np.ones(n, np.int64)]
            if state:
                c = {k: np.concatenate([state[0][k], x]) for k, x in c.items()}
                marks = [np.concatenate([s, m]) for s, m in zip(state[1:], marks)]
            out, state = work(c, *marks)
            held, rows = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["anchor", "k1", "k2", "low", "high", "whole", "want"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 20_000:
                yield flush()
        if held:
            yield flush()
        tidy()

    return sift


def _texts_once(docs: DataFrame, length: int) -> DataFrame:
    """k1, k2 and bytes of each text that may lose something, once a task."""
    schema = "k1 long, k2 long, raw binary"

    def once(batches):
        met = _Met()
        for batch in batches:
            long = [t for t in batch.column(0).to_pylist() if len(t) >= length]
            yield arrow_batch(schema, [(*k, t) for k, t in zip(map(_key, long), long) if not met.first(k)])

    return docs.select(utf8().alias("raw")).mapInArrow(once, schema)


def _pieces(length: int, schema: str):
    """Texts with what is wanted of them, those of one key in a row, to the wanted segments."""

    def pieces(batches):
        before, out, size = None, [], 0
        for batch in batches:
            for k1, k2, text, want in zip(*(batch.column(k) for k in range(4))):
                key = (k1.as_py(), k2.as_py())
                if key == before:
                    continue
                before, text = key, text.as_py()
                for w in want.as_py():
                    out.append((w["anchor"], *key, w["low"], w["whole"], text[w["low"] : w["high"] + length]))
                    size += len(out[-1][-1])
                    if size >= 1 << 22:
                        yield arrow_batch(schema, out)
                        out, size = [], 0
        yield arrow_batch(schema, out)
        tidy()

    return pieces


_RANGES = "k1 long, k2 long, low int, high int"


def _compare(length: int):
    """Segments sorted by anchor to ranges of their repeated windows."""

    def compare(batches):
        group, size, own, mine = [], 0, [], 0  # of earlier anchors, and of the last one

        def flush(group, compare):
            found = compare([x[5] for x in group], length)
            return arrow_batch(_RANGES, [(k1, k2, low + a, low + b + length) for (_, k1, k2, low, whole, _), runs in zip(group, found) if not whole for a, b in runs])

        def ended():
            nonlocal group, size, own, mine
            if mine > BYTES:
                yield flush(own, compare_aligned)
            else:
                group += own
                size += mine
                if size > BYTES:
                    yield flush(group, compare_segments)
                    group, size = [], 0
            own, mine = [], 0

        last = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if last and row[:4] == last[:4]:
                    continue  # a copy of the text
                if last and row[0] != last[0]:
                    yield from ended()
                own.append(row)
                mine += len(row[5])
                last = row
        yield from ended()
        if group:
            yield flush(group, compare_segments)
        tidy()

    return compare


def _named(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Different `columns` and a number each in their order: sorted by ranges, numbered by range and place."""
    different = df.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return cut(different.withColumn(name, F.monotonically_increasing_id()))


def across_tasks(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges of the repeated windows of segments (k1, k2, low, whole, body), by a difference cover whose sorts span tasks.

    A step is `u` bytes. Places whose number of steps is 1 or 2 modulo 3 are sampled; triples
    of steps from there are sorted and named, then triples of these names (nine steps). What
    is left of `length` behind a sampled place is told by three of those names, overlapping,
    and fewer than four steps of bytes. Two windows are both on, both one step before or both two
    steps before sampled places, so they meet in one of three keys if and only if they are equal.
    """
    if length < 11:
        raise ValueError("a window of fewer than 11 bytes has too few steps")
    u = -(-length // 29)
    steps = length // u
    segments = cut(segments.select("k1", "k2", "low", "whole", "body").distinct())
    sampled = lambda p: p // u % 3 > 0

    def triples(batches):
        for batch in batches:
            out = []
            for k1, k2, low, _, body in zip(*(batch.column(k).to_pylist() for k in range(5))):
                out += [(k1, k2, low, p, body[p : p + 3 * u]) for p in range(len(body) - 3 * u + 1) if sampled(p)]
            yield arrow_batch("k1 long, k2 long, low int, p int, b binary", out)

    def gathered(rows):
        return rows.groupBy("k1", "k2", "low").agg(F.map_from_entries(F.collect_list(F.struct("p", "name"))).alias("names"))

    first = segments.mapInArrow(triples, "k1 long, k2 long, low int, p int, b binary")
    first = cut(gathered(first.join(_named(first, ["b"], "name"), "b")))
    at = lambda k: F.element_at("names", F.col("p") + k)
    second = first.select("k1", "k2", "low", "names", F.explode(F.map_keys("names")).alias("p"))
    second = second.select("k1", "k2", "low", "p", at(0).alias("x"), at(3 * u).alias("y"), at(6 * u).alias("z")).where("z is not null")
    second = cut(gathered(second.join(_named(second, ["x", "y", "z"], "name"), ["x", "y", "z"])))
    key = "shift int, head binary, x long, y long, z long, tail binary"

    def windows(batches):
        for batch in batches:
            out = []
            for k1, k2, low, whole, body, names in zip(*(batch.column(k).to_pylist() for k in range(6))):
                names = dict(names)
                for w in range(len(body) - length + 1):
                    for shift in range(3):
                        p = w + shift * u
                        if sampled(p):
                            deep = (steps - shift) // 3 * 3
                            at = p, p + min(9, deep - 9) * u, p + (deep - 9) * u
                            out.append((k1, k2, low, whole, w, shift, body[w:p], *(names[x] for x in at), body[p + deep * u : w + length]))
            yield arrow_batch(f"k1 long, k2 long, low int, whole int, w int, {key}", out)

    each = cut(segments.join(second, ["k1", "k2", "low"]).select("k1", "k2", "low", "whole", "body", "names").mapInArrow(windows, f"k1 long, k2 long, low int, whole int, w int, {key}"))
    columns = ["shift", "head", "x", "y", "z", "tail"]
    twice = each.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = each.where("whole = 0").join(twice, columns).select("k1", "k2", (F.col("low") + F.col("w")).alias("low"))
    return met.select("k1", "k2", "low", (F.col("low") + length).alias("high"))


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k1, k2 (of a text) and ranges: begin and end of what goes, for texts that lose anything and occur once."""
    small_batches(docs.sparkSession)
    rows = docs.select(utf8().alias("raw")).mapInArrow(_segments(length), _ROW)
    order = ["anchor", "s1", "s2", "k1", "k2", "low", "kind"]
    sifted = cut(
        rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_sift(length), "anchor long, k1 long, k2 long, low int, high int, whole int, want int")
    )
    wanted = sifted.where("want = 1").drop("want")
    sizes = wanted.groupBy("anchor").agg(F.sum(F.col("high") - F.col("low") + length).alias("bytes"))
    large = cut(sizes.where(F.col("bytes") > ONE_TASK).select("anchor"))
    has_large = bool(large.head(1))
    wants = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "low", "high", "whole")).alias("wants"))
    schema = "anchor long, k1 long, k2 long, low int, whole int, body binary"
    joined = _texts_once(docs, length).join(wants, ["k1", "k2"]).select("k1", "k2", "raw", "wants")
    cut_out = joined.mapInArrow(_pieces(length, schema), schema)
    if has_large:
        cut_out = cut(cut_out)
        hot, cut_out = cut_out.join(large, "anchor", "left_semi"), cut_out.join(large, "anchor", "left_anti")
    found = cut_out.repartition("anchor").sortWithinPartitions("anchor", "k1", "k2", "low").mapInArrow(_compare(length), _RANGES)
    found = sifted.where("want = 0").select("k1", "k2", "low", "high").union(found)
    if has_large:
        found = found.union(across_tasks(hot, length))
    return found.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with `text`, the remaining bytes too."""
    more = ", kept binary" if text else ""
    facts = f"k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string{more}"

    def apply(batches):
        for batch in batches:
            out, before = [], None
            for k1, k2, raw, ranges in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (k1, k2) == before:
                    continue
                before = k1, k2
                spans = cover(len(raw), [(r["low"], r["high"]) for r in ranges])
                at, parts = 0, []
                for low, high in spans:
                    parts.append(raw[at:low])
                    at = high
                kept = b"".join([*parts, raw[at:]])
                out.append((k1, k2, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if text else [])))
            yield arrow_batch(facts, out)
        tidy()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = f"doc_id {id_type}, k1 long, k2 long, n_bytes long, sha string{', raw binary' if text else ''}"

    def read(batches):
        for batch in batches:
            raws = batch.column(1).to_pylist()
            digests = [hashlib.sha256(t).digest() for t in raws]
            rows = [(*struct.unpack(">qq", d[:16]), len(t), d.hex(), *([t] if text else [])) for t, d in zip(raws, digests)]
            yield arrow_batch(own, rows, batch.column(0))

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", utf8().alias("raw")).mapInArrow(read, own)
    if not text:
        rows = cut(rows)
    copies = cut(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n")).where("copies > 1"))
    goes = lambda x: F.when(F.col("n") >= length, x)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = copies.select(
        "k1", "k2", goes(F.col("n")).alias("n_removed"), goes(F.lit(1).cast("long")).alias("n_spans"), goes(nothing).alias("kept_sha256"),
        *([goes(F.lit(b"")).alias("kept")] if text else []), "copies",
    )
    gone = _texts_once(docs, length).join(removals(docs, length), ["k1", "k2"]).select("k1", "k2", "raw", "ranges").mapInArrow(apply, facts)
    once = gone.dropDuplicates(["k1", "k2"]).join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti").withColumn("copies", F.lit(1).cast("long"))
    found = join_by_size(rows, once.unionByName(whole), ["k1", "k2"], "copies")
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", "raw").alias("kept")] if text else []),
    )


#: Every window's hex digits are hashed, so the SQL suits small tables only.
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) as i from d),
k as (select r, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) as k from w),
c as (select r, i, count(*) over (partition by k) as c from k),
p as (select r, i, lag(i) over (partition by r order by i) as before from c where c > 1),
g as (select r, i, sum(case when i <= before + {LENGTH} then 0 else 1 end) over (partition by r order by i) as g from p),
s as (select r, g, min(i) as low, max(i) + {LENGTH} as high from g group by r, g),
t as (select r, low, high, coalesce(lag(high) over (partition by r order by low), 0) as free from s),
m as (select r, sum(high - low) as gone, count(*) as spans, max(high) as high from t group by r),
b as (select r, string_agg(substr(h, 2 * free + 1, 2 * (low - free)), '' order by low) as body from t join d using (r) group by r)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(high, 0) + 1))) as kept_sha256
from d left join m using (r) left join b using (r)"""
