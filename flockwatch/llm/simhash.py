"""SimHash near-dedup with pivot distance tables.

A fingerprint's bit is the majority of that bit over the hashes of its text's shingles.
Fingerprints are compared with many reference fingerprints (pivots): the empty one and one
for each block of two neighbouring bits. The distances say how many bits a fingerprint has
set in each block, and by the triangle inequality two fingerprints within `radius` bits
have distances to every pivot that differ by at most `radius`.

Search: a table joins fingerprints on groups of coordinates (distances relative to the
empty pivot). Two differing bits touch at most two blocks, so of g groups of blocks all but
two agree, and with one table for each choice of g - 2 groups nothing is missed. Four groups
(six tables) do for some 10^8 fingerprints; more fingerprints take more groups, so keys widen and
cells stay small. Pairs in a cell whose distances to any pivot differ by more than the radius are
discarded, survivors are verified by their Hamming distance, and a cell passes on one star
for each component in it, never all pairs. Fingerprints of cells that are large all the same
(`LARGE`) are linked across tasks, by way of the fingerprints between: each one and its 64
neighbours make 65 rows, two within two bits share one of these, and no value is shared by more than 65.

The pipeline's near copies are documents whose sets of five-word shingles have a Jaccard
similarity of `SIMILAR` or more. Fingerprints (four lanes, of the different shingles) only
propose: 72 of 256 differing bits or fewer make candidates, components of candidates meet in
one task each, and every link is verified there on the shingles themselves. Two sets of that
similarity share one of their first shingles in any order common to all: of m shingles, the
first m - ceil(0.8 m) + 1. Documents are joined on these, so every such pair meets, whatever
the number of documents. The order puts shingles last that are common in a sample, so that
passages which many documents have don't bring them together; it decides the cost only.

Scale: equal fingerprints are one row before any search, so a group of copies costs
nothing; each fingerprint gives one small row a table, in the pipeline one for each fifth word.
Groups of more than `GROUP` candidates are compared by blocks, each pair of blocks in a task.

Defined results: texts without words, null ones too, have fingerprint zero and are linked
like any other; a text of fewer words than a shingle is one shingle; a null doc_id gets its
own row and is never the smallest unless its group has no other. A task holds a text whole, with
some 20 bytes for each word. The query ignores further columns of the input; the pipeline's stage
passes them through, whatever their names.
"""

from __future__ import annotations

import tempfile
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, cut, map_texts, row_key, small_batches, take_rows
from .components import components

SEED = 42
SIMILAR = (4, 5)  # Jaccard similarity of near copies in the pipeline, as a fraction
#: Shingles of one group that a task holds in memory, and that it compares at once; beyond that they wait in a file.
HELD_SHINGLES, AT_ONCE = 4_000_000, 1_000_000
#: Members of a group of candidates that one task compares with all of another so many.
GROUP = 1000
#: Members of a cell: so many that are expected, compared as one matrix, by windows, and at most in one task.
CELL, SMALL_CELL, MATRIX, LARGE = 16, 64, 512, 5000
#: Documents (and shingles of each) that tell which shingles are common, in how many of them, and how many shingles at most are held to be so.
SAMPLE, SAMPLE_SHINGLES, SEEN, COMMON = 20_000, 2000, 3, 200_000
BLOCKS = 32  # of two bits, a lane
#: Multipliers that make further lanes of a shingle's hash.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = raw.lower().split()
    if len(found) > words:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
        return np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)
    return np.array([xxh64_intdigest(b" ".join(found), SEED)] if found else [], dtype=np.uint64)


def arrow_lists(lists: list[np.ndarray]):
    """Lists of hashes as an Arrow column of lists of signed numbers."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.uint64).view(np.int64)))


def majority(h: np.ndarray) -> int:
    """The 64 majority bits of hashes, as an unsigned number."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(bits), 255):
        count += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(count * 2 > len(h)).tobytes(), "big")


def fingerprint(raw: bytes, words: int = 3, lanes: int = 1) -> list[int]:
    """The lanes of a text's fingerprint as signed 64-bit numbers."""
    return signed_lanes(shingle_hashes(raw, words), lanes)


def signed_lanes(h: np.ndarray, lanes: int) -> list[int]:
    out = [majority(h)]
    for multiplier in MIX[: lanes - 1]:
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(multiplier)
        out.append(majority(mixed ^ (mixed >> np.uint64(29))))
    return [x - (1 << 64) if x >> 63 else x for x in out]


def distances(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (n, lanes) fingerprints: distance to the empty pivot, and to each block's pivot."""
    zero = np.bitwise_count(lanes).astype(np.int16).sum(1)
    pivots = np.array([np.uint64(3) << np.uint64(2 * k) for k in range(BLOCKS)])
    whole = np.bitwise_count(lanes).astype(np.int16)
    table = [np.bitwise_count(lanes[:, i : i + 1] ^ pivots) + (zero - whole[:, i])[:, None] for i in range(lanes.shape[1])]
    return zero, np.concatenate(table, 1).astype(np.int16)


def tables(lanes: int, n: int = 0) -> list[list[int]]:
    """Groups of blocks that tables join on, for `n` fingerprints of one lane within two bits.

    A block's coordinate has 1.5 bits of entropy; there are as many groups as leave some `CELL`
    fingerprints in a cell, ten at most.
    """
    if lanes != 1:
        raise ValueError("wider fingerprints are joined on shingles")
    many = next((g for g in range(4, 10) if n <= CELL * 2 ** (1.5 * BLOCKS * (g - 2) / g)), 10)
    groups = [list(range(k, BLOCKS, many)) for k in range(many)]
    return [sum(chosen, []) for chosen in combinations(groups, many - 2)]


def first_shingles(h: np.ndarray, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of a sorted set: the shingles one of which any set similar by `SIMILAR` has among its own first ones.

    `common` (sorted) come last, by how often they were `seen`; else hashes order.
    """
    top, bottom = SIMILAR
    times = np.zeros(len(h), dtype=np.int64)
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        times = np.where(common[at] == h, seen[at], 0)
    return h[np.lexsort((h, times))[: len(h) - -(-top * len(h) // bottom) + 1]]


def common_shingles(named: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and how many have them."""
    rate = min(1.0, SAMPLE / max(1, named.count()))
    some = named.where(F.pmod(F.xxhash64(ROW_KEY), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def make():
        return lambda texts: [arrow_lists([np.unique(shingle_hashes(t, words))[:SAMPLE_SHINGLES] for t in texts])]

    one = map_texts(some, [], "shingles array<long>", make).select(F.explode("shingles").alias("s"))
    most = one.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "s").limit(COMMON)
    found = sorted((r.s % (1 << 64), r.n) for r in most.collect())
    return np.array([s for s, _ in found], dtype=np.uint64), np.array([n for _, n in found], dtype=np.int64)


def cell_stars(lanes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) for members of one cell that some other member is near to."""
    n = len(lanes)
    if n == 2:
        near = int(np.bitwise_count(lanes[0] ^ lanes[1]).sum()) <= radius
        return [(1, 0)] if near else []
    if n <= SMALL_CELL:
        near = np.bitwise_count(lanes[:, None] ^ lanes).sum(2, dtype=np.int16) <= radius
        pairs = zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))))
    elif n > MATRIX:
        return _walk(lanes, radius)
    else:
        pairs = _windows(lanes, radius)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in range(n) if root(x) != x]


def _windows(lanes: np.ndarray, radius: int):
    """Verified pairs: sorted by distance to the empty pivot, compared where that and all other distances allow."""
    zero, table = distances(lanes)
    order = np.argsort(zero, kind="stable")
    zero, table, lanes = zero[order], table[order], lanes[order]
    last = np.searchsorted(zero, zero + radius, side="right")
    step = max(1, 2_000_000 // max(1, len(zero)))
    for begin in range(0, len(zero), step):
        end = min(len(zero), begin + step)
        high = last[end - 1]
        i, j = np.nonzero(zero[None, begin + 1 : high] - zero[begin:end, None] <= radius)
        i, j = i + begin, j + begin + 1
        i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 500_000):
            a, b = i[k : k + 500_000], j[k : k + 500_000]
            for column in range(0, table.shape[1], max(1, table.shape[1] // 8)):  # discard by coordinate
                ok = np.abs(table[a, column] - table[b, column]) <= radius
                a, b = a[ok], b[ok]
            ok = np.bitwise_count(lanes[a] ^ lanes[b]).sum(1) <= radius
            yield from zip(order[a[ok]].tolist(), order[b[ok]].tolist())


def _walk(lanes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """cell_stars by walking from neighbour to neighbour; whoever is reached is never compared again."""
    zero, table = distances(lanes)
    columns = table[:, :: max(1, table.shape[1] // 8)]
    waiting, out = np.arange(len(lanes)), []
    while len(waiting):
        first, waiting = int(waiting[0]), waiting[1:]
        reached = [first]
        while reached and len(waiting):
            x = reached.pop()
            near = np.abs(zero[waiting] - zero[x]) <= radius
            for k in range(columns.shape[1]):  # discard by coordinate
                near[near] = np.abs(columns[waiting[near], k] - columns[x, k]) <= radius
            near[near] = np.bitwise_count(lanes[waiting[near]] ^ lanes[x]).sum(1) <= radius
            found = waiting[near].tolist()
            waiting = waiting[~near]
            reached += found
            out += [(y, first) for y in found]
    return out


def between(prints: DataFrame) -> DataFrame:
    """Links (u, v) that span the same components as all pairs of `prints` (node, f0) within two bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    near = prints.select("node", F.explode(flips).alias("flip"), "f0").select("node", F.col("f0").bitwiseXOR(F.col("flip")).alias("value"))
    least = F.min("node").over(Window.partitionBy("value"))
    return near.select(F.col("node").alias("u"), least.alias("v")).where("u != v")


def link(prints: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Links (u, v) of node ids that span all components of near fingerprints.

    `prints` has one row a different fingerprint: node, and f0.. for its lanes; if there are
    `tokens` (a list), only those that share one are compared, else all.
    """
    spark = prints.sparkSession
    small_batches(spark)
    shared = ["tokens"] if "tokens" in prints.columns else []
    groups = [] if shared else tables(lanes, prints.count())
    columns = [f"f{k}" for k in range(lanes)]

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            node = batch.column(0)
            if shared:
                tokens = batch.column(lanes + 1)
                owner = pa.array(np.repeat(np.arange(n), tokens.value_lengths().to_numpy()))
                key = tokens.flatten()
                rest = [c.take(owner) for c in batch.columns[: lanes + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), key, *rest], names=["t", "key", "node", *columns])
                continue
            fp = np.stack([batch.column(k + 1).to_numpy() for k in range(lanes)], 1).view(np.uint64) if n else np.zeros((0, lanes), np.uint64)
            zero, table = distances(fp)
            coordinate = (table - zero[:, None] + 2) // 2  # 0, 1, 2: bits of the block that are clear
            for t, group in enumerate(groups):
                key = np.zeros(n, dtype=np.int64)
                for block in group:
                    key = key * 3 + coordinate[:, block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(key), node, *batch.columns[1:]], names=["t", "key", "node", *columns]
                )

    def stars(batches):
        import pyarrow as pa

        held: list[pa.RecordBatch] = []

        def cells(table, final):
            """Links of all cells but the last, which may go on in the next batch."""
            t, key = table.column("t").to_numpy(), table.column("key").to_numpy()
            bounds = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate([[0], bounds, [len(t)]]) if len(t) else np.array([0])
            node = table.column("node").to_numpy()
            fp = np.stack([table.column(c).to_numpy() for c in columns], 1).view(np.uint64) if len(t) else None
            u, v = [], []
            stop = len(bounds) - 1 - (not final)
            for k in np.flatnonzero(np.diff(bounds[: stop + 1]) > 1):
                a, b = bounds[k], bounds[k + 1]
                for x, y in cell_stars(fp[a:b], radius):
                    u.append(node[a + x])
                    v.append(node[a + y])
            out = pa.RecordBatch.from_arrays([pa.array(np.array(u, np.int64)), pa.array(np.array(v, np.int64))], names=["u", "v"])
            return out, int(bounds[stop]) if len(t) else 0

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 50_000:
                table = pa.Table.from_batches(held).combine_chunks()
                out, done = cells(table, False)
                held = table.slice(done).to_batches()
                rows = 0
                if out.num_rows:
                    yield out
        if held:
            out, _ = cells(pa.Table.from_batches(held).combine_chunks(), True)
            yield out

    schema = "t int, key long, node long, " + ", ".join(f"{c} long" for c in columns)
    met = prints.select("node", *columns, *shared).mapInArrow(keys, schema)
    if shared:
        return met.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(stars, "u long, v long")
    met = cut(met)
    large = cut(met.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("t", "key"))
    more = None
    if large.head(1):
        more = between(met.join(large, ["t", "key"], "left_semi").select("node", "f0").distinct())
        met = met.join(large, ["t", "key"], "left_anti")
    found = met.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(stars, "u long, v long")
    return found if more is None else found.union(more)


def near_groups(docs: DataFrame, keep: list[str], words: int = 3, radius: int = 2) -> DataFrame:
    """`keep`, the fingerprint f0, root (names the component) and component_id: its smallest doc_id."""
    columns = ["f0"]

    def make():
        def work(texts):
            return list(zip(*[fingerprint(t, words) for t in texts]))

        return work

    rows = cut(map_texts(docs, keep, "f0 long", make))
    prints = cut(rows.groupBy(*columns).agg(F.min("doc_id").alias("low")).withColumn("node", F.col("f0")))
    roots = cut(components(link(prints, 1, radius)))
    joined = prints.join(roots, "node", "left").select(*columns, "low", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(least, "root").select(*columns, "root", "component_id")
    return rows.join(named, columns, "left")


def fingerprints_and_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id at the contract's setting."""
    found = near_groups(docs, ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


class ShingleSets:
    """Sorted shingle hashes of a group's members; many of them wait in a file without a name, which ends with its group."""

    def __init__(self):
        self.ends, self.held, self.file, self.mapped = [0], [], None, None

    def add(self, shingles: np.ndarray) -> None:
        self.ends.append(self.ends[-1] + len(shingles))
        self.held.append(shingles)
        if self.ends[-1] > HELD_SHINGLES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(np.concatenate(self.held).tobytes())
            self.held.clear()

    def finish(self) -> None:
        if self.file:
            self.file.write(np.concatenate([*self.held, np.zeros(1, np.uint64)]).tobytes())
            self.file.flush()
            self.mapped, self.held = np.memmap(self.file, np.uint64, "r"), []

    def __getitem__(self, k: int) -> np.ndarray:
        return self.held[k] if self.mapped is None else self.mapped[self.ends[k] : self.ends[k + 1]]


def similar_stars(lanes: np.ndarray, sets: ShingleSets, radius: int) -> list[tuple[int, int]]:
    """(member, root) that span the components of members within `radius` whose sets are similar by `SIMILAR`."""
    top, bottom = SIMILAR
    zero, size = np.bitwise_count(lanes).astype(np.int64).sum(1), np.diff(sets.ends)

    def similar(x, others):
        mine, ok = sets[x], np.zeros(len(others), dtype=bool)
        ends = np.cumsum(size[others])
        begin = 0
        while begin < len(others):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, side="right")))
            part = others[begin:end]
            tokens = np.concatenate([sets[y] for y in part])
            at = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
            shared = np.add.reduceat((mine[at] == tokens).astype(np.int64), np.cumsum(size[part]) - size[part])
            ok[begin:end] = (top + bottom) * shared >= top * (size[x] + size[part])
            begin = end
        return ok

    waiting, out = np.arange(len(lanes)), []
    while len(waiting):
        first, waiting = int(waiting[0]), waiting[1:]
        reached = [first]
        while reached and len(waiting):
            x = reached.pop()
            if not size[x]:
                continue
            near = bottom * np.minimum(size[waiting], size[x]) >= top * np.maximum(size[waiting], size[x])
            near &= np.abs(zero[waiting] - zero[x]) <= radius
            near[near] = np.bitwise_count(lanes[waiting[near]] ^ lanes[x]).sum(1) <= radius
            near[near] = similar(x, waiting[near])
            found = waiting[near].tolist()
            waiting = waiting[~near]
            reached += found
            out += [(y, first) for y in found]
    return out


def verified(groups: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Links (u, v) that span the components of similar documents. `groups`: root (of candidates), node, f0.. and its shingles.

    The members of a group of more than `GROUP` are dealt into blocks, and each pair of blocks meets in a task of its own.
    """
    columns = [f"f{k}" for k in range(lanes)]
    groups = cut(groups)
    large = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    groups = groups.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    groups = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = groups.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def compare(batches):
        import pyarrow as pa

        at, node, prints, sets = None, [], [], ShingleSets()

        def links():
            sets.finish()
            found = similar_stars(np.array(prints, dtype=np.int64).view(np.uint64), sets, radius) if len(node) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([node[x] for x, _ in found], pa.int64()), pa.array([node[y] for _, y in found], pa.int64())], names=["u", "v"]
            )

        for batch in batches:
            place = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            name = batch.column(3).to_pylist()
            fp = np.stack([batch.column(k + 4).to_numpy() for k in range(lanes)], 1) if place else None
            shingles = batch.column(lanes + 4)
            for k in range(len(place)):
                if place[k] != at:
                    if len(node) > 1:
                        yield links()
                    at, node, prints, sets = place[k], [], [], ShingleSets()
                node.append(name[k])
                prints.append(fp[k])
                sets.add(shingles[k].values.to_numpy().view(np.uint64).copy())
        if len(node) > 1:
            yield links()

    where = ["root", "low", "high"]
    dealt = groups.select(*where, "node", *columns, "shingles").repartition(*where).sortWithinPartitions(*where, "node")
    return dealt.mapInArrow(compare, "u long, v long")


#: The pipeline's setting: five-word shingles; candidates differ in 72 bits or fewer (similarity 0.8 gives some 39, 48 in the shortest texts).
PIPELINE = {"words": 5, "lanes": 4, "radius": 72}


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group: the smallest doc_id, then key."""
    words, lanes, radius = PIPELINE["words"], PIPELINE["lanes"], PIPELINE["radius"]
    columns = [f"f{k}" for k in range(lanes)]
    named = docs.select("doc_id", "text", row_key().alias(ROW_KEY))
    common, seen = common_shingles(named, words)

    def prints_of():
        from xxhash import xxh64_intdigest

        def work(texts):
            out, tokens = [], []
            for text in texts:
                h = np.unique(shingle_hashes(text, words))
                tokens.append(first_shingles(h, common, seen))
                out.append([*signed_lanes(h, lanes), xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)])
            return [*zip(*out), arrow_lists(tokens)]

        return work

    def shingles_of():
        return lambda texts: [arrow_lists([np.unique(shingle_hashes(t, words)) for t in texts])]

    rows = map_texts(named, ["doc_id", ROW_KEY], ", ".join(f"{c} long" for c in [*columns, "same"]) + ", tokens array<long>", prints_of)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW_KEY)).alias("first")
    # one row a different set of shingles: equal fingerprints alone don't make copies
    prints = cut(rows.groupBy(*columns, "same").agg(first, F.first("tokens").alias("tokens")).withColumn("node", F.xxhash64(*columns, "same")))
    candidates = cut(components(link(prints, lanes, radius)))
    members = candidates.union(candidates.select("root", "root").distinct())
    members = members.join(prints, "node").select("root", "node", *columns, f"first.{ROW_KEY}")
    groups = map_texts(named.join(members, ROW_KEY), ["root", "node", *columns], "shingles array<long>", shingles_of)
    roots = cut(components(verified(groups, lanes, radius)))
    found = prints.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    return take_rows(docs, found.groupBy("root").agg(F.min("first").alias("first")).select(f"first.{ROW_KEY}"))
