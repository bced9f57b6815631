"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation is learned so that the signs of rotated principal components are balanced and
lose little (iterative quantisation); several rotations make a binary code. The code is cut
into disjoint substrings, one table each, that key vectors by their substring: two codes that
differ in fewer bits than there are tables share a substring for certain. Vectors that share
one are candidates if their sketches (the code's first `SKETCH` bits) are within a Hamming
radius, and are reranked with the original vectors by cosine in double precision. A pair is
counted in the first table where it meets, so links are counted once without listing them.

Substrings are a few bits shorter than the logarithm of the number of vectors, so a cell has
some `2**SLACK` of them. Pairs at cosine 0.95 are made from a part of the sample that no
rotation is learned from; there are so many tables (and rotations) that the share of these
pairs that share no substring is `MISS` or less, and the radius is where their sketches
end, whatever the number of vectors. Pairs above the threshold are missed less.

Scale: equal vectors are one row, with a weight, before anything is joined. Tables move
codes' sketches only, 16 bytes a vector and table; members of a cell that no other is near to
end there, and vectors are fetched for the rest. Cells of more than `CELL` rows are split into
pairs of blocks that are compared by separate tasks. A cell passes on counts and one star for
each component in it. Rotations are learned from at most `SAMPLE` vectors (a documented
bound) by hash; all vectors are indexed. Codes are computed once and carried.

Defined results: null vectors, zero vectors, and those with null or non-finite components
link with nothing; vectors of different lengths never link; cosines within 1e-9 of the
threshold are summed without rounding errors before they are compared, so ties don't depend on
where they are met; rows that repeat a vec_id each get a row; a null vec_id is never the
smallest unless its component has no other. Further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_size, small_batches, tidy
from .components import components

COSINE = 0.95
#: Bits by which substrings are shorter than the logarithm of the number of vectors, and their least and largest length.
SLACK, LEAST_WIDTH, MOST_WIDTH = 4, 6, 28
LEAST_TABLES, SKETCH = 8, 128
MISS = 0.01
#: Learned rotations of few dimensions differ little from each other; beyond so many, drawn ones follow.
LEARNED, MOST_ROTATIONS = 6, 400
SAMPLE = 8192
CELL = 2048
SEED = 7


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """Iterative quantisation of the rows of `x`: principal axes turned so that signs fit best."""
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def pairs_at(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `unit`, and the same turned to `cosine`: towards other rows, and anywhere."""
    r = np.random.default_rng(SEED)
    unit = unit[:2048]
    left, right = [], []
    for b in (unit[r.permutation(len(unit))], r.standard_normal(unit.shape)):
        b = b - (unit * b).sum(1)[:, None] * unit
        long = np.linalg.norm(b, axis=1)
        some = long > 1e-6
        left.append(unit[some])
        right.append(unit[some] * cosine + b[some] / long[some][:, None] * math.sqrt(1 - cosine**2))
    return np.concatenate(left), np.concatenate(right)


class Quantiser:
    """Rotations of one vector length, and the order in which their bits make substrings.

    The mean stays in: cosine is about angles at the origin, and where all vectors lie close
    together signs around their mean would be noise.
    """

    def __init__(self, sample: np.ndarray, width: int, cosine: float = COSINE):
        d = sample.shape[1]
        self.width = width
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        # tables are counted on rows that no rotation has been fitted to: their bits differ more
        held = np.random.default_rng(SEED).permutation(len(unit))[: len(unit) // 4] if len(unit) >= 64 else np.arange(0)
        apart, unit = (unit[held], np.delete(unit, held, 0)) if len(held) else (unit, unit)
        x, y = pairs_at(apart, cosine)
        self.rotation = np.zeros((d, 0))
        turns, enough = max(1, -(-max(SKETCH, LEAST_TABLES * width) // d)), False
        while not enough and turns <= MOST_ROTATIONS:
            made = self.rotation.shape[1] // d
            more = [learn_rotation(unit, SEED + k) if k < LEARNED else self._drawn(d, k) for k in range(made, turns)]
            self.rotation = np.concatenate([self.rotation, *more], 1)
            bits = self.rotation.shape[1]
            self.order = np.random.default_rng(SEED).permutation(bits)
            self.tables = bits // width
            if not len(x):
                break
            same = self.keys_of(self.bits(x)) == self.keys_of(self.bits(y))
            unmet = 1 - np.maximum.accumulate(same, axis=1).mean(0)
            enough = unmet[-1] <= MISS
            if enough:
                self.tables = max(LEAST_TABLES, int(np.argmax(unmet <= MISS)) + 1)
            turns += max(1, turns // 4)
        self.order = self.order[: max(SKETCH, self.tables * width)]
        self.radius = SKETCH
        if len(x):
            differ = (self.bits(x)[:, :SKETCH] != self.bits(y)[:, :SKETCH]).sum(1)
            self.radius = int(max(differ.max(), differ.mean() + 5 * differ.std()))

    @staticmethod
    def _drawn(d: int, k: int) -> np.ndarray:
        return np.linalg.qr(np.random.default_rng(SEED + 1000 + k).standard_normal((d, d)))[0]

    def bits(self, unit: np.ndarray) -> np.ndarray:
        """The code of each vector, a column a bit."""
        return (unit @ self.rotation >= 0)[:, self.order]

    def keys_of(self, bits: np.ndarray) -> np.ndarray:
        """The substring of each code in each table, as a number."""
        place = 1 << np.arange(self.width, dtype=np.int64)
        return bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width) @ place

    def keys(self, unit: np.ndarray) -> np.ndarray:
        return self.keys_of(self.bits(unit))


def _usable():
    """Non-null, all components finite numbers, not all zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, kind=np.float64) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def quantisers(classes: DataFrame, cosine: float = COSINE) -> dict[int, Quantiser]:
    """One for each vector length that occurs."""
    out = {}
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        rate = min(1.0, SAMPLE / n)
        mine = classes.where((F.col("dim") == dim) & (F.pmod("h1", F.lit(1 << 30)) < int(rate * (1 << 30))))
        if not (rows := [r.embedding for r in mine.select("embedding").orderBy("embedding").collect()]):
            rows = [r.embedding for r in classes.where(F.col("dim") == dim).limit(1).collect()]
        width = min(MOST_WIDTH, max(LEAST_WIDTH, round(math.log2(n + 1)) - SLACK))
        out[dim] = Quantiser(_unit(np.array(rows, dtype=np.float64)), width, cosine)
    return out


_PLACE = ["dim", "t", "key", "low", "high"]


def _cells(batches, work):
    """What `work(rows, places, bounds)` makes of the cells (rows of equal `_PLACE`) of sorted batches; cells stay whole across batches."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    size = 0

    def run(final):
        nonlocal held, size
        table = pa.Table.from_batches(held).combine_chunks()
        where = np.stack([table.column(c).to_numpy().astype(np.int64) for c in _PLACE], 1)
        bounds = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, [len(where)]])
        stop = len(bounds) - 1 - (not final)
        done = int(bounds[stop])
        out = work(table.slice(0, done).combine_chunks(), where, bounds[: stop + 1]) if done else None
        held = table.slice(done).to_batches() if not final else []
        size = 0
        return out

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= 4 * CELL:
            out = run(False)
            if out is not None:
                yield out
    if held:
        out = run(True)
        if out is not None:
            yield out
    tidy()


def _within(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which sketches (two words each) of `left` and `right` are within the radius."""
    apart = np.bitwise_count(left[:, 0][:, None] ^ right[:, 0][None, :])
    return apart + np.bitwise_count(left[:, 1][:, None] ^ right[:, 1][None, :]) <= radius


def search(classes: DataFrame, models: dict[int, Quantiser], cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(node, links) with links counted by weight, and spanning links (u, v)."""
    import pyarrow as pa

    small_batches(classes.sparkSession)

    def coded(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                bits = models[int(dim)].bits(_unit(_matrix(part.column("embedding"))))
                keys = models[int(dim)].keys_of(bits).astype(np.int32)
                sketch = np.ascontiguousarray(np.packbits(bits[:, :SKETCH], axis=1)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                columns = [part.column("node"), part.column("dim"), part.column("weight"), part.column("embedding"), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "dim", "weight", "embedding", "keys", "s1", "s2"])

    rows = classes.select("node", "dim", "weight", "embedding")
    rows = cut(rows.mapInArrow(coded, "node long, dim int, weight long, embedding array<double>, keys array<int>, s1 long, s2 long"))
    entries = rows.select("node", "dim", "s1", "s2", F.posexplode("keys").alias("t", "key"))
    large = entries.groupBy("dim", "t", "key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    placed = (
        entries.join(large, ["dim", "t", "key"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "s1", "s2")
    )
    sides = lambda members, own, low, high: (members, members) if low == high else (members[own[members] == low], members[own[members] == high])

    def active(batches):
        """Members of cells that some other member is near to."""

        def work(table, where, bounds):
            own, node = table.column("own").to_numpy(), table.column("node").to_numpy()
            sketch = np.stack([table.column(c).to_numpy() for c in ("s1", "s2")], 1).view(np.uint64)
            near = np.zeros(len(own), dtype=bool)
            for begin, end in zip(bounds[:-1][np.diff(bounds) > 1], bounds[1:][np.diff(bounds) > 1]):
                dim, _, _, low, high = where[begin]
                left, right = sides(np.arange(begin, end), own, low, high)
                hit = _within(sketch[left], sketch[right], models[int(dim)].radius)
                if low == high:
                    np.fill_diagonal(hit, False)
                near[left] |= hit.any(1)
                near[right] |= hit.any(0)
            keep = np.flatnonzero(near)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*[table.column(c).to_numpy() for c in _PLACE], own, node)], names=[*_PLACE, "own", "node"])

        yield from _cells(batches, work)

    cell = "dim int, t int, key int, low int, high int, own int, node long"
    some = placed.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(active, cell)
    full = some.join(rows.drop("dim"), "node")

    def compare(batches):
        def work(table, where, bounds):
            node, weight, own = (table.column(c).to_numpy() for c in ("node", "weight", "own"))
            sketch = np.stack([table.column(c).to_numpy() for c in ("s1", "s2")], 1).view(np.uint64)
            out_node, out_links, out_to = [], [], []
            dims = where[: bounds[-1], 0]
            for dim in np.unique(dims):
                rows_of = np.flatnonzero(dims == dim)
                a, b = rows_of[0], rows_of[-1] + 1  # sorted by dim
                x = _unit(_matrix(table.column("embedding").slice(a, b - a).combine_chunks()))
                keys = _matrix(table.column("keys").slice(a, b - a).combine_chunks(), np.int32)
                for k in np.flatnonzero(np.diff(bounds) > 1):
                    begin, end = bounds[k], bounds[k + 1]
                    if not a <= begin < b:
                        continue
                    _, t, _, low, high = where[begin]
                    left, right = sides(np.arange(begin, end), own, low, high)
                    i, j = _linked(x, keys, sketch[a:b], int(t), left - a, right - a, cosine, models[int(dim)].radius)
                    if not len(i):
                        continue
                    i, j = i + a, j + a
                    count = np.bincount(i - begin, weight[j], end - begin)
                    if low != high:
                        count += np.bincount(j - begin, weight[i], end - begin)
                    met = np.flatnonzero(count)
                    out_node += node[begin + met].tolist()
                    out_links += count[met].astype(np.int64).tolist()
                    out_to += _stars(node, i, j)
            u, v = [p for p, _ in out_to], [q for _, q in out_to]
            columns = [pa.array(out_node + u, pa.int64()), pa.array(out_links + [0] * len(u), pa.int64()), pa.array([None] * len(out_node) + v, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["node", "links", "other"])

        yield from _cells(batches, work)

    met = cut(full.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(compare, "node long, links long, other long"))
    counts = met.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    return counts, met.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))


def _linked(x, keys, sketch, t: int, left: np.ndarray, right: np.ndarray, cosine: float, radius: int):
    """Pairs of `left` and `right` rows that are near, meet in table `t` first, and reach the cosine."""
    value = x[left] @ x[right].T
    hit = (value >= cosine - 1e-9) & _within(sketch[left], sketch[right], radius)
    hit &= left[:, None] != right[None, :]
    i, j = np.nonzero(hit)
    tie = np.abs(value[i, j] - cosine) <= 1e-9
    i, j = left[i], right[j]
    ok = np.ones(len(i), dtype=bool)
    for step in range(0, len(i), 1 << 18):  # no earlier table has both
        s = slice(step, step + (1 << 18))
        ok[s] = ~(keys[i[s], :t] == keys[j[s], :t]).any(1)
    for k in np.flatnonzero(ok & tie):
        a, b = x[i[k]], x[j[k]]
        ok[k] = math.fsum(a * b) >= cosine * math.sqrt(math.fsum(a * a) * math.fsum(b * b))
    return i[ok], j[ok]


def _stars(node, i, j) -> list[tuple[int, int]]:
    """Links that span the components of the pairs (i, j): one for each node that is not a root."""
    parent: dict[int, int] = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(node[i].tolist(), node[j].tolist()):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in parent if root(x) != x]


def near_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select("vec_id", F.when(_usable(), F.col("embedding").cast("array<double>")).alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(SEED), "embedding").alias("h2"))
    classes = (
        rows.where("embedding is not null")
        .groupBy("h1", "h2", "embedding")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
        .withColumn("dim", F.size("embedding"))
    )
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers hold as the table is written
    models = quantisers(classes, cosine)
    if not models:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    counts, links = search(classes, models, cosine)
    roots = cut(components(links))
    named = (
        classes.select("node", "h1", "h2", "weight", "low")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("h1", "h2", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "low", F.coalesce("root", "node").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", "n_links", "component_id", "weight")
    usable = F.col("embedding").isNotNull()
    own = rows.select("vec_id", usable.alias("usable"), "h1", "h2")
    found = join_by_size(own.where("usable"), named, ["h1", "h2"], "weight").select("vec_id", "n_links", "component_id")
    found = found.unionByName(own.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "vec_id").cast("long")
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


#: Compares all pairs, so the SQL suits small tables only.
ORACLE = f"""
with recursive v as (
  select row_number() over () as r, vec_id, embedding::double[] as e,
         embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
         and list_bool_or(list_transform(embedding, lambda x: x <> 0)) as usable
  from embeddings),
l as (
  select a.r as a, b.r as b from v a join v b on a.r <> b.r and a.usable and b.usable and len(a.e) = len(b.e)
  where case when a.usable and b.usable and len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) end >= {COSINE}),
reach(a, b) as (select r, r from v union select reach.a, l.b from reach join l on l.a = reach.b),
c as (select reach.a as r, min(v.vec_id) as component_id from reach join v on v.r = reach.b group by 1),
n as (select a as r, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id::bigint as component_id, vec_id is not distinct from component_id as kept
from v join c using (r) left join n using (r)"""
