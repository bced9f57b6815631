import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockwatch.llm import components, embedding_dedup, exact_dedup, simhash, suffix_dedup
from flockwatch.llm.common import arrow_batch, cut

from .conftest import SCHEMA, rows


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


# exact dedup


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs, capacity=4).collect()
    by = defaultdict(list)
    for row in rows():
        by[row[1] or ""].append(row[0])
    want = []
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            want.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    order = lambda r: (r[4], r[0] is None, r[0] or 0, r[3])
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)


def test_exact_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.survivors(no_docs).count() == 0


def test_exact_survivors(docs):
    got = exact_dedup.survivors(docs)
    assert got.columns == docs.columns
    texts = Counter(r.text or "" for r in got.collect())
    assert set(texts.values()) == {1} and set(texts) == {r[1] or "" for r in rows()}


def test_exact_index_files_decide(spark, docs, monkeypatch):
    """The directory doubles; each bucket is one owner's file; texts dealt to a wrong bucket would part from their group."""
    entries = cut(exact_dedup.fingerprints(docs))
    directory = exact_dedup.build_directory(entries, capacity=4)
    assert directory.depth > 2 and directory.buckets > 8
    index = exact_dedup.write_index(docs, directory)
    found = index.collect()
    texts = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows()}
    assert {r.text_sha256 for r in found} == texts and len(found) == len(texts)
    for r in found:
        assert r.bucket == directory.slots[(r.key % (1 << 64)) >> (64 - directory.depth)]
    assert len(index.inputFiles()) == len({r.bucket for r in found})
    # a directory with more buckets than there are keys for, and deals that don't follow keys
    wrong = exact_dedup._combined

    def scattered(d, owners, schema):
        def combine(batches):
            import pyarrow as pa

            for batch in wrong(d, owners, schema)(batches):
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    bucket = (row["bucket"] + row["keep_id"] if row["keep_id"] else 0) % d.buckets
                    yield pa.RecordBatch.from_pylist([row | {"bucket": bucket, "owner": bucket * owners // d.buckets}], schema=batch.schema)

        return combine

    monkeypatch.setattr(exact_dedup, "HELD", 1)
    monkeypatch.setattr(exact_dedup, "_combined", scattered)
    assert exact_dedup.write_index(docs.repartition(9), directory).count() > len(texts)


def test_exact_chains_tell_collisions_apart():
    schema = "bucket int, key long, body binary, keep_id long, n long"
    data = [(0, 5, b"x", 1, 1), (0, 5, b"y", 2, 1), (0, 5, b"x", 7, 2), (0, 6, b"z", None, 1), (1, 9, b"w", 3, 1)]
    posting = "bucket int, key long, link int, text_sha256 string, keep_id long, group_size long"
    out = [r for b in exact_dedup._chained(posting)([arrow_batch(schema, data[:2]), arrow_batch(schema, data[2:])]) for r in b.to_pylist()]
    got = {(r["key"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in out}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(5, sha(b"x")): (7, 3), (5, sha(b"y")): (2, 1), (6, sha(b"z")): (None, 1), (9, sha(b"w")): (3, 1)}
    assert sorted(r["link"] for r in out if r["key"] == 5) == [1, 2]


def test_directory_has_a_bounded_size(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    directory = exact_dedup.build_directory(keys, capacity=1, slots=64)
    assert len(directory.slots) <= 64 and directory.buckets > 16


def test_directory_splits_only_where_full():
    histogram = {k: 10 for k in range(8)} | {15: 100}
    d = exact_dedup.grow_directory(histogram, 4, 20)
    assert d.depth == 4 and len(d.slots) == 16 and list(d.slots) == sorted(d.slots)
    load = Counter()
    for cell, n in histogram.items():
        load[d.slots[cell]] += n
    assert sorted(load.values()) == [20, 20, 20, 20, 100]
    assert exact_dedup.grow_directory({}, 4, 20) == exact_dedup.Directory(0, (0,))


# simhash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.fingerprints_and_components(docs).collect()}
    data = {(r[0], f"{brute_fingerprint(r[1]):016x}") for r in rows()}
    assert set(got) == data
    prints = sorted({int(f, 16) for _, f in data})
    root = groups([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2], prints)
    least = {}
    for i, f in data:
        k = root[int(f, 16)]
        if i is not None:
            least[k] = min(least.get(k, i), i)
    assert all(c == least.get(root[int(f, 16)]) for (_, f), c in got.items())


def test_simhash_links_every_cell_size(spark, monkeypatch):
    r = random.Random(3)
    centers = [r.getrandbits(64) for _ in range(25)]
    prints = set()
    while len(prints) < 1500:
        x = r.choice(centers)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    fp = np.array(sorted(prints), dtype=np.uint64)
    want = groups([(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2) if i < j], range(len(fp)))
    for pairs in (simhash._windows(fp[:, None], 2), simhash._walk(fp[:, None], 2)):
        assert groups(pairs, range(len(fp))) == want
    df = spark.createDataFrame([(i, int(x) - (1 << 64) * (int(x) >> 63)) for i, x in enumerate(fp)], "node long, f0 long")
    assert groups([tuple(r) for r in simhash.between(df).collect()], range(len(fp))) == want
    for large in (2, 20_000):  # all cells across tasks, and none
        monkeypatch.setattr(simhash, "LARGE", large)
        assert groups([tuple(r) for r in simhash.link(df, 1, 2).collect()], range(len(fp))) == want


@pytest.mark.parametrize("n", [1000, 10**9, 10**11, 10**13])
def test_simhash_tables_miss_nothing_at_any_size(n):
    made = simhash.tables(1, n)
    touched = [set(pair) for pair in itertools.combinations(range(simhash.BLOCKS), 2)]
    assert all(any(not blocks & set(t) for t in made) for blocks in touched)
    assert max(map(len, made)) * math.log2(3) < 63 and n / 2 ** (1.5 * min(map(len, made))) < 5000


def test_simhash_more_groups(spark, docs, monkeypatch):
    plain = simhash.tables
    monkeypatch.setattr(simhash, "tables", lambda lanes, n=0: plain(lanes, 10**11))
    test_simhash(docs)


def test_simhash_tables_miss_nothing():
    r = random.Random(4)
    a = np.array([r.getrandbits(64) for _ in range(300)], dtype=np.uint64)
    b = np.array([int(x) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for x in a], dtype=np.uint64)
    keys = []
    for fp in (a, b):
        zero, table = simhash.distances(fp[:, None])
        coordinate = table - zero[:, None]
        keys.append([[tuple(row[g]) for g in simhash.tables(1)] for row in coordinate])
    assert all(any(x == y for x, y in zip(p, q)) for p, q in zip(*keys))


def test_near_copies_of_the_pipeline(docs, no_docs):
    got = simhash.survivors(docs)
    assert got.columns == docs.columns
    texts = [r.text for r in got.collect()]
    assert sum("changed" in (t or "") for t in texts) == 1
    unlike = [r[1] for r in rows()[:3] if r[1]]
    assert all(t in texts for t in unlike)
    assert simhash.survivors(no_docs).count() == 0
    assert simhash.fingerprints_and_components(no_docs).count() == 0


def similar_texts(n, seed=8):
    """Bases of 12 to 120 words with copies of every likeness, some through chains, and texts that only share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(60)]
    out = []
    for k in range(n):
        base = [word() for _ in range(r.randint(12, 120))]
        if k % 3 == 0:
            base = shared + base[: r.randint(10, 60)]
        for _ in range(4):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


def brute_near(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return set(groups(pairs, range(len(texts))).values()), pairs


@pytest.mark.parametrize("held", [100, 4_000_000])
def test_near_copies_are_verified_on_their_shingles(held, monkeypatch):
    texts = similar_texts(60)
    want, _ = brute_near(texts)
    monkeypatch.setattr(simhash, "HELD_SHINGLES", held)
    monkeypatch.setattr(simhash, "AT_ONCE", 300)
    sets, lanes = simhash.ShingleSets(), []
    for t in texts:
        h = np.unique(simhash.shingle_hashes(t.encode(), 5))
        sets.add(h)
        lanes.append(simhash.signed_lanes(h, 4))
    sets.finish()
    stars = simhash.similar_stars(np.array(lanes).view(np.uint64), sets, simhash.PIPELINE["radius"])
    assert set(groups(stars, range(len(texts))).values()) == want


def test_texts_that_share_a_passage_stay(spark):
    texts = similar_texts(60)
    want, _ = brute_near(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert want <= {r.doc_id for r in simhash.survivors(df).collect()}


@pytest.mark.parametrize("common", [0, 200])
def test_every_pair_of_near_copies_meets(common):
    texts = similar_texts(150, seed=9)
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    times = Counter(x for h in sets for x in h.tolist())
    often = sorted(times.most_common(common))
    known = np.array([x for x, _ in often], np.uint64), np.array([n for _, n in often], np.int64)
    first = [set(simhash.first_shingles(h, *known).tolist()) for h in sets]
    lanes = np.array([simhash.signed_lanes(h, 4) for h in sets]).view(np.uint64)
    _, pairs = brute_near(texts)
    assert len(pairs) > 100 and all(first[i] & first[j] for i, j in pairs)
    assert all(int(np.bitwise_count(lanes[i] ^ lanes[j]).sum()) <= simhash.PIPELINE["radius"] for i, j in pairs)
    assert len(simhash.first_shingles(np.zeros(0, np.uint64), *known)) == 0


@pytest.mark.parametrize("sample, group", [(10, 1000), (20_000, 3)])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, sample, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    texts = similar_texts(90, seed=8)
    want, _ = brute_near(texts)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.survivors(df).collect()} == want


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, small):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    got = components.components(spark.createDataFrame(pairs, "u long, v long"), small)
    want = groups(pairs, {x for p in pairs for x in p})
    assert {row.node: row.root for row in got.collect()} == {n: root for n, root in want.items() if n != root}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# suffix array


def test_suffix_array():
    r = random.Random(2)
    for _ in range(200):
        s = [r.randint(1, r.choice([2, 3, 9])) for _ in range(r.randint(0, 60))]
        assert suffix_dedup.suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_removals(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), len(suffix_dedup._runs(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, no_docs):
    got = suffix_dedup.remove_repeats(docs).collect()
    data = rows()
    want = [(d[0], *x) for d, x in zip(data, brute_removals([(d[1] or "").encode() for d in data], 400))]
    key = lambda t: (t[0] is None, t[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_anchor_of_any_size(spark, docs, monkeypatch):
    """With no room in a task, all anchors are compared by sorts across tasks; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "ONE_TASK", 0)
    test_suffix_dedup(docs, spark.createDataFrame([], docs.schema))


@pytest.mark.parametrize("length", [400, 120, 41, 11])
def test_suffix_across_tasks(spark, length):
    r = random.Random(length)
    base = bytes(r.choice(b"ab cd") for _ in range(3 * length))
    found = []
    for k in range(30):
        a = r.randint(0, length)
        body = bytes(r.choice(b"xyz") for _ in range(r.randint(0, 9))) + base[a : a + r.randint(length, 2 * length)]
        found.append((k, -k, r.randint(0, 5), 0, body))
    got = suffix_dedup.across_tasks(spark.createDataFrame(found, "k1 long, k2 long, low int, whole int, body binary"), length).collect()
    count = Counter(x[4][i : i + length] for x in found for i in range(len(x[4]) - length + 1))
    want = {(x[0], x[2] + i) for x in found for i in range(len(x[4]) - length + 1) if count[x[4][i : i + length]] > 1}
    assert {(g.k1, g.low) for g in got} == want and all(g.high - g.low == length for g in got)
    runs = suffix_dedup.compare_segments([x[4] for x in found], length)
    assert {(x[0], x[2] + i) for x, own in zip(found, runs) for a, b in own for i in range(a, b + 1)} == want


@pytest.mark.parametrize("length", [400, 120, 41, 11])
def test_suffix_segments_of_one_anchor(length):
    """Segments of one anchor by a suffix array of the anchors' places: what all windows' bytes say."""
    r, gram = random.Random(length), suffix_dedup.gram_of(length)
    for alphabet in (b"\0a", bytes(range(256))):
        common = bytes(r.choices(bytes(range(256)), k=length + length // 4))
        by_anchor = {}
        for _ in range(200):
            text = bytes(r.choices(alphabet, k=r.randrange(length))) + common[r.randrange(length // 4) :] + bytes(r.choices(alphabet, k=r.randrange(length)))
            if len(text) >= length:
                for low, high, name in zip(*(x.tolist() for x in suffix_dedup.anchors(text, length))):
                    by_anchor.setdefault(name, []).append(text[low : high + length])
        name = max(by_anchor, key=lambda k: len(by_anchor[k]))
        assert len(by_anchor[name]) > 50
        got = suffix_dedup.compare_aligned(by_anchor[name], length, gram)
        count = Counter(s[i : i + length] for s in by_anchor[name] for i in range(len(s) - length + 1))
        want = [{i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1} for s in by_anchor[name]]
        assert [{i for a, b in runs for i in range(a, b + 1)} for runs in got] == want and any(want)


def test_suffix_large_anchor_stays_in_a_task(spark, monkeypatch):
    """An anchor of more than a million bytes needs no sort across tasks, which wrote each of its places several times over."""
    def refused(*_):
        raise AssertionError("sorted across tasks")

    r = random.Random(8)
    line = "".join(r.choices("abcdefgh ", k=600))
    texts = ["".join(r.choices("xyz ", k=r.randrange(200, 300))) + line + "".join(r.choices("xyz ", k=300)) for _ in range(3000)]
    monkeypatch.setattr(suffix_dedup, "across_tasks", refused)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 3000 and all(600 <= g.n_removed < 700 and g.n_spans == 1 for g in got)


def test_suffix_sift_in_small_batches():
    """However rows are cut into batches, the same ranges and wants come out."""
    import pyarrow as pa

    r = random.Random(3)
    data = []
    for anchor in range(40):
        for _ in range(r.choice([1, 1, 2, 30])):
            s = r.randint(0, 4)
            row = (anchor, s, s, *[r.randint(0, 30)] * 2, r.randint(0, 2) * 100 + s, r.randint(0, 2) * 100 + 50)
            data += [(*row, suffix_dedup.SEGMENT)] * r.choice([1, 1, 3])
    data.sort()

    def out(step, monkey):
        batches = [suffix_dedup.arrow_batch(suffix_dedup._ROW, data[k : k + step]) for k in range(0, len(data), step)]
        got = [tuple(x.values()) for b in suffix_dedup._sift(10)(batches) for x in b.to_pylist()]
        return {(*g[:5], g[6]) for g in got}

    source = pa.Table.from_batches([suffix_dedup.arrow_batch(suffix_dedup._ROW, data)])
    assert source.num_rows == len(data)
    by = {}
    for row in set(data):
        by.setdefault(row[0], {}).setdefault(row[1], set()).add(row)
    wants = {a: len(g) for a, g in by.items() if len(g) > 1}
    ranges = {(x[0], x[3], x[5]) for g in by.values() for rows_ in g.values() if len({(x[3], x[5]) for x in rows_}) > 1 for x in rows_}
    got = out(len(data), None)
    assert {(g[0], g[1], g[3]) for g in got if not g[5]} == ranges
    assert Counter(g[0] for g in got if g[5]) == wants


def test_suffix_long_text_in_stretches(monkeypatch):
    r = random.Random(9)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    first, last, _ = suffix_dedup.anchors(text)
    assert first[0] == 0 and last[-1] == len(text) - 400 and (first[1:] == last[:-1] + 1).all()
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    first, last, _ = suffix_dedup.anchors(text)
    assert first[0] == 0 and last[-1] == len(text) - 400 and (first[1:] == last[:-1] + 1).all()


# embeddings


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((30, 16))
    near = base[:10] + r.standard_normal((10, 16)) * 0.05
    vectors = [v.tolist() for v in np.concatenate([base, near, base[:3], base[:3] * 2.5])]
    data = [(i, v) for i, v in enumerate(vectors)]
    data += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [float("inf")] + [1.0] * 15), (905, []), (906, [1.0, 2.0])]
    data.append(data[5])
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, node int, dim string")
    got = embedding_dedup.near_groups(df).collect()
    assert len(got) == len(data)
    good = [(i, np.array(v)) for i, v in data if i < 900]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= 0.95
    ids = [i for i, _ in good]
    root = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit)) if ids[a] != ids[b]], set(ids))
    degree = dict(zip(ids, (hit.sum(1) - 1).tolist()))
    for row in got:
        assert row.n_links == degree.get(row.vec_id, 0)
        assert row.component_id == root.get(row.vec_id, row.vec_id) and row.kept == (row.vec_id == row.component_id)


def test_embeddings_recall_at_the_threshold(spark):
    r = np.random.default_rng(2)
    n = 600
    a = r.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.standard_normal((n, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = r.uniform(0.9501, 0.96, n)[:, None]
    data = np.concatenate([a, a * c + b * np.sqrt(1 - c * c)]).tolist()
    got = embedding_dedup.near_groups(spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>"))
    assert sum(row.n_links for row in got.collect()) >= 0.9 * 2 * n


@pytest.mark.parametrize("width", [8, 12, 16, 20, 24, 28])
def test_embeddings_recall_at_any_width(width):
    r = np.random.default_rng(4)
    unit = r.standard_normal((6000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    a, model = unit[4096:], embedding_dedup.Quantiser(unit[:4096], width)
    b = r.standard_normal(a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = a * 0.95 + b * np.sqrt(1 - 0.95**2)
    met = (model.keys(a) == model.keys(c)).any(1)
    near = (model.bits(a)[:, :128] != model.bits(c)[:, :128]).sum(1) <= model.radius
    print(width, model.tables, model.radius, met.mean(), near.mean())
    assert (met & near).mean() >= 0.98
    assert model.tables * width <= len(model.order) and len(set(model.order.tolist())) == len(model.order)  # disjoint substrings


def test_ties_at_the_threshold(spark):
    """(19, sqrt(39)) / 20 is at cosine 0.95 of (1, 0) but for rounding; multiples of it agree with each other."""
    tie = [[0.95 * k, math.sqrt(1 - 0.95**2) * k] for k in (1.0, 3.0, 7.0)]
    below, above = [0.9499999, math.sqrt(1 - 0.9499999**2)], [0.9500001, math.sqrt(1 - 0.9500001**2)]
    x, y = [np.array(v) / np.linalg.norm(v) for v in (tie[0], [1.0, 0.0])]
    df = lambda *v: spark.createDataFrame(list(enumerate([[1.0, 0.0], *v])), "vec_id long, embedding array<double>")
    links = lambda *v: embedding_dedup.near_groups(df(*v)).where("vec_id = 0").first().n_links
    assert links(below) == 0 and links(above) == 1
    assert links(tie[0]) == links(tie[0], below) - 0 == (math.fsum(x * y) >= 0.95 * math.sqrt(math.fsum(x * x) * math.fsum(y * y)))


def test_large_cells_split(spark, monkeypatch):
    r = np.random.default_rng(3)
    one = r.standard_normal(16)
    data = [(one + r.standard_normal(16) * 0.001).tolist() for _ in range(60)]
    monkeypatch.setattr(embedding_dedup, "CELL", 7)
    got = embedding_dedup.near_groups(spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")).collect()
    assert {row.n_links for row in got} == {59} and {row.component_id for row in got} == {0}


def test_no_embeddings(spark):
    assert embedding_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
