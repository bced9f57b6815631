"""Each stage on awkward documents, and the whole against what its parts say."""

from collections import Counter

import pytest

import corpus_pipeline
from flockwatch.llm import mixing, quality
from flockwatch.llm.common import cut, take_rows

from .conftest import rows


def key(row):
    return row.doc_id, row.text


def test_stages_keep_columns_and_decide(spark, docs):
    now = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, cut(stage(spark, now, ""))
        counts.append(now.count())
        if name != "encode":
            assert now.columns == docs.columns
            assert {key(r) for r in now.collect()} <= {key(r) for r in before.collect()}
        if name in ("exact_dedup", "near_dedup"):
            assert max(Counter(r.text or "" for r in now.collect()).values()) == 1
    assert counts[0] > counts[1] > counts[2] > 0 and counts[4] == counts[3]
    assert all(r.roundtrip for r in now.collect())


def test_quality_stage_drops_what_the_classifier_rejects(spark, docs):
    got = Counter(key(r) for r in corpus_pipeline.keep_good(spark, docs, "").collect())
    model = quality.train(docs)
    want = Counter()
    for row in rows():
        raw = (row[1] or "").encode()
        s = quality.statistics(raw)
        if model.score(raw, s) >= quality.THRESHOLD:
            want[row[0], row[1]] += 1
    assert got == want


def test_exact_stage_keeps_the_largest_id(spark, docs):
    got = Counter(key(r) for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    best = {}
    for row in rows():
        text = row[1] or ""
        if text not in best or (row[0] is not None and (best[text][0] is None or row[0] > best[text][0])):
            best[text] = (row[0], row[1])
    assert got == Counter(best.values())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_nothing(spark, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    made = stage(spark, no_docs, "")
    assert made.count() == 0 and (name == "encode" or made.columns == no_docs.columns)


def test_take_rows_repeats(spark):
    from pyspark.sql import functions as F

    from flockwatch.llm.common import ROW_KEY, row_key

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    times = df.select(row_key().alias(ROW_KEY)).distinct().withColumn("n", F.lit(2))
    assert Counter(map(tuple, take_rows(df, times, "n").collect())) == {(1, "a"): 2, (1, "b"): 2, (None, "c"): 2}


def test_join_by_size(spark):
    """Broadcast for keys with many rows, a shuffle for the rest: together the plain left join."""
    from flockwatch.llm.common import join_by_size

    data = [(k, i) for k, n in ((1, 500), (2, 3), (3, 1), (None, 2)) for i in range(n)]
    rows_ = spark.createDataFrame(data, "k long, i long")
    facts = spark.createDataFrame([(1, 500, "a"), (2, 3, "b"), (9, 1, "c")], "k long, size long, what string")
    want = Counter(map(tuple, rows_.join(facts.drop("size"), "k", "left").collect()))
    for share in (2, 1000):
        assert Counter(map(tuple, join_by_size(rows_, facts, ["k"], "size", share).select("k", "i", "what").collect())) == want


def test_take_rows_names_and_ties(spark):
    """Columns named like those of the operator pass through; of rows that differ elsewhere the same one is taken each time."""
    from flockwatch.llm.common import ROW_KEY, row_key

    data = [(1, "a", "keepme", "k1", "t", x) for x in "qzbx"]
    df = spark.createDataFrame(data, "doc_id long, text string, _nth string, _row_key string, _times string, lang string").repartition(4)
    keys = df.select(row_key().alias(ROW_KEY)).distinct()
    for _ in range(3):
        assert [tuple(r) for r in take_rows(df.repartition(3), keys).collect()] == [(1, "a", "keepme", "k1", "t", "b")]


def brute_stages(data):
    """The rows after each stage but the classifier, in plain Python (the mix by its SQL, the codec by the public library); data has no rejected rows."""
    import duckdb
    import pandas as pd
    import public_tokenizers
    import sentencepiece

    best = {}
    for row in data:  # exact copies: the largest doc_id stays, null below any
        text = row.text or ""
        if text not in best or (row.doc_id is not None and (best[text].doc_id is None or row.doc_id > best[text].doc_id)):
            best[text] = row
    exact = list(best.values())
    yield exact

    def shingles(row):
        words = (row.text or "").encode().lower().split()
        return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) > 5 else frozenset([tuple(words)] if words else [])

    sets = [shingles(r) for r in exact]
    root = list(range(len(exact)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(exact)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept = {}
    for i, row in enumerate(exact):
        k = find(i)
        if k not in kept or (row.doc_id is None, row.doc_id or 0) < (kept[k].doc_id is None, kept[k].doc_id or 0):
            kept[k] = row
    near = list(kept.values())
    yield near
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r.doc_id for r in near], "Int64"), "text": [r.text for r in near], "source": [r.source for r in near]}))
    taken = {i: (n, size) for i, n, size in con.execute(f"select doc_id, taken, size from ({mixing.ORACLE})").fetchall()}
    mix = [r for r in near for n, size in [taken[r.doc_id]] if size for _ in range(int(n / size + 0.5))]
    yield mix
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    yield [(r.doc_id, tuple(model.encode(r.text or ""))) for r in mix]


def test_stages_brute_force(spark, docs):
    """From the classifier's output on, each stage against plain Python."""
    now = cut(corpus_pipeline.keep_good(spark, docs, ""))
    want = brute_stages(now.collect())
    for _, stage in corpus_pipeline.STAGES[1:4]:
        now = cut(stage(spark, now, ""))
        expected = next(want)
        assert Counter(map(key, now.collect())) == Counter(map(key, expected))
    last = corpus_pipeline.STAGES[4][1](spark, now, "").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter(next(want))


def test_near_copies_of_the_test_table(spark):
    """Recall and false links on documents with planted near copies, against all pairs that share a shingle: survivors are exactly the brute-force ones."""
    docs = cut(corpus_pipeline.drop_copies(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ""))
    sets, holders = {}, {}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(zip(*(words[k:] for k in range(5)))) if len(words) > 5 else frozenset([tuple(words)] if words else [])
        for s in sets[r.doc_id]:
            holders.setdefault(s, []).append(r.doc_id)
    shared = Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    near = {p for p, n in shared.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    far = sum(2 * n < len(sets[p[0]]) + len(sets[p[1]]) - n for p, n in shared.items())
    empty = [i for i, s in sets.items() if not s]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in [*near, *zip(empty, empty[1:])]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert len(near) >= 5 and far > 100  # there is something to find, and something to leave alone
    assert kept == {find(i) for i in sets}


def test_quality_stage_takes_any_names(spark):
    df = spark.createDataFrame([(1, "The dog and the cat were in the house, and it was good. " * 3, "x", "y")], "doc_id long, text string, _quality_kept string, __quality_votes string")
    assert corpus_pipeline.keep_good(spark, df, "").columns == df.columns


def test_run(spark):
    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and "ids" in made.columns
