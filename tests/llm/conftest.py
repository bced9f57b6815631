import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, votes string, spans string"


def rows(seed=1):
    """Small documents with every awkward case: nulls, blanks, repeats, copies, near copies, long texts, clashing columns."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "ti", "lo", "re", "é", "ß")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() + r.choice(("", "", ",", ".")) for _ in range(n))
    shared = prose(90)
    texts = [prose(r.randint(1, 200)) for _ in range(40)]
    texts += [texts[3]] * 5 + [texts[4]] * 2
    texts += [prose(30) + " " + shared + " " + prose(20) for _ in range(4)]
    near = prose(160).split(" ")
    for k in range(4):
        copy = list(near)
        copy[20 * k] = "changed"
        texts.append(" ".join(copy))
    texts += ["", "   ", None, None, "one", "one two", "Released under the MIT License.", "x" * 5000, "日本語 テキスト", prose(4000)]
    texts += ["aaaa " * 200, "mail bob.b@example.com +1 (555) 123-4567 10.1.2.3 4111 1111 1111 1111", "HELLO!! " * 40]
    out = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}"
        out.append((i, t, None if i % 13 == 0 else "en", source, len(t or ""), 7, "k", "v", "s"))
    out.append(out[2])  # the same row again
    out.append((None, "no id at all, but text", "en", "s1", 1, 7, "k", "v", "s"))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
