"""A text of two million characters through every operator on texts: what stands at its end counts like what stands at its beginning."""

import hashlib
import random

import pytest

from flockwatch.llm import exact_dedup, language_id, license_scan, mixing, pii, piece_fst, quality, simhash, suffix_dedup

from .test_dedup import brute_fingerprint


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(77)
    word = lambda: "".join(r.choice(("an", "er", "ti", "lo", "re", "mo", "st")) for _ in range(r.randint(1, 4)))
    words = [word() for _ in range(380_000)]
    return " ".join(words)[: 2_000_000 - 80] + " released under the mit license, write to jo@example.com or 10.1.2.3"


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    short = long_text[-600:]
    data = [(1, long_text, "en", "a"), (2, short, "en", "a"), (3, "x", "en", "b")] + [(10 + k, long_text[k * 900 : k * 900 + 800], "en", "b") for k in range(20)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string")


def first(df):
    return df.where("doc_id = 1").first()


def test_long_license(long_docs, long_text):
    r = first(license_scan.scan(long_docs))
    assert r.n_words == len(license_scan.WORD.findall(long_text.encode())) and r.n_base == 1 and r.first_word > 300_000 and r.base_labels == "mit"


def test_long_quality(long_docs):
    assert 0 <= first(quality.score(long_docs, quality.train(long_docs), ["doc_id"])).quality <= 1


def test_long_simhash(long_docs, long_text):
    assert first(simhash.fingerprints_and_components(long_docs)).fingerprint == f"{brute_fingerprint(long_text):016x}"


def test_long_mix_and_exact(long_docs, long_text):
    assert first(mixing.mix(long_docs)).size == len(long_text.split())
    assert first(exact_dedup.exact_groups(long_docs)).text_sha256 == hashlib.sha256(long_text.encode()).hexdigest()


def test_long_suffix(long_docs, long_text):
    """The short texts are passages of the long one: all of their bytes go, and as many of its own."""
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(long_docs).collect()}
    assert got[1].n_bytes == len(long_text) and got[1].n_removed == 600 + 20 * 800 and got[1].n_spans == 21
    assert got[2].n_removed == 600 and got[3].n_removed == 0 and all(got[10 + k].n_removed == 800 for k in range(20))


def test_long_pieces(long_docs, long_text):
    import public_tokenizers
    import sentencepiece

    r = first(piece_fst.encoded(long_docs, ["doc_id"], piece_fst.model_bytes()))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert r.roundtrip and r.ids == model.encode(long_text)


def test_long_personal_data(long_docs, long_text):
    r = first(pii.find(long_docs))
    at = long_text.index("jo@example.com")
    assert (r.n_email, r.n_ip) == (1, 1) and f"email:{at}:{at + 14}" in r.spans


def test_long_language(long_docs):
    r = first(language_id.identify(long_docs, {"en": "the cat sat on the mat", "it": "anerti lore most anan titi"}))
    assert r.lang_pred == "it" and 0 <= r.score <= 1
