import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import piece_bpe as P


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.default_model())


CASES = ["", " ", "   ", "hello  world", " a\tb\n\nc ", "\n", "\n\n a", "<s> </s> <unk>", "<0x0A>", "a" + P.MARK + "b", P.MARK * 3, "\x00\x01", "x" * 500, "ab" * 700, "$" * 999, " " * 1000, "é" * 300 + "z", "naïve café", "漢字かな交じり文", chr(0x1F44D) + chr(0x1F3FD), "e" + chr(0x301), chr(0x200B)]


@pytest.mark.parametrize("text", CASES)
def test_cases(library, encoder, text):
    ids = library.encode(text)
    assert encoder.ids(text) == ids
    assert encoder.model.decode(ids) == library.decode(ids)
    assert "".join(d for _, _, d in encoder.batch([text])[0])[1:] == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\tabcdething" + P.MARK), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_random_texts(text):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=P.default_model()), P.Encoder(P.default_model())
    assert encoder.ids(text) == library.encode(text)


def test_decode_any_ids(library, encoder):
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(259), rng.randrange(32000), 28705, 259]) for _ in range(rng.randrange(9))]
        assert encoder.model.decode(ids) == library.decode(ids)


LONG_ALPHABETS = ["x", "ab", "aehinorst", "=-_.*#$", "acgt", "aàéëñ", "".join(map(chr, range(0x4E00, 0x4E40)))]


@pytest.mark.parametrize("alphabet", LONG_ALPHABETS)
@pytest.mark.parametrize("plain", [0, P.PLAIN])
def test_long_words_take_few_rounds(encoder, library, monkeypatch, alphabet, plain):
    rounds, sure = [0], P.PieceModel._sure

    def counted(*args):
        rounds[0] += 1
        return sure(*args)

    monkeypatch.setattr(P, "PLAIN", plain)
    monkeypatch.setattr(P.PieceModel, "_sure", counted)
    rng = random.Random(1)
    for n in (2, 17, 129, 3000, 20_000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        rounds[0] = 0
        assert encoder.ids(text) == library.encode(text)
        assert rounds[0] <= 20


def test_sure_merges_keep_the_library_order(library, monkeypatch):
    """Words glued together from pieces, where many pairs compete, and runs of one symbol beside others."""
    monkeypatch.setattr(P, "PLAIN", 0)
    e, rng = P.Encoder(P.default_model()), random.Random(2)
    pieces = [p.strip(P.MARK) for p, _, t in e.model.pieces if t == P.NORMAL]
    texts = ["".join(rng.choice(pieces) * rng.choice((1, 1, 1, 2, 3, 7)) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    assert [e.ids(t) for t in texts] == library.encode(texts)


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 20)
    e = P.Encoder(P.default_model())
    texts = [f"word{i} other{i * 7} x" for i in range(100)]
    for lo in range(0, 100, 10):
        e.batch(texts[lo : lo + 10])
    assert len(e.spaced) + len(e.bare) <= 40
    assert [e.ids(t) for t in texts] == library.encode(texts)


def test_frames(spark, library):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x\ny"), (4, "long word " * 50000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in P.encode_digests(df, P.default_model()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in rows:
        ids = library.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
    full = P.encode(df, P.default_model()).where("doc_id = 1").collect()
    assert len(full) == 2 and full[0].ids == library.encode("one two") and full[0].decoded == "one two"
    assert P.encode_digests(df.where("false"), P.default_model()).count() == 0
