import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from querndal.llm.tokens import Tokens, band_keys, minhash

TOKEN = regex.compile(r"[぀-ヿ㐀-鿿]|(?:(?![぀-ヿ㐀-鿿])[\p{L}\p{N}])+")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .\nカ漢é٣-", max_size=30), max_size=8))
def test_tokens_as_the_pattern_has_them(texts):
    t = Tokens(texts)
    want = [TOKEN.findall(x) for x in texts]
    assert t.counts().tolist() == [len(w) for w in want]
    names: dict = {}
    for w, h in zip([w for ws in want for w in ws], t.hash.tolist(), strict=True):
        assert names.setdefault(h, w) == w
    assert len(names) == len({w for ws in want for w in ws})


def test_shingles_keep_to_their_text():
    t = Tokens(["a b c d e f", "", "a b c d e", "a b"])
    grams, offsets = t.shingles(5)
    assert np.diff(offsets).tolist() == [2, 0, 1, 0]
    assert grams[0] == grams[2]


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    m = minhash(np.concatenate([a, b]), np.array([0, 400]), 600)
    assert abs((m[0] == m[1]).mean() - 300 / 500) < 0.08
    assert band_keys(m, 3).shape == (2, 200)
