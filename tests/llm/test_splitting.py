import functools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querndal.llm.splitting import _SPACE, BALANCED, LEXICOGRAPHIC, boundary_kinds, cut_pieces, digits_or, split_oversized


def rule(text, size, overlap):
    """The stated rule, place by place."""
    space = lambda c: _SPACE[ord(c)]
    kinds = [lambda p: text[p - 1] == "\n", lambda p: text[p - 1] in "。！？" or (text[p - 1] in ".!?" and p < len(text) and space(text[p])), lambda p: space(text[p - 1])]
    out, s = [], 0
    while len(text) - s > size:
        window = range(s + size, s + size // 2, -1)
        e = next((p for k in kinds for p in window if k(p)), s + size)
        out.append((s, e))
        s = max(s + 1, e - overlap)
    return [*out, (s, len(text))] if text else []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n。!　", max_size=120), st.integers(1, 25), st.integers(0, 9))
def test_greedy_rule(text, size, overlap):
    if len(text) > size:
        assert cut_pieces(text, size, overlap) == rule(text, size, overlap)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n。", min_size=1, max_size=60), st.integers(4, 20), st.integers(0, 3))
def test_balanced_pieces_are_valid(text, size, overlap):
    pieces = cut_pieces(text, size, overlap, BALANCED)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= size for s, e in pieces)
    assert all(b[0] == max(a[0] + 1, a[1] - overlap) for a, b in zip(pieces, pieces[1:], strict=False))


def dearest(text, size, overlap):
    """The least total cost over all paths, by plain recursion."""
    kinds, n = boundary_kinds(text), len(text)

    @functools.cache
    def v(s):
        if n - s <= size:
            return 2 * (1 - (n - s) / size) ** 2
        window = [e for e in range(s + size // 2 + 1, s + size + 1) if kinds[e] < 3] or [s + size]
        return min(BALANCED.kinds[kinds[e]] + 2 * (1 - (e - s) / size) ** 2 + v(max(s + 1, e - overlap)) for e in window)

    return v(0)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcd. \n。", min_size=1, max_size=90), st.integers(2, 20), st.integers(0, 14))
def test_balanced_is_the_least_of_all_paths(text, size, overlap):
    kinds, n = boundary_kinds(text), len(text)
    pieces = cut_pieces(text, size, overlap, BALANCED)
    cost = sum((BALANCED.kinds[kinds[e]] if e < n else 0) + 2 * (1 - (e - s) / size) ** 2 for s, e in pieces)
    assert n <= size or abs(cost - dearest(text, size, overlap)) < 1e-9


def test_long_texts_end_soon():
    began = time.time()
    for text in ("word " * 200_000, "x" * 1_000_000, "one. two\n" * 100_000):
        for costs in (LEXICOGRAPHIC, BALANCED):
            assert cut_pieces(text, 1000, 100, costs)[-1][1] == len(text)
    assert cut_pieces("word " * 20_000, 1000, 900)[-1][1] == 100_000
    assert time.time() - began < 60


def test_balanced_is_no_dearer_than_greedy():
    rng = random.Random(5)
    for _ in range(30):
        text = "".join(rng.choice("abcde. \n") for _ in range(200))
        kinds = boundary_kinds(text)
        cost = lambda ps, kinds=kinds: sum((BALANCED.kinds[kinds[e]] if e < 200 else 0) + 2 * (1 - (e - s) / 40) ** 2 for s, e in ps)
        assert cost(cut_pieces(text, 40, 5, BALANCED)) <= cost(cut_pieces(text, 40, 5)) + 1e-9


def test_table(spark):
    rows = [(1, "x" * 50, {"chunk_size": " 20 ", "chunk_overlap": "5"}), (2, None, None), (3, "", {}), (4, "y" * 1001, None), (5, "é" * 10, {"chunk_size": "auto"}), (6, "😀 " * 20, {"chunk_size": "10", "chunk_overlap": "99"}), (6, "z" * 30, {"chunk_size": "0"}), (7, "w" * 30, {"chunk_size": "99999999999999999999999"})]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "ord bigint, docs string, metadatas map<string,string>, text string")
    size, overlap = (F.try_element_at("metadatas", F.lit(k)) for k in ("chunk_size", "chunk_overlap"))
    out = split_oversized(df, "ord", "docs", digits_or(size, 1000, 1), digits_or(overlap, 100, 0)).collect()
    by = {}
    for r in out:
        by.setdefault(r.ord, []).append((r.piece_no, r.start_at, r.end_at))
    assert by[1] == [(0, 0, 20), (1, 15, 35), (2, 30, 50)] and by[4] == [(0, 0, 1000), (1, 900, 1001)]
    assert set(by) == {1, 4, 6} and by[6][-1][2] == 40
    assert split_oversized(df.limit(0), "ord", "docs", digits_or(size, 1000, 1), digits_or(overlap, 100, 0)).count() == 0


@pytest.mark.parametrize("text", ["", "abc"])
def test_short(text):
    assert cut_pieces(text, 10, 2) == ([(0, 3)] if text else [])
