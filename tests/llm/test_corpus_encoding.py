import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querndal.llm.corpus_encoding import WORD_PATTERN, Merges, encode_corpus, encode_texts
from querndal.runtime import default_tokenizer_file

PATH = default_tokenizer_file("byte_bpe_50k.json")
MERGES, PATTERN = Merges(PATH), regex.compile(WORD_PATTERN)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids(texts):
    flat, offsets = encode_texts(texts, MERGES, PATTERN)
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_as_the_library_encodes(texts):
    assert ids(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["a" * 5001, "ab" * 3000, " " * 999, "<|endoftext|> and\x00\x01", "it's we'll DON'T", "無法回答這個問題。" * 40, "aaaa aaaaa aaaaaaa"])
def test_long_and_odd(text):
    assert ids([text, None, ""]) == [LIBRARY.encode(text, add_special_tokens=False).ids, [], []]


def test_table(spark):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (None, ""), (3, "x" * 100_000)]
    df = spark.createDataFrame([(*r, [5]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = encode_corpus(df, "doc_id", "text", PATH, stretch_bytes=50).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in got) == sorted((str(i), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
