import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querndal.operators import filters as FL

FIELDS = [{"name": "size", "description": "", "type": "integer"}, {"name": "title", "description": "", "type": "string"}, {"name": "bad"}]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(0, "a", "x/one.txt", "alpha beta", {"size": "5", "title": "Big News"}), (1, "b", "y\\two.txt", "beta", {"size": "oops"}), (2, "c", None, None, None), (3, "a", "./one.txt", "gamma alpha", {"size": " 9 ", "title": "old"})]
    return spark.createDataFrame(rows, "ord bigint, ids string, source string, docs string, metadatas map<string,string>").cache()


def ords(df):
    return sorted(r.ord for r in df.collect())


def test_simple_filters(spark, chunks):
    assert ords(FL.by_file(chunks, ["z/one.txt"])) == [0, 3] and ords(FL.drop_file(chunks, "one.txt")) == [1, 2]
    assert {(r.ord, r.keyword_no) for r in FL.by_keyword(chunks, ["gamma", "beta"]).collect()} == {(0, 1), (1, 1), (3, 0)}
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "ids string")
    assert ords(FL.by_ids(chunks, ids)) == [0, 3] and ords(FL.pop_ids(chunks, ids)) == [1, 2]


@pytest.mark.parametrize(
    "expression,want",
    [("gt(size, 5)", [3]), ("GTE(size, 5)", [0, 3]), ("ne(size, 5)", [3]), ("eq(title, news)", [0]), ("or(eq(title, OLD), lte(size, 5))", [0, 3]), ("and(eq(title, old), lte(size, 5))", []), ("AND(gte(size, 1), or(eq(title, big), eq(title, zzz)))", [0]), ("", [0, 1, 2, 3]), ("NO_FILTER", [0, 1, 2, 3]), ("eq(unknown, 1)", [])],
)
def test_language(chunks, expression, want):
    assert ords(FL.by_metadata(chunks, expression, FIELDS)) == want


def test_matched_and_loose(chunks):
    rows = {r.ord: r.matched_fields for r in FL.by_metadata(chunks, "and(eq(title, old), lte(size, 5))", FIELDS, loose=True).collect()}
    assert rows == {0: ["size"], 3: ["title"]}
    rows, q = FL.self_query(chunks, "p", FIELDS, lambda p, f: 'Sure: {"query": "q", "filter": "eq(title, \\"old\\")"}')
    assert ords(rows) == [3] and q == "q"
    assert ords(FL.self_query(chunks, "p", FIELDS, lambda p, f: "no json")[0]) == [0, 1, 2, 3]


@pytest.mark.parametrize("bad", ["eq(a)", "foo(a, 1)", "eq(a, 1", "eq(a, b, c)", "and(eq(a, 1),)"])
def test_errors(bad):
    with pytest.raises(ValueError):
        FL.parse(bad)


leaf = st.builds(FL.Leaf, st.sampled_from(list(FL.COMPARATORS)), st.sampled_from(["a", "b"]), st.sampled_from(["1", "2"]))
tree = st.recursive(leaf, lambda x: st.builds(lambda op, parts: FL.Node(op, tuple(parts)), st.sampled_from(["and", "or"]), st.lists(x, min_size=1, max_size=3)), max_leaves=6)


def show(t):
    return f"{t.op}({t.attribute}, {t.value})" if isinstance(t, FL.Leaf) else f"{t.op}({', '.join(map(show, t.parts))})"


@settings(max_examples=60, deadline=None)
@given(tree)
def test_parse_reads_what_is_written(t):
    assert FL.parse(show(t)) == t and len(FL.leaves(FL.loosen(t))) == len(FL.leaves(t))
