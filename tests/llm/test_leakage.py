import pickle
import random

import numpy as np
import regex

from querndal.llm.leakage import ItemIndex, leaked_items, normal

TOKEN = regex.compile(r"[぀-ヿ㐀-鿿]|(?:(?![぀-ヿ㐀-鿿])[\p{L}\p{N}])+")


def brute(docs, items, run=12):
    grams = lambda t: {tuple(w[i : i + run]) for w in [TOKEN.findall(normal(t))] for i in range(len(w) - run + 1)}
    of = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i in of if grams(t) & of[i]}


def data(seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "of"] * 20 + [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(5, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "一二三四五六七八九十甲乙丙丁"), (63, "the of " * 12)]
    docs = []
    for d in range(150):
        w = text(rng.randint(0, 120))
        if d % 3 == 0:
            source = rng.choice(items[:60])[1].split()
            k = rng.randrange(len(source))
            cut = source[k : k + rng.choice([11, 12, 13, 40])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in cut]
        docs.append((d, " ".join(w)))
    docs += [(150, None), (151, ""), (152, "说：一二三四五六七八九十甲乙，"), (152, "说：一二三四五六七八九十甲乙，"), (153, "Ｗ１ " * 3), (154, " ".join(text(60000)) + " " + items[3][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, doc_id string")
    want = brute(docs, items)
    assert {tuple(r) for r in leaked_items(d, i).collect()} == want
    assert {tuple(r) for r in leaked_items(d, i, max_index_chars=3000).collect()} == want
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_retrieval_is_that_of_all_scores():
    """Pivot and block maxima leave out no passage and item above the threshold."""
    docs, items = data()
    index = ItemIndex([i for i, _ in items], [t for _, t in items], 12, block=4)
    dense = np.zeros((len(index.vocabulary), index.n))
    dense[index.code // index.n, index.code % index.n] = index.weight
    rng = np.random.default_rng(3)
    pick = [np.unique(rng.integers(0, len(index.vocabulary), 40)) for _ in range(60)]
    pick += [np.unique(index.code[index.code % index.n == j] // index.n) for j in range(0, index.n, 3)]
    p, slot = index.retrieve(np.concatenate(pick), np.repeat(np.arange(len(pick)), [len(x) for x in pick]), len(pick))
    scores = np.stack([dense[x].sum(0) for x in pick])
    sure = {(a, b) for a, b in zip(*np.nonzero(scores >= index.thresholds[: index.n] * (1 + 1e-6)), strict=True)}
    assert sure <= set(zip(p.tolist(), slot.tolist(), strict=True)) and len(p) == len(set(zip(p, slot, strict=True)))
    assert (scores[p, slot] >= index.thresholds[slot] * (1 - 1e-6)).all()
    for code, most in zip(index.block_code, index.block_max, strict=True):
        term, c = divmod(int(code), index.blocks)
        assert dense[term, 4 * c : 4 * c + 4].max() == most


def test_many_items_fit_one_small_index():
    """The index grows with the items' tokens, not with tokens times items."""
    items = [" ".join(f"t{(7 * i + j * j) % 5000}" for j in range(20)) for i in range(20_000)]
    index = ItemIndex(list(range(len(items))), items, 12)
    assert len(pickle.dumps(index)) < 80 * 20 * len(items)
