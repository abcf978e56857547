import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from querndal.llm.site_lines import repeated_lines, site_of, strip_repeated_lines


def records(spark, rows):
    return spark.createDataFrame([(i, d, m, "clash") for i, (d, m) in enumerate(rows)], "ord bigint, docs string, metadatas map<string,string>, site string")


def test_sites(spark):
    cases = [("https://WWW.Help.X.test:8080/a", None, "h:help.x.test"), (None, ".\\docs\\a\\b.pdf", "d:docs/a"), (None, "./docs/a.pdf", "d:docs"), (None, "a.pdf", None), (None, None, None), ("http://u@h.test?q", "x/y", "h:h.test")]
    df = records(spark, [("", {k: v for k, v in (("url", u), ("source", s)) if v}) for u, s, _ in cases])
    assert [r[0] for r in df.orderBy("ord").select(site_of(F.col("metadatas"))).collect()] == [c[2] for c in cases]


def brute(rows):
    seen, n, at = defaultdict(set), defaultdict(int), []
    for i, (docs, m) in enumerate(rows):
        if not m or "url" not in m:
            continue
        site = m["url"]
        n[site] += 1
        for k, line in enumerate((docs or "").split("\n") if docs is not None else []):
            key = re.sub(r"\s+", " ", re.sub("[0-9]+", "0", line.lower())).strip()
            if key:
                seen[site, key].add(i)
                at.append((i, k, site, key))
    return {(i, k) for i, k, s, key in at if len(seen[s, key]) >= 5 and 10 * len(seen[s, key]) >= n[s]}


def test_equals_brute_force_with_a_hot_site(spark):
    a, b = {"url": "http://a.test/1"}, {"url": "http://b.test/1"}
    rows = [(f"Notice {i}  of the DAY\n\nline {chr(97 + i % 26) * 3} {i}\t\nx y{i}z\n  notice 7 of the day", a) for i in range(60)]
    rows += [("only four\nhere", b)] * 4 + [("only four times\nhere ", b)] + [(None, b), ("", b), (" \n\r\n", b)]
    rows += [("Share | Print\n" + "\n".join(f"body {i} {j} {chr(97 + j % 26)}" for j in range(300)), a) for i in range(12)]
    rows += [("Notice 1 of the day", None), ("Notice 1 of the day", {})]
    rows += [(t, {"url": "http://c.test/1"}) for t in ("Share This", "share this", "SHARE THIS \u0130", "SHARE  THIS", "share This", "sHARE tHIS")]
    got = [tuple(r) for r in repeated_lines(records(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_cluster_of_almost_equal_lines(spark):
    """Without the exact check, lines that differ by names only form one cluster."""
    names = ["Anna", "Berta", "Clara", "Dora", "Emma", "Flora"]
    rows = [(f"Thanks for reading, yours {n} from the old mill by the river\nunlike {i * 7919} {n}", {"url": "http://a.test/1"}) for i, n in enumerate(names)]
    df = records(spark, rows)
    assert repeated_lines(df).count() == 0
    assert {(i, 0) for i in range(6)} <= {tuple(r) for r in repeated_lines(df, exact=False).collect()}


def test_recall_of_clusters(spark):
    """Byline variants of one site at a word similarity of 0.8 or more are removed, other lines are kept."""
    rng = random.Random(4)
    words = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.choice("qrstuvwxyz")) * rng.randint(1, 6) for _ in range(n)]
    bylines = [words(14) for _ in range(20)]
    rows, planted, other = [], set(), set()
    for i in range(40):
        lines = []
        for b in bylines:
            w = list(b)
            w[rng.randrange(len(w))] = f"Anna{i} {i}"  # a name and a number are masked
            lines.append(" ".join(w))
            planted.add((i, len(lines) - 1))
        for _ in range(20):
            lines.append(" ".join(words(12)))
            other.add((i, len(lines) - 1))
        rows.append(("\n".join(lines), {"url": "http://a.test/1"}))
    got = {tuple(r) for r in repeated_lines(records(spark, rows), exact=False).collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got & other) <= 0.02 * len(other)


def test_a_cluster_counts_rows_once(spark):
    """Four rows with many lines of one cluster are still four rows."""
    text = "\n".join(f"Thanks for reading, yours {n} from the old mill by the river" for n in ("Anna", "Berta", "Clara"))
    assert repeated_lines(records(spark, [(text, {"url": "http://a.test/1"})] * 4), exact=False).count() == 0
    assert repeated_lines(records(spark, [(text, {"url": "http://a.test/1"})] * 5), exact=False).count() == 15


def test_strip(spark):
    rows = [(f"Same line\nown {'abcdefgh'[i]} text\n", {"url": "http://a.test/1"}) for i in range(6)] + [(None, None)]
    df = records(spark, rows)
    out = {r[0]: (r[1], r[2]) for r in strip_repeated_lines(df, repeated_lines(df)).collect()}
    assert out[0] == ("own a text\n", 1) and out[6] == (None, 0)


def test_empty_table(spark):
    assert repeated_lines(records(spark, [("", {})]).limit(0)).count() == 0
