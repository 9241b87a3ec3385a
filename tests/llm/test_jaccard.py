"""The shingle join against brute force over all pairs."""

import random
import re

import pytest

pytest.importorskip("treelode.llm")
from conftest import TESTDATA  # noqa: E402

from treelode.llm import jaccard  # noqa: E402


def shingles(text, k=5):
    lower = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def check(df, rows, **kw):
    assert sorted((tuple(r) for r in jaccard.join(df, **kw).collect()), key=str) == brute(rows)


def rows_of(seed, families=12, each=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 3)))
    rows = []
    boilerplate = [word() for _ in range(30)]
    for _ in range(families):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = boilerplate + w
            sep = rng.choice([" ", "  ", "\n", "\t \r"])
            text = sep.join(w)
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rows += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "one"), (5004, "ONE "), (5005, "one two three four"), (None, rows[0][1]), (5006, rows[3][1]), (5006, rows[3][1]), (5007, "É é"), (5008, "é é")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, node int").repartition(6)
    check(df, rows)


def test_large_regions_lose_their_balls_first(spark):
    rows = rows_of(9, 4, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    check(df, rows, region_nodes=5)


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    check(df, [(1, "a b c d e f g")])
    assert jaccard.join(df.limit(0)).count() == 0


def test_on_the_table(spark):
    df = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_region_join_links_every_close_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
        sets = []
        for _ in range(25):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 16))] = rng.integers(0, 1 << 40, dtype=np.uint64)
            sets.append(np.unique(s))
        nodes = list(range(25))
        root = nodes[:]
        find = lambda i: i if root[i] == i else find(root[i])
        close = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        for i, j in jaccard.join_region(nodes, sets, 75):
            assert close(i, j)
            root[find(i)] = find(j)
        for i in nodes:
            for j in range(i):
                assert not close(i, j) or find(i) == find(j)


def test_dense_regions_are_dealt_into_block_pairs(spark):
    rng = random.Random(9)
    rows = [(region, node, bytes(8)) for region, n in ((1, 300), (2, 8), (3, 41)) for node in range(n)]
    dealt = jaccard.block_pairs(spark.createDataFrame(rows, "region bigint, node bigint, shingles binary"), 40).collect()
    held = {}
    for r in dealt:
        held.setdefault(r.region, set()).add(r.node)
    assert max(map(len, held.values())) < 80 and held[2] == set(range(8))
    for n in (300, 41):
        nodes = {frozenset((a, b)) for h in held.values() for a in h for b in h if a < b}
        assert all(frozenset((a, b)) in nodes for a in range(n) for b in range(a))
    # A family of one template: too far apart for balls, all in one region.
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = words[:]
        own[rng.randrange(20, 40)] = f"own{i}"
        rows.append((i, " ".join(own)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, region_nodes=6)


def test_rows_without_an_id_keep_their_own_sets(spark):
    rows = [(None, " ".join(f"{k}w{i}" for i in range(30))) for k in range(6)] + [(3, " ".join(f"0w{i}" for i in range(29))), (3, " ".join(f"1w{i}" for i in range(31)))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
