"""Line bitmaps, importance resampling and whitening against brute force."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("treelode.llm")
from compare import compare, connect  # noqa: E402
from conftest import TESTDATA  # noqa: E402

from treelode.llm import linededup, resample, whiten  # noqa: E402
from treelode.llm.queries import ORACLES, QUERIES, op13_whitening  # noqa: E402


# ── lines ────────────────────────────────────────────────────────────────────


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_lines(rows, least=10):
    """(id, lines, dropped, kept) of each row; ids that are None count as documents by text, after all others."""
    texts = [text or "" for _, text in rows]
    owner = [(0, i) if i is not None else (1, texts[r]) for r, (i, _) in enumerate(rows)]
    held = defaultdict(set)
    for o, text in zip(owner, texts):
        for line in text.split("\n"):
            held[low(line.strip(linededup.BLANKS))].add(o)
    out = []
    for (i, _), o, text in zip(rows, owner, texts):
        lines = text.split("\n")
        keys = [low(x.strip(linededup.BLANKS)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if len(k) < least or o == min(held[k])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, True) for i, t in rows], "doc_id bigint, text string, who string, pos int, nameless boolean")


def got_lines(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_lines_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_LINES", 3)
    rng = random.Random(hot)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["SHORT", "", "  Common header line \t", "common HEADER line", "naïve ÉTÉ line number", "naïve été line number"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 200])))) for i in range(80)]
    rows += [(7, rows[7][1]), (8, "line number 3 of the pool\nonly here, nowhere else"), (200, None), (201, "\n\n\n"), (202, "common header line\n" * 500)]
    df = lines_frame(spark, rows).repartition(6)
    assert got_lines(linededup.deduplicate(df, hot=hot)) == brute_lines(rows)


def test_lines_without_ids_copies_and_empty_tables(spark):
    one = [(None, "a line that repeats\nown words of this text")]
    rows = [(3, "A LINE that repeats\nand another line here")] + one * 40 + [(None, None), (None, "")]
    df = lines_frame(spark, rows).repartition(3)
    assert got_lines(linededup.deduplicate(df)) == brute_lines(rows)
    assert got_lines(linededup.deduplicate(lines_frame(spark, rows).limit(0))) == []
    carried = linededup.deduplicate(df, carry=("who", "pos")).columns
    assert carried == ["doc_id", "who", "pos", "n_lines", "n_dropped", "kept"]


def test_lines_of_a_long_text_and_a_third_of_all_rows_the_same(spark):
    long = "\n".join(f"paragraph {i % 7000} of a long text" for i in range(60_000))
    rows = [(1, "paragraph 5 of a long text"), (2, long), (3, long)] + [(9, "the very same row again\nwith two lines")] * 300
    rows += [(i, f"the very same row again\ntext {i} has its own words") for i in range(10, 600)]
    df = lines_frame(spark, rows).repartition(8)
    assert got_lines(linededup.deduplicate(df)) == brute_lines(rows)


def test_bitmaps_are_sparse_and_lines_run_without_python(spark):
    df = lines_frame(spark, [(1, "first line of all\n" * 3), (2, "x\n" * 1000 + "first line of all\nlast line of two")])
    rows = linededup.keep_bitmaps(df).collect()
    assert [(r.who, r.n_dropped, [(w.word, w.bits & 0xFFFFFFFFFFFFFFFF) for w in r["keep"]]) for r in rows] == [(2, 1, [(15, (1 << 64) - 1 - (1 << 40))])]
    plan = linededup.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_resampling"])
def test_against_sql_on_the_larger_table(spark, name):
    sf_dir = str(TESTDATA).replace("0.001", "0.01")
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


# ── resampling ───────────────────────────────────────────────────────────────


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute_resample(rows, target, percent=25):
    corpus, wanted = Counter(), Counter()
    per_row = [features(text) for _, text in rows]
    for _, f in per_row:
        corpus.update(f)
    for text in target:
        wanted.update(features(text)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
    out, fit = [], []
    for (i, _), (words, f) in zip(rows, per_row):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words) >= 20:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: len(fit) * percent // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "GAMMA", "été", "naïve", "x", "9lives", "日本語", "long" * 30, "it's", "a-b", "\x00", "über_fluss"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60))) for i in range(200)] + [(None, text(30)), (None, None), (500, ""), (501, "..."), (502, "y" * 5000)]
    rows += [(600, "the same row over and over again, with words enough to be drawn from the urn, many times, and then once more again")] * 70
    target = [text(15), None, "alpha beta alpha beta"]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int").repartition(7)
    for wanted in (target, []):
        bench = spark.createDataFrame([(t,) for t in wanted], "text string")
        got = sorted((tuple(r) for r in resample.resample(df, bench, pivots=3).collect()), key=repr)
        assert got == brute_resample(rows, wanted)
    assert resample.resample(df.limit(0), bench).count() == 0
    assert {r["rank"] for r in resample.resample(df.limit(3), bench).collect()} == {None}


def test_features_of_a_text_cut_in_pieces():
    import pyarrow as pa

    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcXYZ019é") for _ in range(rng.choice([1, 3, 9, 70]))) for _ in range(3000))
    texts = [long + " " * 4000 + "end. " + "q" * 3000 + " of it", "word" + " " * 5000, "", None, " " * 3000]
    for text in texts:
        batch = pa.record_batch([pa.array([text], pa.string())], ["t"])
        for limit in (1000, 1 << 20):
            found = list(resample.bucketed(batch, "t", 10_000, limit))
            words, wanted = features(text)
            assert Counter(np.concatenate([f for f, _, _ in found]).tolist() if found else []) == Counter(wanted)
            assert sum(len(w) for _, _, w in found) == len(words)


# ── whitening ────────────────────────────────────────────────────────────────


def brute_whiten(rows, components=4):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(x) for _, x in good)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in good:
        far = [n * a - s for a, s in zip(x, sums)]
        for c, k in enumerate(order):
            y = float(np.array(far) / n @ axes[:, k] / math.sqrt(values[k]))
            out.append((i, c + 1, n, sum(d * d for d in far), y, float(values[k] / values.sum())))
    return out


def check_whiten(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(abs(r[4]), 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    signs = {}
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[5] / w[5] - 1) < 1e-9
        if abs(w[4]) > 1e-3:
            assert signs.setdefault(g[1], np.sign(g[4] / w[4])) == np.sign(g[4] / w[4])
        assert abs(abs(g[4]) - abs(w[4])) < 1e-8 * max(1, abs(w[4]))
    assert max(g[6] for g in got) < 1e-8 and len({g[6] for g in got}) == 1


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TESTDATA}/embeddings.parquet").collect()]
    check_whiten(op13_whitening(spark, str(TESTDATA)).collect(), brute_whiten(rows))


def test_whitening_in_blocks_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_ROWS", 32)
    monkeypatch.setattr(whiten, "BLOCK_COLUMNS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=10) * np.arange(1, 11)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1]), (900, []), (901, [1.0, -2.0])]
    bad = [(1000, None), (1001, [None, 1.0]), (1002, [float("nan")]), (1003, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id bigint, embedding array<double>, component int").repartition(5)
    check_whiten(whiten.whiten(df).collect(), brute_whiten(rows))


def test_whitening_of_few_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    two = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in two) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
    json.dumps([r.asDict() for r in two])
