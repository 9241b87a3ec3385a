"""Repeated strings against brute force over all windows."""

import random

import numpy as np
import pytest

pytest.importorskip("treelode.llm")
from conftest import TESTDATA  # noqa: E402

from treelode.llm import suffixdedup  # noqa: E402


def brute(rows, length):
    """Removed byte flags of each row, by a table of every window's first place."""
    first = {}
    data = [((i if i is not None else -(1 << 63)), (t or "").encode()) for i, t in rows]
    for doc, b in sorted(data, key=lambda x: x[0]):
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (doc, s)), (doc, s))
    out = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (doc, s):
                gone[s : s + length] = True
        out.append((b, gone))
    return out


def check(df, rows, **kw):
    length = kw.get("length", 100)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, bytes(r.kept), r.n_bytes, [(s.start, s.stop) for s in r.spans]) for r in suffixdedup.deduplicate(df, **kw).collect()))
    want = []
    for (i, _), (b, gone) in zip(rows, brute(rows, length)):
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        want.append((i if i is not None else -1, bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), spans))
    assert got == sorted(want)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, key string").repartition(parts)


def mixed_rows(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(10, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        t = text(rng.randint(0, 80))
        if kind < 0.5:
            t += " " + rng.choice(passages) + " " + text(rng.randint(0, 30))
        elif kind < 0.7 and rows:
            t = rng.choice(rows)[1] or ""
            t = t[: len(t) // 2] + "#" + t[len(t) // 2 :]
        elif kind < 0.8 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, t))
    rows += [(n, "ab" * 300), (n + 1, "ab" * 90 + "b"), (n + 2, "x" * 500), (n + 3, None), (n + 4, ""), (n + 5, "short"), (None, rows[3][1]), (n + 6, "\x00" * 150 + "é" * 99)]
    return rows


@pytest.mark.parametrize("length,gram", [(100, 16), (30, 8)])
def test_against_brute_force(spark, length, gram):
    rows = mixed_rows(length)
    check(frame(spark, rows), rows, length=length, gram=gram)


def test_hot_grams_take_the_salted_way(spark):
    rows = mixed_rows(5) + [(1000 + i, "the very same line that everyone has in the text, " * 4 + str(i)) for i in range(300)]
    check(frame(spark, rows, 9), rows, hot_runs=64)
    check(frame(spark, rows, 9), rows, length=40, gram=8, hot_runs=64)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PART_BYTES", 500)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef ") for _ in range(5000))
    rows = [(1, long), (2, long[1000:3000] + "!" + long[:400]), (3, "z" + long)]
    check(frame(spark, rows, 2), rows)


def test_repeated_rows_and_empty_tables(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(5, text), (5, text), (7, text), (6, text + "tail")]
    check(frame(spark, rows), rows)
    assert suffixdedup.deduplicate(frame(spark, rows).limit(0)).count() == 0


def test_on_the_table(spark):
    df = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    check(df, rows)


def brute_by_row(rows, length):
    """What is left of each text, for rows told apart by id and a hash of their text."""
    first, keys = {}, [(-(1 << 63) if i is None else i, h) for i, _, h in rows]
    data = [t.encode() for _, t, _ in rows]
    for key, b in sorted(zip(keys, data)):
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (key, s))
    out = []
    for key, b in zip(keys, data):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (key, s):
                gone[s : s + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def test_rows_that_share_an_id_or_have_none(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    rows = [(None, text(rng.randint(0, 40 * i)) + passage + text(rng.randint(0, 300))) for i in range(8)]
    rows += [(None, text(120)), (None, text(20)), (7, text(90) + passage), (7, text(400)), (7, passage + text(10)), (8, text(300))]
    for part in (rows, [r for r in rows if r[0] != 7]):
        hashed = [(r.doc_id, r.text, r.h) for r in spark.createDataFrame(part, "doc_id bigint, text string").withColumn("h", F.xxhash64("text")).collect()]
        got = sorted(bytes(r.kept) for r in suffixdedup.deduplicate(frame(spark, part)).collect())
        assert got == sorted(brute_by_row(hashed, 100))
        assert sum(passage.encode() in k for k in got) == 1


def test_low_entropy_texts_are_folded_where_they_are_read(spark):
    rows = [(1, "a" * 3000), (2, "ab" * 900 + "c" + "a" * 500), (3, "x" + "a" * 2000 + "y"), (4, "ab" * 400), (4, "ab" * 400), (5, "=-" * 90 + "a" * 130)]
    for hot_runs in (1, 10**9):
        check(frame(spark, rows, 3), rows, hot_runs=hot_runs)
    n = 200_000
    data, zero = np.full(n, 97, np.uint8), np.zeros(1, np.int64)
    runs = suffixdedup.Runs(data, np.array([0, n]), 100, 16)
    for salts in (np.zeros(suffixdedup.BUCKETS, np.int32), np.full(suffixdedup.BUCKETS, 16, np.int32)):
        out = suffixdedup.run_rows(runs, data, zero, zero, zero, 100, salts, 84)
        assert out.num_rows < 200 and out.nbytes < 100_000
        marked = [(a, b) for a, b, lead in zip(out.column("pos").to_pylist(), out.column("key").to_pylist(), out.column("lead").to_pylist()) if lead < 0]
        assert marked == [(1, n)]


def test_a_row_repeated_for_a_third_of_the_table_travels_once(spark):
    from treelode.llm.common import one_each

    rows = [(5, "abcdefgh" * 40)] * 500 + [(i, f"{i:03d} " * 60) for i in range(10, 60)] + [(6, "abcdefgh" * 20 + "tail")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert one_each(df, "doc_id", "text").count() == 52
    got = suffixdedup.deduplicate(df).collect()
    assert len(got) == len(rows) and len({bytes(r.kept) for r in got if r.doc_id == 5}) == 1
    assert {len(r.kept) for r in got if r.doc_id == 5} == {8} and {bytes(r.kept) for r in got if r.doc_id == 6} == {b"tail"}
