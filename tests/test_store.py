"""Runs, tiers and index-first search of stored texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelode.functions import regex
from treelode.operators import ngrams, numbering, postings, search, trigrams, words
from treelode.operators.numbering import as_bits, marked_in, with_dense_numbers
from treelode.plans import stored
from treelode.plans.store import TextStore, any_of, id_ranges
from treelode.sources import snapshot


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


@pytest.fixture
def store(spark, tmp_path):
    return TextStore(spark, str(tmp_path / "store"), ("words", "trigrams"))


def texts_of(store):
    return {r["path"]: r["text"] for r in store.files().select("path", "text").collect()}


def brute_lines(texts, test):
    return sorted((p, i + 1, line) for p, t in texts.items() for i, line in enumerate(t.split("\n")) if test(line))


def test_dense_numbers(spark, tmp_path):
    def save(df):
        df.write.parquet(str(tmp_path / "n"))
        return spark.read.parquet(str(tmp_path / "n"))

    got = with_dense_numbers(spark.range(1000).repartition(7).where("id % 3 = 0"), "at", save, first=5).collect()
    assert sorted(r["at"] for r in got) == list(range(5, 5 + 334)) and len({r["id"] for r in got}) == 334


def test_blocks_hold_every_posting():
    rng = np.random.default_rng(4)
    for docs, high in ((1, 10), (300, 1 << 18), (60_000, 1 << 16), (9000, 1 << 17)):
        doc = np.unique(rng.integers(0, high, docs))
        term = rng.integers(0, 3, len(doc))
        masks = rng.integers(0, 256, (len(doc), 2)).astype(np.uint8)
        blocks = postings.make_blocks(term, doc, masks)
        t, d, m = postings.unpacked(blocks)
        assert sorted(zip(t.tolist(), d.tolist(), m.tolist())) == sorted(zip(term.tolist(), doc.tolist(), masks.tolist()))
        assert blocks.num_rows <= 3 * ((high >> 16) + 1)
    dense = postings.make_blocks(np.zeros(60_000, np.int64), np.arange(60_000), None)
    assert dense.column("bitmap").to_pylist() == [True] and len(dense.column("docs")[0].as_py()) == postings.BITMAP_BYTES


def test_candidates_equal_those_of_the_postings(spark):
    rng = random.Random(2)
    words = ["needle", "nation", "the", "theory", "NEED", "  ", "é", "hay"]
    rows = [(i * 4001, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(200)] + [(7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    blocks, plain = postings.build(docs), trigrams.postings(docs)
    for query in ("needle", "on the", "theory hay", "absent", "é n"):
        want, got = trigrams.candidates(plain, query), postings.candidates(blocks, query)
        assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect()), query
    assert postings.candidates(blocks, "ab") is None
    for pattern in ("needle.*the", "theory|nation", "hay|x"):
        grams = regex.decompose(pattern)
        if grams.prunes:
            want, got = trigrams.candidates_query(plain, grams), postings.candidates_query(blocks, grams)
            assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.collect()), pattern
    paths = docs.withColumn("path", F.col("doc_id").cast("string"))
    want = {int(r[0]) for r in ngrams.candidates(ngrams.postings(paths), "theory hay").collect()}
    assert {r[0] for r in postings.ngram_candidates(postings.build(docs, postings.ngram_terms()), "theory hay").collect()} == want
    live = docs.where("doc_id % 2 = 0")
    left = postings.rows(postings.live_blocks(blocks, live)).select("doc_id", F.col("term").cast("int").alias("tri"), "next_mask", "loc_mask")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, trigrams.postings(live).collect()))


def test_ranges_cover_all_candidates(spark):
    ids = [1, 2, 3, 900, 901, 1 << 20, (1 << 33) + 5]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    for most in (1, 3, 200):
        ranges = id_ranges(df, most)
        assert len(ranges) <= most + 1 and all(any(a <= i <= b for a, b in ranges) for i in ids)
    assert id_ranges(df.limit(0)) == []
    assert spark.range(20).where(any_of([F.col("id") == i for i in range(0, 20, 3)])).count() == 7
    assert spark.range(3).where(any_of([])).count() == 0


def test_search_reads_only_the_ranges_of_candidates(spark, store):
    rows = [(f"d/{i}.md", f"plain text number {i}\nsecond line") for i in range(400)]
    rows[17] = ("d/17.md", "first\nhere is the Needle in it")
    store.put(frame(spark, rows))
    hits = store.matches("needle")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[doc_id[^\n]*", plan)
    content = next(s for s in scans if "content" in s)
    assert "doc_id" in re.search(r"PushedFilters: \[[^\]]*\]", content)[0] and "span" in re.search(r"PartitionFilters: \[[^\]]*\]", content)[0]
    # The text is tested where it meets a candidate, not in the scan or between both.
    joined, below = plan[plan.index("BroadcastHashJoin") :].split("\n", 1)
    assert "RLIKE" in joined and "RLIKE" not in below
    assert [tuple(r) for r in hits.collect()] == [("d/17.md", 2, "here is the Needle in it")]
    assert store.matches("no such text").count() == 0
    assert store.search("ne+dle", regex=True).count() == 0 and store.search("Ne+dle", regex=True).count() == 1
    assert store.matches("").count() == sum(t.count("\n") + 1 for _, t in rows)


def test_twenty_writes_stay_a_few_runs(spark, store):
    rng = random.Random(6)
    truth = {f"f{i}": f"base words of {i}\nneedle {i % 3}" for i in range(50)}
    store.put(frame(spark, list(truth.items())))
    before = store.view()
    held = before.current("files").select("path").count()
    for step in range(20):
        changed = {f"f{rng.randrange(60)}": f"step {step} writes needle{step}\nand more words" for _ in range(4)}
        gone = [p for p in (f"f{rng.randrange(60)}",) if p not in changed]
        truth = {**{p: t for p, t in truth.items() if p not in gone}, **changed}
        store.put(frame(spark, list(changed.items())), frame(spark, [(p, "") for p in gone]).select("path"))
    assert len(store.view().runs) <= 1 + 3 * 3
    assert texts_of(store) == truth
    for query in ("needle", "writes needle19", "base words"):
        assert sorted(map(tuple, store.matches(query).collect())) == brute_lines(truth, lambda line: query in line)
    assert {r[0] for r in store.search_word("needle").collect()} == {p for p, t in truth.items() if re.search(r"\bneedle\b", t)}
    # A reader of the first commit still has its runs; a complete merge keeps all answers.
    assert before.current("files").select("path").count() == held
    assert store.compact(everything=True) >= 1 and len(store.view().runs) == 1
    assert texts_of(store) == truth
    opened = store.view().read("trigrams", store.view().runs).inputFiles()
    assert len(opened) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    fresh = trigrams.postings(store.files()).select("doc_id", "tri", "next_mask", "loc_mask")
    assert sorted(map(tuple, store.trigrams().select("doc_id", "tri", "next_mask", "loc_mask").collect())) == sorted(map(tuple, fresh.collect()))
    went = store.vacuum(keep_ms=0)
    assert any(w.startswith("files/run=0") for w in went) and any(w.startswith("scratch/") for w in went)
    assert texts_of(store) == truth and store.vacuum(keep_ms=0) == []


def test_a_run_without_a_commit_is_not_seen(spark, store, monkeypatch):
    store.put(frame(spark, [("a", "alpha")]))

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_publish", fail)
        with pytest.raises(RuntimeError):
            store.put(frame(spark, [("b", "beta")]))
    assert texts_of(store) == {"a": "alpha"}
    store.put(frame(spark, [("c", None)]))
    assert texts_of(store) == {"a": "alpha", "c": ""}
    assert search.search_substring(store.files(), "beta").count() == 0


def test_merged_levels(spark, store):
    levels = []
    for i in range(9):
        store.put(frame(spark, [(f"p{i}", f"text {i}")]))
        levels.append([r["level"] for r in store.view().runs])
    assert levels[3] == [0, 0, 0, 0] and levels[4] == [0, 1] and levels[8] == [0, 1, 1]
    assert len(texts_of(store)) == 9


def test_merging_unpacks_bounded_slices_of_a_shard(spark):
    import numpy as np

    from treelode.operators import postings

    counts = np.array([3, 9, 1, 1, 30, 2], np.int32)
    assert list(postings.slices(counts, 10)) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)]
    files = spark.createDataFrame([(i, f"alpha beta {i} gamma") for i in range(40)], "doc_id BIGINT, text STRING")
    blocks = postings.build(files)
    kept = postings.live_blocks(blocks, files.where("doc_id % 3 = 0"))
    want = postings.rows(blocks).where("doc_id % 3 = 0")
    assert sorted(postings.rows(kept).collect()) == sorted(want.collect())
    grouped = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in grouped and postings.PARTS > 1


def test_lists_are_unpacked_together(monkeypatch):
    rng = np.random.default_rng(9)
    term = np.concatenate([np.arange(500), np.full(40_000, 7), rng.integers(-(1 << 62), 1 << 62, 3000)])
    doc = np.concatenate([rng.integers(0, 1 << 18, 500), np.arange(40_000), rng.integers(0, 1 << 18, 3000)])
    term, doc = np.unique(np.stack([term, doc]), axis=1)
    masks = rng.integers(0, 256, (len(doc), 2)).astype(np.uint8)
    blocks = postings.make_blocks(term, doc, masks)
    single, alone = postings.decode_docs, []
    monkeypatch.setattr(postings, "decode_docs", lambda data, bitmap: alone.append(bitmap) or single(data, bitmap))
    found = []
    for lo in range(0, blocks.num_rows, 1000):
        found += zip(*(x.tolist() for x in postings.unpacked(blocks.slice(lo, 1000))))
    assert sorted(found) == sorted(zip(term.tolist(), doc.tolist(), masks.tolist()))
    # A list that is not a bitmap costs no call of its own.
    assert alone and all(alone) and len(alone) == sum(blocks.column("bitmap").to_pylist())


@pytest.mark.parametrize("index", ["ngrams", "trigrams"])
def test_a_merge_unpacks_lists_once(spark, tmp_path, monkeypatch, index):
    ranged = []
    monkeypatch.setattr(postings, "key_ranges", lambda blocks, real=postings.key_ranges: ranged.append(blocks) or real(blocks))
    store = TextStore(spark, str(tmp_path / "once"), (index,))
    store.put(frame(spark, [("a", "alpha beta"), ("b", "beta gamma")]))
    store.put(frame(spark, [("a", "delta epsilon")]))
    store.compact(everything=True)
    plans = [b._jdf.queryExecution().optimizedPlan().toString() for b in ranged]
    assert plans and not any("FlatMapCoGroups" in p for p in plans)
    find = store.ngram_candidates if index == "ngrams" else store.matches
    assert {r["path"] for r in find("epsilon").collect()} == {"a"} and find("alpha").count() == 0


def test_word_lists_hold_every_hit(monkeypatch):
    rng = random.Random(1)
    parts = ["a", "bc", "_9", " ", "\n", "é", "X", ".", "  the ", "z\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "ab", "a", ""]
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    monkeypatch.setattr(words, "HITS", 7)
    # Numbers that fit one sort key, and numbers that do not.
    for lo, hi, spread, step in ((0, 304, 1, 1), (50, 200, 40_001, 1), (0, 304, 1 << 40, 30_000_000)):
        found, doc, line = words.hits(offsets[lo : hi + 1], data)
        want = {(w, (i + lo) * spread, (n + 1) * step) for i, t in enumerate(texts[lo:hi]) for n, part in enumerate(t.split("\n")) for w in re.findall(r"[A-Za-z0-9_]{2,}", part)}
        twice = lambda x: np.concatenate([x, x])
        rows = words.make_lists(found.dictionary, twice(found.indices.to_numpy()), twice((doc + lo) * spread), twice(line * step))
        at, d, n = words.unpacked(rows)
        got = list(zip((rows.column("word")[i].as_py() for i in at.tolist()), d.tolist(), n.tolist()))
        assert len(got) == len(want) and set(got) == want and max(rows.column("n").to_pylist()) <= 7


def test_words_are_stored_as_lists(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "lists"), ("words",))
    truth = {f"f{i}": f"the needle of {i}\nand the hay, the hay" for i in range(60)}
    store.put(frame(spark, list(truth.items())).coalesce(1))
    lists = store.view().blocks("words")
    assert lists.where("word = 'the'").count() == 1 and lists.agg(F.sum("n")).first()[0] == sum(len(set(re.findall(r"\w{2,}", line))) for t in truth.values() for line in t.split("\n"))
    changed = {"f3": "no such thing", "f4": "the end"}
    store.put(frame(spark, list(changed.items())), frame(spark, [("f5", "")]).select("path"))
    truth = {**{p: t for p, t in truth.items() if p != "f5"}, **changed}
    want = sorted({(w, p, n) for p, t in truth.items() for n, line in enumerate(t.split("\n"), 1) for w in re.findall(r"\w{2,}", line)})
    assert sorted(map(tuple, store.words().collect())) == want
    store.compact(everything=True)
    assert sorted(map(tuple, store.words().collect())) == want
    # What was replaced or dropped is left out of the merged lists.
    assert store.view().blocks("words").agg(F.sum("n")).first()[0] == len(want)
    assert sorted(map(tuple, store.search_word("the").collect())) == [(p, n) for w, p, n in want if w == "the"]


def test_snapshots_of_the_same_symbols_parse_once(spark, monkeypatch):
    parsed, real = [], snapshot.write
    monkeypatch.setattr(snapshot, "write", lambda files, decls, *rest: parsed.append("MapInArrow" in decls._jdf.queryExecution().optimizedPlan().toString()) or real(files, decls, *rest))
    rows = stored.snapshot_roundtrip(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and parsed == [True, False]


def test_sets_of_numbers_go_as_bits(spark, monkeypatch):
    ids = [-65, -64, -1, 0, 1, 62, 63, 64, 700, (1 << 40) + 63]
    rows = spark.createDataFrame([(i,) for i in (*ids, -2, 2, 65, 1 << 40, None)], "doc_id bigint")
    held = as_bits(spark.createDataFrame([(i,) for i in (*ids, *ids, None)], "doc_id bigint"))
    assert held.count() == len({i >> 6 for i in ids})
    for sent in (1 << 20, 2):
        monkeypatch.setattr(numbering, "SENT", sent)
        assert sorted(tuple(r) for r in marked_in(rows, held, "met").collect()) == [(i, True) for i in sorted(ids)]


def test_no_text_is_joined_by_its_path(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "narrow"), ("trigrams",))
    truth = {f"f{i}": f"the ones of {i}\nand the eres" for i in range(300)}
    store.put(frame(spark, list(truth.items())))
    changed = {f"f{i}": f"nothing here\nthe ones again {i}" for i in range(0, 300, 3)}
    store.put(frame(spark, list(changed.items())), frame(spark, [("f1", "")]).select("path"))
    truth = {p: t for p, t in {**truth, **changed}.items() if p != "f1"}
    hits = store.matches("the (on|er)es", regex=True)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join [^\n]*", plan)
    assert len(joins) == 1 and "word" in joins[0] and "path" not in joins[0]
    assert sorted(map(tuple, hits.collect())) == brute_lines(truth, lambda line: re.search("the (on|er)es", line))
    store.compact(everything=True)
    assert sorted(map(tuple, store.matches("the (on|er)es", regex=True).collect())) == sorted(map(tuple, hits.collect()))


def test_postings_are_sorted_as_single_numbers(monkeypatch):
    rng = np.random.default_rng(12)
    doc = np.repeat(np.unique(rng.integers(0, 1 << 20, 900)) + (1 << 40), 3)
    term = np.tile([0, 77, (1 << 24) - 1], len(doc) // 3)
    mixed = rng.permutation(len(doc))
    masks = rng.integers(0, 256, (len(doc), 2)).astype(np.uint8)
    with monkeypatch.context() as patch:
        patch.setattr(np, "lexsort", None)
        packed = postings.make_blocks(term[mixed], doc[mixed], masks[mixed])
    far = np.where(np.arange(len(doc)) % 2 > 0, doc, doc - (1 << 40))
    for numbers, blocks in ((doc, packed), (far, postings.make_blocks(term[mixed], far[mixed], masks[mixed]))):
        t, d, m = postings.unpacked(blocks)
        assert sorted(zip(t.tolist(), d.tolist(), m.tolist())) == sorted(zip(term.tolist(), numbers.tolist(), masks.tolist()))
        lists = list(zip(blocks.column("shard").to_pylist(), blocks.column("term").to_pylist()))
        assert lists == sorted(set(lists))


def test_masks_of_bytes_one_by_one(monkeypatch):
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"aAb \t\n\r\x00\xff") for _ in range(rng.choice((0, 1, 2, 3, 4, 9, 300)))) for _ in range(400)]
    want = {}
    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(len(low) - 2):
            if low[at : at + 3].strip(b" \t\n\r"):
                key = (i, int.from_bytes(low[at : at + 3], "big"))
                follows = 1 << low[at + 3] % 8 if at + 3 < len(low) else 0
                before = want.get(key, (0, 0))
                want[key] = (before[0] | follows, before[1] | 1 << at % 8)
    offsets = np.cumsum([3, *map(len, texts)])
    data = np.frombuffer(b"zzz" + b"".join(texts) + b"yyy", np.uint8)
    with monkeypatch.context() as patch:
        patch.setattr(np, "argsort", None)
        got = trigrams.masks(offsets, data)
    assert {(d, t): (n, p) for d, t, n, p in zip(*(x.tolist() for x in got))} == want and len(got[0]) == len(want)


def test_postings_meet_their_paths_as_lists(spark):
    rng = random.Random(11)
    texts = [(i * 997, f"p/{i}.md", "all the same " + "".join(rng.choices("abcd ", k=rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, path string, text string")
    made = postings.build(docs)
    files = docs.where("doc_id % 5 != 0").select("doc_id", "path")
    got = postings.rows(made, files)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = postings.rows(made).join(files, "doc_id").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000
    # Lists are dealt out, postings are not.
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    shuffled = re.search(r"Exchange hashpartitioning\(shard[^\n]*", plan)[0]
    assert "part" in shuffled and plan.count("Exchange") == 1
    assert postings.rows(made, files.limit(0)).count() == 0


@pytest.mark.parametrize("dealt", [0, 1 << 28])
def test_writes_and_merges_leave_one_copy(spark, store, monkeypatch, dealt):
    from treelode.plans import store as module
    from treelode.sources import storage

    monkeypatch.setattr(module, "DEALT", dealt)
    truth = {}
    for step in range(4):
        changed = {f"f{i}": f"step {step} of {i}\nneedle" for i in range(step * 10, step * 10 + 25)}
        truth.update(changed)
        store.put(frame(spark, list(changed.items())))
        assert storage.children(spark, store._table("scratch")) == []
    store.put(frame(spark, []), frame(spark, [("f3", "")]).select("path"))
    truth.pop("f3")
    store.compact(everything=True)
    assert storage.children(spark, store._table("scratch")) == [] and texts_of(store) == truth
    assert {r[0] for r in store.search_word("needle").collect()} == set(truth)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    went = store.vacuum(keep_ms=0)
    assert {w.split("/")[1] for w in went if w.startswith("files/")} and texts_of(store) == truth
    assert len([f for f in storage.children(spark, store._table("files")) if f.startswith("run=")]) == 1


def test_stored_postings_keep_no_replaced_run(spark, monkeypatch):
    from conftest import TESTDATA
    from treelode.sources import storage

    seen = []
    monkeypatch.setattr(stored, "TextStore", lambda *a, **b: seen.append(TextStore(*a, **b)) or seen[-1])
    assert stored.trigrams_stored(spark, str(TESTDATA)).count() > 0
    for table in ("files", "trigrams", "known"):
        assert len([f for f in storage.children(spark, seen[0]._table(table)) if f.startswith("run=")]) == 1
