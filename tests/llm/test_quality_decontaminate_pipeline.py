"""Quality against labels, contamination against plain edit distance, the pipeline stage by stage."""

import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("treelode.llm")
from conftest import TESTDATA  # noqa: E402
from test_jaccard import brute as brute_components  # noqa: E402
from test_suffix import brute as brute_repeats  # noqa: E402
from test_tokens_and_packing import check_pieces  # noqa: E402

from treelode.llm import decontaminate, quality  # noqa: E402
from treelode.llm.queries import op2_decontamination, op3_quality  # noqa: E402

SMALL = "/root/testdata/sf0.01"


def plain_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return row.min(), int(row.argmin())


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(60):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert decontaminate.best_match(pattern, text) == plain_distance(pattern, text)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("xyz ") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


def test_contamination_against_plain_distance(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (None, "x" * 50), (3, None)]
    docs = [(i, " ".join(word() for _ in range(40))) for i in range(20)]
    for i in range(60):
        _, text = items[i % 12]
        part = decontaminate.passages_of(text)[0] if decontaminate.passages_of(text) else text
        docs.append((100 + i, f"Before {word()} " + edited(rng, part, rng.randint(0, 2 + len(part) // 10)).upper() + f"\n\n{word()} after"))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, items[1][1]), (202, items[1][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, distance int").repartition(4)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for doc, text in docs:
        for item, t in items[:12]:
            hits = []
            parts = decontaminate.passages_of(decontaminate.normal(t))
            for part in parts:
                d, _ = plain_distance(part, decontaminate.normal(text))
                if d <= len(part) // decontaminate.RATE:
                    hits.append(d)
            if hits:
                want.append((doc, item, len(parts), len(hits), min(hits)))
    found = decontaminate.contaminated(df, it).collect()
    assert sorted(((r.doc_id, r.item_id, r.passages, r.passages_hit, r.distance) for r in found), key=str) == sorted(want, key=str)
    assert len(want) > 30 and any(w[4] for w in want)
    dirty = {w[0] for w in want}
    assert sorted((r.doc_id for r in decontaminate.clean_documents(df, it).collect()), key=str) == sorted((d for d, _ in docs if d not in dirty), key=str)
    assert decontaminate.contaminated(df.limit(0), it).count() == decontaminate.contaminated(df, it.limit(0)).count() == 0


def test_partial_quotes_at_any_offset(spark):
    rng = random.Random(7)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = []
    for item, text in items:
        whole = decontaminate.normal(text)
        for share in (0.6, 0.8):
            size = int(len(whole) * share) + 1
            at = rng.randrange(len(whole) - size + 1)
            docs.append((len(docs), item, f"Something before. {whole[at : at + size]} and after"))
    df = spark.createDataFrame(docs, "doc_id bigint, item bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, it).collect()}
    assert {(d, i) for d, i, _ in docs} <= found
    assert decontaminate.clean_documents(df, it).count() == 0


def test_short_items_and_items_without_an_id(spark):
    items = [(1, "Which one?"), (None, "the quick brown fox jumps over the lazy dog"), (None, "Six of  one"), (2, None), (3, " "), (4, "art")]
    docs = [(10, "so: which ONE? this"), (11, "a quick brown fox jumps over the lazy dog"), (12, "six of one, half a dozen"), (13, "which ones? a party"), (14, "art")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(df, it).collect())
    assert found == [(10, 1, 0), (11, None, found[1][2]), (12, None, 0), (14, 4, 0)] and found[1][2] <= 3
    assert [r.doc_id for r in decontaminate.clean_documents(df, it).collect()] == [13]


def test_items_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, op2_decontamination(spark, SMALL).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 900)
    assert sorted(map(tuple, op2_decontamination(spark, SMALL).collect())) == whole


def test_exact_passages_are_all_found(spark):
    items = {r.item_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    docs = {r.doc_id: decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    planted = {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    rows = op2_decontamination(spark, SMALL).collect()
    assert planted and planted <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        assert docs[r.doc_id][r.start : r.stop] in items[r.item_id] or r.distance


def test_quality_query(spark):
    rows = {r.doc_id: r for r in op3_quality(spark, SMALL).collect()}
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    bad = [r.doc_id for r in labels if r.quality == 0 or r.toxic == 1]
    good = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(not rows[d].keep for d in bad) >= 0.95 * len(bad)
    assert sum(rows[d].keep for d in good) >= 0.99 * len(good)


def test_quality_of_rows_that_were_not_fitted(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    rows = {r.doc_id: r for r in quality.assess(docs, seen).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    right = sum(rows[r.doc_id].keep == (r.quality == 1 and r.toxic == 0) for r in held)
    assert right >= 0.93 * len(held)


def test_sparse_paths_shrink_to_their_host(spark):
    rng = random.Random(4)
    docs = [(i, "fine words here and there " * rng.randint(3, 6) if i % 3 else "@@@ ### $$$ " * rng.randint(3, 9), f"host{i % 2}", "big" if i < 90 else "tiny") for i in range(92)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 92, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    rows = quality.assess(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    model = quality.fit(d.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    own = {}
    for i, text, _, _ in docs:
        data = np.frombuffer(text.encode(), np.uint8)
        grams, shape = quality.features(data, np.array([0, len(data)]))
        w, v, b = model["quality"]
        own[i] = 1 / (1 + math.exp(-(w[grams[0]].sum(dtype=float) + shape[0] @ v + b)))
    prior = (sum(own.values()) + 0.5) / (len(own) + 1)
    k = quality.STRENGTH
    for r in rows:
        host = [own[i] for i, _, h, _ in docs if h == r.host]
        path = [own[i] for i, _, h, p in docs if (h, p) == (r.host, r.path)]
        of_host = (k * prior + sum(host)) / (k + len(host))
        want = (k * of_host + sum(path)) / (k + len(path))
        assert r.path_quality == pytest.approx(want, rel=1e-6)
        odds = math.log(own[r.doc_id] / (1 - own[r.doc_id])) + math.log(want / (1 - want)) - math.log(prior / (1 - prior))
        assert r.p_quality == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-4, abs=1e-9)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "s", "en", 2), (None, "some text", "s", "en", 3), (2, "", "s", "en", 2)], "doc_id bigint, text string, source string, lang string, keep int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.keep for r in quality.assess(docs, none).collect()] == [True] * 4
    odd = spark.createDataFrame([(1, None, 0), (1, 1, None), (None, 0, 1), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.assess(docs, odd).count() == 4
    assert quality.assess(docs.limit(0), odd).count() == 0


def test_the_labelled_sample_is_bounded_by_rows(spark, monkeypatch):
    import pyarrow as pa

    held = []
    fit_head = quality.fit_head
    monkeypatch.setattr(quality, "fit_head", lambda grams, shape, truth: held.append(len(truth)) or fit_head(grams, shape, truth))
    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(300)] + [(2, "the same text")] * 200, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    quality.fit(docs, labels, rows=50)
    assert held == [50, 50] and pa is not None


def test_rows_without_words_are_linked_with_nothing(spark, tmp_path):
    import corpus_pipeline

    rows = [(None, "...", "en", "a"), (None, "...", None, "a"), (7, None, "en", "b"), (7, "", "en", "b"), (7, "", "en", "b")]
    rows = [(i, None if t is None else t.replace(".", " "), x, s, 0) for i, t, x, s in rows]
    text = " ".join(f"w{i}" for i in range(40))
    rows += [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " more", "en", "a", 6), (3, text, None, "en", 5), (4, text, "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, rows[:5] + [rows[5]]))


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = stage(spark, before, str(TESTDATA)).cache()
        assert docs.columns == columns, name
        kept[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    before, after = kept["quality classifier"]
    assert set(after) == {r.doc_id for r in op3_quality(spark, str(TESTDATA)).collect() if r.keep} and len(after) < len(before)
    before, after = kept["n-gram Jaccard join"]
    assert set(after) == {c for _, _, c in brute_components([(d, r.text) for d, r in before.items()])} and len(after) < len(before)
    before, after = kept["suffix-array dedup"]
    assert set(after) == set(before)
    rows = [(d, r.text) for d, r in before.items()]
    for (d, _), (b, gone) in zip(rows, brute_repeats(rows, 100)):
        want = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert after[d].text == want and after[d].n_chars == len(want)
    before, after = kept["benchmark decontamination"]
    items = spark.read.parquet(f"{TESTDATA}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(list(before.values()), docs.schema), items).collect()}
    assert set(after) == set(before) - dirty
    final = corpus_pipeline.run(spark, str(TESTDATA)).collect()
    check_pieces(final, {d: r.text for d, r in after.items()})


def test_pipeline_with_nulls_and_repeats(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text + " more", None, None, None), (3, None, "en", "s", 0), (None, "lonely", "en", "s", 6), (4, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x" * 30)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(got, {1: text, 3: "", None: "lonely", 4: ""})


def test_stages_keep_exactly_the_chosen_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    one, two = text(60), text(60)
    rows = [(None, one), (None, one + " more"), (None, one + " again"), (None, two), (2, two + " more"), (5, one + " five"), (5, text(50)), (6, two + " six"), (6, two), (None, None), (None, "")]
    lonely = [r for r in rows if r[0] == 5][1]
    group = text(60)
    rows += [(None, group), (None, group + " x"), (None, group + " y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    left = sorted(((r.doc_id, r.text) for r in kept), key=str)
    of_group = [x for x in left if (x[1] or "").startswith(group)]
    assert len(of_group) == 1 and of_group[0][0] is None
    assert sorted((x for x in left if x not in of_group), key=str) == sorted([(5, one + " five"), lonely, (2, two + " more"), (None, None), (None, "")], key=str)

    good, bad = "fine words here and there ", "@@@ ### $$$ "
    docs = [(i, (good if i % 3 else bad) * rng.randint(3, 9), "s", "en") for i in range(90)]
    docs += [(None, good * 5, "s", "en"), (None, bad * 5, "s", "en"), (200, good * 4, "s", "en"), (200, bad * 4, "s", "en")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string"), str(tmp_path)).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t, *_ in docs if t.startswith("fine"))


def test_features_against_plain_text(spark):
    """Shapes exactly, and 5-grams up to the few that share a bucket, of whole texts beside each other."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", "a", "A b  b\n9", "\u00e9 \u00e9 x"]
    data = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    grams, shape = quality.features(np.frombuffer(b"".join(data), np.uint8), starts)
    for one, found, own in zip(data, grams, shape):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in one)
        plain = {low[i : i + 5] for i in range(len(low) - 4)}
        assert 0.97 * len(plain) <= len(found) <= len(plain)
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
        n, w = max(1, len(one)), max(1, len(words))
        signs = sum(c < 128 and c not in b"\t\n\x0b\x0c\r ,." and not chr(c).isalnum() for c in low)
        want = [
            sum(65 <= c <= 90 for c in one) / n, sum(48 <= c <= 57 for c in one) / n, signs / n, sum(c >= 128 for c in one) / n,
            one.count(b"\n") / n, sum(a == b for a, b in zip(words, words[1:])) / w, len(set(words)) / w, math.log1p(len(words)) / 10,
        ]
        assert own.tolist() == pytest.approx(want, abs=1e-12)
