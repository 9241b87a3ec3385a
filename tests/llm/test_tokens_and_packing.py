"""Token counts against the library, packing as an exact partition of all ids."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("treelode.llm")
import public_tokenizers as P  # noqa: E402
import sentencepiece  # noqa: E402
from conftest import TESTDATA  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from treelode.llm import packing, tokencount  # noqa: E402
from treelode.llm.queries import op1_packing, op9_token_counts  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", "  two  spaces  ", "a\nb\tc\r\n", "▁a▁▁b", "<s>x</s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    " " * 40 + "x" + " " * 17, "é é ﬁ ㍿ 漢字かな 한국어 русский 🙂🙂", "\x00a\x00", "x" * 3000, "ab" * 900, "the " * 700, "▁" * 33 + "z",
    "<|endoftext|> and <|endoftext|>", "I'll we've  　 x", "١٢٣ 123 ½ ǅ ʰ",
]


@pytest.fixture(scope="module")
def machine():
    return tokencount.load(MODEL)


@pytest.mark.parametrize("chunk", [1, 3, 50, 65_536])
def test_counts_equal_the_library(machine, chunk):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ODD:
        assert tokencount.count_text(machine, text, chunk) == len(library.encode(text)), repr(text)


def test_chunk_maps_compose_associatively(machine):
    marked = "▁" + "ab  the<x> aaaaaaa\n  zz é".replace(" ", "▁")
    maps = [tokencount.ChunkMap("", machine.start)] + [tokencount.chunk_map(machine, marked[i : i + 4]) for i in range(0, len(marked), 4)]
    left = maps[0]
    for m in maps[1:]:
        left = tokencount.compose(machine, left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = tokencount.compose(machine, m, right)
    assert (left.count, left.state) == (right.count, right.state)


def test_count_query_on_the_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    rows = op9_token_counts(spark, str(TESTDATA)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 4096)


def test_count_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(tokencount.count_tokens(df, MODEL).collect(), key=str)
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(1, 0, 0), (1, 0, 0), (2, 3, 2), (None, 3, 2)]
    assert tokencount.count_tokens(df.limit(0), MODEL).count() == 0


def own_ids(text):
    own = own_ids.__dict__.setdefault("own", Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    return [*own.encode(text or "", add_special_tokens=False).ids, 0]


def check_pieces(rows, texts, window=1024):
    """Each id in exactly one piece, offsets gapless, windows not over-full."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        ids = own_ids(texts[doc])
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(r.length for r in rows)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    padding, tokens = check_pieces(op1_packing(spark, str(TESTDATA)).collect(), texts)
    assert padding < 0.02 * tokens


def digest(pieces):
    from pyspark.sql import functions as F

    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def test_packing_of_odd_texts_over_many_partitions(spark):
    texts = {i: t for i, t in enumerate([*ODD, None, *ODD])}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(23)
    json_path, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    pieces = packing.pack(df, json_path, ranks, window=64, open_windows=3, fan_in=3)
    rows = digest(pieces).collect()
    check_pieces(rows, texts, 64)
    assert packing.pack(df.limit(0), json_path, ranks).count() == 0
    whole = packing.sequences(pieces, 64).collect()
    for r in whole:
        n = len(r.ids) // 4
        assert n == 64 or (n == r.n_tokens and n & (n - 1) == 0)
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows)


def test_both_encoders_agree_on_every_safe_character():
    fast = packing.tokenizer(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    own = packing.tokenizer(P.path("byte_bpe_50k.json"), None)
    chars = [chr(c) for c in range(0x20D0) if not 0xD800 <= c < 0xE000 and packing.SAFE.match(chr(c))]
    assert len(chars) > 600
    for c in chars:
        for text in (c, f"a{c}b", f" {c} {c}{c}1", f"{c}'s {c}\n\n {c}"):
            assert fast(text) == own(text), repr(text)


def test_open_windows_stay_bounded():
    space = packing.OpenWindows(100, 4)
    rng = np.random.default_rng(0)
    for i, n in enumerate(rng.integers(1, 100, 3000).tolist()):
        space.place((i, 0, n, n, b""), n)
        assert len(space.windows) <= 4
    assert sum(len(w) for w in space.closed + space.windows) == 3000
    assert all(sum(p[2] for p in w) <= 100 for w in space.closed + space.windows)
