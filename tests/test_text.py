"""Search dialect, indexes and scores against brute force on small inputs."""

import functools
import random
import re

import numpy as np
import pytest

from treelode.functions import fuzzy, paths, regex
from treelode.functions.text import contains_fold, fold
from treelode.functions.wyhash import hash_bytes
from treelode.operators import lines, ngrams, pairs, search, symbols, trigrams, words
from treelode.sources import ignore
from pyspark.sql import functions as F

# ── dialect: expand groups to flat patterns, then follow sets of positions ──


def flat_patterns(p):
    """Every group-free pattern a dialect alternative stands for."""
    i = 0
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p):
            i += 2
        elif p[i] == "[":
            i = class_end(p, i)
        elif p[i] == "(":
            branches, after = regex._group(p, i)
            return [q for b in branches for q in flat_patterns(p[:i] + b + after)]
        else:
            i += 1
    return [p]


def class_end(p, i):
    m = re.compile(r"\[\^?\]?[^\]]*\]?", re.S).match(p, i)
    return m.end()


def tokens(p):
    out, i = [], 0
    while i < len(p):
        if p[i] == "$" and i == len(p) - 1:
            out.append(("end", 0, 0))
            break
        if p[i] == ")":
            i += 1
            continue
        end = i + 2 if p[i] == "\\" and i + 1 < len(p) else class_end(p, i) if p[i] == "[" else i + 1
        element, low, high = p[i:end], 1, 1
        m = re.compile(r"\*|\+|\?|\{(\d*)(?:(,)(\d*))?\}").match(p, end)
        if m:
            simple = {"*": (0, 10**6), "+": (1, 10**6), "?": (0, 1)}
            if m[0] in simple:
                low, high = simple[m[0]]
            else:
                low = int(m[1] or 0)
                high = low if not m[2] else int(m[3]) if m[3] else 10**6
            end = m.end()
        out.append((element, low, high))
        i = end
    return out


def accepts(element, ch):
    if element == ".":
        return True
    if element[0] == "\\" and len(element) == 2:
        sets = {"d": "0123456789", "w": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "s": " \t\n\r"}
        kind = element[1]
        if kind in "bB":
            return False
        if kind.lower() in sets and kind.isalpha():
            return (ch in sets[kind.lower()]) == kind.islower()
        return ch == kind
    if element[0] == "[":
        body = element[1:-1] if element.endswith("]") and len(element) > 1 else element[1:]
        negate = body.startswith("^")
        body = body[1:] if negate else body
        members, i = set(), 0
        while i < len(body):
            if i + 2 < len(body) and body[i + 1] == "-" and not (i == 0 and body[0] == "]"):
                members.update(chr(c) for c in range(ord(body[i]), ord(body[i + 2]) + 1))
                i += 3
            else:
                members.add(body[i])
                i += 1
        return (ch in members) != negate
    return ch == element


def brute(pattern, text):
    for part in regex.split_alternatives(pattern):
        anchored = part.startswith("^")
        for flat in flat_patterns(part[1:] if anchored else part):
            at = {0} if anchored else set(range(len(text) + 1))
            for element, low, high in tokens(flat):
                if element == "end":
                    at &= {len(text)}
                    continue
                reached = set()
                for start in at:
                    n = 0
                    while n < high and start + n < len(text) and accepts(element, text[start + n]):
                        n += 1
                    reached.update(range(start + low, start + n + 1))
                at = reached
            if at:
                return True
    return False


PATTERNS = [
    "abc", "^a", "c$", "^$", "(ab)+c", "(ab|cd)+e", "a*?b", "*a", "+", "?x", "a{2}", "a{2,}", "a{1,2}b", "a{", "a{x}",
    "[abc]+d", "[^abc]", "[]a]", "[a-", "[a-c]x", "\\t", "\\bfoo", "\\d+", "\\w\\W\\w", "a|b$|^c", "(a|)b", "(|x)+y",
    "((a|b)c)d", "a)b", "(a|b", "a(b|c)(d|e)*f", "\\.", ".", "..$", "$a", "a$b", "^^a", "\\S\\s", "[|]", "(a$|b)c", "{,2}a",
    "a{3,1}", "\\(x\\)", "x[", "a-b", "[a-]", "\\\\", "(a)(b)(c)", "\\", "a**",
]
TEXTS = [
    "", "a", "abc", "ababc", "abbc", "cdde e", "*a", "+", "?x", "aa", "aaa b", "a{", "a{x}", "dd", "]", "bx", "t", "\t", "b foo",
    "12", "a-b", "c", "b", "cb", "acd", "bcd", "a)b", "abdf", "ace ef", ".", "xy", "a$b", "^a", "x y", "|", "bc", "ac", "(x)",
    "x[", "\\", "a*", "{,2}a", "a?b", "ab", "+y", "x+y", "bfoo", "$a",
]


def test_dialect_against_brute_force(spark):
    """Every pattern on every text, matched by Spark and by position sets."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    got = df.select("t", *[regex.rlike(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    wrong = [
        (p, row["t"], row[f"p{i}"]) for row in got for i, p in enumerate(PATTERNS) if row[f"p{i}"] != brute(p, row["t"])
    ]
    assert wrong == []


def test_random_patterns(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc|(.") for _ in range(rng.randrange(7))) for _ in range(40)]
    patterns = ["".join(rng.choice("abc()|*+?.$^{1}[]\\") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    # Brackets inside groups split differently in the helper; they have cases of their own.
    patterns = [p for p in patterns if not ("[" in p and "(" in p)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = df.select("t", *[regex.rlike(F.col("t"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    wrong = [(p, r["t"]) for r in got for i, p in enumerate(patterns) if r[f"p{i}"] != brute(p, r["t"])]
    assert wrong == []


def test_dialect_is_bytewise(spark):
    df = spark.createDataFrame([("é",)], "t STRING")
    row = df.select(*[regex.rlike(F.col("t"), p).alias(p) for p in ("^.$", "^..$", "é", "^[^a][^a]$", "\\W\\W")]).first()
    assert tuple(row) == (False, True, True, True, True)


def test_groups_translate_without_copies(spark):
    assert len(regex.to_java("(a|b)+" * 40)) < 1000
    nested = "((a|bc)*(d|)+x|y(z|(p|q){2,3}))+" * 12
    assert len(regex.to_java(nested)) < 40 * len(nested)
    text = "a" * 5000 + "bc" + "k" * 300
    row = spark.createDataFrame([(text,)], "t STRING").select(
        regex.rlike(F.col("t"), "(" + "a" * 5000 + "|x)bc"), regex.rlike(F.col("t"), "ck{280,}$"), regex.rlike(F.col("t"), "ck{301,}$")
    ).first()
    assert tuple(row) == (True, True, False)
    assert regex.to_java("([x|b)" * 40 + "]" * 40)


def test_long_names_are_whole(spark):
    name = "n" * 700
    files = spark.createDataFrame([("a.py", f"import {'m' * 600}.{name}\ndef {name}(): pass\n"), ("d/" + "p" * 900 + "/needle.md", "")], "path string, text string")
    found = symbols.declarations(files).collect()
    assert {n for r in found for n in [r["name"]] if r["kind"] == "function"} == {name}
    assert [r["imports"] for r in found if r["imports"]] == [[f"{'m' * 600}/{name}.py"]]
    assert [r["path"] for r in search.fuzzy_top(files, "needle", 5).collect()] == ["d/" + "p" * 900 + "/needle.md"]
    assert fuzzy.score_batch("p" * 600, ["d/" + "p" * 900])[0] > 0
    mixed = ["src/main.py", "x" * 3000, "main", "lib/" + "y" * 40_000 + "/main.rs", "src/Main.go"] * 50
    whole = fuzzy.score_batch("main", mixed)
    assert np.array_equal(whole, np.concatenate([fuzzy.score_batch("main", [m]) for m in mixed]), equal_nan=True)


def test_fold_is_ascii_only(spark):
    df = spark.createDataFrame([("K\u212aÉ",)], "t STRING")
    row = df.select(fold(F.col("t")), contains_fold(F.col("t"), "kk"), contains_fold(F.col("t"), "k\u212a")).first()
    assert tuple(row) == ("k\u212aÉ", False, True)
    tricky = spark.createDataFrame([("a\\Eb.c",)], "t STRING")
    assert tricky.select(contains_fold(F.col("t"), "\\eB.")).first()[0] is True


# ── indexes ──────────────────────────────────────────────────────────────────

CORPUS = [
    (1, "a/x.md", "The quick  brown\nfox   jumps"), (2, "b/y.md", "quick brown fox"), (3, "c/z.md", "a   b\t\n  ccc"),
    (4, "d/é.md", "Übergröße quick\nbrown"), (5, "e/e.md", ""), (6, "f/f.md", "xy"), (7, "g/g.md", "browner quicK FOX jumped 100%"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id BIGINT, path STRING, text STRING")


def brute_postings(text):
    raw = text.encode().lower()
    out = {}
    for i in range(len(raw) - 2):
        gram = raw[i:i + 3]
        if not gram.strip(b" \t\n\r"):
            continue
        nxt, loc = out.get(gram, (0, 0))
        if i + 3 < len(raw):
            nxt |= 1 << (raw[i + 3] % 8)
        out[gram] = (nxt, loc | 1 << (i % 8))
    return {int.from_bytes(g, "big"): m for g, m in out.items()}


def test_trigram_postings(corpus):
    got = {}
    for r in trigrams.postings(corpus).collect():
        got.setdefault(r["doc_id"], {})[r["tri"]] = (r["next_mask"], r["loc_mask"])
    assert got == {i: p for i, _, text in CORPUS if (p := brute_postings(text))}


def test_chunked_postings_equal(corpus, monkeypatch):
    offsets = np.cumsum([0] + [len(t.encode()) for _, _, t in CORPUS])
    assert list(trigrams._chunks(offsets, 20))[0] == (0, 1)
    covered = [d for lo, hi in trigrams._chunks(offsets, 20) for d in range(lo, hi)]
    assert covered == list(range(len(CORPUS)))


@pytest.mark.parametrize("query", ["quick", "brown fox", "a   b", "FOX", "zzz", "größe", "qu", "", "   ", "jump", "ccc"])
def test_indexed_search_equals_scan(corpus, query):
    index = trigrams.postings(corpus)
    scan = sorted(map(tuple, search.search_substring(corpus, query).collect()))
    assert sorted(map(tuple, search.search_indexed(corpus, index, query).collect())) == scan
    allowed = trigrams.candidates(index, query)
    hits = {path for path, _, _ in scan}
    if allowed is not None:
        ids = {r["doc_id"] for r in allowed.collect()}
        assert {p for i, p, _ in CORPUS if i in ids} >= hits


@pytest.mark.parametrize("pattern", ["quick|fox", "(quick|slow) brown", "bro.n", "jump(s|ed)", "a +b", "fox$", "x(a|b)?y|zzz", "[q]uick", "qu{1}ick", "quick?"])
def test_indexed_regex_equals_scan(corpus, pattern):
    index = trigrams.postings(corpus)
    scan = sorted(map(tuple, search.search_regex(corpus, pattern).collect()))
    assert sorted(map(tuple, search.search_indexed(corpus, index, pattern, is_regex=True).collect())) == scan


def test_decompose():
    gram = lambda s: tuple(regex.literal_trigrams(s))
    assert regex.decompose("abcd").all_of == gram("abcd")
    assert regex.decompose("abc|xyz").any_of == (gram("abc"), gram("xyz"))
    assert not regex.decompose("abc|x").prunes
    assert not regex.decompose("(abc|xyz)").prunes
    assert regex.decompose("abcd*").all_of == gram("abc")
    assert regex.decompose("^foo\\.bar$").all_of == gram("foo.bar")


def test_overlay_hides_replaced_documents(corpus, spark):
    base = trigrams.postings(corpus)
    fresh = spark.createDataFrame([(2, "b/y.md", "nothing here")], "doc_id BIGINT, path STRING, text STRING")
    merged = trigrams.merged(base, trigrams.postings(fresh), fresh)
    found = {r["doc_id"] for r in trigrams.candidates(merged, "brown").collect()}
    assert found == {1, 4, 7}


def test_words(corpus):
    got = {(r["word"], r["path"], r["line_num"]) for r in words.word_postings(corpus).collect()}
    want = {
        (w, path, n) for _, path, text in CORPUS for n, line in enumerate(text.split("\n"), 1)
        for w in re.findall(r"[A-Za-z0-9_]{2,}", line)
    }
    assert got == want
    assert [r["path"] for r in words.search_word(corpus, "quicK").collect()] == ["g/g.md"]


def test_index_round_trips(corpus, tmp_path, spark):
    trigrams.write_postings(trigrams.postings(corpus), str(tmp_path / "tri"), "abc")
    words.write_postings(words.word_postings(corpus), str(tmp_path / "words"))
    ngrams.write_postings(ngrams.postings(corpus), str(tmp_path / "ngrams"))
    stored = trigrams.read_postings(spark, str(tmp_path / "tri"))
    assert trigrams.read_header(spark, str(tmp_path / "tri")) == {"files": 5, "git_head": "abc"}
    assert trigrams.lookup(stored, int.from_bytes(b"fox", "big")).count() == 3
    assert stored.count() == trigrams.postings(corpus).count()
    assert {r["doc_id"] for r in trigrams.candidates(stored, "brown").collect()} == {1, 2, 4, 7}
    assert words.lookup(spark.read.parquet(str(tmp_path / "words")), "fox").count() == 2
    assert spark.read.parquet(str(tmp_path / "ngrams")).count() > 0


# ── pairs and n-grams ────────────────────────────────────────────────────────


def test_wyhash_vectors():
    assert hash_bytes(b"a", 1) == 0xA8412D091B5FE0A9
    assert hash_bytes(b"abc", 2) == 0x32DD92E4B2915153
    assert hash_bytes(b"message digest", 3) == 0x8619124089A3A16B


def test_default_weights():
    table = pairs.default_table()
    assert table[ord("t") * 256 + ord("h")] == 0x1000 and table[ord("=") * 256 + ord(">")] == 0x0800
    assert table[ord("q") * 256 + ord("z")] == 0xFE00 and (table != 0xFE00).sum() == 59
    jitter = pairs.jittered(table) - table
    assert jitter.min() >= 0 and jitter.max() <= 255


def test_pair_weights(corpus):
    counts = {}
    for _, _, text in CORPUS:
        raw = text.encode()
        for a, b in zip(raw, raw[1:]):
            counts[a, b] = counts.get((a, b), 0) + 1
    found = pairs.pair_counts(corpus)
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == counts
    top = max(counts.values())
    table = pairs.read_weights(pairs.pair_weights(found))
    want = np.full(65536, 0xFE00)
    for (a, b), n in counts.items():
        want[a * 256 + b] = 0xFE00 - n * (0xFE00 - 0x1000) // top
    assert (table == want).all()


def test_pair_weights_of_nothing(spark):
    none = spark.createDataFrame([(1, "x", "")], "doc_id BIGINT, path STRING, text STRING")
    assert set(pairs.read_weights(pairs.pair_weights(pairs.pair_counts(none)))) == {0xFE00}


def brute_spans(folded, weights):
    w = [int(weights[folded[i] * 256 + folded[i + 1]]) for i in range(len(folded) - 1)]
    cuts = [0] + [i for i in range(1, len(w) - 1) if w[i - 1] < w[i] > w[i + 1]] + [len(w) - 1]
    out = []
    for left, right in zip(cuts, cuts[1:]):
        span = list(range(left, right + 2))
        while len(span) > 16:
            out.append((span[0], 16))
            span = span[16:]
            if 0 < len(span) < 3:
                out.append((right + 2 - 3, 3))
                span = []
        if len(span) == 16 or 3 <= len(span) < 16:
            out.append((span[0], len(span)))
    return sorted(out)


def test_ngram_spans():
    weights = pairs.jittered(pairs.default_table())
    rng = random.Random(3)
    for _ in range(300):
        raw = bytes(rng.choice(b"thein (){}=\nqz") for _ in range(rng.randrange(3, 60)))
        start, size = ngrams.spans(np.frombuffer(raw, np.uint8), weights)
        assert sorted(zip(start.tolist(), size.tolist())) == brute_spans(raw, weights), raw
    flat = np.zeros(65536, np.int64)
    for n in range(3, 70):
        raw = b"a" * n
        start, size = ngrams.spans(np.frombuffer(raw, np.uint8), flat)
        assert sorted(zip(start.tolist(), size.tolist())) == brute_spans(raw, flat), n


def test_ngram_postings_and_candidates(corpus):
    weights = pairs.jittered(pairs.default_table())
    want = set()
    for _, path, text in CORPUS:
        raw = text.encode().lower()
        for start, size in brute_spans(raw, weights) if len(raw) >= 3 else []:
            value = hash_bytes(raw[start:start + size])
            want.add((path, value - 2**64 if value >= 2**63 else value))
    index = ngrams.postings(corpus)
    assert {(r["path"], r["hash"]) for r in index.collect()} == want
    cover = {hash_bytes(b"quick"[i:j]) for i in range(5) for j in range(i + 3, 6)}
    assert {h % 2**64 for h in ngrams.covering_set("QUICK")} == cover
    hit = {p for p, h in want if h % 2**64 in cover}
    assert {r["path"] for r in ngrams.candidates(index, "QUICK").collect()} == hit
    assert ngrams.candidates(index, "qu") is None


# ── fuzzy ────────────────────────────────────────────────────────────────────


def brute_score(query, path):
    f = np.float32
    n = len(path)
    base = path.rfind("/") + 1

    @functools.cache
    def gain(i, j):
        if query[i].lower() != path[j].lower():
            return f(-8)
        total = 16 + 2 * (query[i] == path[j]) + 8 * (j == 0 or path[j - 1] in "/_-.\\")
        total += 6 * (j >= base) + 6 * (j in (0, base))
        total += 4 * bool(i > 0 and j > 0 and best(i - 1, j - 1) > best(i - 1, j) * f(0.5))
        return f(total)

    @functools.cache
    def skip_query(i, j):
        return f(-3) if i < 0 else max(best(i - 1, j) - f(3), skip_query(i - 1, j) - f(1))

    @functools.cache
    def skip_path(i, j):
        return f(-3) if j < 0 else max(best(i, j - 1) - f(3), skip_path(i, j - 1) - f(1))

    @functools.cache
    def best(i, j):
        if i < 0 or j < 0:
            return f(0)
        return max(f(0), best(i - 1, j - 1) + gain(i, j), skip_query(i, j), skip_path(i, j))

    rows = [[best(i, j) for j in range(n)] for i in range(len(query))]
    top = max(rows[-1])
    used = max([i + 1 for i, row in enumerate(rows) if max(row) > 0], default=0)
    if top <= 0 or used < (len(query) + 1) // 2 or top < f(len(query)) * f(16) * f(0.3):
        return None
    if path[base:] in fuzzy.ENTRY_POINTS:
        top = top + top * f(0.05)
    return top / np.sqrt(f(n))


NAMES = ["src/main.zig", "src/search_index.zig", "lib/Foo/bar_baz.ts", "a", "README.md", "index.ts", "x/y/z/main.go", "mnzg", "src/MAIN.zig"]


@pytest.mark.parametrize("query", ["main", "si", "Foo", "barbaz", "zig", "zzzzzz", "a", "MAIN.zig", "x/main"])
def test_fuzzy_score(query):
    got = fuzzy.score_batch(query, NAMES)
    for name, value in zip(NAMES, got):
        want = brute_score(query, name)
        assert (want is None and np.isnan(value)) or np.float32(want) == value, (query, name, want, value)


def test_fuzzy_paths(spark):
    df = spark.createDataFrame([(n,) for n in NAMES] + [("p" * 600,)], "path STRING")
    rows = search.fuzzy_top(df, "main *.zig", 10).collect()
    assert [r["path"] for r in rows] == ["src/main.zig", "src/MAIN.zig", *[r["path"] for r in rows][2:]]
    assert all(r["path"].endswith(".zig") for r in rows)
    both = search.fuzzy_paths(df, "src zig").collect()
    for r in both:
        assert np.float32(r["score"]) == brute_score("src", r["path"]) + brute_score("zig", r["path"])
    assert search.fuzzy_paths(df, "*.zig").count() == 0 and search.fuzzy_paths(df, "").count() == 0


# ── paths, lines ─────────────────────────────────────────────────────────────


def test_languages_and_filters(spark):
    cases = {
        "a.zig": "zig", "a.ts": "typescript", "a.js": "javascript", "a.go": "go_lang", "a.php": "php", "a.py": "python",
        "a.h": "c", "a.hpp": "cpp", "a.rake": "ruby", "a.yml": "yaml", "a.css": "unknown", "A.PY": "unknown",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path STRING")
    assert {r[0]: r[1] for r in df.select("path", paths.language(F.col("path"))).collect()} == cases
    secret = [".env", "credentials.json", ".ssh/id_rsa", "a/.env.x", "s.jks", ".aws/config", "k.pem"]
    df = spark.createDataFrame([(p,) for p in secret + ["src/main.zig", "id_rsa.txt"]], "path STRING")
    flagged = [r[0] for r in df.filter(paths.is_sensitive(F.col("path"))).collect()]
    assert sorted(flagged) == sorted(secret) and all(map(paths.is_sensitive_literal, secret))


def test_roots_and_requests(spark):
    for good in ("/Users/dev/project", "/home/user/code", "/root/projects", "/tmpx"):
        assert paths.is_indexable_root(good)
    for bad in ("", "/", "/root", "/home/user", "/Users/dev", "/tmp", "/tmp/foo", "/var/tmp/x", "/private/tmp"):
        assert not paths.is_indexable_root(bad)
    asked = ["a/b", "", "/a", "../a", "..", "a/..", "a\\b", "a/../b", "..a"]
    df = spark.createDataFrame([(p,) for p in asked], "path STRING")
    kept = [r[0] for r in df.filter(paths.is_safe_request(F.col("path"))).collect()]
    assert kept == [p for p in asked if paths.is_safe_request_path(p)] == ["a/b", "..a"]


def test_globs(spark):
    cases = {
        ("*.zig", "src/a.zig"): True, ("a**b", "axxb"): True, ("a?b", "a?b"): True, ("a?b", "axb"): False,
        ("[x]", "x"): False, ("src/*", "src/a/b"): True, ("", ""): True, ("*", ""): True, ("a.b", "axb"): False,
    }
    for (pattern, text), want in cases.items():
        assert spark.range(1).select(paths.glob_match(F.lit(text), pattern)).first()[0] is want, pattern


def test_ignore_column_equals_task(spark):
    rules = ignore.parse_rules("*.log\n/pub/js/\nbuildx/\n!keep.log\na/b\n/c/d*\n# x\n\n!\n/\n") + ignore.parse_rules("*\n!ok\n", "n/m")
    names = [
        "x.log", "a/x.log", "keep.log", "pub/js/a", "pub/js", "x/pub/js/a", "buildx/y", "q/buildx/y", "a/b", "z/a/b", "c/de",
        "z/c/de", "n/m/ok", "n/m/no", "n/mm", "ok",
    ]
    df = spark.createDataFrame([(n,) for n in names], "path STRING")
    for is_dir in (False, True):
        rows = df.select("path", ignore.is_ignored(F.col("path"), rules, is_dir).alias("i")).collect()
        assert {r["path"]: r["i"] for r in rows} == {n: ignore.is_ignored_path(n, ignore.compile_rules(rules), is_dir) for n in names}
    verdict = {n: ignore.is_ignored_path(n, ignore.compile_rules(rules), False) for n in names}
    assert verdict["pub/js/a"] and not verdict["pub/js"] and verdict["buildx/y"] and not verdict["x/pub/js/a"]
    assert verdict["z/a/b"] and not verdict["z/c/de"] and not verdict["n/m/ok"] and verdict["n/m/no"]


def test_line_rules(spark):
    df = spark.createDataFrame([("a.py", "a\n"), ("b.py", ""), ("c.ts", "// x\n* y\n\n z /* \r")], "path STRING, text STRING")
    stats = {r["path"]: (r["line_count"], r["byte_size"]) for r in lines.file_stats(df).collect()}
    assert stats == {"a.py": (2, 2), "b.py": (1, 0), "c.ts": (4, 17)}
    kept = lines.extract_lines(df.filter("path = 'c.ts'"), 1, 9, line_numbers=False, compact=True).collect()
    assert [(r["line_num"], r["line"]) for r in kept] == [(4, " z /* \r")]
    assert search.search_substring(df, "a\n").count() == 0
    assert search.search_substring(df, "").count() == 7


def test_whole_texts_are_tested_before_lines(spark):
    rng = random.Random(11)
    pieces = ["the ", "ones", "eres", "x", " ", "\t", "é", "9", "\n", "\n\n", "\r", "\u2028"]
    texts = ["", "\n", "x\n", None] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(400)]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string").cache()
    patterns = ["the (on|er)es|x.*é", "^", "^$", "^x|9$", "x$", "[^a-z]{3,}", "s.x", "\\S\\s\\s", "\\D+9", "", "^.$|é", "x|9|the|on|er|\\ts|q|z|é$"]
    for pattern in patterns:
        plain = lines.lines(files).filter(F.decode(F.col("line").cast("binary"), "ISO-8859-1").rlike(regex.to_java(pattern)))
        want = plain.select("path", "line_num", "line").collect()
        got = search.search_regex(files, pattern)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)), pattern
    # Only texts that match are split: the test of the text stands below the split.
    plan = search.search_regex(files, "s.x")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan[plan.index("Generate") :].split("InMemoryRelation")[0]
    # What takes any byte ends with the line, so no match runs through the text.
    assert regex.in_text(regex.to_java("a.*b[^c]\\S$")).count("[^\\n") == 4
