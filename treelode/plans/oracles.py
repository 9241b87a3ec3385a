"""ANSI SQL (DuckDB) that recomputes the registered queries independently.

Outlines and imports are checked against the declarations each template is known to
make, listed below by hand; nothing here parses source text.
"""

from __future__ import annotations

from treelode.functions import paths
from treelode.functions.wyhash import SECRET, hash_bytes
from treelode.operators.pairs import LAYOUT_PAIRS, LETTER_PAIRS
from treelode.plans import adapters, catalogue as cat
from treelode.plans.stored import OVERLAY

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


DOCS = "docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, text FROM documents)"


def lines_of(relation: str, name: str = "ln") -> str:
    return (
        f"{name} AS (SELECT path, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_num, unnest(l) AS line "
        f"FROM (SELECT path, string_split(text, chr(10)) AS l FROM {relation}))"
    )


VERSIONS = (
    "versions AS (SELECT 'user/' || user_id AS path, event_id + 1 AS seq, event_type AS op, "
    "epoch_us(ts) // 1000 AS timestamp_ms FROM events)"
)

# ── derived source files ─────────────────────────────────────────────────────

# (line, order in line, kind, name, detail, imports, flag the row needs or None)
EXPECTED = {
    "python": [
        (1, 0, "import", "import os.path", None, ["os/path.py"], None),
        (2, 0, "import", "from pkg{c}.mod{k} import thing as t", None, ["pkg{c}/mod{k}.py"], None),
        (3, 0, "import", "from . import sibling", None, [], None),
        (5, 0, "function", "in_doc_{k}", "def in_doc_{k}():", [], True),
        (7, 0, "struct_def", "Order{k}", "class Order{k}(Base):", [], False),
        (8, 0, "function", "total_{k}", "def total_{k}(self, x):", [], False),
        (11, 0, "function", "tail_{k}", "def tail_{k}(): return 1", [], True),
    ],
    "typescript": [
        (1, 0, "import", 'import { Item{k} } from "./items/{c}";', None, ["./items/{c}"], None),
        (2, 0, "function", "load{k}", "export async function load{k}(id: number) {", [], None),
        (4, 0, "constant", "state{k}", "export let state{k} = 0;", [], False),
        (5, 0, "constant", "table{k}", "export const table{k} = require('./t{c}');", [], False),
        (5, 1, "import", "export const table{k} = require('./t{c}');", None, ["./t{c}"], False),
        (6, 0, "function", "after{k}", "function after{k}() {", [], True),
        (8, 0, "function", "plain{k}", "function plain{k}() {", [], None),
    ],
    "rust": [
        (1, 0, "import", "use crate::m{c}::Thing;", None, ["use crate::m{c}::Thing;"], None),
        (2, 0, "import", "part{k}", None, ["part{k}"], None),
        (5, 0, "test_decl", "check_{k}", "fn check_{k}() {}", [], True),
        (5, 0, "function", "check_{k}", "fn check_{k}() {}", [], False),
        (6, 0, "struct_def", "S{k}", "pub(crate) struct S{k} {", [], None),
        (7, 0, "impl_block", "Show", "impl<T> Show for S{k} {", [], None),
        (8, 0, "constant", "str", "const LIMIT_{k}: &'static str = \"x\";", [], None),
        (9, 0, "macro_def", "m{k}", "macro_rules! m{k} {", [], None),
        (10, 0, "type_alias", "Alias{k}", "pub type Alias{k} = u8;", [], None),
        (11, 0, "trait_def", "T{k}", "pub unsafe trait T{k} {", [], None),
        (12, 0, "enum_def", "E{k}", "enum E{k} { A }", [], None),
    ],
    "go_lang": [
        (3, 0, "import", '"fmt"', None, ["fmt"], None),
        (4, 0, "import", 'alias "lib/{c}/v{k}"', None, ["lib/{c}/v{k}"], None),
        (6, 0, "struct_def", "T{k}", "type T{k} struct{}", [], None),
        (7, 0, "function", "Run{k}", "func (t *T{k}) Run{k}(a int) error {", [], None),
        (9, 0, "constant", "C{k}", "const C{k} = 1", [], False),
        (10, 0, "variable", "V{k}", "var V{k} = 2 */", [], False),
        (11, 0, "function", "New{k}", "func New{k}() {}", [], None),
    ],
    "php": [
        (2, 0, "import", "use App\\Models\\{User{k}, Post as P{c}}", None, ["app/Models/User{k}.php", "app/Models/Post.php"], None),
        (3, 0, "import", "use Lib\\Util{c} as U", None, ["lib/Util{c}.php"], None),
        (4, 0, "class_def", "A{k}", "abstract class A{k} {", [], None),
        (5, 0, "constant", "LIMIT", 'const LIMIT = "}{c}";', [], None),
        (6, 0, "method", "run{k}", "public function run{k}() { return '}'; }", [], None),
        (8, 0, "function", "after{k}", "function after{k}() {", [], True),
        (8, 0, "method", "after{k}", "function after{k}() {", [], False),
        (10, 0, "trait_def", "T{k}", "trait T{k} {", [], None),
        (12, 0, "function", "free{k}", "function free{k}() {}", [], None),
    ],
    "ruby": [
        (1, 0, "import", "require 'json/{c}'", None, ["json/{c}"], None),
        (2, 0, "struct_def", "Order{k}", "class Order{k} < Base", [], None),
        (3, 0, "function", "find{k}?", "def self.find{k}?(id)", [], None),
        (5, 0, "function", "hidden{k}!", "def hidden{k}!", [], False),
        (7, 0, "struct_def", "M{k}", "module M{k}", [], None),
    ],
    "zig": [
        (1, 0, "import", "std{k}", 'const std{k} = @import("lib{c}.zig");', ["lib{c}.zig"], None),
        (2, 0, "struct_def", "P{k}", "pub const P{k} = struct {", [], None),
        (3, 0, "function", "run{k}", "pub fn run{k}() void {", [], None),
        (4, 0, "union_def", "K{k}", "const K{k} = union(enum) {", [], False),
        (5, 0, "test_decl", 'test "order {k}" {', None, [], False),
        (6, 0, "function", "late{k}", "fn late{k}() void {", [], True),
        (7, 0, "constant", "N{k}", "const N{k}: u8 = 1;", [], None),
    ],
}


def fill(text: str | None, source: str) -> str:
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    key, group, _ = adapters.SOURCES[source]
    return f"replace(replace({lit(text)}, '{{k}}', CAST({key} AS VARCHAR)), '{{c}}', CAST({group} AS VARCHAR))"


def code_path(lang: str, source: str) -> str:
    return fill(f"src/{lang}/g{{c}}/f{{k}}{adapters.TEMPLATES[lang].ext}", source)


def code_files(source: str = "customer", langs=tuple(EXPECTED)) -> str:
    flag = adapters.SOURCES[source][2]
    return "code AS (" + " UNION ALL ".join(
        f"SELECT {code_path(lang, source)} AS path, '{lang}' AS language, CASE WHEN {flag} "
        f"THEN {fill(adapters.template_text(lang, True), source)} "
        f"ELSE {fill(adapters.template_text(lang, False), source)} END AS text FROM {source}"
        for lang in langs
    ) + ")"


def declarations(source: str = "customer", langs=tuple(EXPECTED)) -> str:
    flag = adapters.SOURCES[source][2]
    parts = []
    for lang in langs:
        for line, order, kind, name, detail, imports, need in EXPECTED[lang]:
            where = "" if need is None else f" WHERE {'' if need else 'NOT '}({flag})"
            listed = "[" + ", ".join(fill(i, source) for i in imports) + "]::VARCHAR[]"
            parts.append(
                f"SELECT {code_path(lang, source)} AS path, {line} AS line_num, {order} AS ord, '{kind}' AS kind, "
                f"{fill(name, source)} AS name, {fill(detail, source)} AS detail, {listed} AS imports FROM {source}{where}"
            )
    return "decl AS (" + " UNION ALL ".join(parts) + ")"


SYMBOLS = "SELECT path, name, kind, CAST(line_num AS INTEGER) AS line_start, CAST(line_num AS INTEGER) AS line_end, detail FROM decl"
STATS = (
    "stats AS (SELECT c.path, c.language, CAST(len(string_split(c.text, chr(10))) AS INTEGER) AS line_count, "
    "CAST(octet_length(encode(c.text)) AS BIGINT) AS byte_size, CAST(coalesce(n.n, 0) AS BIGINT) AS symbol_count "
    "FROM code c LEFT JOIN (SELECT path, count(*) AS n FROM decl GROUP BY path) n ON n.path = c.path)"
)
EDGES = (
    "edges AS (SELECT path, dep, row_number() OVER (PARTITION BY path ORDER BY line_num, ord, item) - 1 AS pos FROM "
    "(SELECT path, line_num, ord, unnest(imports) AS dep, unnest(range(0, len(imports))) AS item FROM decl) "
    "WHERE NOT contains(dep, '..'))"
)
FIRST_DECL = "first_decl AS (SELECT path, line_num, kind, name FROM decl WHERE ord = 0)"

# ── trees ────────────────────────────────────────────────────────────────────


def tree(base: str, depth: int | None, include: str) -> str:
    """Nodes under ``base`` (may be empty); ``include`` is a SQL condition on path and rel."""
    skip = len(base) + 2
    match = "TRUE" if not base else f"(path = {lit(base)} OR starts_with(path, {lit(base + '/')}))"
    rel = "path" if not base else f"substr(path, {skip})"
    dir_match = "TRUE" if not base else f"(dir = {lit(base)} OR starts_with(dir, {lit(base + '/')}))"
    dir_rel = "dir" if not base else f"CASE WHEN dir = {lit(base)} THEN '' ELSE substr(dir, {skip}) END"
    limit = "TRUE" if depth is None else f"depth <= {depth}"
    base_parts = base.count("/") + 1 if base else 0
    leaf_level = "len(string_split(path, '/')) - 1" if not base else f"len(string_split(path, '/')) - {base_parts}"
    dir_level = "len(string_split(dir, '/')) - 1" if not base else f"len(string_split(dir, '/')) - {base_parts}"
    slashes = "length({0}) - length(replace({0}, '/', ''))"
    return (
        f"kept AS (SELECT *, {slashes.format('rel')} AS depth FROM (SELECT *, {rel} AS rel FROM stats WHERE {match}) "
        f"WHERE {include}), leafs AS (SELECT * FROM kept WHERE {limit}), "
        "dirs AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS dir FROM "
        "(SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS n FROM leafs)), "
        f"dirs2 AS (SELECT dir, {slashes.format('drel')} AS depth FROM (SELECT dir, {dir_rel} AS drel FROM dirs WHERE {dir_match})), "
        "nodes AS (SELECT dir || '/' AS full_path, CAST(depth AS INTEGER) AS depth, "
        f"CAST({dir_level} AS INTEGER) AS level, TRUE AS is_dir, 0 AS line_count, CAST(0 AS BIGINT) AS symbol_count, "
        f"CAST(0 AS BIGINT) AS byte_size FROM dirs2 WHERE {limit} UNION ALL "
        f"SELECT path, CAST(depth AS INTEGER), CAST({leaf_level} AS INTEGER), FALSE, line_count, symbol_count, byte_size FROM leafs)"
    )


NODES = "SELECT full_path, depth, level, is_dir, line_count, symbol_count, byte_size FROM nodes"
# Listing order: per component, directories ('0') before files ('1'), then by name.
SORT_KEY = (
    "list_transform(string_split(rtrim(full_path, '/'), '/'), lambda x, i: "
    "(CASE WHEN i = len(string_split(rtrim(full_path, '/'), '/')) AND NOT is_dir THEN '1' ELSE '0' END) || x)"
)
SIZE_KEY = (
    "list_transform(string_split(rtrim(full_path, '/'), '/'), lambda x, i: "
    "CASE WHEN i = len(string_split(rtrim(full_path, '/'), '/')) AND NOT is_dir "
    "THEN '1' || lpad(CAST(9223372036854775807 - byte_size AS VARCHAR), 19, '0') || x "
    "ELSE '0' || '9223372036854775807' || x END)"
)
CODE_TREE = f"WITH {code_files()}, {declarations()}, {STATS}, "

# ── trigrams, pairs, n-grams ─────────────────────────────────────────────────

BYTES = (
    f"hexed AS (SELECT doc_id, path, regexp_extract_all(lower(hex(encode({fold('text')}))), '..') AS b FROM docs), "
    "raw AS (SELECT doc_id, path, unnest(range(0, len(b) - 2)) AS i, unnest(b[1:len(b) - 2]) AS b0, "
    "unnest(b[2:len(b) - 1]) AS b1, unnest(b[3:len(b)]) AS b2, unnest(list_append(b[4:len(b)], '')) AS nx FROM hexed WHERE len(b) >= 3), "
    "grams AS (SELECT doc_id, path, i, b0 || b1 || b2 AS t, nx FROM raw WHERE NOT "
    "(b0 IN ('20', '09', '0a', '0d') AND b1 IN ('20', '09', '0a', '0d') AND b2 IN ('20', '09', '0a', '0d')))"
)
POSTINGS = (
    "post AS (SELECT doc_id, CAST('0x' || t AS INTEGER) AS tri, "
    "CAST(bit_or(CASE WHEN nx = '' THEN 0 ELSE 1 << (CAST('0x' || nx AS INTEGER) % 8) END) AS INTEGER) AS next_mask, "
    "CAST(bit_or(1 << CAST(i % 8 AS INTEGER)) AS INTEGER) AS loc_mask FROM grams GROUP BY doc_id, t)"
)


def tri(text: str) -> int:
    return int.from_bytes(text.encode(), "big")


def trigram_candidates() -> str:
    q = cat.TRIGRAM_QUERY.lower()
    grams = [q[i:i + 3] for i in range(len(q) - 2)]
    unique = sorted(set(grams))
    asked = ", ".join(str(tri(g)) for g in unique)
    checks = []
    for i in range(len(grams) - 1):
        a, b = tri(grams[i]), tri(grams[i + 1])
        bit = 1 << (ord(q[i + 3]) % 8)
        checks.append(
            f"EXISTS (SELECT 1 FROM post a JOIN post b ON a.doc_id = b.doc_id WHERE a.doc_id = c.doc_id AND a.tri = {a} "
            f"AND b.tri = {b} AND (a.next_mask & {bit}) <> 0 AND ((((a.loc_mask << 1) | (a.loc_mask >> 7)) & 255) & b.loc_mask) <> 0)"
        )
    return (
        f"WITH {DOCS}, {BYTES}, {POSTINGS}, c AS (SELECT doc_id FROM post WHERE tri IN ({asked}) GROUP BY doc_id "
        f"HAVING count(*) = {len(unique)}) SELECT doc_id FROM c WHERE " + " AND ".join(checks)
    )


PAIRS = (
    "hexed AS (SELECT regexp_extract_all(lower(hex(encode(text))), '..') AS h FROM docs), "
    "pr AS (SELECT unnest(h[1:len(h) - 1]) AS x, unnest(h[2:len(h)]) AS y FROM hexed WHERE len(h) >= 2), "
    "counted AS (SELECT CAST('0x' || x AS INTEGER) AS a, CAST('0x' || y AS INTEGER) AS b, count(*) AS n FROM pr GROUP BY x, y)"
)

# Wyhash of 1 to 16 bytes with 128-bit integers.  ``state`` is the mix of the first two
# secrets, and a, b are the two 64-bit words read from the input.
S0, S1 = SECRET[0], SECRET[1]
STATE0 = (S0 * S1 & 2**64 - 1) ^ (S0 * S1 >> 64)
U64 = "18446744073709551616::UHUGEINT"


def wyhash(a: str, b: str, length: str) -> str:
    """Scalar subquery giving the hash as UHUGEINT."""
    return (
        f"(SELECT xor(r % {U64}, r // {U64}) FROM (SELECT xor(xor(q % {U64}, {S0}::UHUGEINT), ({length})::UHUGEINT) * "
        f"xor(q // {U64}, {S1}::UHUGEINT) AS r FROM (SELECT xor({a}, {S1}::UHUGEINT) * xor({b}, {STATE0}::UHUGEINT) AS q)))"
    )


def word(at: str) -> str:
    """Four bytes, little-endian, from the hex list ``g`` (0-based position)."""
    parts = " || ".join(f"g[CAST({at} AS INTEGER) + {k}]" for k in (4, 3, 2, 1))
    return f"CAST(CAST('0x' || {parts} AS UBIGINT) AS UHUGEINT)"


_QUARTER = "((n // 8) * 4)"
_FOUR = "4294967296::UHUGEINT"
_LETTERS = ", ".join(lit(p.encode().hex()) for p in LETTER_PAIRS)
_LAYOUT = ", ".join(lit(p.encode().hex()) for p in LAYOUT_PAIRS)
NGRAMS = (
    "hx AS (SELECT lpad(format('{:x}', v), 2, '0') AS x, v FROM range(256) t(v)), "
    "pw AS (SELECT p, CAST(least(65535, (CASE WHEN p IN (" + _LETTERS + ") THEN 4096 WHEN p IN (" + _LAYOUT + ") THEN 2048 ELSE 65024 END) "
    f"+ CAST({wyhash('w', '0::UHUGEINT', '2')} % 256 AS INTEGER)) AS INTEGER) AS wt FROM "
    # Two bytes: the second one is also the last one.
    "(SELECT l.x || r.x AS p, CAST(l.v * 65536 + r.v * 256 + r.v AS UHUGEINT) AS w FROM hx l, hx r)), "
    f"hexed AS (SELECT path, regexp_extract_all(lower(hex(encode({fold('text')}))), '..') AS b FROM docs), "
    "prs AS (SELECT path, len(b) - 1 AS m, unnest(range(0, len(b) - 1)) AS i, unnest(b[1:len(b) - 1]) AS x, unnest(b[2:len(b)]) AS y FROM hexed WHERE len(b) >= 3), "
    "wts AS (SELECT path, m, i, wt FROM prs JOIN pw ON pw.p = x || y), "
    "nb AS (SELECT path, m, i, wt, lag(wt) OVER (PARTITION BY path ORDER BY i) AS before, lead(wt) OVER (PARTITION BY path ORDER BY i) AS after FROM wts), "
    "bounds AS (SELECT path, i FROM nb WHERE i = 0 OR i = m - 1 OR (wt > before AND wt > after)), "
    "spans AS (SELECT path, i AS s, lead(i) OVER (PARTITION BY path ORDER BY i) + 2 AS e FROM bounds), "
    "sized AS (SELECT path, s, e, e - s AS n FROM spans WHERE e IS NOT NULL AND e - s >= 3), "
    "cut AS (SELECT path, s, n FROM sized WHERE n <= 16 "
    "UNION ALL SELECT path, s + 16 * unnest(range(0, n // 16)), 16 FROM sized WHERE n > 16 "
    "UNION ALL SELECT path, e - greatest(n % 16, 3), greatest(n % 16, 3) FROM sized WHERE n > 16 AND n % 16 > 0), "
    "byte AS (SELECT path, unnest(range(0, len(b))) AS i, unnest(b) AS x FROM hexed), "
    "gr AS (SELECT DISTINCT c.path, c.n, list(y.x ORDER BY y.i) AS g FROM "
    "(SELECT path, s, n, unnest(range(s, s + n)) AS i FROM (SELECT DISTINCT path, s, n FROM cut)) c "
    "JOIN byte y ON y.path = c.path AND y.i = c.i GROUP BY c.path, c.s, c.n), "
    "ab AS (SELECT path, n, CASE WHEN n = 3 THEN CAST(CAST('0x' || g[1] || g[2] || g[3] AS UBIGINT) AS UHUGEINT) "
    f"ELSE {word('0')} * {_FOUR} + {word(_QUARTER)} END AS a, "
    f"CASE WHEN n = 3 THEN 0::UHUGEINT ELSE {word('n - 4')} * {_FOUR} + {word('n - 4 - ' + _QUARTER)} END AS b FROM gr), "
    f"hs AS (SELECT path, {wyhash('a', 'b', 'n')} AS h FROM ab), "
    "ngram AS (SELECT DISTINCT path, CAST(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN CAST(h AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(h AS HUGEINT) END AS BIGINT) AS hash FROM hs)"
)


def covering() -> str:
    q = cat.TRIGRAM_QUERY.lower().encode()
    found = {hash_bytes(q[i:i + n]) for n in range(3, min(16, len(q)) + 1) for i in range(len(q) - n + 1)}
    return ", ".join(str(h - 2**64 if h >= 2**63 else h) for h in sorted(found))


# ── fuzzy path score ─────────────────────────────────────────────────────────


def fuzzy_part(tag: str, query: str) -> str:
    """One alignment as a chain of relations, one per query character.

    Along the path, the best gap ending at a cell is a running maximum, because opening
    one gap from an aligned cell always beats chaining two.
    """
    rows = [
        f"{tag}0 AS (SELECT path, j, ch, base, len, CAST(0 AS DOUBLE) AS h, CAST(-3 AS DOUBLE) AS up, 0 AS used, "
        "16 + CASE WHEN j = 0 OR prev IN ('/', '_', '-', '.', chr(92)) THEN 8 ELSE 0 END + CASE WHEN j >= base THEN 6 ELSE 0 END "
        "+ CASE WHEN j = 0 OR j = base THEN 6 ELSE 0 END AS place FROM chars)"
    ]
    for i, c in enumerate(query, start=1):
        prev = f"{tag}{i - 1}"
        follow = "0" if i == 1 else "CASE WHEN j > 0 AND dh > h * 0.5 THEN 4 ELSE 0 END"
        rows.append(
            f"{tag}{i}a AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY path ORDER BY j), 0) AS dh FROM {prev}), "
            f"{tag}{i}b AS (SELECT *, greatest(h - 3, up - 1) AS up2, CASE WHEN lower(ch) = {lit(c.lower())} "
            f"THEN place + CASE WHEN ch = {lit(c)} THEN 2 ELSE 0 END + {follow} ELSE -8 END AS gain FROM {tag}{i}a), "
            f"{tag}{i}c AS (SELECT *, greatest(0, dh + gain, up2) AS m FROM {tag}{i}b), "
            f"{tag}{i}d AS (SELECT path, j, ch, base, len, place, up2 AS up, used, greatest(m, coalesce(max(m + j) OVER "
            "(PARTITION BY path ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) - j - 2) AS h "
            f"FROM {tag}{i}c), "
            f"{tag}{i} AS (SELECT path, j, ch, base, len, place, up, h, CASE WHEN max(h) OVER (PARTITION BY path) > 0 THEN {i} ELSE used END AS used FROM {tag}{i}d)"
        )
    n = len(query)
    rows.append(
        f"{tag} AS (SELECT path, CAST(max(h) / CAST(CAST(sqrt(max(len)) AS FLOAT) AS DOUBLE) AS FLOAT) AS score FROM {tag}{n} "
        f"GROUP BY path HAVING max(h) > 0 AND max(used) >= {(n + 1) // 2} AND max(h) >= {n} * 16 * 0.3)"
    )
    return ", ".join(rows)


def fuzzy() -> str:
    """The registered query has two parts and one extension; no name is an entry point."""
    one, two, ext = cat.FUZZY.split(" ")
    return (
        f"WITH {DOCS}, named AS (SELECT path FROM docs WHERE ends_with(path, {lit(ext[1:])})), "
        "chars AS (SELECT path, j, substr(path, CAST(j + 1 AS INTEGER), 1) AS ch, CASE WHEN j > 0 THEN substr(path, CAST(j AS INTEGER), 1) ELSE '' END AS prev, "
        "length(path) - length(regexp_extract(path, '([^/]*)$', 1)) AS base, length(path) AS len FROM "
        "(SELECT path, unnest(range(0, length(path))) AS j FROM named)), "
        f"{fuzzy_part('p', one)}, {fuzzy_part('q', two)} "
        "SELECT p.path, round(CAST(CAST(CAST(p.score AS DOUBLE) + CAST(q.score AS DOUBLE) AS FLOAT) AS DOUBLE), 4) AS score "
        "FROM p JOIN q ON q.path = p.path"
    )


# ── path filters ─────────────────────────────────────────────────────────────

SITE = (
    "site AS (SELECT unnest([u, " + ", ".join(
        f"u || '/{n}'" for n in (
            ".env.local", "id_rsa", "key.pem", "app.min.js", "node_modules/x.js", "main.py", ".aws/cfg.yaml", "a.lock"
        )
    ) + "]) AS path FROM (SELECT regexp_extract(url, '://([^?#]*)', 1) AS u FROM pages))"
)


def any_suffix(expr: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {lit(s)})" for s in suffixes) + ")"


BASENAME = "regexp_extract(path, '([^/]*)$', 1)"
SENSITIVE = (
    f"(starts_with({BASENAME}, '.env') OR {BASENAME} IN ({', '.join(lit(n) for n in paths.SENSITIVE_NAMES)}) "
    f"OR {any_suffix(BASENAME, paths.SENSITIVE_SUFFIXES)} OR "
    + " OR ".join(f"contains(path, {lit(d)})" for d in paths.SENSITIVE_DIRS) + ")"
)
SKIP_FILE = f"({any_suffix('path', paths.SKIP_SUFFIXES)} OR {SENSITIVE})"
LANGUAGE = "CASE " + " ".join(
    f"WHEN {any_suffix('path', suffixes)} THEN '{name}'" for name, suffixes in paths.LANGUAGE_SUFFIXES
) + " ELSE 'unknown' END"

LATEST = "SELECT path, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(timestamp_ms, seq) AS timestamp_ms FROM versions"
SUB = f"instr({fold('line')}, {lit(cat.SUBSTRING.lower())}) > 0"
FOUND = f"SELECT path, line_num AS line, line AS text FROM ln WHERE {SUB}"
GRANT = (
    "req AS (SELECT event_id AS req, user_id AS agent_id, event_type || '/' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS path FROM events)"
)
STATE = (
    "SELECT path, max(seq) AS mtime_ms, count(*) % 7 AS size, count(*) % 3 AS hash FROM versions WHERE {0} GROUP BY path"
)

ORACLES: dict[str, str] = {
    "line_stats": f"WITH {DOCS} SELECT path, {LANGUAGE} AS language, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count, "
    "CAST(octet_length(encode(text)) AS BIGINT) AS byte_size FROM docs",
    "corpus_filter": "WITH p AS (SELECT 'site/' || regexp_extract(url, '://([^?#]*)', 1) || '.json' AS path, html FROM pages) "
    f"SELECT path, CAST(octet_length(encode(html)) AS BIGINT) AS byte_size FROM p WHERE instr(left(html, 512), chr(0)) = 0 AND NOT {SKIP_FILE}",
    "search_substring": f"WITH {DOCS}, {lines_of('docs')} {FOUND}",
    "search_top50": f"WITH {DOCS}, {lines_of('docs')} {FOUND} ORDER BY path, line_num LIMIT 50",
    "search_path_filter": f"WITH {DOCS}, {lines_of('docs')} {FOUND} AND starts_with(path, 'src1/en/')",
    "search_regex": f"WITH {DOCS}, {lines_of('docs')} SELECT path, line_num AS line, line AS text FROM ln "
    "WHERE regexp_matches(line, '^[A-Z][a-z]+ (of+|the+|to+) [a-z]{2,5}')",
    "search_regex_alternatives": f"WITH {DOCS}, {lines_of('docs')} SELECT path, line_num AS line, line AS text FROM ln "
    "WHERE regexp_matches(line, '(er+|on+) th') OR regexp_matches(line, '[0-9]{3}[.,]') OR line = ''",
    "search_scoped": f"WITH {code_files()}, {declarations()}, {FIRST_DECL}, {lines_of('code')}, "
    f"hit AS (SELECT * FROM ln WHERE instr({fold('line')}, {lit(cat.SCOPE_QUERY.lower())}) > 0) "
    "SELECT h.path, h.line_num, h.line AS line_text, d.name AS scope_name, d.kind AS scope_kind, "
    "CAST(coalesce(d.line_num, 0) AS INTEGER) AS scope_start, CAST(coalesce(d.line_num, 0) AS INTEGER) AS scope_end "
    "FROM hit h ASOF LEFT JOIN first_decl d ON h.path = d.path AND h.line_num >= d.line_num",
    "enclosing_scope": f"WITH {code_files()}, {declarations()}, {FIRST_DECL}, {lines_of('code')}, "
    "hit AS (SELECT * FROM ln WHERE line <> '') "
    "SELECT h.path, h.line_num, d.name AS scope_name, d.kind AS scope_kind, "
    "CAST(coalesce(d.line_num, 0) AS INTEGER) AS scope_start, CAST(coalesce(d.line_num, 0) AS INTEGER) AS scope_end "
    "FROM hit h ASOF LEFT JOIN first_decl d ON h.path = d.path AND h.line_num >= d.line_num",
    "word_index": f"WITH {DOCS}, {lines_of('docs')} SELECT DISTINCT unnest(regexp_extract_all(line, '[A-Za-z0-9_]{{2,}}')) AS word, path, line_num FROM ln",
    "word_lookup": f"WITH {DOCS}, {lines_of('docs')} SELECT path, line_num FROM ln "
    f"WHERE list_contains(regexp_extract_all(line, '[A-Za-z0-9_]{{2,}}'), {lit(cat.WORD)})",
    "word_df": f"WITH {DOCS}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{{2,}}')) AS word FROM docs) "
    "SELECT word, count(*) AS files FROM w GROUP BY word",
    "trigram_postings": f"WITH {DOCS}, {BYTES}, {POSTINGS} SELECT doc_id, tri, next_mask, loc_mask FROM post",
    "trigram_candidates": trigram_candidates(),
    # Literal runs of the two alternatives: "the " before the group (and "es" after it is
    # too short); "tionre" and "ment".
    "regex_candidates": f"WITH {DOCS}, {BYTES}, {POSTINGS}, "
    "f AS (SELECT doc_id, list(tri) AS t FROM post GROUP BY doc_id) SELECT doc_id FROM f WHERE "
    f"list_has_all(t, [{tri('the')}, {tri('he ')}]) OR list_has_all(t, [{tri('tio')}, {tri('ion')}, {tri('onr')}, {tri('nre')}, {tri('men')}, {tri('ent')}])",
    "search_indexed": f"WITH {DOCS}, {lines_of('docs')} SELECT path, line_num AS line, line AS text FROM ln "
    f"WHERE instr({fold('line')}, {lit(cat.TRIGRAM_QUERY)}) > 0",
    "search_indexed_regex": f"WITH {DOCS}, {lines_of('docs')} SELECT path, line_num AS line, line AS text FROM ln "
    "WHERE regexp_matches(line, 'the (on|er)es') OR regexp_matches(line, 'tionre.*ment')",
    "index_base_overlay": "WITH docs AS (SELECT doc_id, '' AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) "
    f"THEN text || ' Overlaid' ELSE text END AS text FROM documents), {BYTES} "
    "SELECT doc_id, count(DISTINCT t) AS trigrams FROM grams GROUP BY doc_id",
    "index_file_count": f"WITH {DOCS}, {BYTES} SELECT count(DISTINCT doc_id) AS files FROM grams",
    "trigram_lookup": f"WITH {DOCS}, {BYTES}, {POSTINGS} SELECT doc_id, next_mask, loc_mask FROM post WHERE tri = {tri('the')}",
    "pair_counts": f"WITH {DOCS}, {PAIRS} SELECT a, b, CAST(n AS BIGINT) AS n FROM counted",
    "pair_weights": f"WITH {DOCS}, {PAIRS}, every AS (SELECT CAST(r // 256 AS INTEGER) AS a, CAST(r % 256 AS INTEGER) AS b FROM range(65536) t(r)) "
    "SELECT e.a, e.b, CAST(coalesce(65024 - (c.n * 60928) // (SELECT max(n) FROM counted), 65024) AS INTEGER) AS w "
    "FROM every e LEFT JOIN counted c ON c.a = e.a AND c.b = e.b",
    "ngram_postings": f"WITH {DOCS}, {NGRAMS} SELECT path, hash FROM ngram",
    "ngram_candidates": f"WITH {DOCS}, {NGRAMS} SELECT DISTINCT path FROM ngram WHERE hash IN ({covering()})",
    "fuzzy_paths": fuzzy(),
    "fuzzy_top": fuzzy() + " ORDER BY CAST(CAST(p.score AS DOUBLE) + CAST(q.score AS DOUBLE) AS FLOAT) DESC, p.path LIMIT 50",
    "extract_lines": f"WITH {DOCS}, {lines_of('docs')} SELECT path, line_num, lpad(CAST(line_num AS VARCHAR), 5, ' ') || ' | ' || line AS line "
    f"FROM ln WHERE line_num BETWEEN {cat.LINE_RANGE[0]} AND {cat.LINE_RANGE[1]}",
    "compact_lines": f"WITH {code_files()}, {lines_of('code')}, b AS (SELECT ln.*, language, trim(line, chr(32) || chr(9)) AS body FROM ln JOIN code USING (path)) "
    "SELECT path, line_num, line FROM b WHERE NOT (body = '' OR (language IN ('zig', 'rust', 'go_lang') AND starts_with(body, '//')) "
    "OR (language IN ('python', 'ruby') AND starts_with(body, '#')) OR (language IN ('javascript', 'typescript', 'c', 'cpp') "
    "AND (starts_with(body, '//') OR starts_with(body, '/*') OR starts_with(body, '*'))))",
    "symbol_bodies": f"WITH {code_files()}, {declarations()}, {lines_of('code')} SELECT d.path, CAST(d.line_num AS INTEGER) AS line_start, "
    "CAST(d.line_num AS INTEGER) AS line_end, lpad(CAST(d.line_num AS VARCHAR), 5, ' ') || ' | ' || l.line || chr(10) AS body "
    "FROM decl d JOIN ln l ON l.path = d.path AND l.line_num = d.line_num WHERE d.kind = 'function'",
    "glob_include": f"WITH {DOCS} SELECT path FROM docs WHERE path LIKE '%9.md' OR path LIKE 'src1%/%/%0.md'",
    "base_path": f"WITH {DOCS} SELECT path FROM docs WHERE starts_with(path, 'src1/')",
    "tree_nodes": CODE_TREE + tree("", None, "TRUE") + " " + NODES,
    "tree_filtered": CODE_TREE + tree(
        "src/rust", 1, "(regexp_matches(path, '/f[^/]*7\\.rs$') OR rel LIKE 'rust/g1%/%' OR path LIKE 'rust/g1%/%')"
    ) + " " + NODES,
    "tree_depth_zero": CODE_TREE + tree("src/php/g3", 0, "TRUE") + " " + NODES,
    "tree_max_nodes": CODE_TREE + tree("", None, "TRUE") + " SELECT full_path, level, CASE WHEN is_dir THEN "
    "regexp_extract(full_path, '([^/]*/)$', 1) ELSE regexp_extract(full_path, '([^/]*)$', 1) || '  ' || line_count || 'L  ' || symbol_count || ' sym' END AS text "
    f"FROM nodes ORDER BY {SORT_KEY} LIMIT 200",
    "tree_by_size": CODE_TREE + tree("", None, "TRUE") + f" SELECT full_path, byte_size FROM nodes ORDER BY {SIZE_KEY} LIMIT 200",
    "language_detect": f"WITH {code_files()} SELECT path, language FROM code",
    "sensitive_filter": f"WITH {SITE} SELECT path, {SENSITIVE} AS sensitive FROM site",
    "skip_dir_filter": f"WITH {SITE} SELECT path, list_has_any(string_split(path, '/'), [{', '.join(lit(d) for d in paths.SKIP_DIRS)}]) AS skipped FROM site",
    "skip_file_filter": f"WITH {SITE} SELECT path, {SKIP_FILE} AS skipped FROM site",
    # Directories first (src3, any fr but src2/fr is named later, src6/en), then files:
    # the last rule that names a file decides.
    "ignore_rules": f"WITH {DOCS} SELECT path FROM docs WHERE NOT (starts_with(path, 'src3/') OR "
    "(path LIKE '%/fr/%' AND NOT starts_with(path, 'src2/fr/')) OR starts_with(path, 'src6/en/') OR path LIKE '%/src6/en/%') "
    "AND NOT CASE WHEN path LIKE '%11.md' THEN FALSE WHEN path LIKE 'src5/d%/%7.md' THEN TRUE WHEN path LIKE '%1.md' THEN TRUE ELSE FALSE END",
    "nested_ignore_rules": f"WITH {code_files()} SELECT path FROM code WHERE NOT ends_with(path, '.rs') "
    "AND NOT (starts_with(path, 'src/python/') AND regexp_matches(path, '/f1[^/]*$') AND NOT ends_with(path, '.py')) "
    "AND NOT starts_with(path, 'src/python/g2/')",
    "outline_summary": f"WITH {code_files()}, {declarations()}, {STATS} SELECT path, language, line_count, byte_size, symbol_count FROM stats",
    "outlines": f"WITH {code_files()}, {declarations()}, {STATS}, "
    "s AS (SELECT path, string_agg(name || '@' || line_num, '|' ORDER BY line_num, ord) AS symbols FROM decl GROUP BY path), "
    "i AS (SELECT path, string_agg(dep, '|' ORDER BY line_num, ord, item) AS imports FROM (SELECT path, line_num, ord, "
    "unnest(imports) AS dep, unnest(range(0, len(imports))) AS item FROM decl) GROUP BY path) "
    "SELECT stats.path, language, line_count, byte_size, coalesce(symbols, '') AS symbols, coalesce(imports, '') AS imports "
    "FROM stats LEFT JOIN s ON s.path = stats.path LEFT JOIN i ON i.path = stats.path",
    "find_symbol": f"WITH {declarations()} {SYMBOLS} WHERE name = 'Show' ORDER BY path, line_num LIMIT 1",
    "find_all_symbols": f"WITH {declarations()} {SYMBOLS} WHERE name = 'LIMIT'",
    "deps_edges": f"WITH {declarations()}, {EDGES} SELECT path, dep, CAST(pos AS INTEGER) AS pos FROM edges",
    "deps_forward": f"WITH {declarations()}, {EDGES} SELECT dep, path FROM edges WHERE path = "
    "(SELECT 'src/go_lang/g' || arg_min(c_nationkey, c_custkey) || '/f' || min(c_custkey) || '.go' FROM customer)",
    "deps_reverse": f"WITH {declarations()}, {EDGES} SELECT DISTINCT path FROM edges WHERE dep IN ('vendor/lib3.zig', 'lib3.zig')",
    "deps_reverse_all": f"WITH {declarations()}, {EDGES}, m AS (SELECT unnest(['lib/lib' || n_nationkey || '.zig', 'lib/Util' || n_nationkey || '.php']) AS path FROM nation) "
    "SELECT DISTINCT m.path, e.path AS importer FROM m JOIN edges e ON e.dep = m.path OR e.dep = regexp_extract(m.path, '([^/]*)$', 1)",
    "importer_counts": f"WITH {declarations()}, {EDGES} SELECT dep, count(DISTINCT path) AS importers FROM edges GROUP BY dep",
    "changes_since": f"WITH {VERSIONS} SELECT path, op, seq, timestamp_ms FROM ({LATEST} WHERE seq > 500 GROUP BY path)",
    "changes_count": f"WITH {VERSIONS} SELECT count(*) AS changes FROM versions WHERE seq > 500",
    "latest_version": f"WITH {VERSIONS} {LATEST} GROUP BY path",
    "version_at_cursor": f"WITH {VERSIONS} {LATEST} WHERE seq <= 700 GROUP BY path",
    "version_cap": f"WITH {VERSIONS} SELECT path, seq, op, timestamp_ms FROM versions "
    f"QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= {cat.KEEP_VERSIONS}",
    "hot_files": f"WITH {VERSIONS} SELECT path, CAST(coalesce(s, 0) AS BIGINT) AS seq FROM (SELECT 'user/' || c_custkey AS path FROM customer) "
    "LEFT JOIN (SELECT path, max(seq) AS s FROM versions GROUP BY path) USING (path) ORDER BY 2 DESC, 1 LIMIT 100",
    "current_seq": f"WITH {VERSIONS} SELECT coalesce(max(seq), 0) AS current_seq FROM versions",
    "list_files": f"WITH {VERSIONS} SELECT DISTINCT path FROM versions",
    "sequence_assignment": f"WITH {DOCS} SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size, "
    "1000 + row_number() OVER (ORDER BY path) AS seq FROM docs",
    "change_diff": f"WITH {VERSIONS}, o AS ({STATE.format(chr(111) + 'p IN (' + lit('click') + ', ' + lit('view') + ')')}), "
    f"n AS ({STATE.format('op IN (' + lit('click') + ', ' + lit('view') + ', ' + lit('error') + ') AND path <> ' + lit('user/5'))}), "
    "j AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' "
    "WHEN o.mtime_ms = n.mtime_ms THEN 'unchanged' WHEN o.size = n.size AND o.hash <> 0 AND o.hash = n.hash THEN 'unchanged' "
    "ELSE 'modified' END AS change, n.mtime_ms, n.size, n.hash AS nh, o.hash AS oh FROM o FULL OUTER JOIN n ON o.path = n.path) "
    "SELECT path, change, mtime_ms, size, coalesce(nh, CASE WHEN change = 'unchanged' THEN oh END) AS hash FROM j",
    "agent_leases": f"WITH {GRANT}, held AS (SELECT s_suppkey AS agent_id, 'click/' || s_suppkey AS path, "
    "CASE WHEN s_acctbal > 0 THEN 2000 ELSE 500 END AS expiry FROM supplier), "
    "w AS (SELECT r.path, coalesce(max(h.agent_id), arg_min(r.agent_id, r.req)) AS holder FROM req r "
    "LEFT JOIN held h ON h.path = r.path AND h.expiry > 1000 GROUP BY r.path), "
    f"g AS (SELECT DISTINCT r.agent_id, r.path, CAST({1000 + cat.LEASE_TTL_MS} AS BIGINT) AS expiry FROM req r JOIN w ON w.path = r.path AND w.holder = r.agent_id) "
    "SELECT agent_id, path, expiry FROM g UNION ALL SELECT agent_id, path, CAST(expiry AS BIGINT) FROM held WHERE path NOT IN (SELECT path FROM g)",
    "agent_grants": f"WITH {GRANT} SELECT req, agent_id, path, agent_id = first_value(agent_id) OVER (PARTITION BY path ORDER BY req) AS granted FROM req",
    "agent_grants_registered": f"WITH {GRANT}, known AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12), "
    "asked AS (SELECT r.* FROM req r SEMI JOIN known k ON k.id = r.agent_id), "
    "w AS (SELECT path AS held_path, arg_min(agent_id, req) AS holder FROM asked GROUP BY path) "
    "SELECT r.req, r.agent_id, r.path, coalesce(r.agent_id = w.holder, false) AS granted FROM req r LEFT JOIN w ON w.held_path = r.path",
    "content_hash": f"WITH {DOCS} SELECT path, greatest(CAST('0x' || left(md5(text), 15) AS BIGINT), 1) AS hash FROM docs",
    "agent_liveness": "WITH b AS (SELECT user_id AS id, max(epoch_us(ts) // 1000) AS at_ms FROM events GROUP BY user_id) "
    f"SELECT c_custkey AS id, c_name AS name, CASE WHEN 1704153600000 - coalesce(at_ms, 1704067200000) > {cat.REAP_TIMEOUT_MS} "
    "THEN 'crashed' ELSE 'active' END AS state, CAST(coalesce(at_ms, 1704067200000) AS BIGINT) AS last_seen "
    "FROM customer LEFT JOIN b ON b.id = c_custkey",
    "snapshot_meta": f"WITH {code_files()} SELECT count(*) AS file_count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes, "
    "CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_lines FROM code",
}
ORACLES.update({
    f"symbols_{lang}": f"WITH {declarations('orders', (lang,))} {SYMBOLS}" for lang in EXPECTED
})

# Files of many orders: the lines of a template follow those of the orders before.  Only the Python
# template hands a state on: an order without its flag leaves a string open when it began outside
# of one, and an order that begins inside shows the two declarations below.
LARGE_INSIDE = [(5, "function", "in_doc_{k}", "def in_doc_{k}():"), (11, "function", "tail_{k}", "def tail_{k}(): return 1")]
LARGE = (
    f"o1 AS (SELECT *, {adapters.SOURCES['orders'][2]} AS flag, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders), "
    "o2 AS (SELECT *, max(CASE WHEN flag THEN rn END) OVER (PARTITION BY o_orderpriority ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM o1), "
    "o AS (SELECT *, (rn - 1 - coalesce(shown, 0)) % 2 = 1 AS inside FROM o2)"
)


def large_symbols() -> str:
    parts = []
    for lang in EXPECTED:
        template = adapters.TEMPLATES[lang]
        found = [(line, kind, name, detail, need, False) for line, _, kind, name, detail, _, need in EXPECTED[lang]]
        if lang == "python":
            found += [(*row, None, True) for row in LARGE_INSIDE]
        for line, kind, name, detail, need, inside in found:
            tests = [] if need is None else ["flag" if need else "NOT flag"]
            tests += [] if lang != "python" else ["inside" if inside else "NOT inside"]
            at = f"CAST((rn - 1) * {len(template.lines)} + {line} AS INTEGER)"
            parts.append(
                f"SELECT 'large/{lang}/' || o_orderpriority || '{template.ext}' AS path, {fill(name, 'orders')} AS name, '{kind}' AS kind, "
                f"{at} AS line_start, {at} AS line_end, {fill(detail, 'orders')} AS detail FROM o{' WHERE ' + ' AND '.join(tests) if tests else ''}"
            )
    return f"WITH {LARGE} " + " UNION ALL ".join(parts)


def large_lines() -> str:
    first, last = cat.LARGE_RANGE
    parts = []
    for lang, template in adapters.TEMPLATES.items():
        text = f"CASE WHEN flag THEN {fill(adapters.template_text(lang, True), 'orders')} ELSE {fill(adapters.template_text(lang, False), 'orders')} END"
        parts.append(
            f"SELECT 'large/{lang}/' || o_orderpriority || '{template.ext}' AS path, CAST((rn - 1) * {len(template.lines)} + i AS INTEGER) AS line_num, "
            f"string_split({text}, chr(10))[i] AS line FROM o, range(1, {len(template.lines) + 1}) t(i)"
        )
    return f"WITH {LARGE}, a AS ({' UNION ALL '.join(parts)}) SELECT * FROM a WHERE line_num BETWEEN {first} AND {last}"


ORACLES.update({"symbols_of_large_files": large_symbols(), "lines_of_large_files": large_lines()})

# ── stored state ─────────────────────────────────────────────────────────────

STORED = (
    "docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) "
    f"THEN coalesce(text, '') || '{OVERLAY}' ELSE text END AS text FROM documents "
    "WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"
)
MODULES = "m AS (SELECT unnest(['lib/lib' || n_nationkey || '.zig', 'lib/Util' || n_nationkey || '.php']) AS path FROM nation)"
ORACLES.update({
    "search_stored": f"WITH {STORED}, {lines_of('docs')} SELECT path, line_num AS line, line AS text FROM ln "
    f"WHERE instr({fold('line')}, {lit(cat.TRIGRAM_QUERY)}) > 0",
    "search_stored_regex": f"WITH {STORED}, {lines_of('docs')} SELECT path, line_num AS line, line AS text FROM ln "
    "WHERE regexp_matches(line, 'the (on|er)es') OR regexp_matches(line, 'tionre.*ment')",
    "word_index_stored": f"WITH {STORED}, {lines_of('docs')} SELECT path, line_num FROM ln "
    f"WHERE list_contains(regexp_extract_all(line, '[A-Za-z0-9_]{{2,}}'), {lit(cat.WORD)})",
    "ngrams_stored": f"WITH {STORED}, {NGRAMS} SELECT DISTINCT path FROM ngram WHERE hash IN ({covering()})",
    "trigrams_stored": f"WITH {STORED}, {BYTES}, {POSTINGS} SELECT d.path, tri, next_mask, loc_mask FROM post JOIN docs d USING (doc_id)",
    "snapshot_roundtrip": f"WITH {code_files()}, {declarations()}, {STATS} SELECT path, language, line_count, byte_size, symbol_count FROM stats",
    "deps_factored": f"WITH {declarations()}, {EDGES}, {MODULES}, k AS (SELECT DISTINCT unnest([path, regexp_extract(path, '([^/]*)$', 1)]) AS dep, path FROM m) "
    "SELECT DISTINCT dep, 'importer' AS side, path FROM edges WHERE dep IN (SELECT dep FROM k) "
    "UNION ALL SELECT dep, 'file' AS side, path FROM k WHERE dep IN (SELECT dep FROM edges)",
    "deps_expanded": f"WITH {declarations()}, {EDGES}, {MODULES} "
    "SELECT DISTINCT m.path, e.path AS importer FROM m JOIN edges e ON e.dep = m.path OR e.dep = regexp_extract(m.path, '([^/]*)$', 1)",
    "edit_log": "SELECT row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS seq, 'user/' || user_id AS path, event_type AS op, "
    "event_type || ' ' || CAST(CAST(value AS DECIMAL(20, 4)) AS VARCHAR) AS payload FROM events",
})
