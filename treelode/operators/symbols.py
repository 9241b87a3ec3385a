"""Symbol outlines and raw imports for seven language groups.

The parsers are line-oriented and table-driven: a line is recognised by its head (the
declaration prefix), which decides the kind.  What crosses lines (doc strings, block
comments, Go import blocks, PHP braces, a Rust test attribute on the previous line) is a
small state machine over the lines of a file.  A file is one row and its lines leave ``explode``
in order, so the machine runs in the task that reads the file: outlines need no shuffle.
Only lines that can change a state or declare a symbol get there, and the machine keeps a
handful of numbers whatever the length of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.functions import paths
from treelode.functions.text import (
    IDENT,
    after_first,
    contains_any,
    contains_fold,
    ident_after_token,
    line_count,
    null_if_empty,
    php_namespace_path,
    php_strip_alias,
    python_module,
    python_module_path,
    quote_java,
    sql_map,
    sql_text,
    string_literal,
    trim_blank,
)
from treelode.operators.lines import file_stats, lines
from treelode.session import compiled

# Declaration heads and the symbol kind each one declares.
HEADS = {
    "zig": {
        "pub fn ": "function", "fn ": "function", "pub const ": "constant", "const ": "constant",
        "test ": "test_decl",
    },
    "python": {"def ": "function", "class ": "struct_def", "import ": "import", "from ": "import"},
    "typescript": {
        "function ": "function", "export function ": "function", "async function ": "function",
        "export async function ": "function", "export const ": "constant", "export let ": "constant",
        "export var ": "constant",
    },
    "rust": {
        "fn ": "function", "pub fn ": "function", "pub(crate) fn ": "function", "pub(super) fn ": "function",
        "async fn ": "function", "pub async fn ": "function", "unsafe fn ": "function",
        "pub unsafe fn ": "function", "pub(crate) async fn ": "function", "pub(crate) unsafe fn ": "function",
        "pub unsafe extern ": "function",
        "struct ": "struct_def", "pub struct ": "struct_def", "pub(crate) struct ": "struct_def",
        "enum ": "enum_def", "pub enum ": "enum_def", "pub(crate) enum ": "enum_def",
        "trait ": "trait_def", "pub trait ": "trait_def", "pub(crate) trait ": "trait_def",
        "unsafe trait ": "trait_def", "pub unsafe trait ": "trait_def",
        "impl ": "impl_block", "impl<": "impl_block", "unsafe impl ": "impl_block",
        "type ": "type_alias", "pub type ": "type_alias", "pub(crate) type ": "type_alias",
        "const ": "constant", "pub const ": "constant", "pub(crate) const ": "constant",
        "static ": "constant", "pub static ": "constant", "pub(crate) static ": "constant",
        "macro_rules!": "macro_def",
        "use ": "import", "pub use ": "import", "pub(crate) use ": "import",
        "mod ": "import", "pub mod ": "import", "pub(crate) mod ": "import",
    },
    "go_lang": {
        "func ": "function", "func (": "function", "type ": "struct_def", "import ": "import",
        "const ": "constant", "var ": "variable",
    },
    "php": {
        "interface ": "interface_def", "trait ": "trait_def", "enum ": "enum_def", "class ": "class_def",
        "abstract class ": "class_def", "final class ": "class_def", "readonly class ": "class_def",
        "const ": "constant", "public const ": "constant", "protected const ": "constant",
        "private const ": "constant",
    },
    "ruby": {
        "def ": "function", "def self.": "function", "class ": "struct_def", "module ": "struct_def",
        "require ": "import", "require_relative ": "import",
    },
}
HEADS["javascript"] = HEADS["typescript"]

# Heads whose symbol is named by the whole line.
WHOLE_LINE = (
    "test ", "import ", "from ", "use ", "pub use ", "pub(crate) use ", "require ", "require_relative ",
)
PARSED_LANGS = tuple(HEADS)

# Lines that matter besides those with a head, as regexes over the trimmed line.
_MARKS = {
    "zig": r"/\*|\*/",
    "python": "\"\"\"|'''",
    "typescript": r"import |require\(|/\*|\*/",
    "rust": r"\A#\[t|/\*|\*/",
    "go_lang": "[\"']|\\A\\)|/\\*|\\*/",
    "php": r"[{}]|function |\Ause |/\*|\*/",
    "ruby": r"\A=(?:begin|end)",
}
_MARKS["javascript"] = _MARKS["typescript"]

NOTHING = r"\z\A."  # a regex that never matches

# A line's effect on the "inside a comment" state.
NO_ACTION, LEAVE, ENTER, TOGGLE = -1, 0, 1, 2

_OPENS = r"(?s)\A/\*(?!.*\*/)"
_REOPENS = r"(?s)\A(?>.*?\*/)[ \t]*/\*(?!.*\*/)"
_PHP_OPENS = r"(?s)\A(?=/\*)(?!.*\*/)"
_PHP_REOPENS = r"(?s)\A(?>.*?\*/)[ \t]*(?=/\*)(?!(?>/\*).*\*/)(?!/\*/)"
_AFTER_CLOSE = r"(?s)\A(?>.*?\*/)[ \t]*(.*)\z"
_LEADING_COMMENT = r"(?s)\A/\*(?>.*?\*/)[ \t]*"

_ENTRY = "struct<name: string, kind: string, detail: string, imports: array<string>>"
_NO_IMPORTS = "cast(array() as array<string>)"


def _heads_regex(lang: str) -> str:
    longest_first = sorted(HEADS[lang], key=len, reverse=True)
    return "\\A(?:%s)" % "|".join(quote_java(h) for h in longest_first)


def _find_by_lang(text: str, patterns: dict[str, str]) -> Column:
    """First match of the language's pattern in a column; empty if none.  Each pattern is a
    constant, so it is compiled once per task."""
    cases = " ".join(
        f"WHEN {sql_text(lang)} THEN regexp_extract({text}, {sql_text(pattern)}, 0)" for lang, pattern in patterns.items()
    )
    return F.expr(f"coalesce(CASE lang {cases} END, '')")


def _find(text: Column, pattern: Column) -> Column:
    """Text of the first match of a pattern that is itself a column; empty if none."""
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def _comment_action() -> Column:
    lang, body = F.col("lang"), F.col("body")
    quotes = F.regexp_count(body, F.lit("\"\"\"|'''"))
    closes = F.contains(body, F.lit("*/"))
    opens = F.when(lang == "php", body.rlike(_PHP_OPENS)).otherwise(body.rlike(_OPENS))
    reopens = F.when(lang == "php", body.rlike(_PHP_REOPENS)).otherwise(body.rlike(_REOPENS))
    block = (
        F.when(closes & ~reopens, F.when(opens, TOGGLE).otherwise(LEAVE))
        .when(opens, ENTER)
    )
    return (
        F.when(lang == "python", F.when(quotes == 1, TOGGLE).when(quotes >= 2, LEAVE))
        .when(
            lang == "ruby",
            F.when(F.col("flush"), F.when(F.startswith(body, F.lit("=begin")), ENTER).when(F.startswith(body, F.lit("=end")), LEAVE)),
        )
        .when(contains_any(body, ["/*", "*/"]), block)
    )


def _visible_text(inside: Column) -> Column:
    """What the parser of the language sees of a line; null when it is skipped."""
    lang, body, act = F.col("lang"), F.col("body"), F.col("act")
    base = F.when(~inside, body).when(
        F.contains(body, F.lit("*/")), F.regexp_extract(body, _AFTER_CLOSE, 1)
    )
    block = F.when(~base.rlike(_OPENS), F.regexp_replace(base, _LEADING_COMMENT, ""))
    php = F.when(~base.rlike(r"\A(?:<\?php|//|#|/\*)"), base)
    return null_if_empty(
        F.when(lang == "python", F.when(~inside & act.isNull(), body))
        .when(lang == "ruby", F.when(~inside & ~act.eqNullSafe(F.lit(ENTER)), body))
        .when(lang == "php", php)
        .otherwise(block)
    )


def _php_is_use(s: Column) -> Column:
    return F.startswith(s, F.lit("use ")) & F.contains(s, F.lit("\\"))


def _php_imports(s: Column) -> Column:
    """Paths of a ``use`` statement, one per item of a ``{a, b}`` group."""
    statement = F.substring_index(s, ";", 1)
    body = trim_blank(F.substring(statement, F.lit(5), F.length(statement)))
    base = F.substring_index(body, "{", 1)
    items = F.filter(
        F.transform(F.split(F.substring_index(after_first(body, "{"), "}", 1), ",", -1), trim_blank),
        lambda item: item != "",
    )
    # Two steps, since a lambda evaluates its text again wherever it stands.
    whole = F.transform(items, lambda item: F.concat(base, php_strip_alias(item)))
    grouped = F.transform(whole, php_namespace_path)
    single = F.array(php_namespace_path(php_strip_alias(body)))
    return F.when(body != "", F.when(F.contains(body, F.lit("{")), grouped).otherwise(single))


# What remains of a line when all but quotes, braces and escaped ones is dropped, and
# struct(delta, lowest) of such a remainder: brace balance outside string literals, and the
# lowest running balance right after a closing brace.
_PHP_PUNCTUATION = r"""(?s)(\\['"{}\\])|\\.|[^'"{}\\]+"""
_PHP_BRACES = """
aggregate(
  filter(split(%s, ''), c -> c != ''),
  named_struct('quote', '', 'escaped', false, 'delta', 0, 'lowest', cast(null as int)),
  (a, c) -> named_struct(
    'quote', CASE WHEN a.quote != '' AND NOT a.escaped AND c = a.quote THEN ''
                  WHEN a.quote = '' AND c IN ('\\'', '"') THEN c ELSE a.quote END,
    'escaped', a.quote != '' AND NOT a.escaped AND c = '\\\\',
    'delta', a.delta + CASE WHEN a.quote != '' THEN 0 WHEN c = '{' THEN 1 WHEN c = '}' THEN -1 ELSE 0 END,
    'lowest', CASE WHEN a.quote = '' AND c = '}' THEN least(a.lowest, a.delta - 1) ELSE a.lowest END
  )
)
"""
# The remainders of nearly all lines, so that few are folded character by character.
_COMMON_BRACES = {"{": (1, None), "}": (-1, -1), "{}": (0, 0), "}{": (0, -1), "}}": (-2, -2)}


def _php_balance(left: str) -> Column:
    """struct(delta, lowest) of a remainder column; null where it is null."""
    common = " ".join(
        f"WHEN {sql_text(text)} THEN named_struct('delta', {delta}, 'lowest', cast({'null' if low is None else low} as int))"
        for text, (delta, low) in _COMMON_BRACES.items()
    )
    folded = _PHP_BRACES % left
    return F.expr(f"CASE WHEN {left} IS NULL THEN NULL ELSE CASE {left} {common} ELSE transform(array({folded}), f -> named_struct('delta', f.delta, 'lowest', f.lowest))[0] END END")


def _name() -> Column:
    """Declared name of a line with a head; null when no identifier follows."""
    s, head, lang = F.col("s"), F.col("head"), F.col("lang")
    rest = (
        F.when(head == "pub unsafe extern ", F.when(F.contains(s, F.lit("fn ")), after_first(s, "fn ")))
        .when((head == "impl<") & F.contains(s, F.lit("> ")), after_first(s, "> "))
        .when((lang == "rust") & (F.col("kind") == "constant") & F.contains(s, F.lit("static ")), after_first(s, "static "))
        .when(head == "func (", F.when(F.contains(s, F.lit(") ")), after_first(s, ") ")))
        .when(head == "macro_rules!", F.substring(s, F.lit(14), F.length(s)))
        .otherwise(F.substring(s, F.length(head) + 1, F.length(s)))
    )
    pattern = F.when((lang == "ruby") & (F.col("kind") == "function"), F.lit("\\A%s[?!=]?" % IDENT)).otherwise(
        F.lit("\\A" + IDENT)
    )
    return F.when(F.col("whole"), s).otherwise(null_if_empty(_find(rest, pattern)))


def _imports() -> Column:
    s, lang = F.col("s"), F.col("lang")
    one = (
        F.when(lang == "python", python_module_path(python_module(s)))
        .when(lang == "rust", F.col("name"))
        .otherwise(string_literal(s))
    )
    return F.when(one.isNotNull(), F.array(one))


def raw_imports() -> Column:
    """Imports of a symbol, from its ``lang``, visible line ``s``, ``name`` and ``kind``."""
    found = F.when(F.col("lang") == "php", _php_imports(F.col("s"))).otherwise(_imports())
    return F.coalesce(F.when(F.col("kind") == "import", found), F.expr(_NO_IMPORTS))


# Marks of a line as the machine sees them; one number per line and comment state.
GO_OPEN, GO_CLOSE, CLASS, ATTRIBUTE, HIDDEN, RUST = 1, 2, 4, 8, 16, 32
_CLASS_KINDS = ("interface_def", "trait_def", "enum_def", "class_def")
_PHP_CLASS = "\\A(?:%s)[A-Za-z0-9_]" % "|".join(quote_java(h) for h, k in HEADS["php"].items() if k in _CLASS_KINDS)
_NEVER_LOW = 1 << 30
_RUNNING = ["inside", "in_imports", "follows_test", "in_class"]


def _marks(s: Column, hidden: Column) -> Column:
    """What a visible text ``s`` means for the lines after it.  ``hidden``: a Rust line that
    shows nothing counts as absent."""
    lang = F.col("lang")
    php, rust, go = lang == "php", lang == "rust", lang == "go_lang"
    flags = {
        GO_OPEN: go & (s == "import ("),
        GO_CLOSE: go & F.startswith(s, F.lit(")")),
        # A PHP class line needs a name.
        CLASS: php & s.rlike(_PHP_CLASS),
        ATTRIBUTE: rust & ((s == "#[test]") | F.startswith(s, F.lit("#[tokio::test"))),
        HIDDEN: rust & s.isNull() & hidden,
        RUST: rust,
    }
    total = F.lit(0)
    for flag, holds in flags.items():
        total = total + F.when(holds, flag).otherwise(0)
    return total


def _before(value: np.ndarray, event: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """At each row ``value`` of the last earlier event row of its file, else the file's ``start``.

    ``first`` is where the file of each row begins; ``start`` has one entry per row."""
    last = np.maximum.accumulate(np.where(event, np.arange(len(event)), -1))
    last = np.concatenate([[-1], last[:-1]])
    return np.where(last >= first, value[np.maximum(last, 0)], start)


def _sums_before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the earlier rows of the same file."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[:-1] - total[first]


#: State before the first line of a file: inside a comment, in an import listing, brace depth, depth
#: at which the open class began, whether there is one, lowest depth since, lines that count as
#: absent, last line seen, place of the last test attribute.
STATE = ("comment", "listing", "depth", "opened", "has_class", "lowest", "absent", "last", "attribute")
BEGIN = (0, 0, 0, 0, 0, _NEVER_LOW, 0, 0, -1)
_MACHINE = ("line_num", "act", "marks", "marks_in", "delta", "low", "delta_in", "low_in")


def _advance(batch: pa.RecordBatch, opens: np.ndarray, first: np.ndarray, start: list[np.ndarray]) -> tuple[tuple, tuple]:
    """What the machine knows at every row of a batch (``_RUNNING``), and its ``STATE`` after each row.

    ``opens`` marks the first row of each file, ``first`` is its place, and ``start`` the state its
    file begins in, one entry per row.  Everything comes from running sums and maxima.
    """
    n = batch.num_rows
    num, act, marks, marks_in, delta, low, delta_in, low_in = (batch.column(c).to_numpy().astype(np.int64) for c in _MACHINE)
    comment0, listing0, depth0, opened0, has_class0, lowest0, absent0, last0, attribute0 = start

    # Inside a comment: what the last ENTER or LEAVE said, turned by each TOGGLE since.
    odd = (_sums_before(act == TOGGLE, first) & 1).astype(bool)
    sets = (act == ENTER) | (act == LEAVE)
    inside = _before((act == ENTER) ^ odd, sets, first, comment0.astype(bool)).astype(bool) ^ odd
    marks, delta, low = np.where(inside, marks_in, marks), np.where(inside, delta_in, delta), np.where(inside, low_in, low)

    # Rust lines that show nothing count as absent, kept or not.
    last_num = np.where(opens, last0, np.concatenate([[0], num[:-1]]))
    gone = np.where(inside & (marks & RUST > 0), num - last_num - 1, 0) + (marks & HIDDEN > 0)
    absent = absent0 + _sums_before(gone, first) + gone
    marked = marks & ATTRIBUTE > 0
    attribute = _before(num - absent, marked, first, attribute0)
    starts, turns = (marks & GO_OPEN > 0).astype(np.int64), marks & (GO_OPEN | GO_CLOSE) > 0
    listing = _before(starts, turns, first, listing0)

    # A PHP class is open until a closing brace falls back to the depth it began at.
    depth = depth0 + _sums_before(delta, first)
    is_class = marks & CLASS > 0
    began = np.maximum.accumulate(np.where(is_class | opens, np.arange(n), 0))  # of the class, or of the file
    by_class = is_class[began]
    opened = np.where(by_class, depth[began], opened0)
    has_class = by_class | has_class0.astype(bool)
    reached = np.where(low == _NEVER_LOW, _NEVER_LOW, depth + low)
    stretch = (_NEVER_LOW << 1) * (n - began)
    running = np.minimum.accumulate(reached + stretch) - stretch
    before = np.where(began == np.arange(n), _NEVER_LOW, np.concatenate([[_NEVER_LOW], running[:-1]]))
    before = np.where(by_class, before, np.minimum(before, lowest0))

    known = (inside, listing == 1, attribute == num - absent - 1, has_class & (before > opened))
    after = (
        np.where(act == TOGGLE, ~inside, np.where(act == NO_ACTION, inside, act == ENTER)), np.where(turns, starts, listing),
        depth + delta, opened, has_class, np.minimum(before, reached), absent, num, np.where(marked, num - absent, attribute),
    )
    return known, after


def _stretches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """File number of each row, whether it is the first of its file here, and where that one is."""
    no = batch.column("file_no").to_numpy()
    opens = np.concatenate([[True], no[1:] != no[:-1]])
    return no, opens, np.maximum.accumulate(np.where(opens, np.arange(len(no)), 0))


def _running_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State of every line given the lines of its file before it; see ``annotate``.

    A batch is taken at once; what a file that goes on in the next batch has reached is handed
    over.
    """
    file_no, carried = None, BEGIN
    for batch in batches:
        if batch.num_rows == 0:
            continue
        no, opens, first = _stretches(batch)
        given = [no[0] == file_no and first == 0] * len(STATE)
        start = [np.where(goes_on, g, b) for goes_on, g, b in zip(given, carried, BEGIN)]
        start = [np.broadcast_to(column, len(no)) for column in start]
        known, after = _advance(batch, opens, first, start)
        file_no, carried = no[-1], tuple(column[-1] for column in after)
        kept = batch.drop_columns(list(_MACHINE[1:]))
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(f) for f in known)], names=[*kept.schema.names, *_RUNNING])


def machine_rows(files: DataFrame, also_keep: Column | None, keep: tuple[str, ...]) -> DataFrame:
    """Lines that can declare a symbol or change a state, as ``_advance`` takes them: what each
    does to the state where it is visible (``s``) and where a comment is open (``s_in``)."""
    lang, s, body = F.col("lang"), F.col("s"), F.col("body")
    wanted = F.lit(False) if also_keep is None else also_keep
    parsed = lang.isin(*PARSED_LANGS)
    sources = compiled(files).withColumn("lang", paths.language(F.col("path")))
    if also_keep is None:
        sources = sources.filter(parsed)
    # A file that opens no block comment is never inside one: what lines would mean there is not asked.
    hides = F.contains("text", F.lit("/*")) | (lang == "ruby") & F.contains("text", F.lit("=begin"))
    sources = sources.withColumn("file_no", F.monotonically_increasing_id()).withColumn("hides", hides)
    carried = ["file_no", "path", "lang", *keep]
    rows = (
        lines(sources, keep=(*carried, "hides"))
        .select(*carried, "hides", "line_num", "line", trim_blank(F.col("line")).alias("body"), wanted.alias("wanted"))
        .filter(F.col("wanted") | (_find_by_lang("body", {k: _heads_regex(k) + "|" + _MARKS[k] for k in HEADS}) != ""))
        .select(
            *carried, "hides", "line_num", "body", "wanted",
            F.startswith("line", F.lit("=")).alias("flush"),
            F.when(F.col("wanted"), F.col("line")).alias("line"),
        )
        .withColumn("act", F.when(F.col("hides") | (lang == "python"), _comment_action()))
        .withColumn("s", F.when(parsed, _visible_text(F.lit(False))))
        .withColumn("s_in", F.when(parsed & F.col("hides"), _visible_text(F.lit(True))))
    )

    # Braces count on every PHP statement but ``use``.
    def punctuation(text: str) -> Column:
        col = F.col(text)
        braced = (lang == "php") & (F.contains(col, F.lit("{")) | F.contains(col, F.lit("}"))) & ~_php_is_use(col)
        return F.when(braced, F.regexp_replace(col, _PHP_PUNCTUATION, "$1"))

    return rows.select(
        "*", _marks(s, body != "").alias("marks"), F.when(F.col("hides"), _marks(F.col("s_in"), F.lit(True))).otherwise(0).alias("marks_in"),
        punctuation("s").alias("left"), F.when(F.col("hides"), punctuation("s_in")).alias("left_in"),
    ).select("*", _php_balance("left").alias("b"), _php_balance("left_in").alias("b_in")).select(
        *carried, "line_num", "line", "wanted", "s", "s_in",
        F.coalesce("act", F.lit(NO_ACTION)).alias("act"), "marks", "marks_in",
        F.coalesce("b.delta", F.lit(0)).alias("delta"), F.coalesce("b.lowest", F.lit(_NEVER_LOW)).alias("low"),
        F.coalesce("b_in.delta", F.lit(0)).alias("delta_in"), F.coalesce("b_in.lowest", F.lit(_NEVER_LOW)).alias("low_in"),
    )


def annotate(files: DataFrame, also_keep: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines that matter, with ``entries``: the symbols each one declares.

    ``also_keep`` is a predicate over ``line`` and ``line_num``; its rows are kept as well and
    marked ``wanted``, so a search can be combined with the outline in the same pass.
    ``keep`` names more columns of ``files`` to carry.
    Result: file_no, path, line_num, line (null unless wanted), wanted, entries, ``keep``; rows
    of one file are adjacent and in line order.
    """
    rows = machine_rows(files, also_keep, keep)
    carried = ["file_no", "path", "lang", *keep]
    through = [*carried, "line_num", "line", "wanted", "s", "s_in"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*through).schema)
    schema += "".join(f", {name} boolean" for name in _RUNNING)
    rows = rows.select(*through, *_MACHINE[1:]).mapInArrow(_running_state, schema)
    rows = rows.withColumn("s", F.when(F.col("inside"), F.col("s_in")).otherwise(F.col("s"))).drop("s_in")
    rows = rows.withColumn("head", _find_by_lang("s", {k: _heads_regex(k) for k in HEADS}))
    rows = rows.withColumn("kind", _head_kind())
    return _with_entries(rows, carried).select("file_no", "path", "line_num", "line", "wanted", "entries", *keep)


def _head_kind() -> Column:
    """Kind of (lang, head); null for a line without a head."""
    cases = " ".join(f"WHEN {sql_text(lang)} THEN try_element_at({sql_map(heads)}, head)" for lang, heads in HEADS.items())
    return F.expr(f"CASE WHEN head != '' THEN CASE lang {cases} END END")


def _with_entries(rows: DataFrame, carried: list[str]) -> DataFrame:
    lang, s, head, kind, name = (F.col(c) for c in ("lang", "s", "head", "kind", "name"))
    php, go = lang == "php", lang == "go_lang"

    # A line inside a Go import block is an import when it quotes something.
    listed = go & F.col("in_imports")
    rows = rows.withColumn(
        "kind",
        F.when(listed, F.when(~F.startswith(s, F.lit(")")) & string_literal(s).isNotNull(), F.lit("import")))
        .when(go & (s == "import ("), F.lit(None).cast("string"))
        .when(php & _php_is_use(s), F.lit("import"))
        .when((lang == "zig") & (kind == "constant"), _zig_const_kind(s))
        .when((lang == "rust") & (kind == "function") & F.col("follows_test"), F.lit("test_decl"))
        .otherwise(kind),
    )
    rows = rows.withColumn("whole", listed | head.isin(*WHOLE_LINE))
    rows = rows.withColumn("php_imports", F.when(php & (kind == "import"), _php_imports(s)))
    named = F.when(php & (kind == "import"), F.when(F.col("php_imports").isNotNull(), F.substring_index(s, ";", 1))).otherwise(
        F.when(kind.isNotNull(), _name())
    )
    rows = rows.withColumn("name", named)
    # PHP falls back to a function anywhere on a line that declares nothing else.
    nameless = php & F.coalesce(kind != "import", F.lit(True)) & (name.isNull() | ((kind == "constant") & (name == "class")))
    fallback = nameless & F.contains(s, F.lit("function "))
    rows = rows.select(
        *carried, "line_num", "line", "wanted", "s", "head", "php_imports",
        F.when(fallback, ident_after_token(s, "function ")).when(~nameless, name).alias("name"),
        F.when(fallback, F.when(F.col("in_class"), "method").otherwise("function")).otherwise(kind).alias("kind"),
    )
    rows = rows.withColumn("is_import", kind == "import")
    bare = F.col("is_import") & ~((lang == "zig") & (head != "test "))
    imports = F.when(php, F.col("php_imports")).when(F.col("is_import"), _imports())
    primary = F.when(
        name.isNotNull() & kind.isNotNull(),
        F.struct(
            name.alias("name"), kind.alias("kind"),
            F.when(~bare & (kind != "test_decl") | (lang == "rust") & ~bare, s).alias("detail"),
            F.coalesce(imports, F.expr(_NO_IMPORTS)).alias("imports"),
        ).cast(_ENTRY),
    )
    # TypeScript imports are found anywhere on a line, in addition to a declaration.
    quoted = string_literal(s)
    secondary = F.when(
        lang.isin("typescript", "javascript") & contains_any(s, ["import ", "require("]),
        F.struct(
            s.alias("name"), F.lit("import").alias("kind"), F.lit(None).cast("string").alias("detail"),
            F.coalesce(F.when(quoted.isNotNull(), F.array(quoted)), F.expr(_NO_IMPORTS)).alias("imports"),
        ).cast(_ENTRY),
    )
    return rows.withColumn("entries", F.array_compact(F.array(primary, secondary)))


def _zig_const_kind(s: Column) -> Column:
    return (
        F.when(F.contains(s, F.lit("struct {")), "struct_def")
        .when(F.contains(s, F.lit("enum {")), "enum_def")
        .when(contains_any(s, ["union {", "union(enum) {"]), "union_def")
        .when(F.contains(s, F.lit("@import")), "import")
        .otherwise("constant")
    )


def declarations(files: DataFrame) -> DataFrame:
    """One row per symbol with its raw imports; ``ord`` is the order within its line."""
    return exploded(annotate(files))


def exploded(annotated: DataFrame) -> DataFrame:
    return (
        annotated
        # The outer form keeps Catalyst from repeating the parse in an inferred filter.
        .select("path", "line_num", F.posexplode_outer("entries").alias("ord", "e"))
        .filter("ord IS NOT NULL")
        .select("path", "line_num", "ord", "e.name", "e.kind", "e.detail", "e.imports")
    )


def symbols(decls: DataFrame) -> DataFrame:
    return decls.select(
        "path", "name", "kind", F.col("line_num").alias("line_start"), F.col("line_num").alias("line_end"), "detail"
    )


def find_symbol(syms: DataFrame, name: str) -> DataFrame:
    """First declaration of a name in (path, line) order."""
    return find_all_symbols(syms, name).orderBy("path", "line_start").limit(1)


def find_all_symbols(syms: DataFrame, name: str) -> DataFrame:
    return syms.filter(F.col("name") == name)


def symbol_counts(files: DataFrame, decls: DataFrame) -> DataFrame:
    """path, language, line_count, byte_size, symbol_count of every file.

    File rows and symbol rows meet in one aggregation (combined map-side) rather than
    in an aggregation followed by a join.
    """
    sizes = file_stats(files).withColumn("n", F.lit(0).cast("bigint"))
    counts = decls.select(
        "path",
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("int").alias("line_count"),
        F.lit(None).cast("bigint").alias("byte_size"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return (
        sizes.unionByName(counts)
        .groupBy("path")
        .agg(
            F.max("line_count").alias("line_count"),
            F.max("byte_size").alias("byte_size"),
            F.sum("n").alias("symbol_count"),
        )
        .select("path", paths.language(F.col("path")).alias("language"), "line_count", "byte_size", "symbol_count")
    )


def summary(files: DataFrame) -> DataFrame:
    """``symbol_counts`` straight from texts: sizes and symbols out of one scan, folded per
    file before anything is shuffled."""
    sized = files.withColumn("line_count", line_count(F.col("text"))).withColumn(
        "byte_size", F.octet_length("text").cast("bigint")
    )
    rows = annotate(sized, also_keep=F.col("line_num") == 1, keep=("line_count", "byte_size"))
    return (
        rows.groupBy("path")
        .agg(
            F.max("line_count").alias("line_count"), F.max("byte_size").alias("byte_size"),
            F.sum(F.size("entries")).alias("symbol_count"),
        )
        .select("path", paths.language(F.col("path")).alias("language"), "line_count", "byte_size", "symbol_count")
    )


def outlines(files: DataFrame, decls: DataFrame) -> DataFrame:
    """Whole outline of each file as one row (a file's symbols are bounded by its size)."""
    packed = decls.groupBy("path").agg(
        F.array_sort(
            F.collect_list(F.struct("line_num", "ord", "name", "kind", "detail", "imports"))
        ).alias("rows")
    )
    syms = F.transform(
        "rows",
        lambda r: F.struct(
            r["name"].alias("name"), r["kind"].alias("kind"), r["line_num"].alias("line_start"),
            r["line_num"].alias("line_end"), r["detail"].alias("detail"),
        ),
    )
    return (
        file_stats(files)
        # One row per file on either side: nothing for the driver, whatever size Spark expects.
        .join(packed.hint("merge"), "path", "left")
        .select(
            "path", "language", "line_count", "byte_size",
            F.coalesce(syms, F.array()).alias("symbols"),
            F.coalesce(F.flatten(F.transform("rows", lambda r: r["imports"])), F.array()).alias("imports"),
        )
    )


def _carry_scope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted lines with the last declaration at or above them in their file."""
    file_no = None
    for batch in batches:
        hits, names, kinds, starts = [], [], [], []
        declared = (batch.column(c).to_pylist() for c in ("file_no", "line_num", "wanted", "name", "kind"))
        for row, (no, num, wanted, name, kind) in enumerate(zip(*declared, strict=True)):
            if no != file_no:
                file_no, scope = no, (None, None, 0)
            if kind is not None:
                scope = (name, kind, num)
            if wanted:
                hits.append(row)
                for values, value in zip((names, kinds, starts), scope, strict=True):
                    values.append(value)
        at = pa.array(hits, pa.int64())
        start = pa.array(starts, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(at) for c in ("path", "line_num", "line")),
             pa.array(names, pa.string()), pa.array(kinds, pa.string()), start, start],
            names=["path", "line_num", "line_text", "scope_name", "scope_kind", "scope_start", "scope_end"],
        )


def scoped_search(files: DataFrame, query: str) -> DataFrame:
    """Substring hits with the symbol declared nearest above them (or on their line).

    A symbol spans its declaration line only, so the enclosing symbol is a backward
    as-of match; on a line with two symbols the first one counts.  Hits and symbols
    come out of the same scan, in order, and nothing is shuffled.
    """
    hit = F.lit(False) if "\n" in query else contains_fold(F.col("line"), query)
    first = F.get("entries", F.lit(0))
    rows = (
        annotate(files.filter(contains_fold(F.col("text"), query)), also_keep=hit)
        .select("file_no", "path", "line_num", "line", "wanted", first.alias("e"))
        .select("file_no", "path", "line_num", "line", "wanted", "e.name", "e.kind")
    )
    return rows.mapInArrow(
        _carry_scope,
        "path string, line_num int, line_text string, scope_name string, scope_kind string, scope_start int, scope_end int",
    )


def enclosing(points: DataFrame, decls: DataFrame) -> DataFrame:
    """Scope of arbitrary ``points(path, line_num)`` against stored declarations.

    Both sides are laid out in one sort per file and each point takes the last
    declaration at or above it, so no point is ever paired with every symbol.
    """
    none = F.lit(None).cast("struct<name: string, kind: string, line: int>")
    scope = F.struct("name", "kind", F.col("line_num").alias("line"))
    declared = decls.filter(F.col("ord") == 0).select(
        "path", "line_num", F.lit(0).alias("is_point"), scope.cast("struct<name: string, kind: string, line: int>").alias("sym")
    )
    asked = points.select("path", "line_num", F.lit(1).alias("is_point"), none.alias("sym"))
    upto = (
        Window.partitionBy("path").orderBy("line_num", "is_point")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        declared.unionByName(asked)
        .withColumn("scope", F.last("sym", ignorenulls=True).over(upto))
        .filter("is_point = 1")
        .select(
            "path", "line_num", F.col("scope.name").alias("scope_name"), F.col("scope.kind").alias("scope_kind"),
            F.coalesce("scope.line", F.lit(0)).alias("scope_start"),
            F.coalesce("scope.line", F.lit(0)).alias("scope_end"),
        )
    )
