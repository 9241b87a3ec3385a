import pytest
from pyspark.sql import functions as F

from treelode.operators import deps, lines, symbols

FIXTURES = {
    "main.go": (
        'package main\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\ntype Config struct{}\nfunc main() {}\n'
        "func (r *T) Name() {}\nfunc (broken\nvar x = 1\nimport \"os\"\n/* const H = 1\n*/ const C = 2\nimport (\r\n"
    ),
    "a.py": (
        'import os.path, sys\nfrom a.b import c\nfrom . import d\n"""\ndef hidden():\n"""\ndef shown(x):\nclass K:\n'
        'x = """one"""\n    def again(): pass\nasync def no(): pass\n\'\'\' open\nclass Gone:\nx = """ y """\ndef back():\n'
    ),
    "m.rs": (
        "#[test]\n/* c */\nfn t() {}\n#[test]\n\nfn nt() {}\nconst X: &'static str = \"\";\nimpl<T> Foo for T {}\n"
        "impl Trait for T {}\npub mod zed;\nuse a::b;\n/* a\nfn hid() {}\n*/ fn vis() {}\nmacro_rules! m {\n"
        "#[tokio::test]\n/* x\n y */\nasync fn tk() {}\npub const fn odd() {}\npub unsafe extern \"C\" fn ext() {}\n"
        "unsafe impl Send for Q {}\npub(crate) static mut G: u8 = 0;\nunion U {}\n"
    ),
    "p.php": (
        "<?php\nuse App\\Models\\{User, Post as P};\nuse \\Foo\\Bar as Baz;\nclass A {\n"
        "  public function m() { return '}'; }\n  const X = 1;\n}\nfunction g() {}\n/* class B {\n*/ class C {\n"
        " function n() { echo \"\\\"}\"; }\n}\n function h() {\n# function no() {\nreadonly class R { function k() {} }\n"
        "public const class = 1; function after() {}\ninterface I {\nuse ;\\\n"
    ),
    "r.rb": (
        "require 'json'\nrequire_relative \"x/y\"\n=begin\ndef hid\n =end\n=end\nclass A\n def self.ok?\n module M\n"
        " def x=(v)\n =begin\n def still\n"
    ),
    "t.ts": (
        "export function run() {\n  const l = 1;\n}\nexport const k = require('./z');\n/*/ import 'no'\n"
        "*/ import { a } from \"./b\";\nclass W {}\nexport async function go() {}\nlet q = 1;\n/* a */ /* b import c\n"
    ),
    "z.zig": (
        'const std = @import("std");\npub fn main() void {}\nconst S = struct {\n/* x */ const U = union(enum) {\n'
        'test "abc" {\npub const E = enum {\nconst V = 3;\n\tfn inner() void {}\n'
    ),
    "notes.md": "def no(): pass\nclass No\n",
    "lib.c": "int main() {}\n",
}

EXPECTED = {
    "main.go": [
        (4, "import", '"fmt"'), (5, "import", 'x "net/http"'), (7, "struct_def", "Config"), (8, "function", "main"),
        (9, "function", "Name"), (11, "variable", "x"), (12, "import", 'import "os"'), (14, "constant", "C"),
        (15, "import", "import (\r"),
    ],
    "a.py": [
        (1, "import", "import os.path, sys"), (2, "import", "from a.b import c"), (3, "import", "from . import d"),
        (7, "function", "shown"), (8, "struct_def", "K"), (10, "function", "again"), (15, "function", "back"),
    ],
    "m.rs": [
        (3, "test_decl", "t"), (6, "function", "nt"), (7, "constant", "str"), (8, "impl_block", "Foo"),
        (9, "impl_block", "Trait"), (10, "import", "zed"), (11, "import", "use a::b;"), (14, "function", "vis"),
        (15, "macro_def", "m"), (19, "test_decl", "tk"), (20, "constant", "fn"), (21, "function", "ext"),
        (22, "impl_block", "Send"), (23, "constant", "mut"),
    ],
    "p.php": [
        (2, "import", "use App\\Models\\{User, Post as P}"), (3, "import", "use \\Foo\\Bar as Baz"),
        (4, "class_def", "A"), (5, "method", "m"), (6, "constant", "X"), (8, "function", "g"),
        (10, "class_def", "C"), (11, "method", "n"), (13, "function", "h"), (15, "class_def", "R"),
        (16, "function", "after"), (17, "interface_def", "I"),
    ],
    "r.rb": [
        (1, "import", "require 'json'"), (2, "import", 'require_relative "x/y"'), (7, "struct_def", "A"),
        (8, "function", "ok?"), (9, "struct_def", "M"), (10, "function", "x="), (12, "function", "still"),
    ],
    "t.ts": [
        (1, "function", "run"), (4, "constant", "k"), (4, "import", "export const k = require('./z');"),
        (6, "import", 'import { a } from "./b";'), (8, "function", "go"), (10, "import", "/* b import c"),
    ],
    "z.zig": [
        (1, "import", "std"), (2, "function", "main"), (3, "struct_def", "S"), (4, "union_def", "U"),
        (5, "test_decl", 'test "abc" {'), (6, "enum_def", "E"), (7, "constant", "V"), (8, "function", "inner"),
    ],
    "notes.md": [],
    "lib.c": [],
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FIXTURES.items()), "path STRING, text STRING")


@pytest.fixture(scope="module")
def decls(files):
    return symbols.declarations(files).cache()


@pytest.mark.parametrize("path", sorted(FIXTURES))
def test_golden(decls, path):
    rows = decls.filter(decls.path == path).orderBy("line_num", "ord").collect()
    assert [(r["line_num"], r["kind"], r["name"]) for r in rows] == EXPECTED[path]


def test_details(decls):
    rows = {(r["path"], r["name"]): r["detail"] for r in decls.collect()}
    assert rows["m.rs", "t"] == "fn t() {}" and rows["m.rs", "vis"] == "fn vis() {}"
    assert rows["m.rs", "zed"] is None and rows["m.rs", "use a::b;"] is None
    assert rows["z.zig", "std"] == 'const std = @import("std");' and rows["z.zig", 'test "abc" {'] is None
    assert rows["a.py", "again"] == "def again(): pass"


def test_edges(decls):
    got = {}
    for r in deps.edges(decls).orderBy("path", "pos").collect():
        got.setdefault(r["path"], []).append(r["dep"])
    assert got == {
        "main.go": ["fmt", "net/http", "os"],
        "a.py": ["os/path.py", "a/b.py"],
        "m.rs": ["zed", "use a::b;"],
        "p.php": ["app/Models/User.php", "app/Models/Post.php", "Foo/Bar.php"],
        "r.rb": ["json", "x/y"],
        "t.ts": ["./z", "./b"],
        "z.zig": ["std"],
    }


def test_parent_traversal_is_no_edge(spark):
    code = spark.createDataFrame([("a.ts", "import '../x';\nimport './y';\n")], "path STRING, text STRING")
    assert [(r["dep"], r["pos"]) for r in deps.edges(symbols.declarations(code)).collect()] == [("./y", 0)]


def test_reverse_by_path_or_basename(spark):
    rows = [("m.zig", "store.zig", 0), ("n.zig", "src/store.zig", 0), ("o.zig", "src/store.zig", 0), ("o.zig", "store.zig", 1), ("p.zig", "xstore.zig", 0)]
    edges = spark.createDataFrame(rows, "path STRING, dep STRING, pos INT")
    assert sorted(r["path"] for r in deps.imported_by(edges, "src/store.zig").collect()) == ["m.zig", "n.zig", "o.zig"]
    every = deps.imported_by_all(edges, spark.createDataFrame([("src/store.zig",), ("store.zig",)], "path STRING"))
    got = sorted((r["path"], r["importer"]) for r in every.collect())
    assert got == [("src/store.zig", p) for p in ("m.zig", "n.zig", "o.zig")] + [("store.zig", p) for p in ("m.zig", "o.zig")]


def test_scoped_search_and_enclosing_agree(files, decls):
    hits = symbols.scoped_search(files, "").collect()
    by_line = {(r["path"], r["line_num"]): (r["scope_name"], r["scope_kind"], r["scope_start"]) for r in hits}
    assert len(by_line) == sum(text.count("\n") + 1 for text in FIXTURES.values())
    assert by_line["a.py", 5] == ("from . import d", "import", 3)
    assert by_line["t.ts", 4] == ("k", "constant", 4)
    assert by_line["main.go", 1] == (None, None, 0)
    points = lines.lines(files).select("path", "line_num")
    other = symbols.enclosing(points, decls).collect()
    assert {(r["path"], r["line_num"]): (r["scope_name"], r["scope_kind"], r["scope_start"]) for r in other} == by_line


def test_scoped_search_keeps_states_with_extra_rows(spark):
    """Rows kept only because they match must not disturb the neighbouring-line logic."""
    text = "#[test]\n\nfn a() {}\n#[test]\n/* zz\nzz */\nfn b() {}\n"
    code = spark.createDataFrame([("x.rs", text)], "path STRING, text STRING")
    kinds = {r["scope_name"]: r["scope_kind"] for r in symbols.scoped_search(code, "").collect()}
    assert kinds["a"] == "function" and kinds["b"] == "test_decl"


def test_no_shuffle_for_all_states(files):
    for frame in (symbols.declarations(files.filter("path != 'other'")), symbols.scoped_search(files, "a")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_summary_equals_counts_of_declarations(files, decls):
    assert sorted(symbols.summary(files).collect()) == sorted(symbols.symbol_counts(files, decls).collect())


def test_outline_row(files, decls):
    row = symbols.outlines(files, decls).filter("path = 't.ts'").first()
    assert (row["language"], row["line_count"], row["byte_size"]) == ("typescript", 11, len(FIXTURES["t.ts"]))
    assert [s["name"] for s in row["symbols"]][:2] == ["run", "k"] and row["imports"] == ["./z", "./b"]
    empty = symbols.outlines(files, decls).filter("path = 'lib.c'").first()
    assert empty["symbols"] == [] and empty["imports"] == []


def test_symbol_bodies_and_ranges(files, spark):
    ranges = spark.createDataFrame([("a.py", 2, 3), ("a.py", 14, 99)], "path STRING, line_start INT, line_end INT")
    got = {r["line_start"]: r["body"] for r in lines.symbol_bodies(files, ranges).collect()}
    assert got[2] == "    2 | from a.b import c\n    3 | from . import d\n"
    assert got[14] == '   14 | x = """ y """\n   15 | def back():\n   16 | \n'


def test_joins_of_files_with_their_symbols_send_nothing_to_the_driver(spark, tmp_path):
    table = str(tmp_path / "files")
    text = F.concat(F.lit("def f"), F.col("id").cast("string"), F.lit("(): pass\n"))
    spark.range(50).select(F.concat(F.col("id").cast("string"), F.lit(".py")).alias("path"), text.alias("text")).write.parquet(table)
    files = spark.read.parquet(table)
    decls = symbols.declarations(files)
    made = lines.symbol_bodies(files, symbols.symbols(decls)), symbols.outlines(files, decls)
    for df in made:
        assert df.count() == 50
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_trees_and_factored_imports_parse_files_once(spark, tmp_path):
    from treelode.plans import catalogue, stored

    sf = "/root/testdata/sf0.001"
    for query in (catalogue.tree_nodes, catalogue.tree_by_size, catalogue.tree_filtered):
        assert query(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for query in (stored.deps_factored, stored.deps_expanded):
        assert "MapInArrow" not in query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
