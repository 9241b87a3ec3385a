"""Corpora and logs derived from the test tables.

``documents`` is the text corpus; ``events`` is the change log; every ``orders`` or
``customer`` row becomes one source file per language, written by a fixed template, so
the outline and import operators run over data that grows with the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(doc_id, path, text)."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp, whatever the session time zone is."""
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    whole = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return whole * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """versions(path, seq, op, timestamp_ms): users are paths, event types operations."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"),
        (F.col("event_id") + 1).alias("seq"),
        F.col("event_type").alias("op"),
        epoch_ms(F.col("ts")).alias("timestamp_ms"),
    )


@dataclass(frozen=True)
class Template:
    """Source text of one language; ``{k}`` and ``{c}`` are row keys.

    A line given as a pair is (text when the row's flag is set, text otherwise).
    """

    ext: str
    lines: tuple


# File templates.
TEMPLATES = {
    "python": Template(".py", (
        "import os.path",
        "from pkg{c}.mod{k} import thing as t",
        "from . import sibling",
        ('"""Order {k}"""', '"""Order {k}'),
        "def in_doc_{k}():",
        '"""',
        "class Order{k}(Base):",
        "    def total_{k}(self, x):",
        "'''",
        "async def skipped_{k}(): pass",
        "def tail_{k}(): return 1",
    )),
    "typescript": Template(".ts", (
        'import { Item{k} } from "./items/{c}";',
        "export async function load{k}(id: number) {",
        "  const local{k} = 1;",
        ("/* legacy", "/* legacy */ export let state{k} = 0;"),
        "export const table{k} = require('./t{c}');",
        "*/ function after{k}() {",
        "class Widget{k} {}",
        "\tfunction plain{k}() {",
    )),
    "rust": Template(".rs", (
        "use crate::m{c}::Thing;",
        "pub mod part{k};",
        "#[test]",
        ("/* note */", "// note"),
        "fn check_{k}() {}",
        "pub(crate) struct S{k} {",
        "impl<T> Show for S{k} {",
        "const LIMIT_{k}: &'static str = \"x\";",
        "macro_rules! m{k} {",
        "pub type Alias{k} = u8;",
        "pub unsafe trait T{k} {",
        "enum E{k} { A }",
    )),
    "go_lang": Template(".go", (
        "package p{c}",
        "import (",
        '\t"fmt"',
        '\talias "lib/{c}/v{k}"',
        (")", ") // end"),
        "type T{k} struct{}",
        "func (t *T{k}) Run{k}(a int) error {",
        ("/*", "// x"),
        "const C{k} = 1",
        "var V{k} = 2 */",
        "func New{k}() {}",
    )),
    "php": Template(".php", (
        "<?php",
        "use App\\Models\\{User{k}, Post as P{c}};",
        "use Lib\\Util{c} as U;",
        "abstract class A{k} {",
        '  const LIMIT = "}{c}";',
        "  public function run{k}() { return '}'; }",
        ("}", "  // }"),
        "function after{k}() {",
        "}",
        "trait T{k} {",
        "}",
        "function free{k}() {}",
    )),
    "ruby": Template(".rb", (
        "require 'json/{c}'",
        "class Order{k} < Base",
        "  def self.find{k}?(id)",
        ("=begin", "# begin"),
        "  def hidden{k}!",
        "=end",
        "module M{k}",
        "  attr = 1",
    )),
    "zig": Template(".zig", (
        'const std{k} = @import("lib{c}.zig");',
        "pub const P{k} = struct {",
        "pub fn run{k}() void {",
        ("/* gone", "/* gone */ const K{k} = union(enum) {"),
        'test "order {k}" {',
        "*/ fn late{k}() void {",
        "const N{k}: u8 = 1;",
    )),
}

# Key, group and flag columns of the tables that files are derived from.
SOURCES = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus = 'F'"),
    "customer": ("c_custkey", "c_nationkey", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
}


def template_text(lang: str, flag: bool) -> str:
    """Template with both placeholders still in it."""
    pick = [line if isinstance(line, str) else line[0 if flag else 1] for line in TEMPLATES[lang].lines]
    return "\n".join(pick) + "\n"


#: Files (or blocks) that one task makes of a table's rows.
FILES_PER_TASK = 25_000


def code_files(spark: SparkSession, sf_dir: str, source: str, langs=tuple(TEMPLATES)) -> DataFrame:
    """files(path, text): one file per row of ``source`` and language; only keys are dealt out, no text."""
    key, group, flag = SOURCES[source]
    k, c = F.col(key).cast("string"), F.col(group).cast("string")

    def fill(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{k}"), k), F.lit("{c}"), c)

    made = [
        F.struct(
            fill(f"src/{lang}/g{{c}}/f{{k}}{TEMPLATES[lang].ext}").alias("path"),
            F.when(F.expr(flag), fill(template_text(lang, True))).otherwise(fill(template_text(lang, False))).alias("text"),
        )
        for lang in langs
    ]
    rows = spread(table(spark, sf_dir, source).select(key, group, *_flag_columns(flag)), FILES_PER_TASK // len(langs))
    return rows.select(F.explode(F.array(*made)).alias("f")).select("f.path", "f.text")


def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of ``operators.blocks``: one file per order priority and language, which holds the texts
    of its orders by key, each cut in two, so that every state crosses blocks.  No text is shuffled."""
    parts = []
    for lang, template in TEMPLATES.items():
        whole = {held: template_text(lang, held)[:-1].split("\n") for held in (True, False)}
        middle = len(template.lines) // 2
        for half, part in enumerate((slice(0, middle), slice(middle, None))):
            parts.append((lang, template.ext, half, len(whole[True][part]), *("\n".join(whole[held][part]) for held in (False, True))))

    def of_part(column: int) -> Column:
        return F.get(F.array(*(F.lit(part[column]) for part in parts)), F.col("part"))

    narrow = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", *_flag_columns(SOURCES["orders"][2]))
    rows = spread(narrow, FILES_PER_TASK // len(parts), "o_orderkey")
    # A text is made behind the explode, so that none is where only places are asked for.
    rows = rows.select("*", F.explode(F.array(*(F.lit(i) for i in range(len(parts))))).alias("part"))
    text = F.when(F.expr(SOURCES["orders"][2]), of_part(5)).otherwise(of_part(4))
    for mark, key in (("{k}", "o_orderkey"), ("{c}", "o_custkey")):
        text = F.replace(text, F.lit(mark), F.col(key).cast("string"))
    return rows.select(
        F.concat(F.lit("large/"), of_part(0), F.lit("/"), "o_orderpriority", of_part(1)).alias("path"),
        (F.col("o_orderkey").cast("bigint") * 2 + of_part(2)).alias("block"),
        of_part(3).cast("bigint").alias("n_lines"), F.lit(False).alias("alone"), text.alias("text"),
    )


def _flag_columns(flag: str) -> list[str]:
    return [flag.split(" ")[0]]
