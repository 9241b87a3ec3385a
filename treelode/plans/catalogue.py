"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.functions import paths, regex
from treelode.functions.text import line_count
from treelode.operators import agents, blocks, deps, diff, lines, ngrams, pairs, search, symbols, tree, trigrams, versions, words
from treelode.plans import adapters
from treelode.sources import corpus, ignore

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries (shared with the SQL that checks them).
SUBSTRING = "OnEn"
REGEX = "^[A-Z][a-z]+ (of|the|to)+ [a-z]{2,5}"
REGEX_ALT = "(er|on)+ th|\\d{3}[.,]|^$"
WORD = "the"
TRIGRAM_QUERY = "ation the"
REGEX_INDEXED = "the (on|er)es|tionre.*ment"
FUZZY = "src1 en *.md"
IGNORE = "*1.md\n/src3/\nfr/\n!src2/fr/\n/src5/d*/*7.md\n!*11.md\nsrc6/en\n"
CURSOR_FRACTION = 2
LINE_RANGE = (2, 4)
LARGE_RANGE = (1_000, 2_500)
REAP_TIMEOUT_MS = 3_600_000
LEASE_TTL_MS = 60_000
SCOPE_QUERY = "RUN"
KEEP_VERSIONS = 50


def _docs(spark, sf):
    return adapters.documents(spark, sf)


def _code(spark, sf, langs=tuple(adapters.TEMPLATES)):
    return adapters.code_files(spark, sf, "customer", langs)


def _decls(spark, sf):
    return symbols.declarations(_code(spark, sf))


def line_stats(spark, sf):
    return lines.file_stats(_docs(spark, sf))


def corpus_filter(spark, sf):
    """Indexable pages: known language, not skip-listed, within size, no NUL up front."""
    pages = adapters.table(spark, sf, "pages").select(
        F.concat(F.lit("site/"), F.regexp_extract("url", "://([^?#]*)", 1), F.lit(".json")).alias("path"),
        F.col("html").cast("binary").alias("content"),
    )
    return corpus.indexable(pages).select("path", F.octet_length("content").cast("bigint").alias("byte_size"))


def search_substring(spark, sf):
    return search.search_substring(_docs(spark, sf), SUBSTRING)


def search_top50(spark, sf):
    return search.top_results(search_substring(spark, sf))


def search_path_filter(spark, sf):
    return search.search_substring(_docs(spark, sf), SUBSTRING, path="src1/en")


def search_regex(spark, sf):
    return search.search_regex(_docs(spark, sf), REGEX)


def search_regex_alternatives(spark, sf):
    return search.search_regex(_docs(spark, sf), REGEX_ALT)


def search_scoped(spark, sf):
    return symbols.scoped_search(_code(spark, sf), SCOPE_QUERY)


def enclosing_scope(spark, sf):
    """Scope of every blank-free line of the corpus, from the declarations alone."""
    code = _code(spark, sf)
    points = lines.lines(code).filter("line != ''").select("path", "line_num")
    return symbols.enclosing(points, symbols.declarations(code))


def word_index(spark, sf):
    return words.word_postings(_docs(spark, sf))


def word_lookup(spark, sf):
    return words.search_word(_docs(spark, sf), WORD)


def word_df(spark, sf):
    return words.document_frequency(_docs(spark, sf))


def trigram_postings(spark, sf):
    return trigrams.postings(_docs(spark, sf))


def trigram_candidates(spark, sf):
    wanted = regex.literal_trigrams(TRIGRAM_QUERY)
    return trigrams.candidates(trigrams.postings(_docs(spark, sf), wanted), TRIGRAM_QUERY)


def regex_candidates(spark, sf):
    query = regex.decompose(REGEX_INDEXED)
    return trigrams.candidates_query(trigrams.postings(_docs(spark, sf), query.trigrams()), query)


def search_indexed(spark, sf):
    docs = _docs(spark, sf)
    wanted = regex.literal_trigrams(TRIGRAM_QUERY)
    return search.search_indexed(docs, trigrams.postings(docs, wanted), TRIGRAM_QUERY)


def search_indexed_regex(spark, sf):
    docs = _docs(spark, sf)
    query = regex.decompose(REGEX_INDEXED)
    return search.search_indexed(docs, trigrams.postings(docs, query.trigrams()), REGEX_INDEXED, is_regex=True)


def index_base_overlay(spark, sf):
    """Base index of all documents; labelled ones are re-indexed from upper-cased text."""
    docs = _docs(spark, sf)
    labelled = adapters.table(spark, sf, "labels").select("doc_id").distinct()
    fresh = docs.join(labelled, "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" Overlaid")))
    base, overlay = trigrams.postings(docs), trigrams.postings(fresh)
    return trigrams.merged(base, overlay, labelled).groupBy("doc_id").agg(F.count(F.lit(1)).alias("trigrams"))


def index_file_count(spark, sf):
    return trigrams.file_count(trigrams.postings(_docs(spark, sf)))


def trigram_lookup(spark, sf):
    wanted = int.from_bytes(b"the", "big")
    return trigrams.lookup(trigrams.postings(_docs(spark, sf), [wanted]), wanted)


def pair_counts(spark, sf):
    return pairs.pair_counts(_docs(spark, sf))


def pair_weights(spark, sf):
    return pairs.pair_weights(pairs.pair_counts(_docs(spark, sf)))


def ngram_postings(spark, sf):
    return ngrams.postings(_docs(spark, sf))


def ngram_candidates(spark, sf):
    return ngrams.candidates(ngrams.postings(_docs(spark, sf)), TRIGRAM_QUERY)


def extract_lines(spark, sf):
    return lines.extract_lines(_docs(spark, sf), *LINE_RANGE)


def compact_lines(spark, sf):
    return lines.extract_lines(_code(spark, sf), 1, 1 << 30, line_numbers=False, compact=True)


def symbol_bodies(spark, sf):
    code = _code(spark, sf)
    ranges = symbols.symbols(symbols.declarations(code)).filter("kind = 'function'")
    return lines.symbol_bodies(code, ranges)


def glob_include(spark, sf):
    docs = _docs(spark, sf).select("path")
    return docs.filter(paths.matches_any_include(F.col("path"), F.col("path"), ["*9.md", "src1*/*/*0.md", ""]))


def base_path(spark, sf):
    return _docs(spark, sf).select("path").filter(paths.matches_base(F.col("path"), "src1"))


def _tree_stats(spark, sf):
    return symbols.summary(_code(spark, sf))


TREE_COLUMNS = ("full_path", "depth", "level", "is_dir", "line_count", "symbol_count", "byte_size")


def _tree(spark, sf, sort="name", **shown):
    """Nodes of the source files; only files that the tree shows are parsed, and those once."""
    code = tree.passing(_code(spark, sf), **shown)
    return tree.nodes(symbols.summary(code), sort=sort, listed=code.select("path"), **shown)


def tree_nodes(spark, sf):
    return _tree(spark, sf).select(*TREE_COLUMNS)


def tree_filtered(spark, sf):
    return _tree(spark, sf, base="src/rust", depth=1, include=["f*7.rs", "rust/g1*/*"]).select(*TREE_COLUMNS)


def tree_depth_zero(spark, sf):
    return _tree(spark, sf, base="src/php/g3", depth=0).select(*TREE_COLUMNS)


def tree_max_nodes(spark, sf):
    top = tree.ordered(_tree(spark, sf), max_nodes=200)
    return tree.labelled(top).select("full_path", "level", "text")


def tree_by_size(spark, sf):
    top = tree.ordered(_tree(spark, sf, sort="size"), max_nodes=200)
    return top.select("full_path", "byte_size")


def language_detect(spark, sf):
    return _code(spark, sf).select("path", paths.language(F.col("path")).alias("language"))


def _site_paths(spark, sf):
    """Path space with varied names: page URLs next to invented secret and build files."""
    url = F.regexp_extract("url", "://([^?#]*)", 1)
    names = [".env.local", "id_rsa", "key.pem", "app.min.js", "node_modules/x.js", "main.py", ".aws/cfg.yaml", "a.lock"]
    made = F.array(url, *[F.concat(url, F.lit("/"), F.lit(n)) for n in names])
    return adapters.table(spark, sf, "pages").select(F.explode(made).alias("path"))


def sensitive_filter(spark, sf):
    return _site_paths(spark, sf).select("path", paths.is_sensitive(F.col("path")).alias("sensitive"))


def skip_dir_filter(spark, sf):
    return _site_paths(spark, sf).select("path", paths.has_skip_dir(F.col("path")).alias("skipped"))


def skip_file_filter(spark, sf):
    return _site_paths(spark, sf).select("path", paths.is_skipped_file(F.col("path")).alias("skipped"))


def ignore_rules(spark, sf):
    rules = ignore.parse_rules(IGNORE)
    return _docs(spark, sf).select("path").filter(~ignore.is_excluded(F.col("path"), rules))


def nested_ignore_rules(spark, sf):
    rules = ignore.parse_rules("*.rs\n") + ignore.parse_rules("f1*\n!f1*.py\n/g2/\n", "src/python")
    return _code(spark, sf).select("path").filter(~ignore.is_excluded(F.col("path"), rules))


def _symbols_of(lang: str) -> Query:
    def query(spark, sf):
        return symbols.symbols(symbols.declarations(adapters.code_files(spark, sf, "orders", (lang,))))

    return query


def symbols_of_large_files(spark, sf):
    """Files that are as many rows as a table: the state of each block comes from those before it."""
    return symbols.symbols(blocks.declarations(adapters.large_files(spark, sf)))


def lines_of_large_files(spark, sf):
    """A range in the middle of every such file."""
    return blocks.extract_lines(adapters.large_files(spark, sf), *LARGE_RANGE)


def outline_summary(spark, sf):
    return _tree_stats(spark, sf)


def outlines(spark, sf):
    code = _code(spark, sf)
    packed = symbols.outlines(code, symbols.declarations(code))
    names = F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit("@"), s["line_start"])), "|")
    return packed.select("path", "language", "line_count", "byte_size", names.alias("symbols"), F.array_join("imports", "|").alias("imports"))


def find_symbol(spark, sf):
    return symbols.find_symbol(symbols.symbols(_decls(spark, sf)), "Show")


def find_all_symbols(spark, sf):
    return symbols.find_all_symbols(symbols.symbols(_decls(spark, sf)), "LIMIT")


def deps_edges(spark, sf):
    return deps.edges(_decls(spark, sf))


def deps_forward(spark, sf):
    """Imports of the Go file of the first customer."""
    first = adapters.table(spark, sf, "customer").agg(F.min("c_custkey").alias("k"), F.min_by("c_nationkey", "c_custkey").alias("c"))
    key = first.first()
    path = f"src/go_lang/g{key['c']}/f{key['k']}.go"
    return deps.imports_of(deps.edges(_decls(spark, sf)), path).withColumn("path", F.lit(path))


def deps_reverse(spark, sf):
    return deps.imported_by(deps.edges(_decls(spark, sf)), "vendor/lib3.zig")


def _modules(spark, sf):
    """Importable paths: one library file per customer nation, plus a full-path import."""
    nations = adapters.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n"))
    made = F.array(F.concat(F.lit("lib/lib"), "n", F.lit(".zig")), F.concat(F.lit("lib/Util"), "n", F.lit(".php")))
    return nations.select(F.explode(made).alias("path"))


def deps_reverse_all(spark, sf):
    return deps.imported_by_all(deps.edges(_decls(spark, sf)), _modules(spark, sf))


def importer_counts(spark, sf):
    return deps.importer_counts(deps.edges(_decls(spark, sf)))


def changes_since(spark, sf):
    return versions.changes_since(adapters.event_versions(spark, sf), 500)


def changes_count(spark, sf):
    return versions.changes_count(adapters.event_versions(spark, sf), 500)


def latest_version(spark, sf):
    return versions.latest(adapters.event_versions(spark, sf))


def version_at_cursor(spark, sf):
    return versions.at_cursor(adapters.event_versions(spark, sf), 700)


def version_cap(spark, sf):
    return versions.retained(adapters.event_versions(spark, sf), KEEP_VERSIONS)


def hot_files(spark, sf):
    tracked = adapters.table(spark, sf, "customer").select(
        F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("path")
    )
    return versions.hot_files(tracked, adapters.event_versions(spark, sf), 100)


def current_seq(spark, sf):
    return versions.current_seq(adapters.event_versions(spark, sf))


def list_files(spark, sf):
    return versions.list_files(adapters.event_versions(spark, sf))


def sequence_assignment(spark, sf):
    """Versions for every document in path order, numbered after the existing log."""
    entries = _docs(spark, sf).select("path", F.octet_length("text").cast("bigint").alias("size"))
    return versions.number_rows(entries, ["path"], start=1000)


def change_diff(spark, sf):
    """Known state: each user's first half of events; current: the whole log."""
    log = adapters.event_versions(spark, sf)

    def state(v):
        size, mtime = F.count(F.lit(1)), F.max("seq")
        return v.groupBy("path").agg(mtime.alias("mtime_ms"), F.pmod(size, F.lit(7)).alias("size"), F.pmod(size, F.lit(3)).alias("hash"))

    known = state(log.filter("op IN ('click', 'view')"))
    listing = state(log.filter("op IN ('click', 'view', 'error') AND path != 'user/5'"))
    return diff.diff(known, listing).select("path", "change", "mtime_ms", "size", "hash")


def agent_leases(spark, sf):
    """Event users are agents asking for the event type's path; the first one holds it."""
    requests = adapters.table(spark, sf, "events").select(
        F.col("event_id").alias("req"), F.col("user_id").alias("agent_id"),
        F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("path"),
        F.lit(LEASE_TTL_MS).cast("bigint").alias("ttl_ms"),
    )
    held = adapters.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("agent_id"),
        F.concat(F.lit("click/"), F.col("s_suppkey").cast("string")).alias("path"),
        F.when(F.col("s_acctbal") > 0, 2_000).otherwise(500).cast("bigint").alias("expiry"),
    )
    decided = agents.grant(held, requests, now_ms=1_000)
    return agents.apply_grants(held, decided, now_ms=1_000)


def agent_grants(spark, sf):
    requests = adapters.table(spark, sf, "events").select(
        F.col("event_id").alias("req"), F.col("user_id").alias("agent_id"),
        F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("path"),
        F.lit(LEASE_TTL_MS).cast("bigint").alias("ttl_ms"),
    )
    none = requests.select("agent_id", "path", F.lit(0).cast("bigint").alias("expiry")).filter("expiry > 0")
    return agents.grant(none, requests, now_ms=1_000).select("req", "agent_id", "path", "granted")


def agent_liveness(spark, sf):
    """Customers are agents; their events are heartbeats; the silent ones crash."""
    registered = adapters.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("active").alias("state"),
        F.lit(0).cast("bigint").alias("cursor"), F.lit(1704067200000).cast("bigint").alias("last_seen"),
        F.lit(0).cast("bigint").alias("edit_count"),
    )
    beats = adapters.table(spark, sf, "events").select(
        F.col("user_id").alias("id"), adapters.epoch_ms(F.col("ts")).alias("at_ms")
    )
    alive = agents.heartbeat(registered, beats)
    leases = registered.select(F.col("id").alias("agent_id"), F.col("name").alias("path"), F.lit(0).cast("bigint").alias("expiry"))
    reaped, _ = agents.reap_stale(alive, leases, REAP_TIMEOUT_MS, now_ms=1704153600000)
    return reaped.select("id", "name", "state", "last_seen")


def fuzzy_paths(spark, sf):
    hits = search.fuzzy_paths(_docs(spark, sf), FUZZY)
    return hits.select("path", F.round(F.col("score").cast("double"), 4).alias("score"))


def fuzzy_top(spark, sf):
    return search.fuzzy_top(_docs(spark, sf), FUZZY, 50).select("path", F.round(F.col("score").cast("double"), 4).alias("score"))


def agent_grants_registered(spark, sf):
    """The same requests, when only some agents are registered; the others get nothing."""
    requests = adapters.table(spark, sf, "events").select(
        F.col("event_id").alias("req"), F.col("user_id").alias("agent_id"),
        F.concat_ws("/", "event_type", F.floor("value").cast("string")).alias("path"),
        F.lit(LEASE_TTL_MS).cast("bigint").alias("ttl_ms"),
    )
    none = requests.select("agent_id", "path", F.lit(0).cast("bigint").alias("expiry")).filter("expiry > 0")
    registered = adapters.table(spark, sf, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("id"))
    return agents.grant(none, requests, 1_000, registered).select("req", "agent_id", "path", "granted")


def content_hash(spark, sf):
    """Content identity used by the change cascade; empty texts still hash."""
    return _docs(spark, sf).select("path", corpus.content_hash(F.col("text")).alias("hash"))


def snapshot_meta(spark, sf):
    files = _code(spark, sf)
    kept = files.filter(~paths.is_sensitive(F.col("path")))
    return kept.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(F.octet_length("text")).cast("bigint").alias("total_bytes"),
        F.sum(line_count(F.col("text"))).cast("bigint").alias("total_lines"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        line_stats, corpus_filter, search_substring, search_top50, search_path_filter, search_regex,
        search_regex_alternatives, search_scoped, enclosing_scope, word_index, word_lookup, word_df,
        trigram_postings, trigram_candidates, regex_candidates, search_indexed, search_indexed_regex,
        index_base_overlay, index_file_count, trigram_lookup, pair_counts, pair_weights, ngram_postings, ngram_candidates, extract_lines,
        compact_lines, symbol_bodies, glob_include, base_path, tree_nodes, tree_filtered, tree_depth_zero,
        tree_max_nodes, tree_by_size, language_detect, sensitive_filter, skip_dir_filter, skip_file_filter,
        ignore_rules, nested_ignore_rules, symbols_of_large_files, lines_of_large_files, outline_summary, outlines, find_symbol, find_all_symbols, deps_edges,
        deps_forward, deps_reverse, deps_reverse_all, importer_counts, changes_since, changes_count,
        latest_version, version_at_cursor, version_cap, hot_files, current_seq, list_files,
        sequence_assignment, change_diff, agent_leases, agent_grants, agent_grants_registered, agent_liveness, fuzzy_paths, fuzzy_top,
        content_hash, snapshot_meta,
    )
}
QUERIES.update({f"symbols_{lang}": _symbols_of(lang) for lang in adapters.TEMPLATES})
