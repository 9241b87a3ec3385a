"""Schemas of the tables the engine reads and writes."""

FILES = "path STRING, content BINARY, length BIGINT, mtime_ns BIGINT"
LISTING = "path STRING, is_dir BOOLEAN, length BIGINT, mtime_ns BIGINT, dir_mtimes ARRAY<BIGINT>"
SYMBOL = "name STRING, kind STRING, line_start INT, line_end INT, detail STRING"
DEPS = "path STRING, dep STRING, pos INT"
WORD_POSTINGS = "word STRING, path STRING, line_num INT"
TRIGRAM_POSTINGS = "doc_id BIGINT, tri INT, next_mask INT, loc_mask INT"
NGRAM_POSTINGS = "path STRING, hash BIGINT"
PAIR_WEIGHTS = "a INT, b INT, w INT"
VERSIONS = (
    "path STRING, seq BIGINT, agent BIGINT, timestamp_ms BIGINT, op STRING, "
    "hash BIGINT, size BIGINT, place BIGINT"
)
KNOWN = "path STRING, mtime_ms BIGINT, size BIGINT, hash BIGINT"
AGENTS = "id BIGINT, name STRING, state STRING, cursor BIGINT, last_seen BIGINT, edit_count BIGINT"
LEASES = "agent_id BIGINT, path STRING, expiry BIGINT"

# Domains of the enumerated columns.
LANGUAGES = (
    "zig", "c", "cpp", "python", "javascript", "typescript", "rust", "go_lang",
    "php", "ruby", "markdown", "json", "yaml", "unknown",
)
SYMBOL_KINDS = (
    "function", "struct_def", "enum_def", "union_def", "constant", "variable", "import",
    "test_decl", "comment_block", "trait_def", "impl_block", "type_alias", "macro_def",
    "method", "class_def", "interface_def",
)
OPS = ("snapshot", "replace", "insert", "delete", "tombstone")
TREE_SORTS = ("name", "modified", "size")
