import json
import os
import time

import pytest
from pyspark.sql import functions as F

from treelode.operators import trigrams
from treelode.plans import tools
from treelode.plans.workspace import Workspace
from treelode.sources import listing, snapshot

FILES = {
    "src/main.zig": "pub fn main() void {}\n",
    "src/a.ts": 'import { b } from "b.ts";\nexport const needle = 1;\n',
    "src/b.ts": "export function run() {\n  const local = 1;\n}\n",
    "src/__init__.py": "import os.path\ndef blazing():\n  pass\n",
    ".hidden/x.py": "class Hidden:\n",
    "style.css": "body {}\n",
    "page.html": "<p>needle</p>\n",
    ".env": "SECRET=1\n",
    "node_modules/dep/index.js": "function nope() {}\n",
    "bin.py": b"abc\x00def",
    "big.md": "x" * (600 * 1024),
}


@pytest.fixture
def ws(spark, tree_of, tmp_path):
    made = Workspace(spark, tree_of(FILES), str(tmp_path / "state"), max_bytes=512 * 1024)
    made.index()
    return made


def paths_of(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_walk_prunes_and_reads_hidden_names(spark, tree_of):
    root = tree_of(FILES)
    walked = paths_of(listing.walk(spark, root))
    assert "node_modules/dep/index.js" not in walked
    assert ".hidden/x.py" in walked and "src/__init__.py" in walked and "style.css" in walked
    everything = paths_of(listing.read_files(listing.walk(spark, root), root))
    assert everything == [".hidden/x.py", "big.md", "src/__init__.py", "src/a.ts", "src/b.ts", "src/main.zig"]
    read = paths_of(listing.read_files(listing.walk(spark, root), root, 512 * 1024))
    assert read == [".hidden/x.py", "src/__init__.py", "src/a.ts", "src/b.ts", "src/main.zig"]


def test_root_gitignore(spark, tree_of):
    root = tree_of({
        ".gitignore": "/public/upload*\n/public/js/\n*.log\n",
        "src/main.zig": "", "public/upload/a.zig": "", "public/upload-extra/b.zig": "", "public/js/app.zig": "",
        "app.log": "", "x/public/uploadx/keep.zig": "",
    })
    assert paths_of(listing.walk(spark, root)) == [".gitignore", "src/main.zig", "x/public/uploadx/keep.zig"]


def test_nested_gitignore(spark, tree_of):
    root = tree_of({"storage/logs/.gitignore": "*\n!.gitignore\n", "storage/logs/app.php": "", "src/main.zig": ""})
    assert paths_of(listing.walk(spark, root)) == ["src/main.zig", "storage/logs/.gitignore"]


def test_tool_ignore_comes_before_gitignore(spark, tree_of):
    root = tree_of({".treelodeignore": "*.md\n", ".gitignore": "!keep.md\n", "keep.md": "", "drop.md": ""})
    assert paths_of(listing.walk(spark, root)) == [".gitignore", ".treelodeignore", "keep.md"]


def test_symlinks_are_not_followed(spark, tree_of):
    root = tree_of({"a/x.py": ""})
    os.symlink(os.path.join(root, "a"), os.path.join(root, "link"))
    assert paths_of(listing.walk(spark, root)) == ["a/x.py"]


def test_status_index_and_sequence(ws):
    status = json.loads(tools.call_tool(ws, "status"))
    assert status["indexed_files"] == 5
    walked = ws.current_seq()
    assert status["current_seq"] == walked == 10
    again = json.loads(tools.call_tool(ws, "index"))
    assert again == {"started": True, "indexed_files": 5, "current_seq": 2 * walked}


def test_search_tool(ws):
    found = json.loads(tools.call_tool(ws, "search", {"query": "NEEDLE"}))
    assert found == {"matches": [{"path": "src/a.ts", "line": 2, "text": "export const needle = 1;"}]}
    assert json.loads(tools.call_tool(ws, "search", {"query": "NEEDLE", "regex": True})) == {"matches": []}
    every = json.loads(tools.call_tool(ws, "search", {"query": "", "max_results": 3}))
    assert len(every["matches"]) == 3
    scoped = json.loads(tools.call_tool(ws, "search", {"query": "", "path": "src/b.ts"}))
    assert {m["path"] for m in scoped["matches"]} == {"src/b.ts"}


def test_outline_tool(ws):
    out = json.loads(tools.call_tool(ws, "outline", {"path": "src/b.ts"}))
    assert out["language"] == "typescript" and out["line_count"] == 4
    assert out["symbols"] == [
        {"name": "run", "kind": "function", "line_start": 1, "line_end": 1, "detail": "export function run() {"}
    ]
    imports = json.loads(tools.call_tool(ws, "outline", {"path": "src/a.ts"}))["symbols"][0]
    assert imports["kind"] == "import" and "detail" not in imports


def test_outline_errors(ws):
    for args, code, message in (
        ({}, "INVALID_ARGUMENT", "missing path"),
        ({"path": "../secret.txt"}, "OUT_OF_SCOPE", "path traversal not allowed"),
        ({"path": ".env"}, "OUT_OF_SCOPE", "sensitive file access blocked"),
        ({"path": "nope.py"}, "OUT_OF_SCOPE", "path not indexed"),
    ):
        error = json.loads(tools.call_tool(ws, "outline", args))["error"]
        assert (error["code"], error["message"]) == (code, message)


def test_deps_tool(ws):
    assert json.loads(tools.call_tool(ws, "deps", {"path": "src/b.ts"})) == {
        "path": "src/b.ts", "imported_by": ["src/a.ts"], "imports": []
    }
    assert json.loads(tools.call_tool(ws, "deps", {"path": "src/__init__.py"}))["imports"] == ["os/path.py"]


def test_tree_tool(ws):
    whole = json.loads(tools.call_tool(ws, "tree"))["tree"]
    assert whole == [
        ".hidden/", ["x.py  2L  1 sym"],
        "src/", ["__init__.py  4L  2 sym", "a.ts  3L  2 sym", "b.ts  4L  1 sym", "main.zig  2L  1 sym"],
    ]
    picked = json.loads(tools.call_tool(ws, "tree", {"path": "src", "include": "*.ts", "sort": "size"}))["tree"]
    assert picked == ["src/", ["a.ts  3L  2 sym", "b.ts  4L  1 sym"]]
    assert json.loads(tools.call_tool(ws, "tree", {"max_nodes": 0}))["tree"] == []


def test_tree_errors(ws):
    for args, message in (
        ({"sort": "bogus"}, "sort must be one of: name, modified, size"),
        ({"depth": -1}, "depth must be >= 0"),
        ({"max_nodes": -1}, "max_nodes must be >= 0"),
        ({"include": 3}, "include must be a string or string array"),
        ({"include": ["a", 3]}, "include array must contain only strings"),
        ({"path": "a\\b"}, "path traversal not allowed"),
    ):
        assert json.loads(tools.call_tool(ws, "tree", args))["error"]["message"] == message


def test_tree_by_modification_time(spark, tree_of, tmp_path):
    root = tree_of({"old/a.py": "", "new/b.py": "", "c.py": "", "d.py": ""})
    for i, name in enumerate(["old/a.py", "old", "new/b.py", "new", "c.py", "d.py"]):
        os.utime(os.path.join(root, name), (1000 + i, 1000 + i))
    ws = Workspace(spark, root, str(tmp_path / "state"))
    ws.index()
    shown = json.loads(tools.call_tool(ws, "tree", {"sort": "modified"}))["tree"]
    assert shown == ["new/", ["b.py  1L  0 sym"], "old/", ["a.py  1L  0 sym"], "d.py  1L  0 sym", "c.py  1L  0 sym"]


def test_changes_and_refresh(ws):
    base = ws.current_seq()
    root = ws.root
    assert ws.refresh() == 0
    time.sleep(0.02)
    with open(f"{root}/src/main.zig", "a") as handle:
        handle.write("pub fn extra() void {}\n")
    with open(f"{root}/src/new.go", "w") as handle:
        handle.write("func Fresh() {}\n")
    os.remove(f"{root}/src/b.ts")
    os.utime(f"{root}/src/a.ts", (1, 1))
    assert ws.refresh() == 3
    changed = json.loads(tools.call_tool(ws, "changes", {"since": base}))
    assert changed["current_seq"] == base + 3
    ops = {c["path"]: c["op"] for c in changed["changes"]}
    assert ops == {"src/main.zig": "snapshot", "src/new.go": "snapshot", "src/b.ts": "tombstone"}
    names = {r["name"] for r in ws.symbols().collect()}
    assert {"extra", "Fresh", "needle", "main"} <= names and "run" not in names
    assert ws.refresh() == 0
    assert json.loads(tools.call_tool(ws, "changes", {"since": -5}))["current_seq"] == base + 3
    assert ws.indexed_files() == 5
    assert [r["path"] for r in ws.hot_files(2).collect()] == ["src/new.go", "src/main.zig"]


def test_index_accelerated_search(ws):
    ids = [r["doc_id"] for r in ws.files().select("doc_id").collect()]
    assert len(set(ids)) == 5 and min(ids) > 0
    index = ws.trigrams()
    for query, is_regex in (("needle", False), ("ne+dle", True), ("zz", False)):
        got = ws.search_indexed(index, query, regex=is_regex).collect()
        assert got == ws.search(query, regex=is_regex).collect()


def test_notify(ws):
    base = ws.current_seq()
    with open(f"{ws.root}/src/late.py", "w") as handle:
        handle.write("def late(): pass\n")
    assert ws.notify([f"{ws.root}/src/late.py", "../x.py", "node_modules/dep/index.js", "missing.py"]) == 1
    assert ws.current_seq() == base + 1
    assert "late" in {r["name"] for r in ws.symbols().collect()}
    assert ws.refresh() == 0


def test_snapshot_round_trip(ws, spark):
    missing = json.loads(tools.call_tool(ws, "snapshot"))
    assert missing == {"exists": False, "path": ws.snapshot_path, "wrote": False}
    written = json.loads(tools.call_tool(ws, "snapshot", {"write": True}))
    assert written["exists"] and written["wrote"] and written["size_bytes"] > 0
    files, decls = snapshot.load(spark, ws.snapshot_path, ws.root, expected_root=ws.root)
    assert paths_of(files) == paths_of(ws.files())
    assert decls.count() == ws.declarations().count()
    meta = snapshot.read_meta(spark, ws.snapshot_path)
    assert meta["file_count"] == 5
    assert snapshot.read_section(spark, ws.snapshot_path, "freq").count() == 65536
    with pytest.raises(snapshot.SnapshotInvalid):
        snapshot.load(spark, ws.snapshot_path, ws.root, expected_root="/elsewhere")
    soon = time.time() + 5
    with open(f"{ws.root}/src/main.zig", "w") as handle:
        handle.write("pub fn renamed() void {}\n")
    os.utime(f"{ws.root}/src/main.zig", (soon, soon))
    _, decls = snapshot.load(spark, ws.snapshot_path, ws.root)
    names = {r["name"] for r in decls.collect()}
    assert "renamed" in names and "main" not in names


def test_snapshot_truncated(ws, spark):
    ws.snapshot(write=True)
    kept = spark.read.parquet(f"{ws.snapshot_path}/content").filter("path != 'src/a.ts'").collect()
    schema = spark.read.parquet(f"{ws.snapshot_path}/content").schema
    spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{ws.snapshot_path}/content")
    with pytest.raises(snapshot.SnapshotInvalid):
        snapshot.load(spark, ws.snapshot_path, ws.root)


def test_a_job_that_dies_between_sections_leaves_the_last_snapshot(ws, spark, tmp_path, monkeypatch):
    target, second = ws.snapshot_path, str(tmp_path / "second")
    ws.snapshot(write=True)
    before = snapshot.checked(spark, target, ws.root)
    assert snapshot.copy_to(spark, target, second) == list(snapshot.SECTIONS)
    assert snapshot.copy_to(spark, target, second) == []
    changed = ws.files().withColumn("content", F.concat("content", F.lit(b"\n// more")))
    with monkeypatch.context() as patch:
        patch.setattr(snapshot.pairs, "pair_weights", lambda counts: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            snapshot.write(changed, ws.declarations(), ws.root, target)
    assert snapshot.checked(spark, target, ws.root) == before
    snapshot.write(changed.withColumn("length", F.octet_length("content").cast("bigint")), ws.declarations(), ws.root, target)
    after = snapshot.checked(spark, target, ws.root)
    kept = {s["name"]: s["folder"] for s in map(lambda r: r.asDict(), before["sections"])}
    moved = [s["name"] for s in after["sections"] if kept[s["name"]] != s["folder"]]
    assert set(moved) == {"content", "tree", "freq"}
    assert set(snapshot.copy_to(spark, target, second)) == {"content", "tree", "freq"}
    assert snapshot.checked(spark, second)["total_bytes"] == after["total_bytes"]


def test_snapshot_drops_files_that_are_gone(ws, spark):
    ws.snapshot(write=True)
    os.remove(f"{ws.root}/src/a.ts")
    files, decls = snapshot.load(spark, ws.snapshot_path, ws.root)
    assert "src/a.ts" not in paths_of(files) and len(paths_of(files)) == 4 and "src/a.ts" not in paths_of(decls)


def test_notify_of_a_new_workspace_indexes_it(spark, tree_of, tmp_path):
    ws = Workspace(spark, tree_of({"a.py": "def a():\n    pass\n", "b.py": "x = 1\n"}), str(tmp_path / "state"))
    assert ws.notify(["a.py"]) == 1 and ws.indexed_files() == 2
    other = Workspace(spark, tree_of({"c.py": "x = 1\n"}, "other"), str(tmp_path / "edits"))
    other.record_edits(spark.createDataFrame([("c.py", 1, "replace", 1, 1, b"d", 1)], "path STRING, agent BIGINT, op STRING, hash BIGINT, size BIGINT, data BINARY, ord BIGINT"))
    assert other.notify(["c.py"]) == 1 and other.indexed_files() == 1 and other.current_seq() == 2
    assert bytes(other.at_cursor(1).first()["data"]) == b"d"


def test_secondary_checkpoint(spark, tmp_path):
    target = tmp_path / "cp.json"
    target.write_text('{"tier2_processed":12,"tier2_queued":30,"root_hash":1}')
    assert snapshot.secondary_checkpoint(spark, str(target)) == {"processed_files": 12, "queued_files": 30}


def test_edits_cursor_and_payload(ws, spark):
    base = ws.current_seq()
    rows = [("src/a.ts", 7, "replace", 1, 10, b"-x\n+y", 1), ("src/a.ts", 7, "insert", 2, 12, b"+z", 2)]
    edits = spark.createDataFrame(rows, "path STRING, agent BIGINT, op STRING, hash BIGINT, size BIGINT, data BINARY, ord BIGINT")
    assert ws.record_edits(edits) == base + 2
    at = {r["path"]: r for r in ws.at_cursor(base + 1).collect()}
    assert at["src/a.ts"]["op"] == "replace" and bytes(at["src/a.ts"]["data"]) == b"-x\n+y"


def test_protocol(ws):
    ask = lambda **m: json.loads(tools.handle_message(ws, json.dumps({"jsonrpc": "2.0", **m})))
    assert ask(id=1, method="ping")["result"] == {}
    assert ask(id=1, method="initialize")["result"]["capabilities"] == {"tools": {"listChanged": False}}
    assert [t["name"] for t in ask(id=1, method="tools/list")["result"]["tools"]] == list(tools.TOOLS)
    assert ask(id=1, method="nope")["error"]["code"] == -32601
    assert ask(id=1, method="tools/call")["error"]["message"] == "Missing params"
    assert ask(id=1, method="tools/call", params={"name": "bogus"})["error"]["message"] == "Unknown tool"
    assert json.loads(tools.handle_message(ws, "{"))["error"]["code"] == -32700
    assert json.loads(tools.handle_message(ws, "[]"))["error"]["code"] == -32600
    assert tools.handle_message(ws, '{"method":"ping"}') is None
    good = ask(id="a", method="tools/call", params={"name": "search", "query": "needle"})
    assert good["result"]["isError"] is False and "\n" not in tools.dump(good)
    bad = ask(id="a", method="tools/call", params={"name": "tree", "arguments": {"sort": "bogus"}})
    assert bad["result"]["isError"] is True


def test_git_head_change_forces_full_index(spark, tree_of, tmp_path):
    root = tree_of({"a.py": "def a(): pass\n"})
    assert listing.git_head(root) is None
    ws = Workspace(spark, root, str(tmp_path / "state"))
    ws.index()
    os.system(
        f"cd {root} && git init -q . && git -c user.email=t@example.com -c user.name=t commit -q --allow-empty -m x >/dev/null"
    )
    assert len(listing.git_head(root)) == 40
    assert ws.refresh() == 1 and ws.refresh() == 0


def test_cli(spark, tree_of, tmp_path):
    from treelode.__main__ import run

    ws = Workspace(spark, tree_of({"a.py": "import os\n", "b.py": "import a\n"}), str(tmp_path / "state"))
    assert json.loads(run(ws, "index")) == {"started": True, "indexed_files": 2}
    assert json.loads(run(ws, "deps", "a.py"))["imported_by"] == ["b.py"]
    assert json.loads(run(ws, "status"))["watcher_running"] is False


def test_large_files_survive_an_edit(spark, tree_of):
    root = tree_of({"big.py": "x = 1\n" * 50_000 + "def tail():\n"})
    ws = Workspace(spark, root)
    ws.index()
    with open(f"{root}/big.py", "a") as handle:
        handle.write("def added():\n    pass\n")
    assert ws.refresh() == 1
    assert ws.search("def tail").count() == 1 and ws.search("def added").count() == 1


def test_refresh_of_a_new_workspace_indexes(spark, tree_of):
    ws = Workspace(spark, tree_of({"a.py": "def f():\n    pass\n"}))
    assert ws.refresh() == 1 and ws.indexed_files() == 1


def test_many_files_are_read_by_several_tasks(spark, tree_of):
    from treelode.sources import listing

    root = tree_of({f"d{i % 7}/f{i}.py": f"x = {i}\n" for i in range(2100)})
    found = listing.walk(spark, root)
    read = listing.read_files(found, root)
    assert read.rdd.getNumPartitions() >= 4 and read.count() == 2100


def test_refresh_and_notify_take_turns(spark, tree_of):
    import threading

    root = tree_of({"a.py": "def a():\n    pass\n", "b.py": "def b():\n    pass\n"})
    ws = Workspace(spark, root)
    ws.index()
    for name in "ab":
        with open(f"{root}/{name}.py", "a") as handle:
            handle.write(f"def more_{name}():\n    pass\n")
    errors = []

    def run(call):
        try:
            call()
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=run, args=(c,)) for c in (ws.refresh, lambda: ws.notify(["b.py"]))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    gens = [r.gen for r in spark.read.parquet(f"{ws.state_dir}/commits").collect()]
    assert len(gens) == len(set(gens))
    assert ws.search("more_a").count() == ws.search("more_b").count() == 1


def test_an_unreadable_directory_is_not_a_deleted_one(spark, tree_of, monkeypatch):
    from treelode.sources import listing

    def refuse(path):
        raise PermissionError(path)

    monkeypatch.setattr(listing.os, "scandir", refuse)
    with pytest.raises(PermissionError):
        list(listing._list_directory("/somewhere", "", [], []))


def test_versions_of_an_unfinished_job_stay_hidden(spark, tree_of):
    """A batch that no commit names is not read, and its numbers are given out again."""
    ws = Workspace(spark, tree_of({"a.py": "def alpha():\n    beta = 1\n"}))
    ws.index()
    ws._append_versions(ws.versions().withColumn("path", F.lit("ghost")).drop("seq"), ["path"])
    assert ws.current_seq() == 1 and [r["path"] for r in ws.versions().collect()] == ["a.py"]
    assert [r["seq"] for r in ws.changes().collect()] == [1]
    assert [tuple(r) for r in ws.search_word("beta").collect()] == [("a.py", 2)]
    assert ws.trigrams().count() == trigrams.postings(ws.files()).count()
