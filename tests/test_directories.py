"""Listing again only what moved: every kind of change against a full walk."""

import os
import random
import shutil
import time

import pytest

from treelode.plans.workspace import Workspace
from treelode.sources import directories, listing
from treelode.sources.directories import Directories

RACY_NS = 30_000_000


def settle():
    """Until a listing from now on is not too close to the last change."""
    time.sleep(0.06)


def rows_of(df):
    return sorted((r["path"], r["length"], r["mtime_ns"]) for r in df.select("path", "length", "mtime_ns").collect())


def counted(kept):
    """Signals by action, with the directories they name."""
    return sorted({(r["action"], r["path"]) for r in kept.signals().collect()})


@pytest.fixture
def kept(spark, tree_of, tmp_path):
    root = tree_of({
        ".gitignore": "*.log\n", "top.py": "1", "a/x.py": "x", "a/b/y.py": "y", "a/b/c/z.py": "z", "d/.gitignore": "skip/\n",
        "d/w.py": "w", "d/skip/no.py": "n", "e/f/g/h.py": "h", "e/f/i.log": "l",
    })
    settle()
    made = Directories(spark, root, str(tmp_path / "directories"), RACY_NS)
    made.replace(listing.list_tree(spark, root))
    return made


def follow(spark, kept):
    """One step; the kept listing must equal a full walk afterwards.  Returns paths that came and went."""
    before = dict((r[0], r) for r in rows_of(listing.files_of(kept.current())))
    change = kept.moved()
    if change is None:
        assert rows_of(listing.walk(spark, kept.root)) == sorted(before.values())
        return set()
    named = {r["path"] for r in change.paths.collect()}
    files = rows_of(change.files)
    kept.add(change.rows)
    after = rows_of(listing.walk(spark, kept.root))
    assert rows_of(listing.files_of(kept.current())) == after
    differing = {p for p, *_ in set(after) ^ set(before.values())}
    assert named == differing and files == [r for r in after if r[0] in differing]
    return named


def test_a_quiet_tree_lists_nothing(spark, kept):
    assert counted(kept) == [] and kept.moved() is None


def test_one_edit_lists_no_directory(spark, kept):
    with open(f"{kept.root}/a/b/y.py", "w") as handle:
        handle.write("edited")
    assert counted(kept) == [("edited", "a/b")]
    assert follow(spark, kept) == {"a/b/y.py"}
    assert counted(kept) == []


def test_one_new_file_lists_its_directory_alone(spark, kept):
    with open(f"{kept.root}/a/b/new.py", "w") as handle:
        handle.write("n")
    assert counted(kept) == [("listed", "a/b")]
    assert follow(spark, kept) == {"a/b/new.py"}


def test_times_put_back_hide_nothing(spark, kept):
    before = os.stat(f"{kept.root}/a/b")
    with open(f"{kept.root}/a/b/copied.py", "w") as handle:
        handle.write("c")
    os.utime(f"{kept.root}/a/b", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert follow(spark, kept) == {"a/b/copied.py"}


def test_moved_replaced_and_linked_directories(spark, kept, tmp_path):
    root = kept.root
    os.rename(f"{root}/a/b", f"{root}/moved")
    assert follow(spark, kept) == {"a/b/y.py", "a/b/c/z.py", "moved/y.py", "moved/c/z.py"}
    shutil.copytree(f"{root}/e", tmp_path / "elsewhere", copy_function=shutil.copy2)
    shutil.rmtree(f"{root}/e")
    os.symlink(tmp_path / "elsewhere", f"{root}/e")
    assert follow(spark, kept) == {"e/f/g/h.py"}
    os.remove(f"{root}/e")
    os.rename(tmp_path / "elsewhere", f"{root}/e")
    assert follow(spark, kept) == {"e/f/g/h.py"}
    os.remove(f"{root}/top.py")
    os.mkdir(f"{root}/top.py")
    with open(f"{root}/top.py/in.py", "w") as handle:
        handle.write("in")
    assert follow(spark, kept) == {"top.py", "top.py/in.py"}


def test_changed_ignore_files_list_all_below(spark, kept):
    with open(f"{kept.root}/d/.gitignore", "w") as handle:
        handle.write("w.py\n")
    assert follow(spark, kept) == {"d/.gitignore", "d/w.py", "d/skip/no.py"}
    with open(f"{kept.root}/.gitignore", "w") as handle:
        handle.write("b/\n")
    assert follow(spark, kept) == {".gitignore", "a/b/y.py", "a/b/c/z.py", "e/f/i.log"}


def test_a_root_that_goes_and_comes_back(spark, kept):
    shutil.move(kept.root, kept.root + "-away")
    assert len(follow(spark, kept)) == 8
    shutil.move(kept.root + "-away", kept.root)
    assert len(follow(spark, kept)) == 8


def test_large_directories_are_kept_in_parts(spark, tree_of, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PART_FILES", 10)
    root = tree_of({f"wide/f{i:03d}.py": str(i) for i in range(45)})
    settle()
    first = listing.list_tree(spark, root)
    made = Directories(spark, root, str(tmp_path / "directories"), RACY_NS)
    made.replace(first)
    for i in range(0, 45, 2):
        os.remove(f"{root}/wide/f{i:03d}.py")
    follow(spark, made)
    settle()
    follow(spark, made)
    with open(f"{root}/wide/f001.py", "w") as handle:
        handle.write("other")
    assert follow(spark, made) == {"wide/f001.py"}


def test_random_changes_over_merged_deltas(spark, kept, monkeypatch):
    monkeypatch.setattr(directories, "DELTAS", 2)
    rng = random.Random(4)
    root = kept.root
    for step in range(4):
        folders = [f for f, *_ in os.walk(root)]
        for n in range(3):
            folder = rng.choice(folders)
            if os.path.isdir(folder):
                what = rng.randrange(3)
                if what == 0:
                    os.makedirs(f"{folder}/n{step}{n}/deep", exist_ok=True)
                    open(f"{folder}/n{step}{n}/deep/f.py", "w").write("f")
                elif what == 1:
                    open(f"{folder}/f{step}{n}.py", "w").write("g" * step)
                elif folder != root:
                    shutil.rmtree(folder)
        if step % 2:
            settle()
        follow(spark, kept)
    assert len(kept.chain()) <= 4


def test_a_crash_before_the_listing_is_kept_loses_nothing(spark, tree_of, tmp_path, monkeypatch):
    root = tree_of({"a.py": "def a():\n    pass\n", "s/b.py": "def b():\n    pass\n"})
    ws = Workspace(spark, root, str(tmp_path / "state"))
    ws.index()
    with open(f"{root}/s/c.py", "w") as handle:
        handle.write("def c():\n    pass\n")

    def fail(self, rows):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Directories, "add", fail)
        with pytest.raises(RuntimeError):
            ws.refresh()
    seq = ws.current_seq()
    assert ws.refresh() == 0 and ws.current_seq() == seq  # committed once, found again, nothing new
    assert ws.search("def c").count() == 1
