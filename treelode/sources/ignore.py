"""Ignore rules: parsing, and evaluation as regular expressions.

The last matching rule wins, ``!`` re-includes, a leading ``/`` anchors a pattern that
contains an inner slash, a trailing ``/`` restricts it to directories and their content.
A rule file applies below the directory it was found in, and an ignored directory is
never entered, so nothing below it can be re-included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from treelode.functions import paths

# Read at the root only, before the root .gitignore, which can therefore override it.
ROOT_IGNORE_FILE = ".treelodeignore"
IGNORE_FILE = ".gitignore"


@dataclass(frozen=True)
class IgnoreRule:
    base_dir: str
    pattern: str
    anchored: bool
    dir_only: bool
    negated: bool

    def body(self, is_dir: bool) -> str:
        """Regex (to be matched against a whole path) of the paths this rule hits."""
        any_depth = paths.glob_body(self.pattern)
        if "/" not in self.pattern:
            named = "(?:.*/)?" + paths.glob_body(self.pattern, star="[^/]*")
            below = any_depth + "/.*"
        elif self.anchored:
            named, below = any_depth, any_depth + "/.*"
        else:
            named = "(?:.*/)?" + any_depth
            below = named + "/.*"
        if not self.dir_only:
            hit = named
        else:
            hit = f"(?:{named}|{below})" if is_dir else below
        return (paths.glob_body(self.base_dir) + "/" if self.base_dir else "") + "(?:" + hit + ")"


def parse_rules(text: str, base_dir: str = "") -> list[IgnoreRule]:
    rules = []
    for raw in text.split("\n"):
        line = raw.strip(" \t\r")
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[1:] if negated else line
        anchored = pattern.startswith("/")
        pattern = pattern[1:] if anchored else pattern
        dir_only = pattern.endswith("/")
        pattern = pattern[:-1] if dir_only else pattern
        if pattern:
            rules.append(IgnoreRule(base_dir, pattern, anchored, dir_only, negated))
    return rules


def _runs(rules, is_dir: bool) -> list[tuple[bool, str]]:
    """Neighbouring rules of one sign joined to one alternation, last run first."""
    out: list[tuple[bool, list[str]]] = []
    for rule in rules:
        if out and out[-1][0] == rule.negated:
            out[-1][1].append(rule.body(is_dir))
        else:
            out.append((rule.negated, [rule.body(is_dir)]))
    return [(negated, "|".join(bodies)) for negated, bodies in reversed(out)]


def is_ignored(path: Column, rules, is_dir: bool) -> Column:
    """Verdict of the last matching rule, as a Column."""
    verdict = F.lit(False)
    for negated, body in reversed(_runs(rules, is_dir)):
        verdict = F.when(path.rlike("(?s)\\A(?:%s)\\z" % body), F.lit(not negated)).otherwise(verdict)
    return verdict


def is_excluded(path: Column, rules) -> Column:
    """A file is excluded when it, or any directory above it, is ignored or skip-listed."""
    folders = paths.dir_prefixes(path)
    skipped = F.exists(folders, lambda d: paths.basename(d).isin(*paths.SKIP_DIRS))
    pruned = F.exists(folders, lambda d: is_ignored(d, rules, True))
    return skipped | pruned | is_ignored(path, rules, False)


def compile_rules(rules) -> dict[bool, list[tuple[bool, re.Pattern]]]:
    """Rules ready for use inside a listing task, for files and for directories."""
    return {
        is_dir: [(negated, re.compile("(?s:%s)" % body)) for negated, body in _runs(rules, is_dir)]
        for is_dir in (False, True)
    }


def is_ignored_path(path: str, compiled: dict, is_dir: bool) -> bool:
    """Same verdict as ``is_ignored``, from compiled rules."""
    for negated, pattern in compiled[is_dir]:
        if pattern.fullmatch(path):
            return not negated
    return False
