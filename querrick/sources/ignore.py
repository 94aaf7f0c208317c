"""Ignore rules: patterns of ignore files, the last that matches decides."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import IGNORED_DIRS, IGNORED_FILES, IGNORED_PATTERNS


def to_regex(pattern: str) -> str:
    """A pattern of shell globs as a regular expression over a path from the root; ``**`` crosses folders."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file."""

    regex: re.Pattern
    keeps: bool

    @classmethod
    def of(cls, line: str) -> Rule | None:
        line = line.rstrip("\r\n")
        line = line if line.endswith("\\ ") else line.rstrip()
        if not line or line.startswith("#"):
            return None
        keeps = line.startswith("!")
        body = line[1:] if keeps else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
        folder = body.endswith("/")
        body = body.rstrip("/")
        rooted = "/" in body
        body = body.lstrip("/")
        if not body:
            return None
        return cls(re.compile(("" if rooted else "(?:.*/)?") + to_regex(body) + ("/.+" if folder else "(?:/.+)?") + r"\Z", re.S), keeps)


class IgnoreRules:
    """Decides on paths relative to the root. What is always ignored can't be kept by a rule."""

    def __init__(self, lines: Iterable[str] = ()) -> None:
        self.rules = [r for r in map(Rule.of, lines) if r]
        self.always = [r for r in map(Rule.of, [*(f"{d}/" for d in IGNORED_DIRS), *IGNORED_FILES, *IGNORED_PATTERNS]) if r]

    def ignores(self, path: str) -> bool:
        if any(r.regex.match(path) for r in self.always):
            return True
        last = None
        for rule in self.rules:
            if rule.regex.match(path):
                last = rule
        return last is not None and not last.keeps


def ignored(path: Column, lines: Iterable[str] = ()) -> Column:
    """``IgnoreRules.ignores`` as an expression, for listings that are tables."""
    rules = IgnoreRules(lines)
    holds = lambda r: path.rlike("(?s)\\A(?:" + r.regex.pattern.removesuffix(r"\Z") + ")\\z")
    out = F.lit(False)
    for rule in rules.rules:
        out = F.when(holds(rule), F.lit(not rule.keeps)).otherwise(out)
    for rule in rules.always:
        out = out | holds(rule)
    return out


def to_glob(pattern: str) -> str:
    """An ignore pattern as a glob. A bare name without dot, star or question mark counts as a folder."""
    body = pattern.removeprefix("/").removesuffix("/")
    folder = pattern.endswith("/")
    if pattern.startswith("/"):
        return f"{body}/**" if folder else body
    if "**" in body:
        return body
    if folder or not re.search(r"[.*?]", body):
        return f"**/{body}/**"
    return f"**/{body}"


def globs(lines: Iterable[str]) -> list[str]:
    """All globs that a listing may skip: what is always ignored, and ignore lines but for those that keep."""
    own = [x for x in (line.strip() for line in lines) if x and x[0] not in "#!"]
    return [f"**/{d}/**" for d in IGNORED_DIRS] + [f"**/{f}" for f in (*IGNORED_FILES, *IGNORED_PATTERNS)] + [to_glob(x) for x in own]
