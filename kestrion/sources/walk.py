"""Files of a repository that may be indexed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 1024 * 1024
#: Patterns that always exclude.
BUILT_IN = (
    ".env", ".env.*", "*.pem", "*.key", "id_rsa*", "id_ed25519*", "id_ecdsa*", "**/.ssh/**", "**/.aws/**", "**/.gnupg/**", "**/.git/**",
    "**/node_modules/**", "**/target/**", "**/dist/**", "**/build/**", "**/.cache/**", "**/.DS_Store",
)


class WalkError(ValueError):
    """A root that isn't a folder, or a pattern that can't be read."""


def glob_regex(pattern: str) -> str:
    """A glob over whole relative paths: * and ? cross folders, **/ is any number of folders, [..] and {a,b} as usual."""
    out, i, alternatives = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise WalkError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + re.escape(body[1:]) if body[0] in "!^" else re.escape(body)).replace(r"\-", "-") + "]")
            i = end + 1
            continue
        if c == "{":
            alternatives += 1
            out.append("(?:")
        elif c == "}" and alternatives:
            alternatives -= 1
            out.append(")")
        elif c == "," and alternatives:
            out.append("|")
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    if alternatives:
        raise WalkError(f"unclosed alternatives in {pattern!r}")
    return "".join(out)


def gitignore_globs(line: str) -> list[str]:
    """What a line of a .gitignore excludes, as globs; comments, blanks and negations nothing."""
    line = line.strip()
    core = line.strip("/")
    if not core or line[0] in "#!":
        return []
    places = [core] if line[0] == "/" or "/" in core else [core, f"**/{core}"]
    return [g for p in places for g in (p, f"{p}/**")]


def exclude_pattern(extra: list[str] = (), gitignore: str = "") -> re.Pattern:
    """One pattern for a relative path. Built-in and given globs also match the file's name alone; unreadable .gitignore lines are passed over."""
    parts = []
    for glob in [*BUILT_IN, *extra]:
        regex = glob_regex(glob)
        parts.append(regex)
        if "/" not in glob:
            parts.append(f"(?:.*/){regex}")
    for line in gitignore.splitlines():
        for glob in gitignore_globs(line):
            try:
                parts.append(glob_regex(glob))
            except WalkError:
                continue
    return re.compile("(?:" + "|".join(parts) + r")\Z", re.S)


def walk(root: str, extra: list[str] = ()) -> list[tuple[str, str]]:
    """(absolute path, relative path with /) of regular files below the root, none beyond MOST_BYTES, excluded or reached through a link."""
    base = os.path.realpath(root)
    if not os.path.isdir(base):
        raise WalkError(f"not a folder: {root}")
    try:
        with open(os.path.join(base, ".gitignore"), encoding="utf-8") as f:
            ignored = f.read()
    except (OSError, UnicodeDecodeError):
        ignored = ""
    excluded, out = exclude_pattern(list(extra), ignored), []
    for folder, _, names in os.walk(base, followlinks=False):
        for name in names:
            path = os.path.join(folder, name)
            if os.path.islink(path) or not os.path.isfile(path):
                continue
            relative = os.path.relpath(path, base).replace(os.sep, "/")
            try:
                relative.encode()
                size = os.path.getsize(path)
            except (UnicodeEncodeError, OSError):
                continue
            if size <= MOST_BYTES and not excluded.match(relative):
                out.append((path, relative))
    return sorted(out, key=lambda x: x[1])


def read_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """source_path, content, read_error of listed files, read on the executors (the repository lies in a folder that they share)."""
    listed = spark.createDataFrame(files, "path string, source_path string").repartition(max(1, min(len(files) // 64 + 1, 1024)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 64):
                part, content, errors = frame[low : low + 64], [], []
                for path in part.path:
                    try:
                        with open(path, "rb") as f:
                            content.append(f.read())
                            errors.append(None)
                    except OSError as error:
                        content.append(None)
                        errors.append(f"io error: {error.strerror}")
                yield pd.DataFrame({"source_path": part.source_path, "content": content, "read_error": errors})

    return listed.mapInPandas(read, "source_path string, content binary, read_error string")
