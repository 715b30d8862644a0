"""Secret patterns, in the dialect that Java and RE2 share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Public shapes of credentials. `token_assignment` is our own addition.
PATTERNS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36,}",
    "api_key": r"\bsk-[0-9A-Za-z_-]{20,}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{4,}\.[0-9A-Za-z_-]{4,}\.[0-9A-Za-z_-]{4,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "password_assignment": r"(?i)\b(?:password|passwd|secret|api_key)\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']",
    "token_assignment": r"(?i)\btoken\s*=\s*\"[0-9a-f]{40}\"",
}
#: Bytes at a file's start that are searched before anything is sent to a classifier.
HEAD_BYTES = 1024


def matches(text: Column, name: str) -> Column:
    return F.rlike(text, F.lit(PATTERNS[name]))


def looks_like_secret(text: Column) -> Column:
    """Whether any pattern matches; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, (matches(text, n) for n in PATTERNS)), F.lit(False))


def head(content: Column) -> Column:
    """The first bytes of a file as text, broken characters replaced."""
    return F.make_valid_utf8(F.substring(content, 1, HEAD_BYTES).cast("string"))


def head_has_secret(content: Column) -> Column:
    return looks_like_secret(head(content))
