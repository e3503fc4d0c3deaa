"""Path and file-name expressions, shards, ignore rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

#: Extensions of source code and their languages.
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "javascript", ".jsx": "javascript", ".tsx": "javascript", ".java": "java", ".c": "c", ".cpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".rs": "rust",
}
MARKDOWN = (".md", ".markdown")
#: Extensions that ingestion takes (those that it has a reader for), and directories that it passes over.
SUPPORTED = (*MARKDOWN, *CODE_LANGUAGES)
IGNORED_DIRS = ("__pycache__", ".git", "venv", "env", ".venv", ".env")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension as written, with its dot; empty if there is none or the name is just one (``.bashrc``)."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative(path: Column, base: str) -> Column:
    prefix = base.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if base else path


def code_language(path: Column) -> Column:
    """The language by extension in any case; null for others."""
    ext = F.lower(extension(path))
    return reduce(lambda c, kv: c.when(ext == kv[0], F.lit(kv[1])), list(CODE_LANGUAGES.items())[1:], F.when(ext == ".py", F.lit("python")))


def file_kind(path: Column) -> Column:
    """markdown, code or null (unsupported)."""
    ext = F.lower(extension(path))
    return F.when(ext.isin(*MARKDOWN), F.lit("markdown")).when(ext.isin(*CODE_LANGUAGES), F.lit("code"))


def shard_of(path: Column, n: int) -> Column:
    """The 128-bit md5 of the path modulo n, folded over its four 32-bit words so that 64-bit arithmetic does."""
    digest = F.md5(path)
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    acc = F.lit(0).cast("long")
    for i in range(4):
        acc = (acc * F.lit(4294967296 % n) + word(i)) % F.lit(n)
    return acc.cast("int")


def event_ignored(path: Column, patterns: Iterable[str] = ()) -> Column:
    """Watcher rule: hidden name, inside (or named as) an ignored directory, a pattern in the path, or an unsupported extension."""
    bad = basename(path).startswith(".")
    for d in IGNORED_DIRS:
        bad = bad | path.contains(f"/{d}/") | path.endswith(f"/{d}")
    for p in patterns:
        bad = bad | path.contains(p)
    return bad | ~F.lower(extension(path)).isin(*SUPPORTED)


def scan_ignored(path: Column, patterns: Iterable[str] = (), extensions: Iterable[str] = SUPPORTED) -> Column:
    """Scheduled-scan rule: as the watcher's, but any hidden directory is passed over too."""
    bad = path.rlike(r"/\.[^/]*/") | basename(path).startswith(".")
    for d in IGNORED_DIRS:
        bad = bad | path.contains(f"/{d}/")
    for p in patterns:
        bad = bad | path.contains(p)
    return bad | ~F.lower(extension(path)).isin(*extensions)


def sync_ignored(path: Column, extensions: Iterable[str] | None = None) -> Column:
    """Incremental-scan rule: names that start with . or ~ or end with ~; an optional extension whitelist in any case."""
    name = basename(path)
    bad = name.rlike(r"^[.~]|~$")
    return bad | ~F.lower(extension(path)).isin(*[e.lower() for e in extensions]) if extensions else bad
