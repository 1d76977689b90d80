"""File types: by name, by content, and whether bytes are text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "rs": "rust", "py": "python", "pyi": "python", "md": "markdown", "markdown": "markdown", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cu": "cuda", "cuh": "cuda",
    "go": "go", "sh": "bash", "bash": "bash", "txt": "text", "log": "text", "yaml": "text", "yml": "text", "toml": "toml", "html": "html", "htm": "html", "xml": "html", "json": "json",
}
SHEBANGS = {"python": "python", "bash": "bash", "sh": "bash"}
#: Words that speak for a language, with their weights; sums are clipped to 1.
KEYWORDS: dict[str, dict[str, float]] = {
    "rust": {"fn ": 0.3, "let ": 0.2, "impl ": 0.3, "pub ": 0.2, "use ": 0.1, "struct ": 0.2},
    "python": {"def ": 0.3, "import ": 0.2, "class ": 0.2, "self": 0.2, "from ": 0.1, "elif ": 0.2},
    "markdown": {"# ": 0.3, "## ": 0.3, "```": 0.3, "](": 0.2, "- ": 0.1},
    "c": {"#include": 0.4, "int ": 0.1, "void ": 0.2, "struct ": 0.2, "printf": 0.2},
}
LEAST = 0.5


def _base(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), r"\.resolved(\.\d+)?$", "")


def extension(path: Column) -> Column:
    return F.nullif(F.regexp_extract(_base(path), r"\.([a-z0-9]+)$", 1), F.lit(""))


def from_path(path: Column) -> Column:
    """File type by extension, `unknown` for any other; `.resolved.N` at the end doesn't count."""
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit("unknown"))


def content_scores(text: Column) -> dict[str, Column]:
    head = F.substring(text, 1, 1000)
    out = {}
    for lang, words in KEYWORDS.items():
        total = F.lit(0.0)
        for word, weight in words.items():
            total = total + F.when(F.contains(head, F.lit(word)), weight).otherwise(0.0)
        out[lang] = F.least(F.lit(1.0), total)
    return out


#: Media types and the file types they stand for.
MIMES = {
    "text/x-rust": "rust", "text/x-python": "python", "text/x-script.python": "python", "text/markdown": "markdown", "text/x-c": "c", "text/x-c++": "cpp", "text/x-go": "go", "text/x-shellscript": "bash",
    "application/x-sh": "bash", "text/plain": "text", "application/toml": "toml", "text/html": "html", "application/xhtml+xml": "html", "text/xml": "html", "application/json": "json",
}


def detect(path: Column, text: Column, mime: Column | None = None, custom: dict[str, str] | None = None) -> Column:
    """struct(file_type, confidence): the surest of a `custom` extension (1), extension (.9), shebang (.8), media type (.7) and
    content (.6 * score); `unknown` below `LEAST`.  On equal confidence content comes before shebang, and that before extension."""
    ext = from_path(path)
    shebang = F.regexp_extract(text, r"^#!\s*\S*?/?(?:env\s+)?(python|bash|sh)[\d.]*\b", 1)
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in SHEBANGS.items() for x in kv]), shebang)
    candidates = [F.struct(F.when(ext != "unknown", 0.9).otherwise(0.0).alias("confidence"), F.lit(0).alias("rank"), ext.alias("file_type"))]
    candidates.append(F.struct(F.when(found.isNotNull(), 0.8).otherwise(0.0).alias("confidence"), F.lit(1).alias("rank"), F.coalesce(found, F.lit("unknown")).alias("file_type")))
    if mime is not None:
        kinds = F.create_map(*[F.lit(x) for kv in MIMES.items() for x in kv])
        known = F.try_element_at(kinds, F.trim(F.split(F.lower(mime), ";", 2)[0]))
        candidates.append(F.struct(F.when(known.isNotNull(), 0.7).otherwise(0.0).alias("confidence"), F.lit(-1).alias("rank"), F.coalesce(known, F.lit("unknown")).alias("file_type")))
    if custom:
        own = F.try_element_at(F.create_map(*[F.lit(x) for kv in custom.items() for x in kv]), extension(path))
        candidates.append(F.struct(F.when(own.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.lit(9).alias("rank"), F.coalesce(own, F.lit("unknown")).alias("file_type")))
    for k, (lang, score) in enumerate(content_scores(text).items()):
        candidates.append(F.struct((F.coalesce(score, F.lit(0.0)) * 0.6).alias("confidence"), F.lit(2 + k).alias("rank"), F.lit(lang).alias("file_type")))
    best = F.array_max(F.array(*candidates))
    kind = F.when(best["confidence"] >= LEAST, best["file_type"]).otherwise("unknown")
    return F.struct(kind.alias("file_type"), best["confidence"].alias("confidence"))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8 KiB."""
    return F.contains(F.hex(F.substring(content, 1, 8192)).cast("string"), F.lit("00")) & F.regexp_like(F.hex(F.substring(content, 1, 8192)), F.lit("^(?:..)*?00"))


def is_likely_text(content: Column) -> Column:
    """`likely_text` of a binary column; only the first KiB goes to Python."""

    @F.pandas_udf("boolean")
    def run(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: likely_text(bytes(x or b"")))

    return run(F.substring(content, 1, 1024))


def likely_text(content: bytes) -> bool:
    """No zero byte and over 85 % printable among the first 1 KiB; nothing is text."""
    head = content[:1024]
    if not head:
        return True
    if 0 in head:
        return False
    shown = head.decode("utf-8", "ignore")
    return sum(c.isprintable() or c in "\n\r\t" for c in shown) > 0.85 * max(1, len(shown))


def glob_regex(pattern: str) -> str:
    """A glob (`*`, `**`, `?`, `[…]`) as a regular expression for whole paths."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"
