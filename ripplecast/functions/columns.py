"""Column expressions: validation, normalisation, text measures, scores. All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source files and their languages, and directories that hold none.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "rb": "ruby", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "swift": "swift", "php": "php",
}
SKIPPED_DIRECTORIES = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox", "coverage", ".pytest_cache", "target")

# Texts that mark a branch point.
BRANCH_MARKS = ("if ", "elif ", "else ", "for ", "while ", "case ", "catch ", "&&", "||", "?")

# Enumerations.
STATUSES = ("pending", "processing", "completed", "failed")


def holds_any(text: Column, words: Sequence[str]) -> Column:
    """Some word stands anywhere in the text, as its bytes."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def is_rollback_message(message: Column) -> Column:
    """L1: the message begins with 'revert', in any case."""
    return F.lower(F.trim(message)).startswith("revert")


def names_rollback(flag: Column, message: Column) -> Column:
    """L2: flagged, or the word 'revert' stands anywhere."""
    return F.coalesce(flag, F.lit(False)) | F.lower(message).rlike(r"\brevert\b")


def valid_sha(sha: Column) -> Column:
    """7 or 40 hexadecimal digits; null is not valid."""
    return F.coalesce(F.lower(sha).rlike("^([0-9a-f]{7}|[0-9a-f]{40})$"), F.lit(False))


def risk_level(risk: Column) -> Column:
    """D3: low under 25, medium under 50, high under 75, else critical; null stays null."""
    return F.when(risk < 25, "low").when(risk < 50, "medium").when(risk < 75, "high").when(risk.isNotNull(), "critical")


def extension(path: Column) -> Column:
    """The last suffix of the file name, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """By the suffix; null where it names no language."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(pairs, extension(path))


def is_source_path(path: Column) -> Column:
    """S3: a source extension, and no skipped directory on the way."""
    low = F.lower(path)
    return low.rlike(rf"\.({'|'.join(LANGUAGES)})$") & ~F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))


def normal_url(url: Column) -> Column:
    """Without trailing slashes and one .git ending, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""))


def normal_path(path: Column) -> Column:
    """Backslashes as slashes; empty and '.' parts collapse."""
    flat = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    flat = F.regexp_replace(F.regexp_replace(flat, r"(?<=/)(\./)+", ""), r"^(\./)+|(?<=.)/\.?$", "")
    return F.when(flat == "", ".").when(flat == "/.", "/").otherwise(flat)


def directory(path: Column) -> Column:
    """The part before the last slash; the root is empty."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def occurrences(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def complexity(text: Column) -> Column:
    """One, and one for each branch mark; blank text has none. 'elif ' also holds 'if '."""
    total = F.lit(1)
    for mark in BRANCH_MARKS:
        total = total + occurrences(text, mark)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0.0).otherwise(total.cast("double"))


def node_id(kind: str, *parts: Column) -> Column:
    """G1: kind:part::part."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("::", *parts))


def share(x: Column, most: float) -> Column:
    """x / most, at most 1."""
    return F.least(x / most, F.lit(1.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def cosine(a: Column, b: Column) -> Column:
    """V8: 0 where lengths differ; a zero norm counts as 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    safe = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(dot / (safe(a) * safe(b)))


def rounded(x: Column) -> Column:
    return F.round(x, 6)
