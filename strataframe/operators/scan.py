"""Pattern scan of text lines, with an allow list per pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# General patterns of the scan, hard kinds first. Patterns for particular people, places or storage roots
# are built from the caller's own lists.
EMAIL = ("email_pattern", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@")
AUTHOR_TRAILER = ("git_author_real", r"Co-Authored-By:\s*(?!Anonymous)", "Co-Authored-By:")
SOFT_PATTERNS = (
    ("our_lab", r"\bour lab\b", "our lab"),
    ("our_group", r"\bour group\b", "our group"),
    ("we_acknowledge", r"\bwe acknowledge\b", "we acknowledge"),
)

SNIPPET = 200
LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def scan_patterns_for(
    names: Sequence[str] = (), roots: Sequence[str] = (), cited: Sequence[str] = ()
) -> list[tuple[str, str, str, str]]:
    """``(kind, severity, pattern, literal)``: whole words for names, paths below storage roots, citations by author, and
    the general patterns. A line without the literal cannot match, so most lines never reach the pattern."""
    hard = [(f"root_{i}", rf"\Q{r}\E[A-Za-z0-9_\-./]+", r) for i, r in enumerate(roots)]
    hard += [(f"identifier_{n.lower()}", rf"\b\Q{n}\E\b", n) for n in names]
    hard += [(f"citation_{n.lower()}", rf"\b\Q{n}\E et al", n) for n in cited]
    hard += [EMAIL, AUTHOR_TRAILER]
    return [(k, "hard", p, q) for k, p, q in hard] + [(k, "soft", p, q) for k, p, q in SOFT_PATTERNS]


def scan_lines(
    docs: DataFrame,
    patterns: Sequence[tuple[str, str, str, str]],
    path: str = "path",
    text: str = "text",
    allow: DataFrame | None = None,
) -> DataFrame:
    """``kind, severity, path, line, snippet``: every line that matches a pattern, once per kind.

    Each line is tested against all patterns in one pass, so rows multiply only for hits. ``allow(kind, path)`` lists
    expected hits.
    """
    whole = F.regexp_replace(F.col(text), LINE_ENDS, "\n")
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(whole, "\n", -1)).alias("_i", "_line"))
    line = F.col("_line")
    tests = [
        F.when(F.contains(line, F.lit(q)) & line.rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity")))
        for k, s, p, q in patterns
    ]
    found = F.array_compact(F.array(*tests))
    hits = lines.select("path", "_i", "_line", F.explode(found).alias("h"))
    out = hits.select(
        "h.kind",
        "h.severity",
        "path",
        (F.col("_i") + 1).alias("line"),
        F.substring(F.regexp_replace("_line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), 1, SNIPPET).alias("snippet"),
    )
    if allow is not None:
        out = out.join(allow.select("kind", "path"), ["kind", "path"], "left_anti")
    return out


def scan_report(hits: DataFrame) -> DataFrame:
    """Hits, documents and first position per kind."""
    return hits.groupBy("kind", "severity").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count_distinct("path").alias("n_docs"),
        F.min(F.struct("path", "line")).alias("_first"),
    ).select("kind", "severity", "n_hits", "n_docs", F.col("_first.path").alias("first_path"), F.col("_first.line").alias("first_line"))
