"""Script hygiene and secret scans of lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Script ranges, the control characters that are allowed, and the mark that exempts a line.
CYRILLIC = "[\\u0400-\\u052F]"
HANGUL = "[\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
ALLOW = "text-hygiene:allow"
# What blocks, and what warns.
SECRETS = (
    ("private_key", "block", "-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----"),
    ("access_key", "block", "AKIA[0-9A-Z]{16}"),
    ("credential", "block", "(?i)\\b(api[_-]?key|secret|token|password|passwd)\\b\\s*[=:]\\s*['\"][^'\"]{8,}['\"]"),
    ("eval", "warn", "\\beval\\s*\\("),
    ("sql_format", "warn", "(?i)(execute|cursor\\.execute)\\s*\\(\\s*[\"'].*%s.*[\"']\\s*%"),
)


def line_flags(line: Column, allow: str = ALLOW) -> Column:
    """What does not belong in a line: cyrillic, hangul, control; none for an exempt line."""
    kinds = [F.when(line.rlike(p), F.lit(k)) for k, p in (("cyrillic", CYRILLIC), ("hangul", HANGUL), ("control", CONTROL))]
    return F.when(line.contains(allow), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*kinds)))


def line_secrets(line: Column) -> Column:
    """The secret rules that a line breaks."""
    return F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(k)) for k, _, p in SECRETS]))


def numbered_lines(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """A row for each line, numbered from 1."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
