"""Text predicates and extractions. Patterns use no look-around, so other engines read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Subjects that take something back (a word that is an option, like --revert, doesn't), and subjects that nobody writes by hand.
REVERT = r"(?i)^\s*revert\b|^\s*fix\w*\b(?:\S*?\brevert\b|.*\s(?:[^\s-]\S*?)?\brevert\b)"
BOILERPLATE = r"^[Mm]erge branch|^[Mm]erge pull request|^[Bb]ump version|^[Uu]pdate package-lock|^[Uu]pdate yarn\.lock|[Gg]enerated by|[Aa]uto-generated"
TICKET = r"\b[A-Z][A-Z0-9]+-[0-9]+\b"


def first_line(message) -> Column:
    return F.regexp_replace(F.split_part(message, F.lit("\n"), F.lit(1)), "\r$", "")


def is_revert(message) -> Column:
    """Whether the first line says that something is taken back."""
    return first_line(message).rlike(REVERT)


def is_boilerplate(message, changed: Column) -> Column:
    """Whether a subject's wording or more than 5,000 changed lines tell that nobody wrote a commit by hand."""
    return first_line(message).rlike(BOILERPLATE) | (changed > 5000)


def ticket(message) -> Column:
    """KEY-n anywhere, else #n; null without."""
    key = F.regexp_extract(message, r"\b([A-Z][A-Z0-9]+-[0-9]+)\b", 1)
    number = F.regexp_extract(message, r"(#[0-9]+)", 1)
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(number, F.lit("")))


def is_test_path(path: Column) -> Column:
    """Test files as effort counts them: a tests or __tests__ folder, test_ before or _test.rs behind the name, spec or test before the last dot."""
    p = F.lower(path)
    return p.rlike(r"(?:^|/)(?:tests|__tests__)/|^tests$|_test\.rs$|(?:^|/)test_[^/]*$|(?:^|/)[^/]*\.(?:spec|test)\.[^./]*$")


def word_count(text) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def without_tags(text) -> Column:
    """Tags become blanks, runs of white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def redact_emails(text) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
