"""Column expressions for string work that must agree with Python semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() and str.split() take every Unicode white-space character,
# SQL trim() only blanks.  The inside of a character class, for Java and RE2 alike.
BLANKS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
_STRIP_RE = rf"^[{BLANKS}]+|[{BLANKS}]+\z"

# Word tokens of the TF-IDF similarity: maximal runs of >= 2 letters, digits
# or underscores, taken from lower-cased text.
WORD_TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a string column (NULL stays NULL)."""
    return F.regexp_replace(col_(c), _STRIP_RE, "")


def split_part(c, delim: str, n: int) -> Column:
    """Python ``s.split(delim)[n-1]`` for n >= 1; '' when the piece is absent."""
    return F.split_part(col_(c), F.lit(delim), F.lit(n))


def has_piece(c, delim: str, n: int) -> Column:
    """True when ``s.split(delim)`` has at least n pieces."""
    need = n - 1
    if need <= 0:
        return col_(c).isNotNull()
    # count of occurrences >= need  <=>  length of the n-th piece's prefix exists
    occurrences = (F.length(col_(c)) - F.length(F.replace(col_(c), F.lit(delim), F.lit("")))) / len(delim)
    return occurrences >= need


def before_first(c, delim: str) -> Column:
    """Python ``s.split(delim)[0]``."""
    return split_part(c, delim, 1)


def word_tokens(c) -> Column:
    """Array of lower-cased word tokens (runs of >= 2 word characters)."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(WORD_TOKEN_RE), 0)


def common_prefix_len(a, b) -> Column:
    """Length of the longest common prefix of two strings (character wise)."""
    a, b = col_(a), col_(b)
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_diff = F.array_position(pairs, False)
    return (F.when(n == 0, F.lit(0))
            .when(first_diff == 0, n)
            .otherwise(F.least(first_diff - 1, n))).cast("int")
