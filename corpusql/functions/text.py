"""Text helpers with Python ``str`` semantics, as native Spark expressions.

Java regexes treat ``\\s`` as ASCII unless ``(?U)`` is set; Python's
``str.split``/``str.strip`` use Unicode white space (plus the ASCII
separators 0x1c-0x1f). ``WS`` is that class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x{1c}-\x{1f}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: Unicode white space at both ends."""
    return F.regexp_replace(_c(c), rf"(?U)^{WS}+|{WS}+$", "")



def collapse_ws(c) -> Column:
    """``re.sub(r"\\s+", " ", s)`` on ``str``."""
    return F.regexp_replace(_c(c), rf"(?U){WS}+", " ")


def word_count(c) -> Column:
    """``len(s.split())``: white-space runs separate words; empty -> 0."""
    parts = F.split(_c(c), rf"(?U){WS}+")
    return F.size(F.filter(parts, lambda x: x != ""))


def hash_draw(*parts) -> Column:
    """Deterministic 48-bit integer from md5 of ``parts`` joined by ':'.

    DuckDB form of the same value: ``cast('0x' || substr(md5(x), 1, 12) as bigint)``.
    """
    key = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")


def hash_key(*parts) -> Column:
    """md5 hex of ``parts`` joined by ':' (a string sort key)."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))
