"""White space and record pointers, as JVM column expressions with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, in a spelling that Java's and RE2's regular expressions share.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_ENDS = rf"^{SPACE}+|{SPACE}+$"


def strip(c: Column) -> Column:
    """The text without white space at its ends; null stays null."""
    return F.regexp_replace(c, _ENDS, "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text; never null."""
    return c.isNull() | (strip(c) == "")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '{_ENDS}', '', 'g')"


def pointer_key(pointer: Column, table: str) -> Column:
    """The key of a record pointer to ``table``; null where the text is no pointer to it.

    Outer blanks are dropped, the part before the first colon is compared with ``table`` without
    case, one enclosing pair of angle brackets or backticks is dropped from the key. A key that is
    then empty names no record, so such a text is no pointer.
    """
    p = strip(pointer)
    colon = F.instr(p, ":")
    key = F.substr(p, colon + 1)
    marks = F.concat(F.left(key, F.lit(1)), F.right(key, F.lit(1)))
    paired = (F.char_length(key) >= 2) & marks.isin("⟨⟩", "``")
    bare = F.when(paired, F.substr(key, F.lit(2), F.char_length(key) - 2)).otherwise(key)
    return F.when((colon > 0) & (F.lower(F.left(p, colon - 1)) == table.lower()) & (bare != ""), bare)


def pointer_key_sql(pointer: str, table: str) -> str:
    """The same, written from the definition of pointers and not from the expression above: one pattern per way to enclose a key."""
    # RE2's group is the whole key, as the pattern takes the first colon; (?s) lets a key hold line breaks
    whole = f"regexp_extract({pointer}, '(?is)^{SPACE}*{table}:(.*?){SPACE}*$', 1)"
    return f"nullif(regexp_replace(regexp_replace({whole}, '(?s)^⟨(.*)⟩$', '\\1'), '(?s)^`(.*)`$', case when {whole} like '⟨%⟩' then '`\\1`' else '\\1' end), '')"
