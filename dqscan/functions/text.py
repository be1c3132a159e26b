"""Column expressions for text cells: trimming, case, missing kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, and a word character as its \w.
WS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]"
WORD = r"[\p{L}\p{N}_]"

#: Cells that a file reader turns into null, exactly as written (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def cell_text(c: Column, kind: str) -> Column:
    """A typed cell as text. Doubles below 1e7 read the same in Spark and Python; larger ones are spelled out."""
    if kind in ("double", "float"):
        plain = F.regexp_replace(F.format_string("%.17g", c.cast("double")), r"^(-?\d+)$", "$1.0")
        return F.when(F.abs(c) < 1e7, c.cast("string")).otherwise(F.when(c.isNotNull(), F.coalesce(c.cast("decimal(38,10)").cast("double").cast("decimal(38,1)").cast("string"), plain)))
    return c.cast("string")


def clean(c: Column) -> Column:
    """The stripped cell; null where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def collapsed(c: Column) -> Column:
    """For comparing rows that differ in spelling alone: stripped, lowered, blanks collapsed, then punctuation dropped. Null is empty."""
    t = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), f"{WS}+", " ")
    return F.regexp_replace(t, r"[^\p{L}\p{N}_\s\p{Z}@.]", "")


def token_print(c: Column) -> Column:
    """The sorted tokens of a cell: word order, case and punctuation don't count. Null is empty."""
    t = F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_\s\p{Z}]", "")
    return F.array_join(F.array_sort(F.array_remove(F.split(t, f"{WS}+"), "")), " ")


def edit_text(c: Column) -> Column:
    """A cell for edit distances; a null reads `nan`."""
    return F.coalesce(F.lower(strip(c)), F.lit("nan"))
