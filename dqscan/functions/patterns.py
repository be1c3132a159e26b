"""Ordered tables of formats, and the expressions over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_STANDARD = "(non-standard)"

#: Formats in the order they are tried, as (pattern, label); results must carry these labels (fixed values).
DATE = (
    (r"^\d{4}-\d{2}-\d{2}$", "YYYY-MM-DD"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/DD/YYYY"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/D/YYYY"),
    (r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$", "Mon DD, YYYY"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "DD-Mon-YYYY"),
    (r"^\d{4}/\d{2}/\d{2}$", "YYYY/MM/DD"),
    (r"^\d{4}\.\d{2}\.\d{2}$", "YYYY.MM.DD"),
    (r"^\d{2}-\d{2}-\d{4}$", "MM-DD-YYYY"),
)
PHONE = (
    (r"^\(\d{3}\)\s?\d{3}-\d{4}$", "(XXX) XXX-XXXX"),
    (r"^\d{3}-\d{3}-\d{4}$", "XXX-XXX-XXXX"),
    (r"^\d{10}$", "XXXXXXXXXX"),
    (r"^\d{3}\.\d{3}\.\d{4}$", "XXX.XXX.XXXX"),
    (r"^\d{3}\s\d{3}\s\d{4}$", "XXX XXX XXXX"),
    (r"^\+?1-?\d{3}-\d{3}-\d{4}$", "+1-XXX-XXX-XXXX"),
    (r"^\(\d{3}\)\d{7}$", "(XXX)XXXXXXX"),
)
CURRENCY = (
    (r"^\$[\d,]+\.\d{2}$", "$X,XXX.XX"),
    (r"^\$[\d,]+$", "$X,XXX"),
    (r"^[\d,]+\.\d{2}$", "X,XXX.XX (no symbol)"),
    (r"^[\d,]+$", "X,XXX (bare number)"),
    (r"^\$-?[\d,]+\.\d{2}\s*(USD)?$", "$X,XXX.XX USD"),
)
FORMATS = {"date": DATE, "phone": PHONE, "currency": CURRENCY}
#: What addresses, placeholders, codes in names and ids look like (fixed values).
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PLACEHOLDER = r"^(test|n/?a|null|none|tbd|xxx+|placeholder|default|dummy|sample|todo|temp|unknown|undefined|blank|\.+|0{3,}|-+)$"
CODE_IN_NAME = r"^[A-Z]{2,}-\d+|^(?i:REF-)"
CODED_ID = r"^[A-Za-z]+-\d+$"
BARE_ID = r"^\d+$"


def spread(pattern: str) -> str:
    """A pattern for Java with Python's reach: digits, word characters and white space of all scripts."""
    reach = {"d": r"\p{Nd}", "w": r"\p{L}\p{N}_", "s": r"\s\p{Z}\x0B\x1C-\x1F\x{85}"}
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1 : i + 2].lower() in reach:
            body = reach[pattern[i + 1].lower()]
            out.append(f"[^{body}]" if pattern[i + 1].isupper() else body if inside else f"[{body}]")
            i += 2
            continue
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(spread(pattern))


def format_label(c: Column, kind: str) -> Column:
    """The first format of a kind that fits a stripped cell."""
    return reduce(lambda rest, f: F.when(matches(c, f[0]), f[1]).otherwise(rest), reversed(FORMATS[kind]), F.lit(NON_STANDARD))


def is_placeholder(c: Column) -> Column:
    return c.rlike("(?i)" + PLACEHOLDER)


#: Words in a column's name that give its type away, in the order they are asked (fixed values).
NAME_HINTS = (
    ("date", ("date", "time", "created", "updated", "ship", "join", "birth", "dob")),
    ("phone", ("phone", "fax", "mobile", "cell", "tel")),
    ("email", ("email", "mail")),
    ("currency", ("price", "amount", "balance", "cost", "fee", "total", "revenue", "salary")),
    ("zipcode", ("zip", "postal")),
    ("id", ("id", "code", "key", "sku", "ref", "number")),
    ("name", ("first", "last", "name", "fname", "lname")),
    ("categorical", ("status", "state", "type", "category", "flag")),
    ("freetext", ("note", "comment", "desc", "remark", "memo")),
)


def type_by_name(name: str) -> str | None:
    flat = name.lower().replace("_", "").replace(" ", "")
    return next((kind for kind, hints in NAME_HINTS if any(h in flat for h in hints)), None)
