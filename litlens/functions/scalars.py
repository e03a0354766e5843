"""Column functions (no UDFs): dates, token estimates, answer clean-up,
JSON text, wide label column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and name patterns the labels and reports are read with.
DATE_FORMAT = "d-M-yyyy"                       # day-month-year as in the paper records
DATE_SHAPE = r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"  # only this shape is a date
WIDE_PREFIX = "como-tax-"                      # wide label column: como-tax-<category>2[-<run>]
WIDE_KEY = r"^como-tax-(.*?)2(?:-([0-9]+))?$"
COLUMN_ALIASES = {"openess": "openness"}       # spelling of a column name -> category
CHARS_PER_TOKEN = 4                            # approximate tokens = characters // 4
# Characters Python's str.strip() removes, derived from Python itself
# (Unicode white space plus U+001C..U+001F; 29 code points).
STRIP_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pub_year(date_col) -> Column:
    """Year of a ``dd-mm-yyyy`` string; anything else (or an impossible date) is NULL."""
    c = _c(date_col)
    return F.when(c.rlike(DATE_SHAPE),
                  F.year(F.try_to_timestamp(c, F.lit(DATE_FORMAT)))).cast("int")


def decade(year_col, width: int = 10) -> Column:
    """Start year of the ``width``-year bucket holding ``year``."""
    y = _c(year_col)
    return (F.floor(y / width) * width).cast("int")


def approx_tokens(text_col) -> Column:
    """Approximate token count: code points // 4."""
    return F.floor(F.length(_c(text_col)) / CHARS_PER_TOKEN).cast("long")


def py_strip(text_col) -> Column:
    """Strip leading/trailing white space the way Python's ``str.strip()`` does
    (``btrim`` with Python's white-space set: no regular expression)."""
    return F.btrim(_c(text_col), F.lit(STRIP_CHARS))


def json_string(text_col) -> Column:
    """A string as a JSON literal (quotes included), NULL as ``null``.

    Same escapes and length as Python ``json.dumps(..., ensure_ascii=False)``;
    control characters without a short escape come out as ``\\u00XX`` with
    upper-case hex (Python writes lower case), which does not change lengths.
    """
    c = _c(text_col)
    body = F.to_json(F.array(c))  # ["..."] with JSON escapes
    return F.when(c.isNull(), F.lit("null")).otherwise(
        F.substring(body, F.lit(2), F.length(body) - 2))


def entry_json(fields: list[tuple[str, Column]]) -> Column:
    """A record as JSON text with two-space indent, keys in the given order,
    nulls kept, non-ASCII kept (the ``json.dumps(indent=2)`` layout)."""
    parts = [F.lit("{\n")]
    for i, (name, col) in enumerate(fields):
        sep = ",\n" if i < len(fields) - 1 else "\n"
        parts += [F.lit(f'  "{name}": '), json_string(col), F.lit(sep)]
    parts.append(F.lit("}"))
    return F.concat(*parts)


# characters JSON writes as a two-character escape, and the other control
# characters (written as six-character \\u00XX escapes)
_SHORT_ESC = '"\\\n\r\t\b\f'
_LONG_ESC = "".join(chr(i) for i in range(0x20) if chr(i) not in "\n\r\t\b\f")


def json_text_length(text_col) -> Column:
    """Length of :func:`json_string` without building it (``translate``
    deletes the escaped characters; the length difference counts them)."""
    c = _c(text_col)
    n = F.length(c)
    short = n - F.length(F.translate(c, _SHORT_ESC, ""))
    ctrl = n - F.length(F.translate(c, _LONG_ESC, ""))
    return F.when(c.isNull(), F.lit(4)).otherwise(n + short + 5 * ctrl + 2)


def wide_key(category, run) -> Column:
    """Wide label column name of (category, run): run 1 is the base column."""
    cat, r = _c(category), _c(run)
    return F.concat(F.lit(WIDE_PREFIX), cat, F.lit("2"),
                    F.when(r > 1, F.concat(F.lit("-"), r.cast("string"))).otherwise(F.lit("")))


def key_category(key_col) -> Column:
    """Category of a wide label column name (prefix and trailing ``2`` removed),
    under the name its vocabulary has."""
    name = F.regexp_extract(_c(key_col), WIDE_KEY, 1)
    for old, new in COLUMN_ALIASES.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    return name


def key_run(key_col) -> Column:
    """Run of a wide label column name: the ``-n`` suffix, or 1 for the base column."""
    r = F.regexp_extract(_c(key_col), WIDE_KEY, 2)
    return F.when(r == "", F.lit(1)).otherwise(r.cast("int"))
