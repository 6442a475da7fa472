"""Date parsing helpers (DAT-1).

``try_to_timestamp`` returns NULL for text that does not parse (no error
under ANSI mode).  Its result is the zoned ``timestamp`` type; it is cast to
``timestamp_ntz`` so parsed columns have the same type as the tables' own
wall-clock timestamps (the session time zone is UTC).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime directives and the Spark datetime patterns they mean.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh",
    "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%z": "Z", "%Z": "z", "%%": "%",
}


def strftime_to_spark(fmt: str) -> str:
    """Translate a strftime format into a Spark datetime pattern.

    Literal text is quoted so letters are not read as pattern symbols.
    """
    out, i = [], 0
    literal = []

    def flush():
        if literal:
            text = "".join(literal).replace("'", "''")
            out.append(f"'{text}'" if re.search(r"[A-Za-z]", text) else text)
            literal.clear()

    while i < len(fmt):
        two = fmt[i:i + 2]
        if two in STRFTIME_TO_SPARK:
            flush()
            out.append(STRFTIME_TO_SPARK[two])
            i += 2
        else:
            literal.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


def parse_timestamp(c: Column, fmt: str | None = None) -> Column:
    """Text to ``timestamp_ntz``; unparsable text gives NULL."""
    if fmt is None:
        parsed = F.try_to_timestamp(c)
    else:
        pattern = strftime_to_spark(fmt) if "%" in fmt else fmt
        parsed = F.try_to_timestamp(c, F.lit(pattern))
    return parsed.cast("timestamp_ntz")


def format_timestamp(c: Column, fmt: str) -> Column:
    pattern = strftime_to_spark(fmt) if "%" in fmt else fmt
    return F.date_format(c, pattern)
