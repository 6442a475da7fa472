"""String column functions (STR-1..5), all JVM-side except NFKD.

Spark has no Unicode normalisation function, so ``normalize_ascii`` is the
one Arrow UDF of the library; everything else is built from built-in
expressions and stays inside whole-stage codegen.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns.
# White space at either end, Unicode-aware (Python's str.strip semantics).
STRIP_PATTERN = r"(?U)^\s+|\s+$"
# Marker put after each non-letter for title case (two private-use characters).
TITLE_MARK = "\ue000\ue001"
NON_ASCII = r"[^\x00-\x7F]"


def strip(c: Column) -> Column:
    """STR-1: remove Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def title_case(c: Column) -> Column:
    """STR-3: capital letter after every non-letter, the rest lower case.

    ``initcap`` capitalises after spaces only, so every non-letter is first
    followed by a private-use marker and a space, ``initcap`` runs, and the
    markers are removed again.  Checked equal to Python's ``str.title`` on
    every document of the test tables.
    """
    marked = F.regexp_replace(c, r"(\P{L})", "$1" + TITLE_MARK + " ")
    return F.regexp_replace(F.initcap(marked), TITLE_MARK + " ", "")


@F.arrow_udf(T.StringType())
def _nfkd_ascii(texts: pa.Array) -> pa.Array:
    # a slice of about a megabyte at a time: as Python strings, in all their forms, a whole
    # batch takes many times its own room; ASCII slices are their own result
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    parts, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
        part = texts.slice(i, j - i)
        if not pc.all(pc.string_is_ascii(part), min_count=0).as_py():
            part = pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
                             for t in part.to_pylist()], pa.string())
        parts.append(part.cast(pa.string()))
        i = j
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalize_ascii(c: Column) -> Column:
    """STR-5: Unicode NFKD decomposition, then drop every non-ASCII character."""
    return _nfkd_ascii(c)


def literal_pattern(text: str, case_insensitive: bool = False) -> str:
    """A regex matching ``text`` literally (Java ``\\Q..\\E`` quoting)."""
    body = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return ("(?i)" if case_insensitive else "") + body


def java_replacement(text: str) -> str:
    """A replacement with back-references ``\\1`` as the regex engine writes them (``$1``)."""
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", "\\$"))


def replace_text(c: Column, pattern: str, replacement: str = "", regex: bool = True,
                 case_insensitive: bool = False) -> Column:
    """STR-4: regex or literal replacement, optional ignore-case."""
    if not regex and not case_insensitive:
        return F.replace(c, F.lit(pattern), F.lit(replacement))
    pat = pattern if regex else literal_pattern(pattern)
    if case_insensitive and regex:
        pat = "(?i)" + pat
    elif case_insensitive:
        pat = literal_pattern(pattern, True)
    java_repl = java_replacement(replacement) if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, pat, java_repl)


STRING_OPERATIONS = {
    "strip": strip,
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "normalize": normalize_ascii,
}
