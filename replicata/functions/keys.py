"""Key forms, subsets and the reduced form of structures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_form(c: Column) -> Column:
    """Letters and digits of ``c`` in lower case; null for null and for values without any."""
    k = F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))
    return F.when(F.length(k) > 0, k)


def subset_form(c: Column) -> Column:
    """``train``, ``valid`` or ``test`` without surrounding blanks and letter case; null for anything else."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(s.isin("train", "valid", "test"), s)


def structure_form(c: Column) -> Column:
    """``c`` without white space, ``@``, ``/`` and ``\\``, and of its dot-separated pieces the (first) longest; null if empty."""
    pieces = F.split(F.regexp_replace(c, r"(?U)[\s@/\\]", ""), r"\.")
    longest = F.reduce(pieces, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.length(longest) > 0, longest)


def hash60(*c: Column) -> Column:
    """A number in [0, 2^60) that depends on the values' texts alone, the same in any engine that has MD5; nulls are passed over."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", *[x.cast("string") for x in c])), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
