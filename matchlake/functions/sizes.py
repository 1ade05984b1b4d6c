"""Sizes: shard size texts, the tar size model, and readable byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each unit.
UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def parse_size(text: Column) -> Column:
    """Bytes of texts such as '500MB', '1 GiB' or '42'; null for an unknown unit or less than 1."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^(\d+)\s*([A-Z]*)$", 1).try_cast("long")
    unit = F.regexp_extract(clean, r"^(\d+)\s*([A-Z]*)$", 2)
    factor = F.when(unit == "", F.lit(1))
    for name, size in UNITS.items():
        factor = factor.when(unit == name, F.lit(size).cast("long"))
    return F.when(number >= 1, number * factor)


def tar_member(size: Column) -> Column:
    """Bytes of a member in a tar file: a 512-byte header and the content in blocks of 512."""
    return 512 + F.ceil(size / 512) * 512


def tar_file(members: Column) -> Column:
    """Bytes of a tar file: its members, 1024 at the end, rounded up to 10240."""
    return F.ceil((members + 1024) / 10240) * 10240


def human_size(size: Column) -> Column:
    """'1.5 MB' by powers of 1024."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    text = F.concat(F.format_string("%.1f", size / 1024.0 ** (len(units) - 1)), F.lit(f" {units[-1]}"))
    for k in range(len(units) - 2, -1, -1):
        text = F.when(size < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", size / 1024.0**k), F.lit(f" {units[k]}"))).otherwise(text)
    return text
