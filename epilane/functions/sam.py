"""FLAG bits, optional tags and names of alignment records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alignment format.
PAIRED = 0x1
PROPER = 0x2
UNMAPPED = 0x4
MATE_UNMAPPED = 0x8
REVERSE = 0x10
SEGMENT_FIRST = 0x40
SEGMENT_LAST = 0x80
SECONDARY = 0x100
NOT_PRIMARY = 0x900
NOT_PRIMARY_OR_UNMAPPED = 0x904


def flag(col: Column, mask: int) -> Column:
    """True where any bit of ``mask`` is set."""
    return col.bitwiseAND(F.lit(mask)) != 0


def segment(col: Column) -> Column:
    """0 for a first segment, 1 for a last one; both bits at once fail."""
    return (
        F.when(~flag(col, SEGMENT_LAST), F.lit(0))
        .when(
            flag(col, SEGMENT_FIRST),
            F.raise_error(F.lit("a record is marked as both first and last segment")).cast("int"),
        )
        .otherwise(F.lit(1))
    )


def is_pair(col: Column) -> Column:
    """Paired alignment: the template has two segments and the mate is mapped."""
    return flag(col, PAIRED) & ~flag(col, MATE_UNMAPPED)


def tag(tags: Column, name: str, required: bool = True) -> Column:
    """Text after the last colon of tag ``name``; fails or gives NULL if absent."""
    found = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit(name + ":"))), F.lit(0))
    value = F.substring_index(found, ":", -1)
    if not required:
        return value
    missing = F.raise_error(F.lit(f"no {name} tag on a record"))
    return F.coalesce(value, missing.cast("string"))


def sample_name(path: Column, keep_folder: bool = False) -> Column:
    """Sample name of a counts file: everything up to the first dot."""
    base = path if keep_folder else F.element_at(F.split(path, "/"), -1)
    return F.substring_index(base, ".", 1)


def sample_names(paths: Iterable[str]) -> list[str]:
    """Unique sample names for a list of files, in order."""
    names: list[str] = []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
        while name in names:
            name += "-"
        if name.startswith("-"):
            name = "_" + name[1:]
        names.append(name)
    return names
