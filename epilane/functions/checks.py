"""Argument validation."""

from __future__ import annotations


def check_range(value, lo=None, hi=None, kind=int, name="value"):
    """Parse ``value`` as ``kind`` and require ``lo <= value <= hi``."""
    try:
        parsed = kind(value)
    except (TypeError, ValueError):
        raise ValueError(f"cannot convert {name}={value!r} to {kind.__name__}") from None
    if lo is not None and parsed < lo:
        raise ValueError(f"{name}={parsed} is below {lo}")
    if hi is not None and parsed > hi:
        raise ValueError(f"{name}={parsed} is above {hi}")
    return parsed
