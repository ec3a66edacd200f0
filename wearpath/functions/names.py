"""Generated column names."""

from __future__ import annotations

import re
from collections.abc import Iterable


def numbered(prefix: str, count: int, start: int = 1) -> tuple[str, ...]:
    """``numbered("s", 3)`` -> ``("s1", "s2", "s3")``."""
    return tuple(f"{prefix}{i}" for i in range(start, start + count))


def renumbered(columns: Iterable[str], prefix: str) -> list[str]:
    """Swap the alphabetic prefix of each name: ``s7`` with prefix ``a`` -> ``a7``.

    A name without a number keeps its whole text after the prefix: ``temp`` -> ``a_temp``.
    """
    out = []
    for column in columns:
        number = re.fullmatch(r"[A-Za-z_]+(\d+)", column)
        out.append(f"{prefix}{number.group(1)}" if number else f"{prefix}_{column}")
    return out
