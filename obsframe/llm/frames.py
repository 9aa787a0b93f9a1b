"""Names for columns an operator adds for itself."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, lengthened until none is a column already (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
