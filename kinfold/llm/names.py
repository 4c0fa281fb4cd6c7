"""Column names of an operator's own that no column of the caller's table has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each led by as many underscores as it takes to differ from ``taken`` and each other.

    Case does not tell names apart, as it does not in Spark.
    """
    known = {name.lower() for name in taken}
    drawn = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        drawn.append(name)
    return drawn
