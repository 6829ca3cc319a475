"""Where a project and its files lie; for the driver, not for executors."""

from __future__ import annotations

from pathlib import Path

# Files that mark a project's root, and how many folders up they are looked for.
MARKS = ("pyproject.toml", ".git")
MOST = 10


def find_root(start: str | Path, otherwise: int = 2) -> Path:
    """The nearest folder from start upwards that holds a mark; else the parent that many folders above start."""
    at = Path(start).resolve()
    above = [at, *at.parents]
    found = next((p for p in above[: MOST + 1] if any((p / m).exists() for m in MARKS)), None)
    return found or above[min(otherwise + 1, len(above) - 1)]


def resolve(path: str | Path, base: str | Path, root: str | Path) -> Path:
    """An absolute path as it is; a relative one below base if it is there, else below root."""
    p = Path(path)
    if p.is_absolute():
        return p
    return Path(base) / p if (Path(base) / p).exists() else Path(root) / p
