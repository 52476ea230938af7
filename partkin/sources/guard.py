"""Keeping the raw folder read-only: a place is told by the file system's identity, not by its name."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

Identity = tuple[int, int]


def identity(path: str | Path) -> Identity | None:
    """Device and inode of what a path leads to, links followed; None where there is nothing."""
    try:
        found = os.stat(path)
    except (FileNotFoundError, NotADirectoryError):
        return None
    return found.st_dev, found.st_ino


def held_by(folder: str | Path) -> dict[Identity, str]:
    """The identities of a folder and of everything below it, with a name for each."""
    found = {identity(folder): str(folder)}
    for place, folders, files in os.walk(folder):
        for name in (*folders, *files):
            path = os.path.join(place, name)
            found[identity(path)] = path
    found.pop(None, None)
    return found


def places(path: str | Path) -> list[str]:
    """A path and all above it, as written and with its links resolved."""
    out: list[str] = []
    for start in (os.path.abspath(path), os.path.realpath(path)):
        while start not in out:
            out.append(start)
            start = os.path.dirname(start)
    return out


def trespass(outputs: Iterable[Path], raw_dir: Path) -> str | None:
    """Why outputs may not be written: one of them is, or lies in, something of the raw folder.

    Hard links and links at any depth count, since identities are compared. A folder that can't be
    looked through is a reason too.
    """
    if not os.path.isdir(raw_dir):
        return None
    try:
        owned = held_by(raw_dir)
        for out in outputs:
            for place in places(out):
                if (known := identity(place)) in owned:
                    return f"{out} leads to {owned[known]}, and {raw_dir} is only read"
    except OSError as problem:
        return f"{raw_dir} can't be kept safe: {problem.strerror or problem}"
    return None
