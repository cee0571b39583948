"""Paths as people read them."""

from __future__ import annotations

import os


def display_path(path: str, base: str | None = None) -> str:
    """A path below ``base`` (the current folder, if none) relative to it, one below the home folder with ``~``, any other as it is."""
    try:
        whole, start = os.path.abspath(path), os.path.abspath(base or os.getcwd())
        if os.path.commonpath([whole, start]) == start:
            return os.path.relpath(whole, start)
    except (OSError, ValueError):
        return path
    home = os.path.expanduser("~")
    if home not in ("~", os.sep) and whole.startswith(home.rstrip(os.sep) + os.sep):
        return "~" + whole[len(home.rstrip(os.sep)) :]
    return whole
