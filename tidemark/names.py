"""Names that go into statements."""

from __future__ import annotations

import re

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def plain_name(name: str | None) -> str:
    """The name itself if it is a plain one; others are refused."""
    if not _NAME.fullmatch(name or ""):
        raise ValueError(f"not a plain name: {name!r}")
    return name
