"""The written score of one text, for code that runs on the driver or in a task."""

from __future__ import annotations

import re

from ..functions.text import SCORE

_WRITTEN = re.compile(f"{SCORE}([1-5])", re.I)


def written_score(text: str) -> int | None:
    """The last ``Score: n``; None if there is none."""
    hits = _WRITTEN.findall(text)
    return int(hits[-1]) if hits else None
