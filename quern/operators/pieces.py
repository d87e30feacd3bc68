"""Batches of long rows in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Rows of pages or documents whose results a task holds at once.
ROWS = 256


def pieces(batches: Iterator[pd.DataFrame], rows: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows of batches, few at a time: what a task makes of a batch is handed on piece by piece, so that its memory
    doesn't grow with the batch. A batch without rows is left out."""
    rows = rows or ROWS
    for b in batches:
        for low in range(0, len(b), rows):
            yield b.iloc[low : low + rows]
