"""Arrow batches in small slices, so that a Python worker holds few texts at a time."""

from __future__ import annotations

ROWS = 1000


def small(batches, rows: int = ROWS):
    """The rows of the batches, at most ``rows`` at a time; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
