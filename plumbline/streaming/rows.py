"""Row-at-a-time delivery of results: a bounded part of the result is on the driver at any time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row


def fetch_stream(df: DataFrame, prefetch: bool = False) -> Iterator[Row]:
    """Rows partition by partition, each fetched when the last is used up."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


class Cursor:
    """DECLARE / FETCH / CLOSE over a streamed result."""

    def __init__(self, df: DataFrame):
        self._rows: Iterator[Row] | None = fetch_stream(df)

    def fetch(self, n: int = 1) -> list[Row]:
        if self._rows is None:
            raise ValueError("the cursor is closed")
        out = []
        for row in self._rows:
            out.append(row)
            if len(out) == n:
                break
        return out

    def close(self) -> None:
        self._rows = None
