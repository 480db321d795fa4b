"""Progress of streaming queries for a callback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls back with (rows so far, share of `expected`) each time another `every` rows have been read.

    Add with spark.streams.addListener(); a callback that raises stops nothing.
    """

    def __init__(self, callback: Callable[[int, float], None], expected: int, every: int = 50) -> None:
        self.callback, self.expected, self.every, self.rows, self.told = callback, max(1, expected), every, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.every:
            self.told = self.rows
            try:
                self.callback(self.rows, min(1.0, self.rows / self.expected))
            except Exception as e:  # a listener must not break its query
                print(f"progress callback failed: {e}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
