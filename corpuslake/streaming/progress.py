"""What a stream is doing, published by a listener."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls ``publish(state, **more)`` for the streams named ``name``: ``started``, ``running`` (batch, rows, seconds), ``waiting``, ``stopped`` or ``error`` (error_message).

    Events come behind the stream, on a thread of their own; nothing is computed for them. What ``publish`` raises is not let out.
    """

    def __init__(self, name: str, publish: Callable[..., None]):
        self.name, self._publish, self._ids = name, publish, set()

    def _say(self, state: str, **more) -> None:
        try:
            self._publish(state, **more)
        except Exception as error:  # a listener must not stop the stream
            print(f"{self.name}: its state could not be published: {error}")

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._ids.add(str(event.id))
            self._say("started")

    def onQueryProgress(self, event) -> None:
        found = event.progress
        if str(found.id) in self._ids:
            self._say("running", batch=found.batchId, rows=found.numInputRows, seconds=round(found.batchDuration / 1000, 3))

    def onQueryIdle(self, event) -> None:
        if str(event.id) in self._ids:
            self._say("waiting")

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self._ids:
            self._say(**{"state": "error", "error_message": event.exception} if event.exception else {"state": "stopped"})

