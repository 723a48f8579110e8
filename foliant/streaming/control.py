"""What goes on in a walk, and messages to it.

Messages are numbered files in the index's folder, so any application may send them. A stream that indexes reads them between its
micro-batches, in order, and writes an answer for each under the same number, once: a number is taken by whoever writes it first. A batch that
a message keeps from beginning isn't lost: its offsets aren't committed, so the next start of the stream begins with it.
"""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql.streaming import StreamingQueryListener

from foliant.operators.index import Index
from foliant.operators.versions import Numbered

MESSAGES = {
    "pause": "begin no further batch until resume or quit",
    "resume": "go on",
    "save": "merge all runs into one now",
    "quit": "end after what was done; a later start goes on from there",
}


class Stopped(RuntimeError):
    """A stream was told to quit."""


class Control:
    """The messages to those who index into one index, and their answers."""

    def __init__(self, index: Index, wait: float = 0.2):
        self.index, self.wait = index, wait
        self.sent, self.answers = Numbered(index.store, "control", "message"), Numbered(index.store, "control", "answer")

    def send(self, message: str) -> int:
        """The number of the message, by which it is answered."""
        if message not in MESSAGES:
            raise ValueError(f"{message}: one of {', '.join(MESSAGES)}")
        while True:
            number = self.sent.last()[0] + 1
            if self.sent.put(number, {"message": message, "at": time.time()}):
                return number

    def answer(self, number: int) -> dict | None:
        """When a message was done, and before which batch; None until then."""
        return self.answers.read(number)

    def open(self) -> list[int]:
        """Messages without an answer."""
        return sorted(set(self.sent.numbers()) - set(self.answers.numbers()))

    def between(self, batch: int) -> None:
        """Do what there are messages for, before a batch begins. Stopped if it must not begin."""
        held = False
        while True:
            for number in self.open():
                message = self.sent.read(number)["message"]
                if not self.answers.put(number, {"message": message, "batch": batch, "at": time.time()}):
                    continue  # another one does it
                if message == "save":
                    self.index.compact()
                elif message == "quit":
                    raise Stopped(f"told to quit before batch {batch}")
                else:
                    held = message == "pause"
            if not held:
                return
            time.sleep(self.wait)


class Progress(StreamingQueryListener):
    """The last figures of each stream of a session: batch, rows, rows a second, seconds by phase, and what waits in its sources."""

    KEPT = 100

    def __init__(self):
        self.batches: deque[dict] = deque(maxlen=self.KEPT)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(event.name, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        waiting = sum(int((s.metrics or {}).get("numFilesOutstanding", 0)) for s in p.sources)
        self.batches.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "milliseconds": dict(p.durationMs), "waiting": waiting})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def of(self, name: str) -> list[dict]:
        return [b for b in self.batches if b["name"] == name]
