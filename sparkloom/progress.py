"""Progress of a run on a console."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

STAGES = ("documents", "chunks", "analyses", "questions", "checked", "verdicts", "outcomes")


class Progress:
    """A bar over the stages of a run, written as each is reached; silent without a writer.

    Stages of repairs come between verdicts and outcomes and are named, but don't move the bar.
    """

    def __init__(self, write: Callable[[str], object] | None = None, width: int = 28):
        self.write, self.width, self.began, self.done = write, width, time.monotonic(), 0

    @classmethod
    def console(cls) -> "Progress":
        return cls(lambda line: print(line, file=sys.stderr, flush=True))

    def reached(self, stage: str) -> None:
        if stage in STAGES:
            self.done = max(self.done, STAGES.index(stage) + 1)
        if self.write:
            full = self.width * self.done // len(STAGES)
            self.write(f"[{'#' * full}{'.' * (self.width - full)}] {self.done}/{len(STAGES)} {stage}, {time.monotonic() - self.began:.1f} s")
