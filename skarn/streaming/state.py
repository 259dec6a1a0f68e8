"""The life of a workspace's index, and who is told about it."""

from __future__ import annotations

import enum
import logging
from collections.abc import Callable


class State(enum.IntEnum):
    NOT_STARTED = 0
    LOADING_CACHE = 1
    INDEXING = 2
    READY = 3


class Lifecycle:
    """Holds the state; listeners hear of every change, and one that fails does not stop the others."""

    def __init__(self):
        self.state = State.NOT_STARTED
        self.listeners: list[Callable[[State, State], None]] = []

    def to(self, new: State) -> None:
        if new == self.state:
            return
        old, self.state = self.state, new
        for f in self.listeners:
            try:
                f(old, new)
            except Exception:
                logging.getLogger(__name__).exception("a listener failed")
