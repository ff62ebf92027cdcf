"""How far a job has come, and resources that steps share."""

from __future__ import annotations

import logging
from collections.abc import Callable

log = logging.getLogger("corpusmill")


class Progress:
    """Says how far a job of `total` steps has come, every twentieth of it; nothing if quiet. A step's own tasks are
    shown by Spark."""

    def __init__(self, name: str, total: int, quiet: bool = False, tell: Callable[[str], None] = log.info):
        self.name, self.total, self.quiet, self.tell, self.done, self._said = name, total, quiet, tell, 0, -1

    def add(self, n: int = 1) -> None:
        self.done += n
        share = 100 if self.total <= 0 else min(100, 100 * self.done // self.total)
        if not self.quiet and share // 5 > self._said:
            self._said = share // 5
            self.tell(f"{self.name}: {self.done} of {self.total} ({share} %)")


class Shared:
    """A resource that is opened by the first user and closed by the last."""

    def __init__(self, start: Callable, stop: Callable = lambda x: None):
        self._start, self._stop, self._users, self._value = start, stop, 0, None

    def __enter__(self):
        if not self._users:
            self._value = self._start()
        self._users += 1
        return self._value

    def __exit__(self, *_):
        self._users -= 1
        if not self._users:
            value, self._value = self._value, None
            self._stop(value)
