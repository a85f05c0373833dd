"""Models that a worker keeps open: the least recently used one makes room before another is loaded."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable

LIMIT = 2


class ModelPool:
    def __init__(self, limit: int = LIMIT) -> None:
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
            raise ValueError(f"the limit is a whole number of at least 1, not {limit!r}")
        self.limit, self.lock = limit, threading.Lock()
        self.held: OrderedDict[str, object] = OrderedDict()

    def get(self, key: str, opener: Callable[[], object]) -> object:
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
            while len(self.held) >= self.limit:
                self.held.popitem(last=False)
            self.held[key] = opener()
            return self.held[key]

    @property
    def loaded(self) -> tuple[str, ...]:
        """Keys of the open models, the one used last at the end."""
        return tuple(self.held)

    def unload(self) -> None:
        with self.lock:
            self.held.clear()


def worker_pool(limit: int = LIMIT) -> ModelPool:
    """The pool of this Python worker; tasks that follow one another share it."""
    import builtins

    pool = builtins.__dict__.setdefault("_verbaloom_pool", ModelPool(limit))
    pool.limit = limit
    return pool
