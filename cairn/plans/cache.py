"""A map whose entries expire, for results and query vectors."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable


class TtlCache:
    """At most ``size`` entries, the least recently used go first; ttl None: they never expire."""

    def __init__(self, size: int, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self._map: OrderedDict = OrderedDict()

    def __len__(self) -> int:
        return len(self._map)

    def get(self, key):
        hit = self._map.get(key)
        if hit is None:
            return None
        if self.ttl is not None and self.clock() - hit[0] > self.ttl:
            del self._map[key]
            return None
        self._map.move_to_end(key)
        return hit[1]

    def put(self, key, value) -> None:
        self._map[key] = (self.clock(), value)
        self._map.move_to_end(key)
        while len(self._map) > self.size:
            self._map.popitem(last=False)

    def clear(self) -> None:
        self._map.clear()
