"""Results kept within a Python worker, across its tasks, in bounded space."""

from __future__ import annotations

from collections.abc import Callable, Iterable

_kept: dict = {}


def once_per_worker(key, make: Callable):
    """`make()`, or what it gave before in this worker."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


class Recent:
    """A table of at most about two times `limit` entries that forgets what was not used lately."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def settle(self, keys: Iterable, compute: Callable[[list], list]) -> dict:
        """A table with all of `keys`; those not known are computed together. Valid until the next call."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old, unknown = self.new, self.old, []
        for k in keys:
            if k not in new:
                value = old.get(k)
                if value is None:
                    unknown.append(k)
                else:
                    new[k] = value
        if unknown:
            new.update(zip(unknown, compute(unknown)))
        return new
