"""Accumulated wall-clock seconds by label."""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager


class Timers:
    def __init__(self) -> None:
        self.seconds: dict[str, float] = defaultdict(float)
        self._began: dict[str, float] = {}

    @contextmanager
    def run(self, label: str):
        self.up(label)
        try:
            yield
        finally:
            self.down(label)

    def up(self, label: str) -> None:
        self._began[label] = time.perf_counter()

    def down(self, label: str) -> None:
        self.seconds[label] += time.perf_counter() - self._began.pop(label)

    def stats(self) -> list[tuple[str, float]]:
        return sorted(self.seconds.items(), key=lambda x: -x[1])
