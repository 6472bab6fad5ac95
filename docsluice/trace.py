"""Spans of the control plane: names, attributes, events and durations, given to a sink that may fail.

A sink is a function of finished spans (dicts). What it raises is logged and goes no further: work never stops for
want of a trace.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

log = logging.getLogger(__name__)
Sink = Callable[[list[dict]], None]


class Tracer:
    """Collects spans and hands them to the sink, `batch` at a time and on `flush`; without a sink they are let go."""

    def __init__(self, sink: Sink | None = None, batch: int = 1):
        self.sink, self.batch, self._ended, self._open, self._lock = sink, batch, [], threading.local(), threading.Lock()

    @contextmanager
    def span(self, name: str, **attributes) -> Iterator[dict]:
        """A span around a block; its parent is the span open in this thread. An error marks it and is raised."""
        above = getattr(self._open, "span", None)
        span = {"name": name, "parent": above and above["name"], "attributes": {k: v for k, v in attributes.items() if v is not None}, "events": [], "ok": True, "error": None}
        self._open.span, began = span, time.perf_counter()
        try:
            yield span
        except BaseException as e:
            span["ok"], span["error"] = False, f"{type(e).__name__}: {e}"
            raise
        finally:
            self._open.span = above
            span["duration_ms"] = int(1000 * (time.perf_counter() - began))
            with self._lock:
                self._ended.append(span)
                full = len(self._ended) >= self.batch
            if full:
                self.flush()

    def set(self, **attributes) -> None:
        """Attributes of the span that is open in this thread, if one is; nulls are left out."""
        if (span := getattr(self._open, "span", None)) is not None:
            span["attributes"].update({k: v for k, v in attributes.items() if v is not None})

    def event(self, name: str, **attributes) -> None:
        if (span := getattr(self._open, "span", None)) is not None:
            span["events"].append({"name": name, "attributes": attributes})

    def flush(self) -> bool:
        """True unless the sink failed; spans it failed on are not given again."""
        with self._lock:
            ended, self._ended = self._ended, []
        if not ended or self.sink is None:
            return True
        try:
            self.sink(ended)
        except Exception as e:
            log.warning("%d spans could not be exported: %s", len(ended), e)
            return False
        return True
