"""Elapsed time, memory and output size of an operation, as one log line."""
from __future__ import annotations

import logging
import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("corposcope")


@contextmanager
def measured(what: str) -> Iterator[dict]:
    """Log ``what`` with its duration and peak memory; the block may add 'bytes' of output to the yielded dict."""
    notes: dict = {}
    began = time.perf_counter()
    try:
        yield notes
    finally:
        if log.isEnabledFor(logging.INFO):
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
            size = f", {notes['bytes']} B, ~{(notes['bytes'] + 2) // 4} tokens" if "bytes" in notes else ""
            log.info("%s: %.1f ms, %.1f MB%s", what, (time.perf_counter() - began) * 1000, peak, size)
