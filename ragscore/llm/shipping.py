"""Sending a fitted model to the executors: pickled once, unpickled and prepared once per process."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_ready: dict[str, Any] = {}


def shipped(model: Any, prepare: Callable[[Any], Any] = lambda m: m) -> Callable[[], Any]:
    """A function that gives the prepared model; models are bounded by their parameters, not by the data."""
    blob, key = pickle.dumps(model), uuid.uuid4().hex

    def get() -> Any:
        from ragscore.llm.shipping import held  # by name, so that the process's own table is used

        return held(key, lambda: prepare(pickle.loads(blob)))

    return get


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, held by the process until it is asked for another: one model at a time, as tables grow with use."""
    if key not in _ready:
        _ready.clear()
        give_back()
        _ready[key] = make()
    return _ready[key]


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
