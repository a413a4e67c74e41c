"""Python workers live on after their task, for later stages: what a task no longer needs goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa

#: Values that are turned into Python objects and worked on at a time.
PART = 500


def give_back() -> None:
    """Return freed memory of Arrow and of the C library; where that library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def by_parts(batches: Iterator[pd.Series], work: Callable[[list], list], dtype: Any = object) -> Iterator[pd.Series]:
    """``work`` applied to ``PART`` values of the batches at a time; memory goes back once a batch is done."""
    for batch in batches:
        out: list = []
        for at in range(0, len(batch), PART):
            out += work(batch.iloc[at : at + PART].tolist())
        yield pd.Series(out, dtype=dtype)
        del batch, out
        give_back()


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches; memory goes back when it ends."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run
