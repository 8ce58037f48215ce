"""Python workers serve one stage after another: what a stage leaves in them counts against the memory of the next."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What a worker keeps from task to task, by the kind of work that needs it.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """A store that stays in a worker until it takes up another kind of work."""
    return _kept.setdefault(kind, {})


def settle(kind: str = "") -> None:
    """Drop the stores of other kinds of work, and give memory that is free back to the system."""
    for name, store in _kept.items():
        if name != kind:
            store.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """go over the batches of a task, with the worker settled before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(kind)
        yield from go(batches)
        settle(kind)

    return run


def lean_group(go: Callable[[pa.Table], pa.Table], kind: str = "") -> Callable[[pa.Table], pa.Table]:
    """go over a group, with the worker settled afterwards."""

    def run(t: pa.Table) -> pa.Table:
        out = go(t)
        settle(kind)
        return out

    return run
