"""Memory of Python workers."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle

# Tasks get this code with the function, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Batches of fewer bytes are not worth the call.
GIVE_BACK_BYTES = 1 << 18


def give_back() -> None:
    """What a batch took and no longer needs goes back to the system; else the allocators of a worker keep it, more with every batch."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
