"""Small helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def free_name(taken: Iterable[str], wish: str) -> str:
    """`wish`, or `wish_2`, `wish_3`, ... : the first that no column is called (case aside)."""
    names, n, name = {t.lower() for t in taken}, 1, wish
    while name.lower() in names:
        n += 1
        name = f"{wish}_{n}"
    return name


def quoted(name: str) -> str:
    """A column name for F.col, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


class Memory(dict):
    """Answers of `find` by key, of about the last `most` keys met: an older half is forgotten when a new half is full."""

    def __init__(self, find: Callable[[Any], Any], most: int, longest: int):
        super().__init__()
        self.find, self.half, self.longest, self.older = find, most // 2, longest, {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteMemory(dict):
    """Answers of `find` by key, of the last keys met: an older half is forgotten when a new half has taken its bytes.

    Keys and values are strings or bytes; each counts with what Python and the dictionary need for it.
    """

    def __init__(self, find: Callable[[Any], Any], most_bytes: int, longest: int):
        super().__init__()
        self.find, self.half, self.longest, self.older, self.room = find, most_bytes // 2, longest, {}, most_bytes // 2

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= self.longest:
            self.room -= sys.getsizeof(key) + sys.getsizeof(value) + 110
            if self.room < 0:
                self.older, self.room = dict(self), self.half
                self.clear()
            self[key] = value
        return value


def sampled_text(text: Column, most_chars: int, block_chars: int) -> Column:
    """A text of up to `most_chars` characters as it is; of a longer one that many, in blocks drawn by hash from all of it.

    The blocks stand in their order, set apart by a line break.
    """
    blocks = F.sequence(F.lit(0), F.ceil(F.length(text) / block_chars).cast("int") - 1)
    drawn = F.slice(F.array_sort(F.transform(blocks, lambda i: F.struct(F.xxhash64(i, F.length(text)).alias("draw"), i.alias("i")))), 1, most_chars // block_chars)
    places = F.array_sort(F.transform(drawn, lambda d: d["i"]))
    cut = F.array_join(F.transform(places, lambda i: F.substring(text, i * block_chars + 1, F.lit(block_chars))), "\n")
    return F.when(F.length(text) <= most_chars, text).otherwise(cut)


def held_out(id_column: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`. A row without id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % of == remainder, F.lit(False))


def kept(key: tuple, make: Callable[[], Any], family: str = "", most: int = 24) -> Any:
    """What `make` returned for `key` earlier in this process, else made now.

    Functions are sent to executors by value with their globals, so what a worker should keep from task to task
    lives in a module of its own. At most `most` things are kept, and only those of one `family` (default: the first
    part of the key): a worker that goes on to another operator lets go of what the last one needed, and gives it back to
    the system.
    """
    family = family or key[0]
    home = sys.modules.setdefault("veilframe_worker_store", types.ModuleType("veilframe_worker_store"))
    store = home.__dict__.setdefault("items", {})
    if key not in store:
        if len(store) >= most or home.__dict__.get("family") != family:
            if store:
                store.clear()
                _give_back()
            home.__dict__["family"] = family
        store[key] = make()
    return store[key]


def _give_back() -> None:
    """Memory that nothing uses returns to the system, for the executor's other processes.

    Memories of words point at their owners and these at them, so only a collection finds them, and numpy code makes too few
    objects for one to come by itself.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass
