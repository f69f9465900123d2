"""Texts of a batch cut at blanks, with every distinct stretch named once.

What depends on a stretch alone (ids, hashes) is then found once for each distinct one of a portion of
texts and handed back to the texts by Arrow's take, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import PORTION


def portions(texts: list[bytes], size: int = PORTION) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of ``size`` bytes together, or of one longer text."""
    low = held = 0
    for k, t in enumerate(texts):
        if k > low and held + len(t) > size:
            yield low, k
            low, held = k, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


@dataclass
class Stretches:
    """``distinct`` stretches (each begins with a blank), which of them each stretch ``is``, and the ``first`` stretch of every text (one more at the end)."""

    distinct: pa.LargeBinaryArray
    which: pa.Array
    first: np.ndarray

    def texts(self) -> list[bytes]:
        """The distinct stretches without their blank, if they hold no other one."""
        return bytes(self.distinct.buffers()[2] or b"").split(b" ")[1:]

    def gather(self, values: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
        """The values of all stretches in order, and where those of each text begin (one more at the end)."""
        taken = values.take(self.which)
        offsets = np.frombuffer(taken.buffers()[1], np.int64)
        return memoryview(taken.buffers()[2] or b""), offsets[self.first]


def cut(texts: list[bytes], runs: bool = False, fold: bytes | None = None) -> Stretches:
    """Cut texts before every blank, or with ``runs`` before every run of them; a blank is put before each text.

    ``fold`` is a table for bytes.translate, applied first.
    """
    data = b" " + b" ".join(texts) if texts else b""
    if fold is not None:
        data = data.translate(fold)
    raw = np.frombuffer(data, np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    here = raw == 32
    if runs:
        here[1:] &= raw[:-1] != 32
        here[begins[:-1]] = True
    cuts = np.append(np.flatnonzero(here), len(raw)).astype(np.int64)
    all_of_them = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    named = all_of_them.dictionary_encode()
    return Stretches(named.dictionary, named.indices, np.searchsorted(cuts, begins))


def binary(values: np.ndarray, counts: np.ndarray) -> pa.LargeBinaryArray:
    """Runs of ``counts`` fixed-size values each as binary values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
