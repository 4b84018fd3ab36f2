"""Multikey quicksort of suffixes, eight bytes a key, over a bucket held in memory."""

from __future__ import annotations

import numpy as np


def equal_classes(text: np.ndarray, at: np.ndarray, length: int, start_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes that begin at ``at`` by their first ``length`` bytes, within start_class.

    One round sorts by the next eight bytes, read as a big-endian number, and keeps only suffixes that tie with a
    neighbour, as multikey quicksort recurses only into its middle part.  Returns (indices into at, class numbers) of
    the suffixes that tie to the end, in sorted order.
    """
    buf = np.concatenate([text, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))
    live, cls = np.arange(len(at)), np.asarray(start_class, np.int64)
    for depth in range(0, length, 8):
        key = wide[at[live] + depth].astype(np.uint64)
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - (length - depth)))
        order = np.lexsort((key, cls))
        live, cls, key = live[order], cls[order], key[order]
        new = np.r_[True, (cls[1:] != cls[:-1]) | (key[1:] != key[:-1])] if len(live) else np.zeros(0, bool)
        cls = np.cumsum(new)
        tied = ~(new & np.r_[new[1:], True]) if len(live) else new
        live, cls = live[tied], cls[tied]
        if not len(live):
            break
    return live, cls
