"""Whole groups out of sorted partitions, for numpy work on groups without a Python call and a frame for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str], at_least: int = 1) -> Iterator[pd.DataFrame]:
    """Join sorted batches into frames that hold whole groups of ``key``, of ``at_least`` rows where there are as many."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows < at_least:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        last = np.ones(len(whole), bool)
        for k in key:
            last &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
            held, rows = [whole.iloc[cut:].reset_index(drop=True)], len(whole) - cut
        else:
            held, rows = [whole], len(whole)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def group_starts(frame: pd.DataFrame, key: list[str]) -> np.ndarray:
    """First row of each group of a sorted frame, and its length at the end."""
    new = np.zeros(len(frame), bool)
    if len(frame):
        new[0] = True
    for k in key:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(new), len(frame)]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that links ``(a, b)`` reach from each of ``n`` indexes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root
