"""Merging many symbol sequences at once, each by its lowest-ranked pair per round.

The sequences lie behind one another in one numpy array.  In a round each takes its
lowest-ranked pair and merges all its occurrences, from the left, at the same time.  A
merge list makes each token by one merge, after those that make its parts, so a round
never undoes a later choice and the result is that of merging one pair at a time.
"""

from __future__ import annotations

import numpy as np

from spanloom.llm.vocabularies import PairTable


def merge(sym: np.ndarray, length: np.ndarray, table: PairTable, keep: bool = False):
    """Symbols that remain of each sequence (none empty); with ``keep`` also the symbols, in one array."""
    sym, length = sym.copy(), length.astype(np.int64)
    counts = np.zeros(len(length), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    who = np.arange(len(length))
    while len(who):
        start = np.zeros(len(who), np.int64)
        np.cumsum(length[:-1], out=start[1:])
        at = np.full(len(sym), -1, np.int64)
        at[:-1] = table.find(sym[:-1], sym[1:])
        at[start + length - 1] = -1  # no pair across two sequences
        rank = np.where(at >= 0, table.rank[at], PairTable.ABSENT)
        least = np.minimum.reduceat(rank, start)
        done = least == PairTable.ABSENT
        if done.any():
            counts[who[done]] = length[done]
            leaving = np.repeat(done, length)
            if keep:
                ends.append((who[done], sym[leaving]))
            sym, at, rank = sym[~leaving], at[~leaving], rank[~leaving]
            who, length, least = who[~done], length[~done], least[~done]
            if not len(who):
                break
            start = np.zeros(len(who), np.int64)
            np.cumsum(length[:-1], out=start[1:])
        place = np.flatnonzero(rank == np.repeat(least, length))
        # In a run of hits (a a a) every second one is free to merge.
        new_run = np.ones(len(place), bool)
        new_run[1:] = place[1:] != place[:-1] + 1
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - first) % 2 == 0]
        sym[place] = table.made[at[place]]
        stay = np.ones(len(sym), bool)
        stay[place + 1] = False
        length = np.add.reduceat(stay, start, dtype=np.int64)
        sym = sym[stay]
    if not keep:
        return counts
    where = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=where[1:])
    out = np.zeros(int(counts.sum()), np.int32)
    for ids, symbols in ends:
        sizes = counts[ids]
        inner = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(where[ids], sizes) + inner] = symbols
    return counts, out
