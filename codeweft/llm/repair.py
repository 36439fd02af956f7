"""Re-Pair grammars of many token sequences at once (NumPy, one batch of files at a time).

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no pair
occurs twice. Here every sequence of a batch takes its step in the same array operations: a round
replaces, in each sequence, all pairs at least half as frequent as its most frequent one, where
neighbouring candidates give way to the more frequent. Rounds are logarithmic in the counts.
"""

from __future__ import annotations

import numpy as np


def grammars(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sequence: size of the final string, number of rules, uses of rules.

    Symbols are non-negative integers below 2**20. The grammar's size is final + 2 * rules; an
    incompressible sequence keeps its length and has no rule. Sequences may be empty.
    """
    k = len(seqs)
    rules, uses = np.zeros(k, np.int64), np.zeros(k, np.int64)
    lengths = np.array([len(s) for s in seqs], np.int64)
    if not lengths.sum():
        return lengths, rules, uses
    sym = np.concatenate([np.asarray(s, np.int64) for s in seqs])
    fid = np.repeat(np.arange(k, dtype=np.int64), lengths)
    fresh = int(sym.max()) + 1
    done_final = np.zeros(k, np.int64)
    while len(sym) > 1:
        same = fid[:-1] == fid[1:]
        pair = np.where(same, (sym[:-1] << 31) | sym[1:], -1)
        # ids of (sequence, pair)
        order = np.lexsort((pair, fid[:-1]))
        f, p = fid[:-1][order], pair[order]
        head = np.ones(len(p), bool)
        head[1:] = (p[1:] != p[:-1]) | (f[1:] != f[:-1])
        group = np.cumsum(head) - 1
        count = np.bincount(group)
        first = np.flatnonzero(head)
        count[p[first] < 0] = 0
        top = np.zeros(k, np.int64)
        np.maximum.at(top, f[first], count)
        chosen = (count >= 2) & (2 * count >= top[f[first]])
        at = np.empty(len(p), np.int64)
        at[order] = group
        c = np.where(chosen[at], count[at], 0)
        # a candidate yields to a more frequent neighbour, then to the left one
        rank = c * (2 * len(c)) - at
        rank[c == 0] = -1
        left = np.concatenate(([-2], rank[:-1]))
        right = np.concatenate((rank[1:], [-2]))
        best = (c > 0) & (rank >= left) & (rank >= right)
        run = best & np.concatenate(([False], best[:-1]))
        if run.any():  # equal neighbours, as in aaaa: every other one
            idx = np.arange(len(best))
            start = np.maximum.accumulate(np.where(best & ~run, idx, 0))
            best &= (idx - start) % 2 == 0
        hits = np.flatnonzero(best)
        used, inverse, times = np.unique(at[hits], return_inverse=True, return_counts=True)
        good = times >= 2
        if not good.any():
            # stop the sequences whose candidates cannot form a rule; nothing else changes
            break
        keep = good[inverse]
        hits, inverse = hits[keep], inverse[keep]
        number = np.cumsum(good) - 1
        owner = f[first][used[good]]
        np.add.at(rules, owner, 1)
        np.add.at(uses, owner, times[good])
        sym[hits] = fresh + number[inverse]
        fresh += int(good.sum())
        stay = np.ones(len(sym), bool)
        stay[hits + 1] = False
        changed = np.zeros(k, bool)
        changed[owner] = True
        done_final += np.bincount(fid[stay & ~changed[fid]], minlength=k)
        stay &= changed[fid]
        sym, fid = sym[stay], fid[stay]
    return done_final + np.bincount(fid, minlength=k), rules, uses
