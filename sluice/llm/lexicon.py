"""Minimal acyclic transducer of words.

Words in byte order are added one by one; a state that can get no more arcs is looked up among equal ones, so equal
suffixes share states and the automaton is minimal.  The outputs on the arcs of a word add up to its slot, which
names its token ids in a pool.  States, arcs and pool lie in one file that readers map into memory, so the Python
workers of a machine share its pages.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

_MAGIC = b"MATLEX1\0"
_HEAD = struct.Struct("<8sQQQQQQ")


def automaton(words: list[bytes]) -> tuple[list[tuple[bool, tuple]], list[int], int]:
    """Of ascending distinct words: per state (final, arcs as (byte, state)), words below it, and the root."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    below: list[int] = []
    path: list[list] = [[False, []]]
    labels: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            below.append(node[0] + sum(below[t] for _, t in node[1]))
        return register[key]

    def close(to: int) -> None:
        while len(labels) > to:
            child = freeze(path.pop())
            path[-1][1].append((labels.pop(), child))

    last = b""
    for w in words:
        k, most = 0, min(len(last), len(w))
        while k < most and last[k] == w[k]:
            k += 1
        close(k)
        for c in w[k:]:
            labels.append(c)
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(0)
    root = freeze(path[0])
    return states, below, root


def write(path: str, entries: dict[bytes, list[int]]) -> None:
    """Compile word -> ids into the file ``path``."""
    words = sorted(entries)
    states, below, root = automaton(words)
    keys, to, out = [], [], []
    final = np.zeros(len(states), np.uint8)
    for s, (is_final, arcs) in enumerate(states):
        final[s] = is_final
        passed = int(is_final)
        for byte, t in arcs:
            keys.append(s << 8 | byte)
            to.append(t)
            out.append(passed)
            passed += below[t]
    pool = np.fromiter((i for w in words for i in entries[w]), np.uint32)
    ends = np.zeros(len(words) + 1, np.uint32)
    ends[1:] = np.cumsum([len(entries[w]) for w in words], dtype=np.uint64)
    longest = max(map(len, words), default=0)
    with open(path, "wb") as f:
        f.write(_HEAD.pack(_MAGIC, len(states), len(keys), len(words), len(pool), root, longest))
        for a in (np.array(keys, np.uint64), np.array(to, np.uint32), np.array(out, np.uint32), ends, pool, final):
            f.write(a.tobytes())


class Lexicon:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            magic, states, arcs, self.size, n_pool, self.root, self.longest = _HEAD.unpack(f.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        at, parts = _HEAD.size, []
        for kind, n in ((np.uint64, arcs), (np.uint32, arcs), (np.uint32, arcs), (np.uint32, self.size + 1), (np.uint32, n_pool), (np.uint8, states)):
            parts.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.to, self.out, self.ends, self.pool, self.final = parts

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Of each word its slot, or -1; all words walk the automaton together, one byte a step."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not self.size:
            return found
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.flatnonzero((size > 0) & (size <= self.longest))
        state, total = np.full(len(at), self.root, np.uint64), np.zeros(len(at), np.int64)
        for step in range(self.longest + 1):
            done = size[at] == step
            if done.any():
                hit = done & (self.final[state] == 1)
                found[at[hit]] = total[hit]
                at, state, total = at[~done], state[~done], total[~done]
            if not len(at):
                break
            key = (state << np.uint64(8)) | text[start[at] + step].astype(np.uint64)
            arc = np.searchsorted(self.keys, key)
            np.minimum(arc, len(self.keys) - 1, out=arc)
            ok = self.keys[arc] == key
            at, arc, total = at[ok], arc[ok], total[ok]
            state, total = self.to[arc].astype(np.uint64), total + self.out[arc]
        return found

    def ids(self, slot: int) -> list[int]:
        return self.pool[self.ends[slot] : self.ends[slot + 1]].tolist()


@functools.lru_cache(maxsize=4)
def open_lexicon(path: str) -> Lexicon:
    return Lexicon(path)
