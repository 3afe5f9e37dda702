"""A minimal acyclic transducer over sorted byte strings.

Every accepted string has its place in the sorted list as output: arcs carry how
many accepted strings sort before those beneath them, and the outputs along a
path add up to the ordinal. States with the same finality and the same arcs are
one state. Strings are walked many at a time in numpy, one byte of all of them a
step; a string leaves the walk at its first byte without an arc.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """Arcs lie in slots ``base[state] + byte``, those of all states interleaved:
    ``owner`` tells whose arc a slot holds (-1: none), ``target`` the next state
    and ``output`` what the arc adds."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    root: int
    size: int
    first: bytes
    last: bytes

    def to_bytes(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinals of the strings ``data[start:end]``; -1 for those not accepted."""
        found = np.full(len(starts), -1, np.int64)
        alive, at, stop = np.arange(len(starts)), starts.astype(np.int64), ends
        state, total = np.full(len(starts), self.root, np.int32), np.zeros(len(starts), np.int64)
        while len(alive):
            over = at == stop
            if over.any():
                done = over & self.final[state]
                found[alive[done]] = total[done]
                alive, at, stop, state, total = (x[~over] for x in (alive, at, stop, state, total))
                if not len(alive):
                    break
            slot = self.base[state] + data[at]
            on = self.owner[slot] == state
            if not on.all():
                alive, at, stop, total, slot = (x[on] for x in (alive, at, stop, total, slot))
            total = total + self.output[slot]
            state, at = self.target[slot], at + 1
        return found


def build(terms: list[bytes]) -> Transducer:
    """The transducer of distinct terms in ascending order of their bytes.

    Only the path of the last term is open. Where the next term leaves it, the
    states below are closed: each is looked up by finality and arcs among those
    closed before, so equal ones are met, and the automaton is never larger than
    the minimal one and one path.
    """
    closed: dict[tuple, int] = {}
    kept: list[tuple[bool, tuple[tuple[int, int], ...]]] = [(False, ())]
    below = [0]
    open_path: list[list] = [[False, []]]

    def close(depth: int, term: bytes) -> None:
        while len(open_path) - 1 > depth:
            final, arcs = open_path.pop()
            key = (final, tuple(arcs))
            at = closed.get(key)
            if at is None:
                at = closed[key] = len(kept)
                kept.append(key)
                below.append(final + sum(below[target] for _, target in arcs))
            open_path[-1][1].append((term[len(open_path) - 1], at))

    last = b""
    for n, term in enumerate(terms):
        if n and term <= last:
            raise ValueError("terms are not distinct and sorted")
        common = 0
        while common < min(len(term), len(last)) and term[common] == last[common]:
            common += 1
        close(common, last)
        open_path.extend([False, []] for _ in range(len(term) - common))
        open_path[-1][0] = True
        last = term
    close(0, last)
    kept.append((open_path[0][0], tuple(open_path[0][1])))

    base, owner, target, output = _laid_out([arcs for _, arcs in kept], [int(final) for final, _ in kept], below)
    return Transducer(base, owner, target, output, np.array([f for f, _ in kept]), len(kept) - 1, len(terms), terms[0] if terms else b"", last)


def _laid_out(arcs: list[tuple[tuple[int, int], ...]], final: list[int], below: list[int]) -> tuple[np.ndarray, ...]:
    """Slots for the arcs of all states, states with many arcs first."""
    n = sum(map(len, arcs))
    free = bytearray(b"\x01") * (2 * n + 1024)
    base, owner, target, output = np.zeros(len(arcs), np.int32), np.full(len(free), -1, np.int32), np.zeros(len(free), np.int32), np.zeros(len(free), np.int64)
    low, used = 256, 0
    for state in sorted(range(len(arcs)), key=lambda k: -len(arcs[k])):
        own = arcs[state]
        if not own:
            break
        lead = own[0][0]
        low = slot = free.index(1, low)
        while not all(free[slot + byte - lead] for byte, _ in own[1:]):
            slot = free.index(1, slot + 1)
        base[state] = slot - lead
        before = final[state]
        for byte, to in own:
            at = slot + byte - lead
            free[at], owner[at], target[at], output[at] = 0, state, to, before
            before += below[to]
            used = max(used, at)
        if used + 768 > len(free):
            more = len(free)
            free += b"\x01" * more
            owner, target, output = (np.concatenate((x, np.full(more, fill, x.dtype))) for x, fill in ((owner, -1), (target, 0), (output, 0)))
    end = used + 257
    return base, owner[:end], target[:end], output[:end]
