"""Double-array tries of number sequences, through which many places of an array are advanced at once."""

from __future__ import annotations

import numpy as np

#: Bits of a number that one step through the trie reads; a node has at most as many children as these tell apart.
DIGIT = 10
FAN = 1 << DIGIT


class Trie:
    """Sequences (rows of positive numbers, zeros after their end; sorted, distinct) with a place 0 .. n - 1 each.

    base[s] + digit is the state after state s, if check[] names s there; accept[] is the sequence that
    ends in a state, or -1. A number is read as `digits` digits, the highest first.
    """

    def __init__(self, rows: np.ndarray):
        rows = np.asarray(rows, np.int64)
        n, self.depth = rows.shape
        self.n = n
        self.digits = max(1, -(-int(rows.max(initial=1)).bit_length() // DIGIT))
        size = (rows > 0).sum(1)
        self.base, self.check, self.accept = np.zeros(4 * FAN, np.int32), np.full(4 * FAN, -1, np.int32), np.full(4 * FAN, -1, np.int32)
        self.top = 2 * FAN  # slots below FAN stay empty, so that no base is negative
        state = np.zeros(n, np.int64)
        rng = np.random.default_rng(1)
        for d in range(self.depth):
            on = size > d
            for k in range(self.digits):
                digit = rows[:, d] >> DIGIT * (self.digits - 1 - k) & (FAN - 1)
                state[on] = self._grow(state[on], digit[on], rng)
            ended = size == d + 1
            self.accept[state[ended]] = np.flatnonzero(ended)
        self.base, self.check, self.accept = (x[: self.top + FAN].copy() for x in (self.base, self.check, self.accept))

    def _room(self, top: int) -> None:
        while top + FAN > len(self.check):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])
            self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
        self.top = max(self.top, top)

    def _grow(self, parents: np.ndarray, digits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Give every parent its children (digits); the child's state of each row."""
        edges, of = np.unique(parents * FAN + digits, return_inverse=True)
        parent, digit = edges // FAN, edges % FAN
        heads = np.flatnonzero(np.diff(parent, prepend=-1))
        sizes = np.diff(np.append(heads, len(parent)))
        slots = np.zeros(len(edges), np.int64)
        many = np.flatnonzero(sizes > 6)
        low = FAN
        for g in many[np.argsort(-sizes[many], kind="stable")].tolist():  # wide nodes one by one, in the first window that takes them
            own = digit[heads[g] : heads[g] + sizes[g]]
            found = None
            for tries in range(6):
                at = low + 128 * tries + np.arange(128)
                if at[-1] >= self.top:
                    break
                free = (self.check[at[:, None] + own] == -1).all(1)
                if free.any():
                    found = int(at[np.argmax(free)])
                    break
            if found is None:
                found, low = self.top, max(low, self.top - FAN)
                self._room(self.top + FAN)
            self._room(found + FAN)  # children may lie past the top, where the next node would be put unasked
            slots[heads[g] : heads[g] + sizes[g]] = found + own
            self.check[found + own] = parent[heads[g]]
        todo = np.flatnonzero(sizes <= 6)
        while len(todo):  # narrow ones together, at random free slots; of those that meet one stays
            free = np.flatnonzero(self.check[2 * FAN : self.top] == -1) + 2 * FAN
            if len(free) < 3 * int(sizes[todo].sum()):
                self._room(self.top + 2 * int(sizes[todo].sum()) + FAN)
                free = np.flatnonzero(self.check[2 * FAN : self.top] == -1) + 2 * FAN
            first = rng.permutation(free)[: len(todo)]
            todo = todo[: len(first)] if len(first) < len(todo) else todo
            where = np.repeat(np.arange(len(todo)), sizes[todo])
            places = np.repeat(heads[todo], sizes[todo]) + np.arange(len(where)) - np.repeat(np.cumsum(sizes[todo]) - sizes[todo], sizes[todo])
            asked = (first - digit[heads[todo]])[where] + digit[places]
            good = self.check[asked] == -1
            claim = np.full(self.top + 2 * FAN, -1, np.int64)
            claim[asked] = where
            good &= claim[asked] == where
            took = np.bincount(where, good, len(todo)) == sizes[todo]
            rows = took[where]
            slots[places[rows]] = asked[rows]
            self.check[asked[rows]] = parent[places[rows]]
            todo = np.setdiff1d(np.flatnonzero(sizes <= 6), np.flatnonzero(slots[heads] > 0), assume_unique=True)
        self._room(int(slots.max(initial=0)) + 1)
        self.base[parent] = slots - digit
        return slots[of]

    def advance(self, ids: np.ndarray, own: int):
        """For each depth the places of ids[:own] from which the trie goes that deep, and the states there. Zeros end a sequence."""
        at = np.flatnonzero(ids[:own])
        state = np.zeros(len(at), np.int32)
        for d in range(self.depth):
            inside = at + d < len(ids)
            at, state = at[inside], state[inside]
            word = ids[at + d]
            for k in range(self.digits):
                digit = word >> DIGIT * (self.digits - 1 - k)
                if k:
                    digit = digit & (FAN - 1)
                on = digit < FAN
                after = self.base[state] + np.where(on, digit, 0)
                on &= (self.check[after] == state) & (word > 0)
                at, state, word = at[on], after[on], word[on]
            yield at, state
