"""A cuckoo filter of 64-bit hashes: set membership with few false positives, no false negatives, and deletion.

A hash has a fingerprint of 16 bits, which lies in one of the SLOTS places of either of its two buckets; each
bucket follows from the other and the fingerprint. Who finds both buckets full takes the place of another one, which moves to its
other bucket. What still has no place after ROUNDS such moves is kept in a short list beside the table, so nothing is ever lost. Each insertion
adds one fingerprint and each removal takes one away; only inserted hashes may be removed.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

SLOTS = 4
ROUNDS = 200
#: The filled share of a table's places that makes a larger one worth while.
LOAD = 0.85


class CuckooFilter:
    def __init__(self, capacity: int = 0):
        """A filter for about ``capacity`` hashes."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1.0, capacity / (LOAD * SLOTS))))))
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.rest = np.zeros((0, 2), np.int64)  # (smaller bucket, fingerprint) without a place

    @classmethod
    def read(cls, table: bytes, rest: bytes) -> CuckooFilter:
        made = cls()
        made.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        made.rest = np.frombuffer(rest, np.int64).reshape(-1, 2)
        return made

    def write(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.rest.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.rest)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The fingerprint (1 to 65535) and both buckets of each hash."""
        hashes = hashes.astype(np.uint64)
        mark = (hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        one = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark.astype(np.uint16), one, self._other(one, mark)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if len(self.rest):
            own = np.minimum(one, two) << 16 | mark
            found |= np.isin(own, self.rest[:, 0] << 16 | self.rest[:, 1])
        return found

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put what finds a free place in its bucket there; the positions of the others."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.append(True, b[1:] != b[:-1])
        nth = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
        free = self.table[b] == 0
        fits = nth < free.sum(1)
        place = np.argmax(np.cumsum(free[fits], axis=1) == nth[fits, None] + 1, axis=1)
        self.table[b[fits], place] = mark[order[fits]]
        return order[~fits]

    def insert(self, hashes: np.ndarray) -> None:
        mark, bucket, other = self._places(hashes)
        left = self._settle(bucket, mark)
        bucket, mark = other[left], mark[left]
        random = np.random.default_rng(len(self.table))
        for _ in range(ROUNDS):
            left = self._settle(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if not len(left):
                return
            _, kicks = np.unique(bucket, return_index=True)  # one in each full bucket takes a place, the others look at their other bucket
            place = random.integers(0, SLOTS, len(kicks))
            mark = mark.copy()
            mark[kicks], self.table[bucket[kicks], place] = self.table[bucket[kicks], place], mark[kicks]
            bucket = self._other(bucket, mark)
        left = self._settle(bucket, mark)
        bucket, mark = bucket[left], mark[left]
        lower = np.minimum(bucket, self._other(bucket, mark))
        self.rest = np.concatenate([self.rest, np.stack([lower, mark.astype(np.int64)], axis=1)])

    def remove(self, hashes: np.ndarray) -> None:
        """Take away one fingerprint for each hash; all of them have been inserted."""
        mark, one, two = self._places(hashes)
        while len(mark):
            first, second = self.table[one] == mark[:, None], self.table[two] == mark[:, None]
            bucket = np.where(first.any(1), one, two)
            held = first.any(1) | second.any(1)
            if not held.any():
                break
            at = np.flatnonzero(held)
            place = bucket[at] * SLOTS + np.argmax(self.table[bucket[at]] == mark[at, None], axis=1)
            places, winners = np.unique(place, return_index=True)
            self.table.reshape(-1)[places] = 0
            stay = np.ones(len(mark), bool)
            stay[at[winners]] = False
            mark, one, two = mark[stay], one[stay], two[stay]
        for b, m in zip(np.minimum(one, two), mark):
            at = np.flatnonzero((self.rest[:, 0] == b) & (self.rest[:, 1] == m))
            if not len(at):
                raise KeyError("a hash to be removed is not in the filter")
            self.rest = np.delete(self.rest, at[0], axis=0)
