"""Texts cut into units that are encoded apart from each other: each distinct unit once, its ids kept and gathered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FLAT = 16  # ids kept, as a multiple of the units


class Units:
    """Ids of the units met, and what ``read`` makes of them; of more than ``most`` only those go on that a second call has asked for."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, read: Callable[[list[list[int]]], list[str]] | None = None):
        self.encode, self.most, self.read = encode, most, read  # encode: the ids of all given units in a row, and how many each has
        self._keep(np.zeros(0, np.int64))

    def _keep(self, kept: np.ndarray) -> None:
        if not len(kept):
            self.place, self.texts = {}, []
            self.flat, self.counts, self.starts, self.asked = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        names = list(self.place)
        self.place = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.texts = [self.texts[i] for i in kept.tolist()] if self.read else []
        self.flat, self.counts = self._ids(kept), self.counts[kept]
        self.starts, self.asked = np.cumsum(self.counts) - self.counts, np.zeros(len(kept), np.int64)

    def _ids(self, at: np.ndarray) -> np.ndarray:
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - counts), counts)]

    def _add(self, fresh: list[str]) -> None:
        ids, counts = self.encode(fresh)
        ends = np.cumsum(counts)
        if self.read:
            flat, cuts = ids.tolist(), [0, *ends.tolist()]
            self.texts += self.read([flat[a:b] for a, b in zip(cuts, cuts[1:])])
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.asked = np.concatenate([self.asked, np.zeros(len(fresh), np.int64)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def places(self, distinct: list[str]) -> np.ndarray:
        """The numbers of distinct units, which hold until the next call."""
        if len(self.place) > self.most or len(self.flat) > FLAT * self.most:
            often = np.flatnonzero(self.asked > 1)
            self._keep(often if len(often) <= self.most // 2 and self.counts[often].sum() <= FLAT * self.most // 2 else often[:0])
        at = np.array([self.place.get(unit, -1) for unit in distinct], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.place), len(self.place) + len(new))
            self._add([distinct[i] for i in new.tolist()])
        self.asked[at] += 1
        return at

    def gather(self, rows: pa.ListArray) -> tuple[list[np.ndarray], list[str] | None]:
        """The ids of each row of units, and what was read of them, put together."""
        coded = rows.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        distinct = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = distinct[which]
        offsets = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))])
        cuts = np.concatenate([[0], np.cumsum(self.counts[at])])[offsets]
        ids = np.split(self._ids(at), cuts[1:-1]) if len(rows) else []
        if not self.read:
            return ids, None
        texts = pa.array([self.texts[i] for i in distinct.tolist()], pa.string()).take(pa.array(which))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), "")
        return ids, joined.to_numpy(zero_copy_only=False).tolist()
