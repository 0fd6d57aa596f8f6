"""How records become frames: by a count that frame 0 settles, by a given count, or by size alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from recframe.errors import Refused, SpecError

#: The least that frame_size * limit_multiplier may be for inputs that are longer than it.
LEAST_LIMIT = 32768


@dataclass(frozen=True)
class Framing:
    """frame_size: what frame 0 grows to; records_per_frame: a given count instead; uniform: False cuts every frame by size alone."""

    frame_size: int = 131072
    records_per_frame: int | None = None
    limit_multiplier: int = 4
    uniform: bool = True
    level: int = 3
    checksum: bool = True

    def __post_init__(self):
        if self.frame_size <= 0 or self.limit_multiplier <= 0 or self.records_per_frame is not None and self.records_per_frame <= 0:
            raise SpecError("frame_size, limit_multiplier and records_per_frame must be above 0")
        if self.records_per_frame is not None and not self.uniform:
            raise SpecError("a count of records a frame makes frames uniform")

    @classmethod
    def from_options(cls, options: dict[str, str]) -> Framing:
        yes = lambda name: str(options.get(name, "true")).lower() in ("true", "1", "yes")
        number = lambda name, usual: int(options[name]) if options.get(name) not in (None, "") else usual
        return cls(number("frame_size", 131072), number("records_per_frame", None), number("limit_multiplier", 4), yes("uniform"), number("level", 3), yes("checksum"))

    @property
    def limit(self) -> int:
        return self.frame_size * self.limit_multiplier


class FrameCutter:
    """Takes runs of whole records in order and gives (frame, records) as frames fill.

    Records arrive whole, so a frame's size is known when it is cut and nothing is ever tried again. A record above the limit
    that comes before the count of a uniform file is known settles it at what is held, at least 1; with a given count, or
    where size alone cuts, such a record is refused.
    """

    def __init__(self, framing: Framing):
        self.framing = framing
        self.per_frame = framing.records_per_frame
        self.held: list[bytes] = []
        self.count = self.size = 0

    def _cut(self, last: bytes = b"", count: int = 0) -> tuple[bytes, int]:
        frame = b"".join([*self.held, last]) if self.held else last, self.count + count  # a view of the given run where nothing is held
        self.held, self.count, self.size = [], 0, 0
        return frame

    def _hold(self, data: bytes, count: int) -> None:
        if count:
            self.held.append(bytes(data))
            self.count += count
            self.size += len(data)

    def feed(self, data: bytes, ends: np.ndarray) -> Iterator[tuple[bytes, int]]:
        """data is a run of records that end at `ends`."""
        n, view = len(ends), memoryview(data)
        starts = np.concatenate([[0], ends[:-1]]) if n else ends
        long = np.flatnonzero(ends - starts > self.framing.limit)
        if len(long):
            at = int(long[0])
            if self.framing.records_per_frame is not None or not self.framing.uniform:
                raise Refused(f"a record of {int(ends[at] - starts[at])} bytes is above the limit of {self.framing.limit}: raise frame_size or limit_multiplier")
            if self.per_frame is None and at:
                yield from self._run(view[: starts[at]], ends[:at])
                view, ends = view[starts[at] :], ends[at:] - starts[at]
            if self.per_frame is None:
                self.per_frame = max(1, self.count)
                if self.count == self.per_frame:
                    yield self._cut()
        yield from self._run(view, ends)

    def _run(self, view: memoryview, ends: np.ndarray) -> Iterator[tuple[bytes, int]]:
        n = len(ends)
        if self.framing.uniform:
            if self.per_frame is None:
                at = int(np.searchsorted(ends, self.framing.frame_size - self.size))
                if at < n:
                    self.per_frame = self.count + at + 1
            cuts = np.arange(self.per_frame - self.count - 1, n, self.per_frame).tolist() if self.per_frame is not None else []
        else:
            cuts, reach = [], self.framing.frame_size - self.size
            while (at := int(np.searchsorted(ends, reach))) < n:
                cuts.append(at)
                reach = int(ends[at]) + self.framing.frame_size
        first, start = 0, 0
        for at in cuts:
            yield self._cut(view[start : ends[at]], at + 1 - first)
            first, start = at + 1, int(ends[at])
        self._hold(view[start : int(ends[-1]) if n else 0], n - first)

    def add(self, record: bytes) -> Iterator[tuple[bytes, int]]:
        """One record."""
        return self.feed(record, np.array([len(record)]))

    def finish(self) -> Iterator[tuple[bytes, int]]:
        if self.count:
            yield self._cut()
