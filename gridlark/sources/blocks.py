"""Where the values of a field lie in a file."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Block:
    """A field of one variable, step and member as an unbroken run of values, x fastest and components interleaved."""

    path: str
    variable: str
    t: int
    e: int
    offset: int
    kind: str
    sizes: tuple[int, int, int]
    components: int = 1
    fills: tuple[float, ...] = ()

    @property
    def values(self) -> int:
        xs, ys, zs = self.sizes
        return xs * ys * zs * self.components

    @property
    def nbytes(self) -> int:
        return self.values * np.dtype(self.kind).itemsize
