"""Shape of the address space: how many rows a step has and how rows are numbered."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """Fixed parameters of an exchange.

    prompts:  prompts per global step
    samples:  rows per prompt (a prompt group is this many consecutive indices)
    slots:    number of steps the address ring holds before indices repeat
    shards:   number of shards rows are dealt to round-robin
    """

    prompts: int
    samples: int = 1
    slots: int = 1
    shards: int = 1

    def __post_init__(self):
        for name in ("prompts", "samples", "slots", "shards"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @property
    def rows_per_step(self) -> int:
        return self.prompts * self.samples

    @property
    def total_rows(self) -> int:
        return self.rows_per_step * self.slots

    @property
    def shard_capacity(self) -> int:
        return -(-self.total_rows // self.shards)

    def step_range(self, global_step: int) -> tuple[int, int]:
        """First index of a step and the index after its last."""
        start = global_step % self.slots * self.rows_per_step
        return start, start + self.rows_per_step
