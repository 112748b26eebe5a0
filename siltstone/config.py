"""Parameters of the chunk-reduction pipeline."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    #: Bytes of a fixed chunk; with ``chunking="cdc"`` the average size.
    chunk_size: int = 8192
    chunking: str = "fixed"
    #: Average size of the sub-chunks that represent a chunk.
    sub_avg: int = 2048
    #: Chunks of a group at most.
    cap: int = 8
    #: Sampled share of rolling hashes: 1/2**sample_bits (5, 2 or 0).
    sample_bits: int = 5
    #: Buckets of more leftover items are packed in order instead of by best fit.
    merge_limit: int = 1000
    #: Chunks that the greedy method looks at.
    greedy_limit: int = 1024
    #: How many files take part (None: all).
    files: int | None = None

    def but(self, **changes) -> Config:
        return replace(self, **changes)
