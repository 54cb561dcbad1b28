"""Channel choice of the partition strategies; Spark places rows by itself, this is for reports and tests."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from tidemark.plans.graph import Partition


@dataclass
class Partitioner:
    strategy: Partition
    channels: int
    sent: int = 0

    def select(self, key: bytes | None = None) -> list[int]:
        if self.strategy is Partition.BROADCAST:
            return list(range(self.channels))
        if self.strategy is Partition.REBALANCE:
            self.sent += 1
            return [(self.sent - 1) % self.channels]
        if self.strategy is Partition.HASH and key is not None:
            return [zlib.crc32(key) % self.channels]
        return [0]
