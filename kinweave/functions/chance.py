"""Random choices that do not depend on partitions, order or retries.

Every draw is a digest of the seed and the key it is made for, so a task that is
run again after a lost executor draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *parts) -> Column:
    """Digest of seed and key, to be sorted by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]))


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) for the key."""
    head = F.substring(draw_key(seed, *parts), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
