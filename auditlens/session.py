"""Session settings the flows are written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, also where that costs one more shuffle later.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows that go to Python are bounded by their size, as texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "1m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; cluster settings such as memory stay untouched."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


#: Bytes of a partition of the smaller side up to which a shuffled join hashes it instead of sorting
#: both sides; also the size that read partitions are put together to, which must not be larger.
HASHED_PARTITION = "32m"


@contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Within, joins whose smaller side has small partitions do without a sort; others, such as one
    with a hot key on that side, are sorted as before. For flows that write what they join."""
    names = ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, HASHED_PARTITION)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
