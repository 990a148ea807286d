"""Session options the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Ids that a runtime Bloom filter is made for, and its bits: 16 MB for 16 million.
FILTER_ITEMS, FILTER_BITS = 16_000_000, 1 << 27

# Hot keys in joins are split at run time. Where that costs the next join of the same
# stage its partitioning, one more shuffle is still cheaper than one task with a third
# of the rows, hence the force option. A shuffled join whose smaller side turns out to
# have only small partitions hashes them instead of sorting both sides.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32MB",
    # The orders of some days are few among all values: a Bloom filter of their ids, of 16 MB
    # at most, is worth building from far more than the default's 10 MB of them.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    # Without table statistics Spark takes the expected numbers, with them the greatest.
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": str(FILTER_ITEMS),
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": str(FILTER_ITEMS),
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(FILTER_BITS),
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(FILTER_BITS),
    # One for each range of ids that is joined by itself.
    "spark.sql.optimizer.runtimeFilter.number.threshold": "1000",
}
PARTITION_BYTES = 128 << 20


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Set the runtime options above on ``spark``.

    With the size of the input, also set the number of shuffle partitions so that one
    holds about 128 MB even if all of the input is shuffled; AQE merges small ones.
    """
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        wanted = -(-input_bytes // PARTITION_BYTES)
        at_least = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(max(wanted, at_least)))
    return spark
