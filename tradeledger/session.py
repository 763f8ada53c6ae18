"""Session settings the reports are planned for.  All are ordinary runtime settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes partitions, splits skewed join partitions and picks
# broadcast joins from measured sizes.  Hints stand only where a number bounds the
# side: cut points and offsets of large parties, index rows per file.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join also where a grouping by the same key follows, at the price of a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    # The JVM leaves methods above 8000 bytes of bytecode uncompiled.  Fused stages with many decimal
    # columns exceed that and run interpreted, several times slower than the same stage unfused.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark
