"""How many bytes of documents cross to Python at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Spark's own limit is 10,000 rows, which for long texts is far more than a worker needs at a time.
BATCH_BYTES = 8 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's limit of bytes in an Arrow batch was lowered to ``BATCH_BYTES``, if it was above."""
    conf = docs.sparkSession.conf
    now = conf.get(_KEY).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_KEY, str(BATCH_BYTES))
    return docs
