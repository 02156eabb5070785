"""Tables that are made once and found again by what they were made from.

A table lies under the fingerprint of its inputs' rows, its parameters and the
version of the code that makes it, so a change of any of these leads elsewhere.
Beside it stands a note with its own fingerprint, written last. On reading the
table is held against that note; one that is missing, cut off or changed is made
anew under a fresh name, and the note is replaced in one step.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError

from lexiweave.runtime import delete
from lexiweave.sources import commits


def fingerprint(df: DataFrame) -> str:
    """Of the rows, in any order, repeats counted, and the columns; one pass, one row to the driver."""
    names = sorted(df.columns)
    # Two sums of different hashes: one could be met by chance, and a sum, unlike an exclusive or, sees repeats.
    cells = [F.col(f"`{c}`") for c in names]
    text = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    n, a, b = df.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64(F.reverse(text), F.lit(1)).cast("decimal(38,0)")), F.lit(0))
    ).first()
    kinds = dict(df.dtypes)
    return hashlib.sha256(json.dumps([[(c, kinds[c]) for c in names], n, str(a), str(b)]).encode()).hexdigest()


class Memo:
    """Tables under ``root``, by name and fingerprint."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.made = spark, root.rstrip("/"), 0

    def table(self, name: str, inputs: Mapping[str, DataFrame], make: Callable[[], DataFrame], params: object = None, version: int = 1) -> DataFrame:
        """The table that ``make`` gives of ``inputs``, read if it is there and whole, else made and kept; ``made`` counts the latter."""
        key = json.dumps([name, version, params, {k: fingerprint(df) for k, df in sorted(inputs.items())}], sort_keys=True)
        note = f"{self.root}/{name}/{hashlib.sha256(key.encode()).hexdigest()[:32]}.json"
        found = self._whole(note)
        if found is None:
            self.made += 1
            path, df = f"{self.root}/{name}/tables/{uuid.uuid4().hex}", make()
            df.write.parquet(path)
            found = self.spark.read.schema(df.schema).parquet(path)
            commits.put_text(self.spark, json.dumps({"path": path, "schema": df.schema.json(), "rows": fingerprint(found)}), note)
        return found

    def _whole(self, note: str) -> DataFrame | None:
        """The table of a note, or None if either is not as it was written; what is left of it then goes."""
        if not commits.exists(self.spark, note):
            return None
        path = None
        try:
            kept = json.loads(commits.read_text(self.spark, note))
            path = kept["path"]
            df = self.spark.read.schema(StructType.fromJson(json.loads(kept["schema"]))).parquet(path)
            if fingerprint(df) == kept["rows"]:
                return df
        except (ValueError, KeyError, TypeError, PySparkException, Py4JJavaError):
            pass  # a damaged note or table counts as none
        if isinstance(path, str) and path.startswith(f"{self.root}/"):
            delete(self.spark, path)
        return None
