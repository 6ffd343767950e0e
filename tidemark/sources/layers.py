"""Publishing layers under a folder, and reading them back.

A layer is written to a folder of its own run, checked there, and only then
entered in the manifest.  Readers go by the manifest, so they never see a
layer that is half written or breaks its rules, and publishing again does not
disturb those who read the run before.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.check import Rule, check
from tidemark.operators.pick import pick_one

MANIFEST = "manifest"
MANIFEST_SCHEMA = (
    "name string, role string, contract string, rows bigint, schema_json string, path string, published_at timestamp"
)


class LayerRefused(Exception):
    """The layer breaks its rules; ``violations`` has a row for each."""

    def __init__(self, name: str, path: str, violations: list):
        self.violations = violations
        super().__init__(f"layer {name} not published, written to {path}: {violations}")


def publish(
    df: DataFrame,
    root: str,
    name: str,
    role: str,
    key: str,
    rules: list[Rule] = (),
    partition_by: list[str] = (),
    contract: str = "1.0",
) -> str:
    """Write a layer, check what was written, enter it in the manifest.

    The input is computed once: the rules read the written files, of which
    they need a few columns.  Rows are gathered by ``partition_by`` with
    Spark's rebalance hint, which splits a value that holds much of the table.
    Raises ``LayerRefused`` and leaves the manifest alone if a rule is broken;
    an empty string in a partition column fails the write, as it would come
    back as null.
    Returns the path of the run.
    """
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name) or name == MANIFEST:
        raise ValueError("a layer name is made of lower-case letters, digits and _, and is not 'manifest'")
    spark = df.sparkSession
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    texts = [c for c in partition_by if df.schema[c].dataType.typeName() == "string"]
    # A folder cannot tell an empty string from a null.
    refuse = {c: F.expr(f"if(`{c}` = '', raise_error('empty string in partition column {c}'), `{c}`)") for c in texts}
    named = df.withColumns(refuse) if refuse else df
    spread = named.hint("rebalance", *partition_by) if partition_by else named
    writer = spread.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    written = spark.read.schema(df.schema).parquet(path)
    violations = check(written, list(rules), key).collect() if rules else []
    if violations:
        raise LayerRefused(name, path, violations)
    entry = (
        name, role, contract, written.count(), df.schema.json(), path, datetime.now(timezone.utc)
    )
    spark.createDataFrame([entry], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return path


def layers(spark: SparkSession, root: str, role: str | None = None) -> DataFrame:
    """The newest manifest row of every layer, or of those with a role."""
    try:
        manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{MANIFEST}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        manifest = spark.createDataFrame([], MANIFEST_SCHEMA)
    newest = pick_one(manifest, "name", [F.desc("published_at"), F.desc("path")])
    return newest if role is None else newest.where(F.col("role") == role)


def read_layer(
    spark: SparkSession, root: str, name: str, columns: list[str] | None = None, where: str | None = None
) -> DataFrame:
    """Rows and columns of the newest run of a layer; both reach the scan."""
    row = layers(spark, root).where(F.col("name") == name).first()
    if row is None:
        raise LookupError(f"no layer {name} under {root}")
    schema = T.StructType.fromJson(json.loads(row["schema_json"]))
    df = spark.read.schema(schema).parquet(row["path"]).select(*schema.names)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*columns)
