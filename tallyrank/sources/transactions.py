"""Reader of the labelled card-transaction file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, StringType, StructField, StructType,
)

from tallyrank.contract import CARD_FEATURES, CARD_LABEL
from tallyrank.session import materialize

CARD_SCHEMA = StructType(
    [StructField(c, DoubleType()) for c in CARD_FEATURES] + [StructField(CARD_LABEL, IntegerType())]
)


def read_transactions(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Transactions with the declared types; no pass to infer them.

    The header is checked by name first.  A row that does not parse has nulls in
    the columns at fault, which the quality checks report.  A missing file raises,
    and so does reading one of several files whose header differs from the others'.
    """
    header = spark.read.csv(path, header=True).columns
    if validate:
        absent = [c for c in CARD_SCHEMA.names if c not in header]
        if absent:
            raise ValueError(f"required columns are missing: {absent}")
    types = {f.name: f for f in CARD_SCHEMA}
    schema = StructType([types.get(c, StructField(c, StringType())) for c in header])
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False)
    return rows.select(*[c for c in CARD_SCHEMA.names if c in header])


BROKEN = "_broken"


def read_checked(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of a file that parse under ``schema``, and (line, reason) of those that don't.

    The reason is ``fields`` where a line has another number of them, else ``value``.  The
    parsed rows are written once, as a reader that is asked for some columns only would
    not look at the others.
    """
    declared = StructType([*schema.fields, StructField(BROKEN, StringType())])
    rows = spark.read.schema(declared).csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, enforceSchema=True)
    rows = materialize(rows, "parsed")
    fits = F.size(F.split(BROKEN, ",")) == len(schema)
    bad = rows.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"), F.when(fits, "value").otherwise("fields").alias("reason"))
    return rows.filter(F.col(BROKEN).isNull()).drop(BROKEN), bad
