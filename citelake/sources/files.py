"""Files that graphs, cache entries and lists are kept in: JSON lines (gzip if wanted) and CSV with fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Columns of a graph's CSV, in order; recordUrl is the address of a paper's page.
GRAPH_COLUMNS = ["recid", "kind", "title", "year", "citationCount", "localItemID", "recordUrl", "doi", "arxivId"]


def write_json(rows: DataFrame, path: str, compress: bool = True) -> None:
    rows.write.mode("overwrite").json(path, compression="gzip" if compress else None)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines, compressed or not, with a schema that is given and never guessed; broken lines give nulls."""
    return spark.read.schema(schema).json(path)


def csv_line(*cells: Column) -> Column:
    """Cells as a line of CSV: one with a comma, quote or line end is quoted, quotes in it doubled; a null cell is empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    quoted = [F.when(F.rlike(t, F.lit(r'[",\n\r]')), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    return F.concat_ws(",", *quoted)


def write_graph_csv(nodes: DataFrame, path: str) -> None:
    """Nodes (GRAPH_COLUMNS) as CSV files with a header each, in the form of csv_line."""
    own = nodes.select(*(F.col(c).cast("string") for c in GRAPH_COLUMNS))
    own.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def references_of(records: DataFrame) -> DataFrame:
    """(citing, ordinal, cited, label) out of records with arrays of references; the record number is taken from the reference's address."""
    each = records.select(F.col("recid").alias("citing"), F.posexplode("references").alias("ordinal", "ref"))
    return each.select("citing", "ordinal", F.regexp_extract("ref.record", r"/(\d+)/?$", 1).try_cast("long").alias("cited"), F.col("ref.label").alias("label"))
