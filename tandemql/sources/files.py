"""Files: Spark's own formats, and MySQL's LOAD DATA and INTO OUTFILE.

Paths are Spark's, so any file system that Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemql.sql import nodes as N
from tandemql.sql.dialect import SqlError

FORMATS = ("parquet", "csv", "json", "orc", "text")


def read_files(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """A table from files; the format is told by the ending, if not given."""
    fmt = fmt or next((f for f in FORMATS if path.rstrip("/").endswith(f".{f}")), "parquet")
    return spark.read.options(**options).format(fmt).load(path)


def _csv_options(separator: str, quote: str, escape: str, line: str) -> dict[str, str]:
    if len(line) > 2:
        raise SqlError("lines end with at most two characters")
    options = {"sep": separator, "quote": quote, "escape": escape or "\0", "nullValue": "\\N", "emptyValue": ""}
    return options | ({"lineSep": line} if line not in ("\n", "\r\n") else {})


def read_infile(spark: SparkSession, node: N.LoadData, width: int) -> DataFrame:
    """The rows of a LOAD DATA file as ``width`` text columns; fields that a line lacks are null."""
    if not node.skip and not node.starting:
        schema = ", ".join(f"_f{i} string" for i in range(width))
        return spark.read.options(**_csv_options(node.fields, node.enclosed, node.escaped, node.lines)).schema(schema).csv(node.path)
    # Lines to skip are counted in each file from its start, so the lines are read as text with their file.
    lines = spark.read.option("lineSep", node.lines).text(node.path).withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    if node.skip:
        first = lines.groupBy("_file").agg(F.min("_at").alias("_first"))
        lines = lines.join(F.broadcast(first), "_file").where(F.col("_at") >= F.col("_first") + node.skip)  # a row per file
    if node.starting:
        at = F.instr(F.col("value"), node.starting)
        lines = lines.where(at > 0).withColumn("value", F.substr("value", at + len(node.starting)))
    schema = ", ".join(f"_f{i} string" for i in range(width))
    options = {k: v for k, v in _csv_options(node.fields, node.enclosed, node.escaped, "\n").items()}
    parsed = lines.select(F.from_csv("value", schema, options).alias("r"))
    return parsed.select("r.*")


def write_outfile(df: DataFrame, path: str, options: dict[str, str]) -> None:
    """SELECT ... INTO OUTFILE: a folder of text files; an existing path is an error."""
    fields = options.get("fields_terminated", "\t")
    quote = options.get("fields_enclosed", "")
    escape = options.get("fields_escaped", "\\")
    line = options.get("lines_terminated", "\n")
    flat = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    writer = flat.write.options(**{k: v for k, v in _csv_options(fields, quote, escape, line).items() if k != "lineSep" or line != "\n"})
    writer.option("quoteAll", str(bool(quote)).lower()).csv(path)
