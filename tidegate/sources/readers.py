"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import schemas
from tidegate.functions import text as X


def text_or_size(data: Column) -> Column:
    """Bytes as text; bytes that are not valid UTF-8 become a note of their size."""
    return F.when(
        F.is_valid_utf8(data.cast("string")), data.cast("string")
    ).otherwise(F.format_string("<%d bytes binary>", F.octet_length(data)))


def read_traffic(
    spark: SparkSession, path: str, fmt: str = "json", binary_bodies: bool = False, agent_headers: tuple[str, ...] = X.AGENT_HEADERS
) -> DataFrame:
    """The request and response log.

    Lines that do not parse are kept in `_corrupt_record`. A missing timestamp becomes the time of
    ingestion, the agent is taken from the first of `agent_headers` where it is not given.
    """
    schema = schemas.TRAFFIC
    if binary_bodies:
        schema = schema.replace("body string", "body binary")
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(schema + ", _corrupt_record string").option(
            "columnNameOfCorruptRecord", "_corrupt_record"
        )
        raw = reader.option("mode", "PERMISSIVE").json(path)
    else:
        raw = reader.schema(schema).format(fmt).load(path)
    return finish_traffic(raw, agent_headers)


def finish_traffic(raw: DataFrame, agent_headers: tuple[str, ...] = X.AGENT_HEADERS) -> DataFrame:
    """Defaults of the traffic source, for batch and stream alike."""
    kinds = dict(raw.dtypes)
    columns = {
        "timestamp": F.coalesce("timestamp", F.current_timestamp()),
        "agent_name": F.coalesce("agent_name", X.agent_from_headers(F.col("req_headers"), agent_headers)),
        "environment": F.coalesce("environment", F.lit("prod")),
    }
    for name in ("body", "resp_body"):
        if kinds.get(name) == "binary":
            columns[name] = text_or_size(F.col(name))
    return raw.withColumns(columns)


def stream_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stored Parquet table, a folder or one file, as a stream of its files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if alone:
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Custom blocklist entries; a missing file is an empty list."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "entry string")
    return parse_blocklist(spark.read.text(path))


def parse_blocklist(lines: DataFrame) -> DataFrame:
    entry = F.lower(X.strip(F.split_part("value", F.lit("#"), F.lit(1))))
    return lines.select(entry.alias("entry")).filter("entry <> ''").distinct()


def read_filter_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: domains of a privacy filter list."""
    return parse_filter_list(spark.read.text(path))


def parse_filter_list(lines: DataFrame) -> DataFrame:
    line = X.strip(F.col("value"))
    domain = F.replace(F.split_part(line, F.lit("^"), F.lit(1)), F.lit("||"), F.lit(""))
    return (
        lines.filter(line.startswith("||") & F.contains(line, F.lit("^")))
        .select(domain.alias("domain"))
        .distinct()
    )


def read_threat_feed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A snapshot of threat verdicts."""
    reader = spark.read.schema(schemas.THREAT_FEED)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def with_headers(df: DataFrame, raw: str = "headers_json", parsed: str = "headers") -> DataFrame:
    """The parsed header map beside the raw text, which stays as it is where it is not JSON."""
    return df.withColumn(parsed, X.decode_headers(F.col(raw)))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table by its fixed schema."""
    return spark.read.schema(schema).parquet(path)
