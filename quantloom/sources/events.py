"""Event envelopes: parse, serialise, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

ENVELOPE = (
    "event_id STRING, event_type STRING, source STRING, ts TIMESTAMP, symbol STRING, correlation_id STRING, "
    "payload STRING, schema_version STRING")

# JSON field names of the envelope.
FIELDS = ("event_id", "event_type", "source", "timestamp", "symbol", "correlation_id", "payload", "schema_version")


def parse_envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to envelope columns plus ``error`` (NULL when well formed).

    Unknown fields are an error, as are missing type, source or payload.
    """
    text = c(column).cast("string")
    known = F.array(*[F.lit(f) for f in FIELDS])
    extra = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), known)

    def field(name: str) -> Column:
        return F.get_json_object(text, f"$.{name}")

    df = raw.withColumns({
        "event_id": field("event_id"), "event_type": field("event_type"), "source": field("source"),
        "ts": F.try_to_timestamp(field("timestamp")), "symbol": field("symbol"),
        "correlation_id": field("correlation_id"), "payload": field("payload"),
        "schema_version": F.coalesce(field("schema_version"), F.lit("1.0")),
    })
    error = (
        F.when(F.json_object_keys(text).isNull(), "not a JSON object")
        .when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(F.array_sort(extra), ", ")))
        .when(c("event_type").isNull() | c("source").isNull() | c("payload").isNull(), "missing required field"))
    return df.withColumn("error", error)


def serialize(events: DataFrame) -> DataFrame:
    """Envelope rows to a JSON ``value`` with the topic as ``topic`` (payload stays an object)."""
    head = F.to_json(F.struct(
        "event_id", "event_type", "source",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "symbol", "correlation_id",
        "schema_version"))
    body = F.concat(F.expr("left(value, length(value) - 1)"), F.lit(',"payload":'), c("payload"), F.lit("}"))
    return events.withColumn("value", head).select(
        c("event_type").alias("topic"), c("correlation_id").alias("key"), body.alias("value"))


def dead_letters(rejected: DataFrame, topic: Column, error: Column, retryable: Column) -> DataFrame:
    """Failed events in their own schema, keeping the correlation id and the original."""
    original = F.to_json(F.struct(*[n for n in (
        "event_id", "event_type", "source", "ts", "symbol", "correlation_id", "payload", "schema_version")]))
    return rejected.select(
        F.concat(F.lit("dead-"), c("event_id")).alias("event_id"), F.lit("system.dead_letter").alias("event_type"),
        F.lit("dead_letter_publisher").alias("source"), "ts", "symbol", "correlation_id",
        original.alias("original_event"), topic.alias("original_topic"), error.alias("error"),
        retryable.alias("retryable"))


def read_stream(spark: SparkSession, path: str | None = None, servers: str | None = None, topics: str | None = None) -> DataFrame:
    """Envelope stream from JSON-line files, or from Kafka where its connector is installed."""
    if servers:
        return (
            spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topics).option("startingOffsets", "earliest").load())
    return spark.readStream.schema("value STRING").text(path)
