"""Table and event schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FILE_ENTRY = _struct(("length", T.LongType()), ("path", T.ArrayType(T.StringType())))

SIGHTINGS = _struct(
    ("infohash", T.BinaryType()),
    ("first_seen", T.TimestampType()),
    ("last_seen", T.TimestampType()),
    ("source_counts", T.MapType(T.StringType(), T.LongType())),
    ("total_seen", T.LongType()),
)

METADATA = _struct(
    ("infohash", T.BinaryType()),
    ("name", T.StringType()),
    ("piece_length", T.LongType()),
    ("total_size", T.LongType()),
    ("file_count", T.IntegerType()),
    ("files", T.ArrayType(FILE_ENTRY)),
    ("fetch_attempts", T.IntegerType()),
    ("verified_at", T.TimestampType()),
)

JOBS = _struct(
    ("infohash", T.BinaryType()),
    ("status", T.StringType()),
    ("retry_count", T.IntegerType()),
    ("next_retry_at", T.TimestampType()),
    ("last_error", T.StringType()),
    ("updated_at", T.TimestampType()),
)

METRICS = _struct(
    ("ts", T.TimestampType()),
    ("metric_name", T.StringType()),
    ("metric_value", T.LongType()),
)

SIGHTING_EVENTS = _struct(
    ("infohash", T.BinaryType()), ("source", T.StringType()), ("ts", T.TimestampType())
)

OUTCOME_EVENTS = _struct(
    ("infohash", T.BinaryType()),
    ("outcome", T.StringType()),
    ("error", T.StringType()),
    ("ts", T.TimestampType()),
)

PAYLOADS = _struct(("infohash", T.BinaryType()), ("payload", T.BinaryType()))

PARSED_PAYLOAD = _struct(
    ("name", T.StringType()),
    ("piece_length", T.LongType()),
    ("total_size", T.LongType()),
    ("file_count", T.LongType()),
    ("files", T.ArrayType(FILE_ENTRY)),
)

# Rows to classify: every spelling of a field that input files use, merged by
# sources.files.read_items.
ITEMS = _struct(
    ("infohash", T.StringType()),
    ("id", T.StringType()),
    ("idx", T.StringType()),
    ("name", T.StringType()),
    ("file_count", T.LongType()),
    ("total_size", T.LongType()),
    ("total_size_bytes", T.LongType()),
    ("top_dirs", T.ArrayType(T.StringType())),
    ("files", T.ArrayType(T.StringType())),
    ("label_category", T.StringType()),
    ("label_keep", T.BooleanType()),
    ("true_category", T.StringType()),
)

CANDIDATES = T.ArrayType(_struct(("category", T.StringType()), ("confidence", T.DoubleType())))

PREDICTIONS = _struct(
    ("infohash", T.StringType()),
    ("idx", T.StringType()),
    ("category", T.StringType()),
    ("confidence", T.DoubleType()),
    ("method", T.StringType()),
    ("model", T.StringType()),
    ("classifier", T.StringType()),
    ("top_candidates", CANDIDATES),
    ("raw_output", T.StringType()),
    ("parse_status", T.StringType()),
    ("retry_used", T.BooleanType()),
    ("latency_ms", T.DoubleType()),
)

ANCHORS = _struct(("category", T.StringType()), ("anchors", T.ArrayType(T.StringType())))
LABEL_MAP = _struct(("idx", T.LongType()), ("category", T.StringType()), ("keep", T.BooleanType()))
FEWSHOT = _struct(("user", T.StringType()), ("assistant", T.StringType()))
