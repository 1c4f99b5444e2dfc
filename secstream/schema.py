"""Fixed schemas: nested event, flat event, dead letter, alert."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENT = T.StructType(
    [
        T.StructField("@timestamp", _S),
        T.StructField("event", _struct(id=_S, category=_S, action=_S, outcome=_S, reason=_S)),
        T.StructField("user", _struct(id=_S, name=_S, domain=_S)),
        T.StructField(
            "source",
            _struct(ip=_S, port=_S, geo=_struct(country_iso_code=_S, city_name=_S)),
        ),
        T.StructField("service", _struct(name=_S, version=_S, environment=_S)),
        T.StructField("user_agent", _struct(original=_S)),
        T.StructField("labels", T.MapType(_S, _S)),
    ]
)

FLAT_EVENT = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("event_category", _S),
        T.StructField("event_action", _S),
        T.StructField("event_outcome", _S),
        T.StructField("event_reason", _S),
        T.StructField("user_id", _S),
        T.StructField("user_name", _S),
        T.StructField("user_domain", _S),
        T.StructField("source_ip", _S),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("source_country", _S),
        T.StructField("source_city", _S),
        T.StructField("service_name", _S),
        T.StructField("service_environment", _S),
        T.StructField("user_agent", _S),
        T.StructField("labels", T.MapType(_S, _S)),
        T.StructField("raw", _S),
    ]
)
FLAT_COLUMNS = FLAT_EVENT.fieldNames()

# In the archive labels are JSON text, so that a file needs no map support to be read.
ARCHIVE = T.StructType(
    [T.StructField(f.name, _S if f.name == "labels" else f.dataType) for f in FLAT_EVENT]
)
DAY_PARTS = ["year", "month", "day"]
ARCHIVE_WITH_DAY = T.StructType(
    list(ARCHIVE) + [T.StructField(part, T.IntegerType()) for part in DAY_PARTS]
)

# What a broker delivers: payload plus its coordinates.
MESSAGE = T.StructType(
    [
        T.StructField("topic", _S),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", _S),
        T.StructField("value", _S),
        T.StructField("arrived_at", T.TimestampType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("failed_at", T.TimestampType()),
        T.StructField("source_topic", _S),
        T.StructField("source_partition", T.IntegerType()),
        T.StructField("source_offset", T.LongType()),
        T.StructField("source_key", _S),
        T.StructField("failure_type", _S),
        T.StructField("failure_reason", _S),
        T.StructField("payload", _S),
        T.StructField("replayed_at", T.TimestampType()),
        T.StructField("replay_count", T.IntegerType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_id", _S),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("rule_id", _S),
        T.StructField("rule_name", _S),
        T.StructField("severity", _S),
        T.StructField("technique", _S),
        T.StructField("entity_type", _S),
        T.StructField("entity_id", _S),
        T.StructField("observed", T.LongType()),
        T.StructField("threshold", T.LongType()),
        T.StructField("context", T.MapType(_S, _S)),
        T.StructField("sample_event_ids", T.ArrayType(_S)),
        T.StructField("dedupe_key", _S),
    ]
)
ALERT_COLUMNS = ALERT.fieldNames()
