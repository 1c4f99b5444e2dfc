"""From broker messages to stored events: parse, validate, quarantine, de-duplicate, flatten."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secstream import schema
from secstream.functions.fields import ACTIONS, CATEGORIES, OUTCOMES, known_or_unknown
from secstream.functions.scalar import as_time, at_most, is_address, shorten
from secstream.functions.ordered import running_before

# Failure types, reasons and the length at which a reason is cut.
PARSE_ERROR = "PARSE_ERROR"
VALIDATION_ERROR = "VALIDATION_ERROR"
PERSIST_ERROR = "PERSIST_ERROR"
REASON_LIMIT = 500

_BROKEN = "_broken"
_WIRE = T.StructType(list(schema.EVENT) + [T.StructField(_BROKEN, T.StringType())])
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to the nested event. Unknown fields are ignored; text that is not an event gives
    ``event_data`` null and never an error. Adds ``event_data``, ``event_ts``, ``parse_problem``."""
    text = F.col(value)
    parsed = F.from_json(text, _WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    stamp, port = F.col("event_data.`@timestamp`"), F.col("event_data.source.port")
    # Generating the column instead of projecting it keeps the optimizer from copying from_json
    # into every expression that reads a field, so each message is parsed once.
    once = F.inline(F.array(F.struct(parsed.alias("event_data"))))
    return (
        raw.select("*", once)
        .withColumn("event_ts", F.when(stamp.rlike(_ISO), F.try_to_timestamp(stamp)))
        .withColumn(
            "parse_problem",
            F.when(text.isNull() | ~F.ltrim(text).startswith("{"), "not a JSON object")
            .when(F.col(f"event_data.{_BROKEN}").isNotNull(), "malformed JSON")
            .when(
                stamp.isNotNull() & F.col("event_ts").isNull(),
                F.concat(F.lit("@timestamp is not an instant: "), stamp),
            )
            .when(
                port.isNotNull() & port.try_cast("int").isNull(),
                F.concat(F.lit("source.port is not a number: "), port),
            ),
        )
    )


def message_times(parsed: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Add ``time`` and ``time_from`` to parsed messages: the event's own time; without one the stream time, which is
    the newest event time that its partition has seen before; without that the time the broker gave it.

    ``held`` has the stream time that earlier batches left (``topic, partition, stream_time``). A partition is read
    in slices of a million offsets, so none has to fit in one task.
    """
    place = parsed.withColumn("_at", F.timestamp_micros("offset"))
    seen = running_before(place, ["topic", "partition"], "_at", [], {"_stream": ("max", F.col("event_ts"))}, "1 second").drop("_at")
    if held is not None:
        seen = seen.join(held, ["topic", "partition"], "left").withColumn("_stream", F.greatest("_stream", "stream_time")).drop("stream_time")
    origin = F.when(F.col("event_ts").isNotNull(), "event").when(F.col("_stream").isNotNull(), "stream").otherwise("broker")
    return seen.withColumns({"time": F.coalesce("event_ts", "_stream", "arrived_at"), "time_from": origin}).drop("_stream")


def validate_events(parsed: DataFrame) -> DataFrame:
    """Add ``failure_type`` and ``failure_reason``; both are null for a usable event."""
    ip = F.col("event_data.source.ip")
    missing = F.coalesce(
        F.when(F.col("event_ts").isNull(), "missing required field @timestamp"),
        F.when(F.col("event_data.event.id").isNull(), "missing required field event.id"),
        F.when(F.col("event_data.user.id").isNull(), "missing required field user.id"),
    )
    unstorable = F.when(
        ip.isNotNull() & ~is_address(ip), F.concat(F.lit("source.ip is not an address: "), ip)
    )
    problem = F.col("parse_problem")
    return (
        parsed.withColumn("_missing", missing)
        .withColumn("_unstorable", unstorable)
        .withColumn(
            "failure_type",
            F.when(problem.isNotNull(), PARSE_ERROR)
            .when(F.col("_missing").isNotNull(), VALIDATION_ERROR)
            .when(F.col("_unstorable").isNotNull(), PERSIST_ERROR),
        )
        .withColumn("failure_reason", F.coalesce(problem, "_missing", "_unstorable"))
        .drop("_missing", "_unstorable", "parse_problem")
    )


def flatten_events(valid: DataFrame, arrived: str = "arrived_at") -> DataFrame:
    """Nested events to the flat columns, with the vocabulary normalised and the document kept."""
    e = "event_data."
    columns = {
        "event_id": F.col(e + "event.id"),
        "ts": F.col("event_ts"),
        "ingested_at": F.col(arrived),
        "event_category": known_or_unknown(F.col(e + "event.category"), CATEGORIES),
        "event_action": known_or_unknown(F.col(e + "event.action"), ACTIONS),
        "event_outcome": known_or_unknown(F.col(e + "event.outcome"), OUTCOMES),
        "event_reason": F.col(e + "event.reason"),
        "user_id": F.col(e + "user.id"),
        "user_name": F.col(e + "user.name"),
        "user_domain": F.col(e + "user.domain"),
        "source_ip": F.col(e + "source.ip"),
        "source_port": F.col(e + "source.port").try_cast("int"),
        "source_country": F.col(e + "source.geo.country_iso_code"),
        "source_city": F.col(e + "source.geo.city_name"),
        "service_name": F.col(e + "service.name"),
        "service_environment": F.col(e + "service.environment"),
        "user_agent": F.col(e + "user_agent.original"),
        "labels": F.col(e + "labels"),
        "raw": F.to_json(F.col("event_data")),
    }
    arrival = [c for c in ("topic", "partition", "offset") if c in valid.columns]
    return valid.select(*[column.alias(name) for name, column in columns.items()], *arrival)


def dedupe_events(
    events: DataFrame, existing: DataFrame | None = None, tie: tuple[str, ...] = ("partition", "offset")
) -> DataFrame:
    """Keep the first arrival of each ``(event_id, ts)`` that is not stored yet.

    ``rank = 1`` becomes a group limit before the shuffle, so a message delivered a million times
    reaches the reducer as one row per map task. Stored events are only read for the days the
    batch touches.
    """
    order = Window.partitionBy("event_id", "ts").orderBy(
        "ingested_at", *[c for c in tie if c in events.columns]
    )
    first = events.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    if existing is None:
        return first
    stored = existing
    if set(schema.DAY_PARTS) <= set(existing.columns):
        # the days themselves, not the span from the oldest to the newest: one wrong clock costs one more day
        touched = events.agg(F.collect_set(F.to_date("ts")).alias("days")).scalar()
        stored = existing.filter(F.array_contains(touched, F.make_date("year", "month", "day")))
    return first.join(stored.select("event_id", "ts"), ["event_id", "ts"], "left_anti")


def dead_letters(validated: DataFrame, as_of=None) -> DataFrame:
    """Unusable messages with their coordinates; the reason is cut to a bounded length."""
    failed_at = F.col("arrived_at") if as_of is None else as_time(as_of)
    return validated.filter(F.col("failure_type").isNotNull()).select(
        failed_at.alias("failed_at"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.col("key").alias("source_key"),
        "failure_type",
        shorten(F.col("failure_reason"), REASON_LIMIT).alias("failure_reason"),
        F.col("value").alias("payload"),
        F.lit(None).cast("timestamp").alias("replayed_at"),
        F.lit(0).alias("replay_count"),
    )


def dlq_archive(dead: DataFrame) -> DataFrame:
    """One row per failed source coordinate, however often the failure was delivered."""
    key = ["source_topic", "source_partition", "source_offset"]
    order = Window.partitionBy(*key).orderBy("failed_at")
    return dead.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


@dataclass
class Ingested:
    good: DataFrame
    dead: DataFrame
    counters: DataFrame


def ingest_batch(raw: DataFrame, existing: DataFrame | None = None, as_of=None) -> Ingested:
    """Messages to (new flat events, dead letters, counters)."""
    validated = validate_events(parse_events(raw))
    usable = flatten_events(validated.filter(F.col("failure_type").isNull()))
    good = dedupe_events(usable, existing).select(*schema.FLAT_COLUMNS)
    dead = dlq_archive(dead_letters(validated, as_of))
    counters = validated.agg(
        F.count("*").alias("received"),
        F.count_if(F.col("failure_type").isNotNull()).alias("rejected"),
    ).withColumn("ingested", good.agg(F.count("*")).scalar())
    counters = counters.withColumn(
        "duplicates", F.col("received") - F.col("rejected") - F.col("ingested")
    )
    return Ingested(good, dead, counters)


def replay_candidates(
    dead: DataFrame, failure_type: str | None = None, limit: int | None = None, include_replayed: bool = False
) -> DataFrame:
    rows = dead
    if failure_type is not None:
        rows = rows.filter(F.col("failure_type") == failure_type)
    if not include_replayed:
        rows = rows.filter(F.col("replayed_at").isNull())
    return rows.orderBy("failed_at", "source_partition", "source_offset").transform(at_most, limit)


@dataclass
class Replayed:
    ingested: Ingested
    bookkeeping: DataFrame


def dlq_replay(
    dead: DataFrame,
    failure_type: str | None = None,
    limit: int | None = None,
    include_replayed: bool = False,
    existing: DataFrame | None = None,
    as_of=None,
) -> Replayed:
    """Feed dead letters through ingest again and count the replay on the ones taken."""
    taken = replay_candidates(dead, failure_type, limit, include_replayed)
    now = F.current_timestamp() if as_of is None else as_time(as_of)
    again = taken.select(
        F.col("source_topic").alias("topic"),
        F.col("source_partition").alias("partition"),
        F.col("source_offset").alias("offset"),
        F.col("source_key").alias("key"),
        F.col("payload").alias("value"),
        now.alias("arrived_at"),
    )
    key = ["source_topic", "source_partition", "source_offset"]
    mark = F.coalesce(F.col("_taken"), F.lit(False))
    bookkeeping = (
        dead.join(taken.select(*key, F.lit(True).alias("_taken")), key, "left")
        .withColumn("replayed_at", F.when(mark, now).otherwise(F.col("replayed_at")))
        .withColumn("replay_count", F.col("replay_count") + mark.cast("int"))
        .select(*dead.columns)
    )
    return Replayed(ingest_batch(again, existing, as_of), bookkeeping)


def dlq_list(dead: DataFrame, failure_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest dead letters with the first 300 characters of the payload."""
    rows = dead if failure_type is None else dead.filter(F.col("failure_type") == failure_type)
    return (
        rows.withColumn("preview", F.substring("payload", 1, 300))
        .drop("payload")
        .orderBy(F.desc("failed_at"), "source_partition", "source_offset")
        .transform(at_most, limit)
    )


def dlq_summary(dead: DataFrame) -> DataFrame:
    return dead.groupBy("failure_type").agg(
        F.count("*").alias("failures"),
        F.min("failed_at").alias("first_failed"),
        F.max("failed_at").alias("last_failed"),
        F.count_if(F.col("replayed_at").isNotNull()).alias("replayed"),
    )


# The contract of an event document. Objects other than ``labels`` are closed.
CONTRACT_TYPES = {
    "@timestamp": "STRING",
    "event": "OBJECT",
    "event.id": "STRING",
    "event.category": "STRING",
    "event.action": "STRING",
    "event.outcome": "STRING",
    "event.reason": "STRING",
    "user": "OBJECT",
    "user.id": "STRING",
    "user.name": "STRING",
    "user.domain": "STRING",
    "source": "OBJECT",
    "source.ip": "STRING",
    "source.port": "BIGINT",
    "source.geo": "OBJECT",
    "source.geo.country_iso_code": "STRING",
    "source.geo.city_name": "STRING",
    "service": "OBJECT",
    "service.name": "STRING",
    "service.version": "STRING",
    "service.environment": "STRING",
    "user_agent": "OBJECT",
    "user_agent.original": "STRING",
    "labels": "OBJECT",
}
CONTRACT_REQUIRED = [
    "@timestamp", "event", "user", "event.id", "event.action", "event.outcome", "user.id",
]
CONTRACT_OUTCOMES = ["success", "failure", "unknown"]


def schema_conformance(raw: DataFrame, value: str = "value") -> DataFrame:
    """How often each path breaks the document contract: missing, unknown, wrong type or value.

    All but one of the checks depend on a document's shape alone, so documents of one shape and outcome
    are counted first, from one parse each, and one of them is looked at path by path.
    """
    document = F.try_parse_json(value)
    shape = F.schema_of_variant("_doc").alias("_shape")
    outcome_text = F.try_variant_get("_doc", "$.event.outcome", "string").alias("_outcome")
    raw = (
        raw.select(value, F.inline(F.array(F.struct(document.alias("_doc")))))
        .select(value, shape, outcome_text)
        .groupBy("_shape", "_outcome")
        .agg(F.first(value).alias(value), F.count("*").alias("_documents"))
        .select(value, "_documents")
    )
    closed = ["", *[p for p, kind in CONTRACT_TYPES.items() if kind == "OBJECT" and p != "labels"]]

    def at(path: str) -> Column:
        return F.try_variant_get("_doc", _json_path(path), "variant")

    def kind(path: str) -> Column:
        return F.regexp_extract(F.schema_of_variant(at(path)), r"^[A-Z]+", 0)

    def problem(path: Column, name: str) -> Column:
        return F.struct(path.alias("path"), F.lit(name).alias("problem"))

    checks: list[Column] = []
    for path, wanted in CONTRACT_TYPES.items():
        checks.append(F.when(at(path).isNotNull() & (kind(path) != wanted), problem(F.lit(path), "wrong_type")))
    for path in CONTRACT_REQUIRED:
        parent = path.rpartition(".")[0]
        owner = kind(parent) == "OBJECT" if parent else F.lit(True)
        checks.append(F.when(owner & at(path).isNull(), problem(F.lit(path), "missing")))
    outcome = F.try_variant_get("_doc", "$.event.outcome", "string")
    checks.append(F.when(~outcome.isin(CONTRACT_OUTCOMES), problem(F.lit("event.outcome"), "wrong_value")))
    strangers = []
    for owner in closed:
        text = F.col(value) if not owner else F.get_json_object(value, _json_path(owner))
        prefix = f"{owner}." if owner else ""
        known = [p[len(prefix):] for p in CONTRACT_TYPES if p.startswith(prefix) and "." not in p[len(prefix):]]
        keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
        full = F.transform(extra, partial(_under, prefix))
        strangers.append(F.transform(full, lambda path: problem(path, "unknown")))
    broken = F.array(problem(F.lit("$"), "not_an_object"))
    return (
        raw.select("*", F.inline(F.array(F.struct(document.alias("_doc")))))
        .select(
            "_documents",
            F.explode(
                F.when(
                    F.coalesce(F.regexp_extract(F.schema_of_variant("_doc"), r"^[A-Z]+", 0) != "OBJECT", F.lit(True)),
                    broken,
                ).otherwise(F.concat(F.array_compact(F.array(*checks)), *strangers))
            ).alias("p"),
        )
        .groupBy("p.path", "p.problem")
        .agg(F.sum("_documents").alias("occurrences"))
    )


def _under(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key)


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split(".")) if path else "$"
