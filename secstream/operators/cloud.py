"""Cloud audit records to security events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secstream import schema
from secstream.functions.scalar import shorten, text_map

_S = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, _S) for name in names]


_ISSUER = T.StructType(_strings("type", "principalId", "arn", "accountId", "userName"))
_IDENTITY = T.StructType(
    _strings("type", "principalId", "arn", "accountId", "userName", "invokedBy")
    + [
        T.StructField(
            "sessionContext", T.StructType([T.StructField("sessionIssuer", _ISSUER)])
        )
    ]
)
RECORD = T.StructType(
    _strings(
        "eventVersion", "eventTime", "eventSource", "eventName", "eventType", "awsRegion",
        "sourceIPAddress", "userAgent", "eventID", "errorCode", "errorMessage",
    )
    + [
        T.StructField("userIdentity", _IDENTITY),
        T.StructField("responseElements", T.StructType(_strings("ConsoleLogin"))),
        T.StructField("requestParameters", _S),
        T.StructField("additionalEventData", _S),
    ]
)

# API names that mean the same as one of our actions, service categories, and the
# suffixes of service host names.
CALL_ACTIONS = {
    "ConsoleLogin": "user-login",
    "AssumeRole": "token-issued",
    "AssumeRoleWithSAML": "token-issued",
    "AssumeRoleWithWebIdentity": "token-issued",
    "GetSessionToken": "token-issued",
    "GetFederationToken": "token-issued",
    "CreateAccessKey": "api-key-used",
    "UpdateAccessKey": "api-key-used",
    "DeleteAccessKey": "token-revoked",
    "DeactivateMFADevice": "token-revoked",
    "ChangePassword": "password-change",
    "UpdateLoginProfile": "password-change",
    "CreateLoginProfile": "password-change",
    "AttachUserPolicy": "role-change",
    "AttachRolePolicy": "role-change",
    "PutUserPolicy": "role-change",
    "PutRolePolicy": "role-change",
    "AttachGroupPolicy": "role-change",
    "CreatePolicyVersion": "role-change",
    "AddUserToGroup": "role-change",
    "CreateUser": "account-lifecycle",
    "DeleteUser": "account-lifecycle",
    "CreateRole": "account-lifecycle",
    "DeleteRole": "account-lifecycle",
}
SOURCE_CATEGORIES = {
    "signin.amazonaws.com": "authentication",
    "sts.amazonaws.com": "authentication",
    "iam.amazonaws.com": "iam",
}
SERVICE_SUFFIXES = [".amazonaws.com", ".aws.internal"]
MESSAGE_LIMIT = 200


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def cloud_records(deliveries: DataFrame, value: str = "value") -> DataFrame:
    """Audit records of deliveries given as JSON text: a ``Records`` wrapper, an array or one object."""
    text = F.trim(F.col(value))
    wrapped = F.get_json_object(text, "$.Records")
    array = (
        F.when(text.startswith("["), text)
        .when(wrapped.startswith("["), wrapped)
        .otherwise(F.concat(F.lit("["), text, F.lit("]")))
    )
    return deliveries.select(F.inline(F.from_json(array, T.ArrayType(RECORD))))


def cloud_failures(deliveries: DataFrame, value: str = "value") -> DataFrame:
    """Deliveries that hold no audit record, with the reason; nothing that arrives is lost silently.

    Text that is cut or is not JSON is a PARSE_ERROR; JSON without a record is one as well.
    """
    text = F.trim(F.col(value))
    parsed = F.try_parse_json(text)
    wrapped = F.get_json_object(text, "$.Records")
    records = F.when(text.startswith("["), text).when(wrapped.isNotNull(), wrapped).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    found = F.from_json(records, T.ArrayType(RECORD))
    held = F.coalesce(F.exists(found, lambda r: r["eventName"].isNotNull()), F.lit(False))
    reason = (
        F.when(text.isNull() | (text == ""), "empty delivery")
        .when(parsed.isNull(), "delivery is not JSON")
        .when(~held, "delivery holds no audit record")
    )
    return deliveries.withColumn("failure_type", F.lit("PARSE_ERROR")).withColumn("failure_reason", reason).filter("failure_reason IS NOT NULL")




def _last_segment(arn: Column) -> Column:
    return (
        F.when(F.coalesce(arn, F.lit("")) == "", F.lit("unknown"))
        .when(arn.rlike("/[^/]+$"), F.regexp_extract(arn, r"([^/]+)$", 1))
        .otherwise(arn)
    )


def _filled(column: Column) -> Column:
    return F.when(column != "", column)


def cloud_audit_to_events(records: DataFrame, as_of=None) -> DataFrame:
    """Audit records to flat events. A record without an API name or an event id gives no event."""
    who = F.col("userIdentity")
    kind, account = who["type"], F.coalesce(who["accountId"], F.lit(""))
    principal = F.coalesce(who["principalId"], F.lit(""))
    issuer = who["sessionContext"]["sessionIssuer"]
    role = F.coalesce(_filled(issuer["userName"]), _last_segment(F.coalesce(issuer["arn"], who["arn"])))
    user = F.coalesce(who["userName"], principal)
    service = F.coalesce(who["invokedBy"], F.lit("aws"))
    other = F.coalesce(_filled(who["arn"]), _filled(principal), F.lit("unknown"))
    user_id = (
        F.when(kind == "IAMUser", user)
        .when(kind == "AssumedRole", F.concat(F.lit("role:"), role))
        .when(kind == "Root", F.concat(F.lit("root:"), account))
        .when(kind == "AWSService", F.concat(F.lit("service:"), service))
        .otherwise(other)
    )
    user_name = (
        F.when(kind == "IAMUser", user)
        .when(kind == "AssumedRole", role)
        .when(kind == "Root", "root")
        .when(kind == "AWSService", service)
        .otherwise(_last_segment(other))
    )
    domain = F.when(kind == "AWSService", "aws:service").otherwise(F.concat(F.lit("aws:"), account))
    session = F.when(
        (kind == "AssumedRole") & principal.contains(":"), F.regexp_extract(principal, r"^[^:]*:(.*)$", 1)
    )

    call, origin = F.col("eventName"), F.coalesce("eventSource", F.lit(""))
    answer = F.when(call == "ConsoleLogin", _filled(F.col("responseElements.ConsoleLogin")))
    failed = F.when(answer.isNotNull(), F.lower(answer) != "success").otherwise(
        F.col("errorCode").isNotNull()
    )
    code, message = _filled(F.col("errorCode")), _filled(F.col("errorMessage"))
    reason = F.when(
        failed,
        F.when(code.isNull(), "console login failed")
        .when(message.isNull(), code)
        .otherwise(F.concat(code, F.lit(": "), shorten(message, MESSAGE_LIMIT))),
    )

    address = _filled(F.trim("sourceIPAddress"))
    is_host = address.endswith(SERVICE_SUFFIXES[0]) | address.endswith(SERVICE_SUFFIXES[1])
    no_ip = is_host | ~address.rlike("^[0-9a-fA-F:.]+$")
    when = F.try_to_timestamp("eventTime")
    labels = text_map(
        {
            "cloud_provider": F.lit("aws"),
            "cloud_event_name": call,
            "cloud_event_source": origin,
            "cloud_region": _filled(F.col("awsRegion")),
            "cloud_account_id": _filled(account),
            "assumed_role": session,
        }
    )
    flat = records.filter(call.isNotNull() & F.col("eventID").isNotNull()).select(
        F.col("eventID").alias("event_id"),
        (when if as_of is None else F.coalesce(when, F.lit(as_of).cast("timestamp"))).alias("ts"),
        when.alias("ingested_at"),
        _lookup(SOURCE_CATEGORIES, origin, "api").alias("event_category"),
        _lookup(CALL_ACTIONS, call, "unknown").alias("event_action"),
        F.when(failed, "failure").otherwise("success").alias("event_outcome"),
        reason.alias("event_reason"),
        user_id.alias("user_id"),
        user_name.alias("user_name"),
        domain.alias("user_domain"),
        F.when(~no_ip, address).alias("source_ip"),
        F.lit(None).cast("int").alias("source_port"),
        F.lit(None).cast("string").alias("source_country"),
        F.lit(None).cast("string").alias("source_city"),
        F.when(no_ip, address).otherwise(origin).alias("service_name"),
        F.lit("aws").alias("service_environment"),
        F.col("userAgent").alias("user_agent"),
        labels.alias("labels"),
    )
    from secstream.sources.tables import nested

    return flat.withColumn("raw", F.to_json(nested())).select(*schema.FLAT_COLUMNS)


def cloud_messages(events: DataFrame, partitions: int = 6) -> DataFrame:
    """Cloud events as broker messages, so that they take the way of all others: parsing, validation, dead letters,
    de-duplication. Keyed by account; the offset is drawn from the event id, as no broker has given one yet."""
    return events.select(
        F.lit("events.raw").alias("topic"),
        F.pmod(F.xxhash64("user_id"), F.lit(partitions)).cast("int").alias("partition"),
        F.xxhash64("event_id").alias("offset"),
        F.col("user_id").alias("key"),
        F.col("raw").alias("value"),
        F.coalesce("ingested_at", "ts").alias("arrived_at"),
    )


def cloud_ingest_report(records: DataFrame) -> DataFrame:
    """Per action: published events; skipped records and unmapped API names get their own rows."""
    call = F.col("eventName")
    skipped = call.isNull() | F.col("eventID").isNull()
    action = _lookup(CALL_ACTIONS, call, "unknown")
    return records.groupBy(
        F.when(skipped, "skipped").otherwise("published").alias("result"),
        F.when(~skipped, action).alias("event_action"),
        F.when(~skipped & (action == "unknown"), call).alias("unmapped_call"),
    ).agg(F.count("*").alias("records"))
