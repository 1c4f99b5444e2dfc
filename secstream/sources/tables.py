"""Security events, raw messages and cloud audit records derived from the activity table.

The activity table (``event_id, ts, user_id, event_type, value, props``) is turned row by row into
the three inputs the library works on. Everything is a column expression over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream import schema
from secstream.session import use_utc

CITIES = {
    "DE": "Berlin", "GR": "Athens", "NL": "Amsterdam", "GB": "London", "US": "New York",
    "RU": "Moscow", "SG": "Singapore", "BR": "Sao Paulo",
}
BROWSERS = ["Firefox/128.0", "Chrome/126.0", "Safari/17.5", "Edge/126.0"]
SCRIPT_AGENT = "python-requests/2.32.3"
SCENARIOS = ["brute-force", "credential-stuffing", "session-hijack", "privilege-escalation"]
TECHNIQUES = ["T1110.001", "T1110.004", "T1539", "T1068"]


def _pick(words: list[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), position.cast("int") + 1)


def activity(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The activity rows; ``dealt`` spreads them over tasks whatever the files' row groups, in ranges: neighbours compress well."""
    use_utc(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (rows.repartitionByRange("event_id") if dealt else rows).select(
        F.col("event_id").alias("n"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("u"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def security_events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Flat events (19 columns), one per activity row."""
    return _events(spark, sf_dir, dealt).select(*schema.FLAT_COLUMNS)


def _events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    n, u, k, kind = (F.col(c) for c in ("n", "u", "k", "event_type"))
    home = k < 80
    login = kind.isin("signup", "error")
    action = (
        F.when(login, "user-login")
        .when(kind == "view", "token-issued")
        .when(kind == "click", "permission-check")
        .when(k % 10 == 0, "role-change")
        .when(k % 10 < 3, "password-change")
        .otherwise("api-key-used")
    )
    failed = (kind == "error") | ((kind == "click") & (k % 3 == 0))
    country = F.when(home, _pick(["DE", "GR", "NL", "GB", "US"], u % 5)).otherwise(
        _pick(["RU", "SG", "BR"], k % 3)
    )
    city = F.create_map(*[F.lit(x) for pair in CITIES.items() for x in pair])
    scenario = _pick(SCENARIOS, k % 4)
    labels = F.when(
        k >= 90,
        F.create_map(
            F.lit("scenario"), scenario,
            F.lit("run_id"), F.concat(scenario, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")),
            F.lit("attack_technique"), _pick(TECHNIQUES, k % 4),
        ),
    )
    flat = activity(spark, sf_dir, dealt).select(
        "n", "u", "k",
        F.concat(F.lit("e-"), F.lpad(n.cast("string"), 8, "0")).alias("event_id"),
        "ts",
        F.timestamp_micros(
            F.unix_micros("ts") + F.round(F.col("value") * 100000).cast("long")
        ).alias("ingested_at"),
        F.when(login | (kind == "view"), "authentication")
        .when(kind == "click", "session")
        .when(k % 10 < 3, "iam")
        .otherwise("api")
        .alias("event_category"),
        action.alias("event_action"),
        F.when(failed, "failure").otherwise("success").alias("event_outcome"),
        F.when((kind == "error") & (k % 20 == 7), "account disabled")
        .when(kind == "error", "invalid credentials")
        .when(failed, "forbidden")
        .alias("event_reason"),
        F.concat(F.lit("u-"), F.lpad(u.cast("string"), 5, "0")).alias("user_id"),
        F.when((kind == "purchase") & (k % 25 == 0), "root")
        .otherwise(F.concat(F.lit("user"), u.cast("string")))
        .alias("user_name"),
        F.lit("corp").alias("user_domain"),
        F.when(
            home,
            F.concat_ws(".", F.lit("10"), (u % 64).cast("string"), (u % 256).cast("string"), (k % 3 + 1).cast("string")),
        )
        .otherwise(F.concat(F.lit("203.0.113."), k.cast("string")))
        .alias("source_ip"),
        (F.lit(1024) + k * 7 + u % 1000).cast("int").alias("source_port"),
        country.alias("source_country"),
        city[country].alias("source_city"),
        F.when(kind == "purchase", "iam").otherwise("sso").alias("service_name"),
        F.when(kind == "purchase", "aws").otherwise("prod").alias("service_environment"),
        F.when(home, _pick(BROWSERS, u % 4)).otherwise(F.lit(SCRIPT_AGENT)).alias("user_agent"),
        labels.alias("labels"),
    )
    return flat.withColumn("raw", F.to_json(nested()))


def nested() -> Column:
    """The nested event of a flat row (absent values are left out by ``to_json``)."""
    return F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"),
        F.struct(
            F.col("event_id").alias("id"),
            F.col("event_category").alias("category"),
            F.col("event_action").alias("action"),
            F.col("event_outcome").alias("outcome"),
            F.col("event_reason").alias("reason"),
        ).alias("event"),
        F.struct(
            F.col("user_id").alias("id"),
            F.col("user_name").alias("name"),
            F.col("user_domain").alias("domain"),
        ).alias("user"),
        F.struct(
            F.col("source_ip").alias("ip"),
            F.col("source_port").alias("port"),
            F.struct(
                F.col("source_country").alias("country_iso_code"),
                F.col("source_city").alias("city_name"),
            ).alias("geo"),
        ).alias("source"),
        F.struct(
            F.col("service_name").alias("name"),
            F.col("service_environment").alias("environment"),
        ).alias("service"),
        F.struct(F.col("user_agent").alias("original")).alias("user_agent"),
        F.col("labels"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker messages: every event as JSON text, some damaged, some delivered twice.

    By the activity row's ``k``: 4, 14, 24 … are delivered twice; 50 is cut JSON; 51 lacks the
    time; 52 has a nonsense time; 53 lacks the event id; 54 lacks the user id; 55 has a bad
    address; 56 an unknown action; 57 an upper-case action; 58 an extra key; 59 a bad port.
    """
    k = F.col("k")
    edits = [
        (51, r'"@timestamp":"[^"]*",', ""),
        (52, r'"@timestamp":"[^"]*"', '"@timestamp":"nonsense"'),
        (53, r'"id":"e-\d+",', ""),
        (54, r'"id":"u-\d+",', ""),
        (55, r'"ip":"[^"]*"', '"ip":"not-an-address"'),
        (56, r'"action":"[^"]*"', '"action":"teleport"'),
        (57, r'"action":"[^"]*"', '"action":"USER-LOGIN"'),
        (58, r"^\{", '{"trace":"t-1",'),
        (59, r'"port":\d+', '"port":"many"'),
    ]
    pattern, replacement = F.when(k < 0, F.lit("")), F.when(k < 0, F.lit(""))
    for number, found, new in edits:
        pattern = pattern.when(k == number, F.lit(found))
        replacement = replacement.when(k == number, F.lit(new))
    edited = F.regexp_replace("raw", pattern.otherwise("^$"), replacement.otherwise(""))
    copies = F.when(k % 10 == 4, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        _events(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .select(
            F.lit("events.raw").alias("topic"),
            (F.col("u") % 6).cast("int").alias("partition"),
            (F.col("n") * 2 + F.col("copy")).alias("offset"),
            F.col("user_id").alias("key"),
            F.when(k == 50, F.substring(edited, 1, 40)).otherwise(edited).alias("value"),
            F.timestamp_micros(
                F.unix_micros("ingested_at") + F.col("copy") * F.lit(5_000_000)
            ).alias("arrived_at"),
        )
    )


CLOUD_CALLS = [
    "ConsoleLogin", "AssumeRole", "CreateAccessKey", "DeleteAccessKey", "ChangePassword",
    "AttachUserPolicy", "CreateUser", "DeleteTrail", "StopLogging", "DescribeInstances",
]
CLOUD_SOURCES = [
    "signin.amazonaws.com", "sts.amazonaws.com", "iam.amazonaws.com", "iam.amazonaws.com",
    "iam.amazonaws.com", "iam.amazonaws.com", "iam.amazonaws.com", "cloudtrail.amazonaws.com",
    "cloudtrail.amazonaws.com", "ec2.amazonaws.com",
]
CLOUD_ACCOUNT = "123456789012"


def cloud_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud audit deliveries as JSON text, one per activity row, in the three envelope shapes.

    The API call follows ``k % 10``, the identity type ``u % 5``, the envelope ``n % 3``; calls
    with ``k % 7 = 0`` carry an error, and ``k % 11 = 0`` records lack their API name.
    """
    n, u, k = F.col("n"), F.col("u"), F.col("k")
    rows = activity(spark, sf_dir)
    arn = F.concat(F.lit(f"arn:aws:iam::{CLOUD_ACCOUNT}:"))
    name = F.concat(F.lit("user"), u.cast("string"))
    role = F.concat(F.lit("role"), (u % 7).cast("string"))
    kind = _pick(["IAMUser", "AssumedRole", "Root", "AWSService", "AWSAccount"], u % 5)
    record = F.struct(
        F.lit("1.08").alias("eventVersion"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"),
        _pick(CLOUD_SOURCES, k % 10).alias("eventSource"),
        F.when(k % 11 != 0, _pick(CLOUD_CALLS, k % 10)).alias("eventName"),
        F.lit("eu-west-1").alias("awsRegion"),
        F.when(u % 5 == 3, "config.amazonaws.com")
        .when(k % 13 == 0, "AWS Internal")
        .otherwise(F.concat(F.lit("203.0.113."), (u % 250).cast("string")))
        .alias("sourceIPAddress"),
        F.lit("aws-cli/2.17.0").alias("userAgent"),
        F.concat(F.lit("c-"), F.lpad(n.cast("string"), 8, "0")).alias("eventID"),
        F.when(k % 7 == 0, "AccessDenied").alias("errorCode"),
        F.when(k % 14 == 0, F.repeat(F.lit("denied "), 40)).alias("errorMessage"),
        F.struct(
            kind.alias("type"),
            F.when(u % 5 == 1, F.concat(F.lit("AROA:session-"), k.cast("string")))
            .otherwise(F.concat(F.lit("AIDA"), u.cast("string")))
            .alias("principalId"),
            F.when(u % 5 == 4, F.concat(arn, F.lit("partner/"), name))
            .otherwise(F.concat(arn, F.lit("user/"), name))
            .alias("arn"),
            F.lit(CLOUD_ACCOUNT).alias("accountId"),
            F.when(u % 5 == 0, name).alias("userName"),
            F.when(u % 5 == 3, "config.amazonaws.com").alias("invokedBy"),
            F.when(
                u % 5 == 1,
                F.struct(
                    F.struct(
                        F.concat(arn, F.lit("role/"), role).alias("arn"),
                        F.when(u % 2 == 0, role).alias("userName"),
                    ).alias("sessionIssuer")
                ),
            ).alias("sessionContext"),
        ).alias("userIdentity"),
        F.when(
            k % 10 == 0,
            F.struct(F.when(u % 3 == 0, "Failure").otherwise("Success").alias("ConsoleLogin")),
        ).alias("responseElements"),
        F.when(k % 5 == 0, "AwsServiceEvent").otherwise("AwsApiCall").alias("eventType"),
    )
    text = F.to_json(record)
    return rows.select(
        F.when(n % 3 == 0, F.concat(F.lit('{"Records":['), text, F.lit("]}")))
        .when(n % 3 == 1, F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
        .alias("value")
    )
