"""The closed set of dotted paths that rules may name, and the vocabularies of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule paths and the flat column each one reads.
FIELD_COLUMNS = {
    "event.category": "event_category",
    "event.action": "event_action",
    "event.outcome": "event_outcome",
    "event.reason": "event_reason",
    "user.id": "user_id",
    "user.name": "user_name",
    "user.domain": "user_domain",
    "source.ip": "source_ip",
    "source.geo.country_iso_code": "source_country",
    "source.geo.city_name": "source_city",
    "service.name": "service_name",
    "service.environment": "service_environment",
    "user_agent.original": "user_agent",
}

# The words an event may use; anything else reads as "unknown".
ACTIONS = [
    "user-login",
    "user-logout",
    "mfa-challenge",
    "token-issued",
    "token-revoked",
    "permission-check",
    "password-change",
    "role-change",
    "account-lifecycle",
    "api-key-used",
    "unknown",
]
CATEGORIES = ["authentication", "iam", "session", "api", "unknown"]
OUTCOMES = ["success", "failure", "unknown"]
ENTITY_TYPES = ["user", "source_ip"]


def field(path: str) -> Column:
    """The column behind a dotted path; an unknown path fails while the plan is built."""
    try:
        return F.col(FIELD_COLUMNS[path])
    except KeyError:
        raise ValueError(
            f"unsupported field path '{path}', expected one of {sorted(FIELD_COLUMNS)}"
        ) from None


def known_or_unknown(value: Column, vocabulary: list[str]) -> Column:
    """Case-insensitive vocabulary lookup: null stays null, a foreign word becomes 'unknown'."""
    lowered = F.lower(value)
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(lowered.isin(vocabulary), lowered).otherwise(F.lit("unknown"))
    )
