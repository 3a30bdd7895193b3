"""Schedules, retries, error classes, status mappings and derived audit fields as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.operators.quality import EVENT_TYPES

# --- schedules ----------------------------------------------------------------------------------

CRON_PARTS = ("minute", "hour", "day", "month", "weekday")

# Schedules with an exact rule and their period in seconds; any other runs in one hour.
SCHEDULE_SECONDS = {"0 * * * *": 3600, "0 0 * * *": 86400, "*/15 * * * *": 900, "*/5 * * * *": 300}


def cron_parts(schedule: Column) -> dict[str, Column]:
    parts = F.split(F.trim(schedule), r"\s+")
    return {name: F.get(parts, F.lit(i)) for i, name in enumerate(CRON_PARTS)}


def is_cron(schedule: Column) -> Column:
    return F.size(F.split(F.trim(schedule), r"\s+")) == 5


def next_run(schedule: Column, after: Column) -> Column:
    """The next start strictly after a time: the next whole period of a known schedule, else one hour later."""
    at = F.unix_micros(after.cast("timestamp"))
    result = F.timestamp_micros(at + F.lit(3_600_000_000))
    for text, seconds in SCHEDULE_SECONDS.items():
        period = F.lit(seconds * 1_000_000)
        result = F.when(schedule == text, F.timestamp_micros((F.floor(at / period) + 1) * period)).otherwise(result)
    return result.cast("timestamp_ntz")


def is_known_schedule(schedule: Column) -> Column:
    return schedule.isin(list(SCHEDULE_SECONDS))


# --- retries ------------------------------------------------------------------------------------

# Defaults of the retry policy and error codes that are never retried.
MAX_ATTEMPTS, BASE_DELAY, MAX_DELAY, EXPONENT = 3, 1.0, 60.0, 2.0
NOT_RETRIED = ("VALIDATION_ERROR", "AUTHENTICATION_FAILED", "AUTHORIZATION_FAILED", "TOPIC_ALREADY_EXISTS",
               "INSTANCE_ALREADY_EXISTS", "TOPIC_NOT_FOUND", "INSTANCE_NOT_FOUND")


def retry_delay(strategy: Column, attempt: Column, base: float = BASE_DELAY, limit: float = MAX_DELAY, exponent: float = EXPONENT) -> Column:
    """Seconds to wait before a retry, without jitter."""
    delay = (F.when(strategy == "exponential", F.lit(base) * F.pow(F.lit(exponent), attempt - 1))
             .when(strategy == "linear", F.lit(base) * attempt).otherwise(F.lit(base)))
    return F.greatest(F.lit(0.0), F.least(delay, F.lit(limit)))


def retry_attempts(max_attempts: Column) -> Column:
    """One row per attempt."""
    return F.explode(F.when(max_attempts >= 1, F.sequence(F.lit(1), max_attempts)))


def should_retry(attempt: Column, code: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return (attempt < max_attempts) & (code.isNull() | ~code.isin(list(NOT_RETRIED)))


# --- errors -------------------------------------------------------------------------------------

# Words looked for in a message, in this order, and the class they mean.
MESSAGE_CLASSES = ((("timeout",), "KAFKA_TIMEOUT_ERROR"), (("connection", "network"), "KAFKA_CONNECTION_ERROR"),
                   (("authentication", "sasl"), "KAFKA_AUTHENTICATION_ERROR"), (("authorization", "acl"), "KAFKA_AUTHORIZATION_ERROR"))

# HTTP status of each error code; the broker API answers three of them differently.
HTTP_STATUS = {
    "VALIDATION_ERROR": 400, "AUTHENTICATION_FAILED": 401, "INVALID_API_KEY": 401, "AUTHORIZATION_FAILED": 403,
    "TOPIC_NOT_FOUND": 404, "CLUSTER_NOT_FOUND": 404, "INSTANCE_NOT_FOUND": 404, "SERVICE_NOT_FOUND": 404, "PLAN_NOT_FOUND": 404,
    "TOPIC_ALREADY_EXISTS": 409, "INSTANCE_ALREADY_EXISTS": 409, "CLEANUP_CONFLICT": 409, "OPERATION_IN_PROGRESS": 409,
    "INVALID_TOPIC_CONFIG": 422, "RATE_LIMIT_EXCEEDED": 429, "REQUEST_THROTTLED": 429,
    "INTERNAL_ERROR": 500, "KAFKA_CONNECTION_ERROR": 502, "KAFKA_TIMEOUT_ERROR": 504,
    "CLUSTER_PROVISIONING_FAILED": 500, "STORAGE_OPERATION_FAILED": 500, "PROVIDER_OPERATION_FAILED": 500,
}
BROKER_STATUS = {"INSTANCE_NOT_FOUND": 410, "INSTANCE_ALREADY_EXISTS": 409, "OPERATION_IN_PROGRESS": 422}


def classify_error(message: Column) -> Column:
    lowered, result = F.lower(message), F.lit("INTERNAL_ERROR")
    for words, code in reversed(MESSAGE_CLASSES):
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        result = F.when(hit, code).otherwise(result)
    return result


def _lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), default)


def http_status(code: Column, broker: bool = False) -> Column:
    return _lookup({**HTTP_STATUS, **BROKER_STATUS} if broker else HTTP_STATUS, code, F.lit(500))


# --- states and plans ---------------------------------------------------------------------------

# Operation state of each instance status (others are in progress) and the plan defaults.
OPERATION_STATE = {"running": "succeeded", "error": "failed"}
PLANS = {
    "basic": {"cluster_size": 1, "replication_factor": 1, "partition_count": 3, "retention_hours": 24, "storage_size_gb": 5,
              "enable_ssl": False, "enable_sasl": False},
    "standard": {"cluster_size": 3, "replication_factor": 3, "partition_count": 6, "retention_hours": 168, "storage_size_gb": 20,
                 "enable_ssl": False, "enable_sasl": False},
    "premium": {"cluster_size": 5, "replication_factor": 3, "partition_count": 12, "retention_hours": 720, "storage_size_gb": 100,
                "enable_ssl": True, "enable_sasl": True},
}
PLAN_PROPERTIES = {"premium": {"auto.create.topics.enable": "false", "delete.topic.enable": "true",
                               "log.retention.check.interval.ms": "300000"}}


def operation_state(status: Column) -> Column:
    return _lookup(OPERATION_STATE, status, F.lit("in progress"))


def operation_description(status: Column) -> Column:
    """Fixed wording: clients of the operation table show these sentences and match on them."""
    return (F.when(status == "running", "Service instance is running")
            .when(status.isin("creating", "stopping"), F.concat(F.lit("Service instance is "), status))
            .when(status == "error", "Service instance failed")
            .otherwise(F.concat(F.lit("Service instance status: "), status)))


def plan_value(plan: Column, name: str) -> Column:
    """The plan's default; an unknown plan counts as standard."""
    value = F.lit(PLANS["standard"][name])
    for other in ("basic", "premium"):
        value = F.when(plan == other, F.lit(PLANS[other][name])).otherwise(value)
    return value


def effective_cluster(plan: Column, overrides: dict[str, Column]) -> list[Column]:
    """One column per cluster setting: the given parameter, else the plan's default."""
    return [(F.coalesce(overrides[name], plan_value(plan, name)) if name in overrides else plan_value(plan, name)).alias(name)
            for name in PLANS["standard"]]


def plan_properties(plan: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    value = none
    for name, properties in PLAN_PROPERTIES.items():
        value = F.when(plan == name, F.create_map(*[F.lit(x) for pair in properties.items() for x in pair])).otherwise(value)
    return value


# --- audit --------------------------------------------------------------------------------------

# Event families and what an unknown operation of each counts as; the operations are those of the event types.
AUDIT_DEFAULTS = {"cluster": "update", "topic": "update", "system": "error"}
AUDIT_OPERATIONS = {family: (tuple(e.partition(".")[2] for e in EVENT_TYPES if e.startswith(f"{family}.")), default)
                    for family, default in AUDIT_DEFAULTS.items()}


def event_type(family: Column, operation: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, (known, default) in AUDIT_OPERATIONS.items():
        verb = F.when(operation.isin(list(known)), operation).otherwise(default)
        result = F.when(family == name, F.concat(F.lit(f"{name}."), verb)).otherwise(result)
    return result


def is_success(status_code: Column) -> Column:
    return (status_code >= 200) & (status_code < 400)


def request_level(status_code: Column) -> Column:
    return F.when(is_success(status_code), "info").otherwise("warning")


def request_result(status_code: Column) -> Column:
    return F.when(is_success(status_code), "success").otherwise("failure")


def request_message(method: Column, path: Column, status_code: Column, duration_ms: Column) -> Column:
    """``API GET /x -> 200 (1.5ms)``; the duration is left out where it is missing or zero. Fixed wording: log searches
    match on it."""
    timing = F.when(F.coalesce(duration_ms, F.lit(0.0)) != 0, F.format_string(" (%.1fms)", duration_ms)).otherwise("")
    return F.concat(F.lit("API "), method, F.lit(" "), path, F.lit(" -> "), status_code.cast("string"), timing)
