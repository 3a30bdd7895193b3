"""Data-quality rules: every rule is a condition on a row, and all rules of a table run in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains, ranges and lists that the rules check against.
CLEANUP_POLICIES = ("delete", "compact", "compact,delete")
COMPRESSION_TYPES = ("none", "gzip", "snappy", "lz4", "zstd")
CLUSTER_STATUSES = ("pending", "creating", "running", "stopping", "stopped", "error")
RUNTIME_PROVIDERS = ("docker", "kubernetes", "terraform")
OPERATION_STATES = ("in progress", "succeeded", "failed")
INSTANCE_STATES = ("in_progress", "succeeded", "failed")
OPERATION_TYPES = ("provision", "deprovision", "update", "backup", "restore")
SASL_MECHANISMS = ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512", "GSSAPI")
RETENTION_PATTERNS = ("expired", "test", "all")
SERVICE_IDS = ("kafka-service",)
PLAN_IDS = ("basic", "standard", "premium")
ALERT_SEVERITIES = ("critical", "warning", "info")
EVENT_TYPES = (
    "auth.login", "auth.logout", "auth.failure", "auth.permission_denied",
    "cluster.create", "cluster.delete", "cluster.update", "cluster.start", "cluster.stop", "cluster.health_check",
    "topic.create", "topic.delete", "topic.update", "topic.purge", "topic.list", "topic.describe",
    "config.update", "config.view",
    "cleanup.topic", "cleanup.cluster", "cleanup.metadata",
    "api.request", "api.error",
    "system.start", "system.stop", "system.error",
    "data.read", "data.write", "data.delete",
)
UPDATABLE_CONFIGS = ("retention.ms", "retention.bytes", "cleanup.policy", "compression.type", "max.message.bytes",
                     "min.insync.replicas", "segment.ms", "segment.bytes", "delete.retention.ms")
FORBIDDEN_NAME_CHARACTERS = "[/\\\\,\\x00:\"';*? \\t\\r\\n=]"
TOPIC_RANGES = {"partitions": (1, 1000), "replication_factor": (1, 10), "max_message_bytes": (1, 104857600)}
CLUSTER_RANGES = {"cluster_size": (1, 10), "replication_factor": (1, 10), "partition_count": (1, 1000),
                  "retention_hours": (1, 8760), "storage_size_gb": (1, 1000)}


@dataclass(frozen=True)
class Rule:
    id: str
    broken: Column
    message: str | Column = ""
    severity: str = "error"


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(keys, rule_id, severity, message), one row per broken rule. A condition that is null is not broken."""
    found = F.array_compact(F.array(*[
        F.when(r.broken, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"),
                                  (F.lit(r.message) if isinstance(r.message, str) else r.message).alias("message")))
        for r in rules]))
    return df.select(*keys, F.explode(found).alias("_r")).select(*keys, "_r.*")


def out_of_range(name: str, low: int, high: int) -> Rule:
    c = F.col(name)
    return Rule(f"{name}_range", (c < low) | (c > high), f"{name} must be between {low} and {high}")


def not_in(name: str, domain: Sequence[str], rule: str | None = None) -> Rule:
    return Rule(rule or f"{name}_domain", ~F.col(name).isin(list(domain)), f"{name} must be one of: {', '.join(domain)}")


#: The listed value domains by what they describe.
DOMAINS = {"status": CLUSTER_STATUSES, "provider": RUNTIME_PROVIDERS, "cleanup_policy": CLEANUP_POLICIES, "compression_type": COMPRESSION_TYPES,
           "operation_state": OPERATION_STATES, "instance_state": INSTANCE_STATES, "operation_type": OPERATION_TYPES, "severity": ALERT_SEVERITIES,
           "event_type": EVENT_TYPES}


def domain_rules(**columns: str) -> list[Rule]:
    """A rule per column that must hold a value of a listed domain: ``domain_rules(state="operation_state")``."""
    return [not_in(column, DOMAINS[domain]) for column, domain in columns.items()]


def topic_rules() -> list[Rule]:
    name = F.col("name")
    return [
        Rule("name_length", (F.length(name) < 1) | (F.length(name) > 249) | name.isNull(), "name must have 1 to 249 characters"),
        Rule("name_characters", name.rlike(FORBIDDEN_NAME_CHARACTERS), "name holds a forbidden character"),
        Rule("name_dots", name.isin(".", ".."), "name must not be . or .."),
        Rule("name_reserved", name.startswith("__"), "names that start with __ are reserved"),
        *[out_of_range(c, *bounds) for c, bounds in TOPIC_RANGES.items()],
        Rule("retention_infinite", F.col("retention_ms") == -1, "retention -1 keeps data for ever"),
        Rule("retention_range", (F.col("retention_ms") < 1) & (F.col("retention_ms") != -1), "retention_ms must be at least 1"),
        Rule("insync_range", F.col("min_insync_replicas") < 1, "min_insync_replicas must be at least 1"),
        Rule("insync_over_replication", F.col("min_insync_replicas") > F.col("replication_factor"),
             "min_insync_replicas must not exceed replication_factor"),
        not_in("cleanup_policy", CLEANUP_POLICIES),
        not_in("compression_type", COMPRESSION_TYPES),
    ]


def topic_health(topics: DataFrame, partitions: DataFrame) -> DataFrame:
    """Issues per partition and warnings per topic, as violations keyed by topic name and partition."""
    hours = F.col("retention_ms") / 3600000.0
    length = F.format_string("%.1f hours", hours)
    warnings = violations(topics, ["name"], [
        Rule("low_replication", F.col("replication_factor") < 2, "replication factor is below 2", "warning"),
        Rule("single_partition", F.col("partitions") == 1, "topic has one partition", "warning"),
        Rule("short_retention", hours < 1, F.concat(F.lit("very short retention: "), length), "warning"),
        Rule("long_retention", hours > 8760, F.concat(F.lit("very long retention: "), length), "warning")])
    detail = partitions.join(topics.select("topic_id", "name", "replication_factor"), "topic_id")
    number = F.col("partition_id").cast("string")
    issues = violations(detail, ["name", "pkey", "partition_id"], [
        Rule("no_leader", F.col("leader") == -1, F.concat(F.lit("partition "), number, F.lit(" has no leader")), "issue"),
        Rule("under_replicated", F.col("isr_count") < F.col("replication_factor"),
             F.concat(F.lit("partition "), number, F.lit(" is under-replicated")), "issue")])
    return issues.unionByName(warnings, allowMissingColumns=True)


def parameter_rules(parameters: str) -> list[Rule]:
    """Rules on a VARIANT column of provisioning parameters: present values must be whole numbers in range."""
    rules = []
    for name, high in (("cluster_size", 10), ("replication_factor", None), ("retention_hours", None)):
        node = F.try_variant_get(parameters, f"$.{name}", "variant")
        number = F.try_variant_get(parameters, f"$.{name}", "bigint")
        wrong = (F.schema_of_variant(node) != "BIGINT") | number.isNull() | (number < 1)
        if high:
            wrong = wrong | (number > high)
        rules.append(Rule(name, node.isNotNull() & wrong, f"{name} must be a whole number from 1" + (f" to {high}" if high else "")))
    return rules


def cluster_rules() -> list[Rule]:
    return [*[out_of_range(c, *bounds) for c, bounds in CLUSTER_RANGES.items()],
            Rule("replication_over_size", F.col("replication_factor") > F.col("cluster_size"), "replication_factor must not exceed cluster_size"),
            not_in("sasl_mechanism", SASL_MECHANISMS)]


def not_updatable(configs: Column) -> Column:
    """Keys of a settings map that may not be changed."""
    return F.array_except(F.map_keys(configs), F.array(*[F.lit(k) for k in UPDATABLE_CONFIGS]))


def update_rules(configs: str) -> list[Rule]:
    bad = not_updatable(F.col(configs))
    return [Rule("empty", F.coalesce(F.size(configs), F.lit(0)) <= 0, "at least one setting is needed"),
            Rule("not_updatable", F.size(bad) > 0, F.concat(F.lit("not updatable: "), F.array_join(F.sort_array(bad), ", ")))]


def missing_fields(body: Column, required: Sequence[str]) -> Column:
    """Required names that a JSON object lacks; a body that is no object, or empty, lacks all of them."""
    wanted = F.array(*[F.lit(r) for r in required])
    return F.array_except(wanted, F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")))


def config_rules() -> list[Rule]:
    """Cross-field rules on configurations with one column per key."""
    def empty(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit("")) == ""
    postgres = F.col("`database.type`") == "postgresql"
    return [
        Rule("database_username", postgres & empty("database.username"), "a postgresql database needs a username"),
        Rule("database_password", postgres & empty("database.password"), "a postgresql database needs a password"),
        Rule("bootstrap_servers", empty("kafka.bootstrap_servers"), "bootstrap servers must not be empty"),
        Rule("api_port", F.col("`api.port`").try_cast("int") < 1024, "a port below 1024 needs root"),
        Rule("default_provider", ~F.col("`providers.default_provider`").isin(list(RUNTIME_PROVIDERS)), "unknown default provider"),
    ]


def widen(entries: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    """Long settings with one column per named key; the key list is fixed, so no pass collects it."""
    return entries.groupBy(entity).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def cleanup_request_rules() -> list[Rule]:
    return [Rule("max_age_hours", F.col("max_age_hours") <= 0, "max_age_hours must be a positive whole number"),
            Rule("max_age_days", F.col("max_age_days") <= 0, "max_age_days must be a positive whole number"),
            not_in("retention_pattern", RETENTION_PATTERNS, "retention_pattern")]


