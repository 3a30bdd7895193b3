"""Configuration trees in long form (entity, dotted key, value, source): layers, drift, typing, masking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

# Layers from weakest to strongest, words in sensitive keys, boolean words, mask text.
LAYERS = ("default", "file", "cli", "env")
SENSITIVE = ("password", "secret", "key", "token", "credential", "sasl_password", "ssl_key_password")
TRUE_WORDS = ("true", "yes", "1", "on")
FALSE_WORDS = ("false", "no", "0", "off")
MASK = "***MASKED***"

# Key prefix (or whole key) to the action its change calls for.
ROUTES = (("logging.level", True, "set_log_level"), ("database.", False, "restart_for_database"), ("api.", False, "restart_for_api"))


def layer_rank(source: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(LAYERS, start=1):
        rank = F.when(source == name, i).otherwise(rank)
    return rank


def resolve(entries: DataFrame, keys: Sequence[str] = ("entity", "key"), newest: Sequence[str] = ()) -> DataFrame:
    """The value of the strongest layer per key with its source; ``newest`` orders entries within a layer."""
    ranked = entries.withColumn("_rank", layer_rank(F.col("source")))
    best = F.max_by(F.struct("value", "source"), F.struct("_rank", *newest))
    return ranked.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.value").alias("value"), F.col("_b.source").alias("source"))


def set_values(entries: DataFrame, changes: DataFrame, keys: Sequence[str] = ("entity", "key")) -> DataFrame:
    """Entries after setting the changed keys; a key set below or above an existing one replaces it only if equal."""
    both = entries.select(*keys, "value", F.lit(0).alias("_rank")).unionByName(changes.select(*keys, "value", F.lit(1).alias("_rank")))
    return both.groupBy(*keys).agg(F.max_by("value", "_rank").alias("value"))


def sections(entries: DataFrame, entity: str = "entity") -> DataFrame:
    """Long form regrouped: the first part of the key as section, its settings as one sorted JSON object."""
    parts = F.split("key", r"\.", 2)
    pairs = F.sort_array(F.collect_list(F.struct(F.get(parts, F.lit(1)).alias("k"), F.col("value").alias("v"))))
    return (entries.where(F.col("key").contains(".")).groupBy(entity, parts[0].alias("section"))
            .agg(F.to_json(F.map_from_entries(pairs)).alias("settings")))


def merge_maps(base: Column, override: Column) -> Column:
    """Both maps, the override winning; does not depend on the session's duplicate-key policy."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.coalesce(F.map_concat(kept, override), base, override)


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("entity", "key")) -> DataFrame:
    """Keys whose value differs, appeared or went away, with both values."""
    joined = old.select(*keys, F.col("value").alias("old_value")).join(new.select(*keys, F.col("value").alias("new_value")), list(keys), "full_outer")
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def drift(entries: DataFrame, before: Column, keys: Sequence[str] = ("entity", "key"), newest: Sequence[str] = ()) -> DataFrame:
    """The ``diff`` between what the entries for which ``before`` holds resolve to and what all of them do, in one pass."""
    order = F.struct("_rank", *newest)
    both = entries.withColumn("_rank", layer_rank(F.col("source"))).groupBy(*keys).agg(
        F.max_by("value", F.when(before, order)).alias("old_value"), F.max_by("value", order).alias("new_value"))
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def _words(value: Column, words: Sequence[str]) -> Column:
    return F.lower(value).isin(list(words))


_WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def _whole_number(value: Column) -> Column:
    digits = F.regexp_replace(F.trim(value), "[_+]", "")
    sign = F.when(digits.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(F.regexp_replace(digits, "^-", ""), "^0+(?=[0-9])", "")
    return F.concat(F.when(bare == "0", "").otherwise(sign), bare)


def infer_environment(value: Column) -> Column:
    """Type and canonical text of an environment value: boolean words, whole number, comma list, text."""
    items = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return (F.when(_words(value, TRUE_WORDS), _typed("bool", F.lit("true")))
            .when(_words(value, FALSE_WORDS), _typed("bool", F.lit("false")))
            .when(value.rlike(_WHOLE), _typed("int", _whole_number(value)))
            .when(value.contains(","), _typed("list", F.to_json(items)))
            .when(value.isNotNull(), _typed("string", value)))


_JSON_NUMBER = r"^\s*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"


def infer_command(value: Column) -> Column:
    """Type and canonical text of a command-line value: boolean words, JSON, whole number, decimal, text.

    Numbers and words are told by pattern; only what opens like a JSON text, list or object is parsed.
    """
    bare = F.trim(value)
    node = F.try_parse_json(bare)
    kind = F.when(bare.startswith("["), "list").when(bare.startswith("{"), "object").otherwise("string")
    text = F.when(bare.startswith('"'), F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))
    container = F.struct(kind.alias("type"), text.alias("value"))
    return (F.when(_words(value, TRUE_WORDS), _typed("bool", F.lit("true")))
            .when(_words(value, FALSE_WORDS), _typed("bool", F.lit("false")))
            .when(value.rlike(r"^\s*-?(0|[1-9][0-9]*)\s*$"), _typed("int", _whole_number(value)))
            .when(value.rlike(_JSON_NUMBER), _typed("float", bare.try_cast("double").cast("string")))
            .when(bare == "null", _typed("null", F.lit("null")))
            .when(bare.rlike(r'^[\[{"]') & node.isNotNull(), container)
            .when(value.rlike(_WHOLE), _typed("int", _whole_number(value)))
            .when(bare.try_cast("double").isNotNull(), _typed("float", bare.try_cast("double").cast("string")))
            .when(value.isNotNull(), _typed("string", value)))


def _typed(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def is_sensitive(key: Column) -> Column:
    """Any part of a dotted key that contains a sensitive word makes the whole branch sensitive."""
    lowered = F.lower(key)
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in SENSITIVE])


def masked(key: Column, value: Column) -> Column:
    return F.when(is_sensitive(key), F.lit(MASK)).otherwise(value)


#: Levels that are opened without a write; only documents that are deeper than this are taken up again where they were left.
LEVELS = 24


def nesting(document: Column) -> Column:
    """How deep the objects and lists of a JSON text are nested: 0 for a bare value. Only brackets outside strings count."""
    bare = F.regexp_replace(F.regexp_replace(document, r"\\.", ""), '"[^"]*+"', "")
    brackets = F.split(F.translate(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "[]", "{}"), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(depth: Column, bracket: Column) -> Column:
        now = depth["now"] + F.when(bracket == "{", 1).when(bracket == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(depth["top"], now).alias("top"))

    return F.aggregate(brackets, start, step, lambda depth: depth["top"])


def flatten_masked(documents: DataFrame, key: Sequence[str], document: str) -> DataFrame:
    """JSON documents of any depth as (key, path, value) leaves with sensitive branches masked, through objects and lists.

    A masked branch is one leaf at its own path and an empty branch is a leaf holding {} or []. One aggregate finds the deepest
    nesting, and that many levels are opened in one go; only what is nested deeper than ``LEVELS`` is written in between, and
    only branches that are still open go on. Whether a node is a branch is never asked: a node that does not open is a leaf.
    """
    spark, keep = documents.sparkSession, list(key)

    def opened(level: DataFrame) -> DataFrame:
        inner = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_node").outer()).toDF("_pos", "_name", "_child"))
        step = F.when(F.col("_name").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(
            F.concat(F.when(F.col("_path") == "", "").otherwise("."), F.col("_name")))
        inside = F.col("_pos").isNotNull()
        hidden = inside & F.coalesce(is_sensitive(F.col("_name")), F.lit(False))
        return inner.select(
            *keep, F.when(inside, F.concat("_path", step)).otherwise(F.col("_path")).alias("_path"),
            F.when(inside & ~hidden, F.col("_child")).alias("_node"),
            F.when(hidden, F.lit(MASK)).when(~inside, F.coalesce("_leaf", text(F.col("_node")))).alias("_leaf"))

    def text(node: Column) -> Column:
        return F.try_variant_get(node, "$", "string")

    def leaves(level: DataFrame) -> DataFrame:
        return level.select(*keep, F.col("_path").alias("path"), F.coalesce("_leaf", text(F.col("_node"))).alias("value"))

    depth = documents.agg(F.max(nesting(F.col(document)))).first()[0] or 0
    level = documents.select(*keep, F.lit("").alias("_path"), F.parse_json(document).alias("_node"), F.lit(None).cast("string").alias("_leaf"))
    done: DataFrame | None = None
    while True:
        for _ in range(min(depth, LEVELS)):
            level = opened(level)
        if depth <= LEVELS:
            return leaves(level) if done is None else done.unionByName(leaves(level))
        depth -= LEVELS
        stored = materialize(level.select(*keep, "_path", F.to_json("_node").alias("_open"), "_leaf"), "leaves")
        settled = stored.where("_open IS NULL").select(*keep, F.col("_path").alias("path"), F.col("_leaf").alias("value"))
        done = settled if done is None else done.unionByName(settled)
        level = stored.where("_open IS NOT NULL").select(*keep, "_path", F.parse_json("_open").alias("_node"), F.lit(None).cast("string").alias("_leaf"))


def route_changes(changes: DataFrame) -> DataFrame:
    """Each changed key with the action it calls for; keys nobody handles are left out."""
    routes = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(w).alias("whole"), F.lit(a).alias("action")) for p, w, a in ROUTES])
    hits = F.filter(routes, lambda r: F.when(r["whole"], F.col("key") == r["prefix"]).otherwise(F.col("key").startswith(r["prefix"])))
    return changes.select("*", F.explode(hits).alias("_r")).select(*changes.columns, F.col("_r.action").alias("action"))
