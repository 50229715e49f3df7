"""Usage history, pins, and stores kept by namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is counted as a launch.
KINDS = ["app", "file", "folder", "extension", "command"]


def usage_scores(events: DataFrame, half_life_days: float = 14.0, as_of: Column | None = None, kinds: list[str] | None = KINDS) -> DataFrame:
    """(id, kind, usage_score, last_launched) of events(id, kind, ts), ts in whole seconds. Each launch adds 1 to a score
    that halves every half_life_days; in closed form a launch counts 2 ** -(last - ts) / half-life. The score is as of
    the last launch, or decayed on to as_of (seconds). One shuffle, pre-aggregated by id twice."""
    counted = events.where(F.col("kind").isin(*kinds)) if kinds is not None else events
    last = counted.groupBy("id").agg(F.max("ts").alias("last_launched"), F.max_by("kind", "ts").alias("kind"))
    decay = lambda seconds: F.pow(F.lit(2.0), -seconds / F.lit(86_400.0 * half_life_days))
    scores = counted.select("id", "ts").join(last, "id").groupBy("id", "kind", "last_launched").agg(F.sum(decay(F.col("last_launched") - F.col("ts"))).alias("usage_score"))
    if as_of is not None:
        scores = scores.withColumn("usage_score", F.col("usage_score") * decay(F.greatest(as_of - F.col("last_launched"), F.lit(0))))
    return scores.select("id", "kind", "usage_score", "last_launched")


def forget_prefix(table: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """The table without a namespace's rows; called for scores (id) and for pins (result_id)."""
    return table.where(~F.coalesce(F.col(id_col).startswith(prefix), F.lit(False)))


def normalized_query(col: str) -> Column:
    return F.lower(F.trim(F.col(col)))


def pin(pins: DataFrame, commands: DataFrame) -> DataFrame:
    """Pins(query, result_id, kind, title, subtitle, created_ms) after commands with the same columns and seq: the last
    command of each query and result holds, a pin that is renewed keeps its time, blank queries are refused."""
    new = commands.withColumn("query", normalized_query("query")).where(F.length("query") > 0)
    values = F.struct("kind", "title", "subtitle", "created_ms")
    last = new.groupBy("query", "result_id").agg(F.max_by(values, "seq").alias("v"), F.min("created_ms").alias("first"))
    old = pins.select("query", "result_id", F.col("created_ms").alias("old"))
    renewed = last.join(old, ["query", "result_id"], "left").select("query", "result_id", "v.kind", "v.title", "v.subtitle", F.coalesce("old", "first").alias("created_ms"))
    return pins.join(last, ["query", "result_id"], "left_anti").unionByName(renewed)


def unpin(pins: DataFrame, commands: DataFrame) -> DataFrame:
    """Pins without the exact (query, result_id) pairs of commands."""
    return pins.join(commands.select(normalized_query("query").alias("query"), "result_id").distinct(), ["query", "result_id"], "left_anti")


def unpin_matching(pins: DataFrame, commands: DataFrame) -> DataFrame:
    """Pins without those of commands(typed, result_id) whose query begins with what is typed."""
    typed = commands.select(normalized_query("typed").alias("typed"), F.col("result_id").alias("r")).distinct()
    return pins.join(typed, (F.col("result_id") == F.col("r")) & F.col("query").startswith(F.col("typed")), "left_anti")


def list_pins(pins: DataFrame, targets: DataFrame) -> DataFrame:
    """Pins, newest first, with stale: whether targets(id) has the result no longer."""
    live = targets.select(F.col("id").alias("result_id"), F.lit(True).alias("live")).distinct()
    return pins.join(live, "result_id", "left").withColumn("stale", F.col("live").isNull()).drop("live").orderBy(F.desc("created_ms"), "query", "result_id")


def namespaces(ids: DataFrame, id_col: str = "id", scheme: str = "ext") -> DataFrame:
    """(name), distinct and sorted, of ids such as ext:NAME:REST."""
    parts = F.split(F.col(id_col), ":", 3)
    return ids.where((F.get(parts, F.lit(0)) == scheme) & (F.size(parts) == 3)).select(F.get(parts, F.lit(1)).alias("name")).distinct().orderBy("name")


def purge_orphans(stores: dict[str, tuple[DataFrame, Column]], installed: DataFrame) -> dict[str, DataFrame]:
    """Every store without rows of namespaces that are not in installed(name). A store is (table, namespace of a row);
    rows with a null namespace stay."""
    out = {}
    for store, (table, namespace) in stores.items():
        named = table.withColumn("namespace_", namespace)
        orphans = named.select("namespace_").where(F.col("namespace_").isNotNull()).distinct().join(installed.select(F.col("name").alias("namespace_")), "namespace_", "left_anti")
        out[store] = named.join(orphans, "namespace_", "left_anti").select(*table.columns)
    return out


def kv_usage(kv: DataFrame, incoming: DataFrame, limit: int = 10 << 20) -> DataFrame:
    """(extension, key, bytes, refused) for incoming(extension, key, value): what the extension's store would hold, the
    key's old value not counted, and whether that is above the limit."""
    cost = F.octet_length("key") + F.octet_length("value")
    used = kv.groupBy("extension").agg(F.sum(cost).alias("used"))
    old = kv.select("extension", "key", cost.alias("old"))
    joined = incoming.withColumn("new", cost).join(used, "extension", "left").join(old, ["extension", "key"], "left")
    total = F.coalesce("used", F.lit(0)) - F.coalesce("old", F.lit(0)) + F.col("new")
    return joined.select("extension", "key", total.alias("bytes"), (total > limit).alias("refused"))


def kv_keys(kv: DataFrame, prefixes: DataFrame, limit: int = 10_000) -> DataFrame:
    """(extension, prefix, key) of kv for prefixes(extension, prefix), sorted, at most limit of each."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("extension", "prefix").orderBy("key")
    return kv.join(prefixes, "extension").where(F.col("key").startswith(F.col("prefix"))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("extension", "prefix", "key")
