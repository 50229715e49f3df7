"""Package catalogs: versions, updates, permissions, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The flags and lists of a permission set, and which of their growth relaxes the sandbox.
FLAGS = ["kv", "clipboard", "open_url", "paste", "bus"]
LISTS = ["network", "spawn"]
SANDBOX = ["spawn"]


def version_newer(a: Column, b: Column, on_unparseable: str = "newer") -> Column:
    """Whether version a is newer than b: dotted numbers, compared from the left, the shorter filled with zeros. With
    other parts any difference counts as newer, or as not_newer."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(F.trim(v), "^v", ""), r"\."), lambda p: p.try_cast("bigint"))
    x, y = parts(a), parts(b)
    n = F.greatest(F.size(x), F.size(y))
    padded = lambda p: F.concat(p, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(p)))
    numeric = ~F.exists(x, lambda p: p.isNull()) & ~F.exists(y, lambda p: p.isNull())
    return F.when(numeric, padded(x) > padded(y)).otherwise((F.trim(a) != F.trim(b)) if on_unparseable == "newer" else F.lit(False))


def compare_versions(df: DataFrame, a_col: str, b_col: str, on_unparseable: str = "newer") -> DataFrame:
    return df.withColumn("newer", version_newer(F.col(a_col), F.col(b_col), on_unparseable))


def available_updates(catalog: DataFrame, installed: DataFrame, api: int) -> DataFrame:
    """(name, installed_version, version) of packages installed from the catalog(name, version, api) that it has in a
    strictly newer version for the same API, by name. installed(name, version, origin)."""
    own = installed.where(F.col("origin") == "catalog").select("name", F.col("version").alias("installed_version"))
    both = catalog.where(F.col("api") == api).join(own, "name")
    return both.where(version_newer(F.col("version"), F.col("installed_version"))).select("name", "installed_version", "version").orderBy("name")


def permission_growth(pairs: DataFrame) -> DataFrame:
    """pairs(name, old, new) of permission structs with grows (any flag or list entry is new) and relaxes_sandbox."""
    flag = lambda f: F.coalesce(F.col(f"new.{f}"), F.lit(False)) & ~F.coalesce(F.col(f"old.{f}"), F.lit(False))
    empty = F.array().cast("array<string>")
    listed = lambda f: F.size(F.array_except(F.coalesce(F.col(f"new.{f}"), empty), F.coalesce(F.col(f"old.{f}"), empty))) > 0
    grows = flag(FLAGS[0])
    for c in [*map(flag, FLAGS[1:]), *map(listed, LISTS)]:
        grows = grows | c
    return pairs.withColumn("grows", grows).withColumn("relaxes_sandbox", listed(SANDBOX[0]))


def catalog_state(catalog: DataFrame, installed: DataFrame, api: int) -> DataFrame:
    """catalog with state: incompatible, not_installed, update or installed; and browse_order, updates first."""
    own = installed.select("name", F.col("version").alias("installed_version"))
    state = (
        F.when(F.col("api") != api, "incompatible").when(F.col("installed_version").isNull(), "not_installed")
        .when(version_newer(F.col("version"), F.col("installed_version")), "update").otherwise("installed")
    )
    return catalog.join(own, "name", "left").withColumn("state", state).withColumn("browse_order", F.when(F.col("state") == "update", 0).otherwise(1))


def search_catalog(state: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, name, place): packages that have the query in their name, keywords or description; all for an empty
    query; updates first, then by name."""
    from pyspark.sql.window import Window

    from sparkseek.operators.substring import substring_matches

    text = F.lower(F.concat_ws("\n", "name", F.concat_ws("\n", "keywords"), "description"))
    asked = queries.select("query_id", F.lower(F.trim("query_text")).alias("q"))
    found = substring_matches(state.select("name", "browse_order", text.alias("text")), asked)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("browse_order", "name"))).select("query_id", "name", "place")


def verify_packages(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, version, reason) for files(name, version, content): null, unknown, checksum or version. A blank checksum in
    the catalog(name, version, sha256), which has a name once, is not checked; a file without content has no checksum."""
    known = catalog.select("name", F.col("version").alias("expected"), F.lower(F.trim("sha256")).alias("sha"))
    reason = (
        F.when(F.col("expected").isNull(), "unknown")
        .when((F.coalesce("sha", F.lit("")) != "") & (F.coalesce(F.sha2("content", 256), F.lit("")) != F.col("sha")), "checksum")
        .when(F.col("version") != F.col("expected"), "version")
    )
    return files.join(known, "name", "left").select("name", "version", reason.alias("reason"))
