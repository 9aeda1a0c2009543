"""The audit: supplier statistics, identical packages, exact file groups, repeated attributes.

``files`` has a row per file: submission_id, supplier, zip_name, path, name,
kind, size, sha256, ord (a file's place in the project), attributes
(map<string,string>), and optionally parse_error. Groups keep what the first
file in ``ord`` shows. All groups come from partial aggregations; the members
are joined back only where a caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scalar import format_bytes, normalize, risk_level, stable_id


def cross_supplier() -> Column:
    return F.col("n_suppliers") > 1


def exact_groups(files: DataFrame) -> DataFrame:
    """(group_id, sha256, size, size_label, n_files, n_suppliers): contents that several suppliers have, largest first."""
    groups = files.where("sha256 <> ''").groupBy("sha256").agg(F.min_by("size", "ord").alias("size"), F.count("*").alias("n_files"), F.count_distinct("supplier").alias("n_suppliers"), F.min("ord").alias("first_ord"))
    return groups.where((F.col("n_files") > 1) & cross_supplier()).select(stable_id(F.concat(F.lit("file:"), "sha256")).alias("group_id"), "sha256", "size", format_bytes(F.col("size")).alias("size_label"), "n_files", "n_suppliers", "first_ord").orderBy(F.desc("size"), "first_ord").drop("first_ord")


def exact_members(files: DataFrame) -> DataFrame:
    """(group_id, supplier, path, size, sha256): every file of an exact group."""
    groups = exact_groups(files).select("group_id", "sha256")
    return files.join(groups, "sha256").select("group_id", "supplier", "path", "size", "sha256")


def manifest_hashes(files: DataFrame) -> DataFrame:
    """(submission_id, supplier, manifest_hash, file_count, total_size): SHA-256 over a package's sorted path:sha256 lines."""
    line = F.concat_ws(":", "path", "sha256")
    return files.groupBy("submission_id").agg(F.first("supplier").alias("supplier"), F.first("zip_name").alias("zip_name"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("manifest_hash"), F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.min("ord").alias("ord"))


def structure_hashes(entries: DataFrame) -> DataFrame:
    """(submission_id, structure_hash): SHA-256 over the names in archive order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda e: e["path"])
    return entries.groupBy("submission_id").agg(F.sha2(F.array_join(names, "\n"), 256).alias("structure_hash"))


def identical_packages(packages: DataFrame) -> DataFrame:
    """(group_id, manifest_hash, suppliers, file_count, total_size, total_size_label): manifests that several packages have."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "supplier"))), lambda p: p["supplier"])
    groups = packages.groupBy("manifest_hash").agg(F.count("*").alias("n"), F.array_join(ordered, "、").alias("suppliers"), F.min_by("file_count", "ord").alias("file_count"), F.min_by("total_size", "ord").alias("total_size")).where("n > 1")
    return groups.select(stable_id(F.concat(F.lit("package:"), "manifest_hash")).alias("group_id"), "manifest_hash", "suppliers", "file_count", "total_size", format_bytes(F.col("total_size")).alias("total_size_label"))


def supplier_stats(files: DataFrame) -> DataFrame:
    """(submission_id, supplier, file_count, total_size, size_label, parse_errors, types)."""
    error = F.col("parse_error").isNotNull() if "parse_error" in files.columns else F.lit(False)
    per_kind = files.groupBy("submission_id", "supplier", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_if(error).alias("errors"))
    stats = per_kind.groupBy("submission_id", "supplier").agg(F.sum("n").alias("file_count"), F.sum("size").alias("total_size"), F.sum("errors").alias("parse_errors"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("types"))
    return stats.withColumn("size_label", format_bytes(F.col("total_size")))


def attributes_long(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """(field, label, weight, value, norm, supplier, path, kind, ord): a row per attribute that a rule of the kind names and that isn't empty."""
    a = F.col("attributes")
    version = F.coalesce(F.nullif(a["version"], F.lit("")), a["appVersion"])
    rows = files.select("submission_id", "supplier", "path", "kind", "ord", F.explode(F.map_concat(F.map_filter(a, lambda k, v: ~k.isin("version", "appVersion")), F.create_map(F.lit("version"), version))).alias("field", "value"))
    # the rule table is a few dozen fixed rows
    named = rows.where("value IS NOT NULL AND value <> ''").join(F.broadcast(rules.attribute_rules(files.sparkSession)), ["kind", "field"])
    return named.withColumn("norm", normalize(F.col("value"), compatibility)).where("norm <> ''")


def attribute_groups(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """(group_id, field, value, label, kind, weight, risk, n_files, n_suppliers): values that several suppliers' files share, whatever the kind; heaviest first."""
    groups = attributes_long(files, compatibility).groupBy("field", "norm").agg(
        F.min_by("value", "ord").alias("value"), F.min_by("label", "ord").alias("label"), F.max("weight").alias("weight"), F.min("kind").alias("kind"), F.max("kind").alias("kind_to"), F.count("*").alias("n_files"), F.count_distinct("supplier").alias("n_suppliers"), F.min("ord").alias("first_ord")
    )
    kept = groups.where((F.col("n_files") > 1) & cross_supplier())
    return kept.select(
        stable_id(F.concat(F.lit("attribute:"), "field", F.lit(":"), "norm")).alias("group_id"), "field", "value", "label", F.when(F.col("kind") == F.col("kind_to"), F.col("kind")).otherwise("mixed").alias("kind"), "weight", risk_level(F.col("weight")).alias("risk"), "n_files", "n_suppliers", "first_ord"
    ).orderBy(F.desc("weight"), F.desc("n_files"), "first_ord").drop("first_ord")


def attribute_members(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """(group_id, field, label, value, risk, weight, group_kind, supplier, path): every file of an attribute group."""
    long = attributes_long(files, compatibility).withColumn("group_id", stable_id(F.concat(F.lit("attribute:"), "field", F.lit(":"), "norm")))
    groups = attribute_groups(files, compatibility).select("group_id", F.col("label").alias("group_label"), F.col("value").alias("group_value"), "risk", F.col("weight").alias("group_weight"), F.col("kind").alias("group_kind"))
    return long.join(groups, "group_id").select("group_id", "field", F.col("group_label").alias("label"), F.col("group_value").alias("value"), "risk", F.col("group_weight").alias("weight"), "group_kind", "supplier", "path")


def summary(files: DataFrame, compatibility: bool = True) -> DataFrame:
    """One row: suppliers, files, bytes and the number of each kind of group."""
    totals = files.agg(F.count_distinct("submission_id").alias("supplier_count"), F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    counts = [identical_packages(manifest_hashes(files)).agg(F.count("*").alias("identical_package_groups")), exact_groups(files).agg(F.count("*").alias("exact_file_groups")), attribute_groups(files, compatibility).agg(F.count("*").alias("attribute_match_groups"))]
    for one in counts:  # one row each
        totals = totals.join(F.broadcast(one), F.lit(True))
    return totals.withColumn("total_size_label", format_bytes(F.col("total_size")))
