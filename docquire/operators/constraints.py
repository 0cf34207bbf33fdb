"""Constraints across documents: dependencies between columns that different rows break together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dependency_violations(rows: DataFrame, rules: dict[str, tuple[list[str], str]], key: str) -> DataFrame:
    """rule_id, determinant (SHA-256 of its values), n_values, n_rows, first_key, last_key, least_value, most_value: each
    group of rows that agree in a rule's determinants and differ in its dependent column.

    Rules are rule_id: (determinants, dependent). Null determinants take no part and null dependents hold with any value.
    Groups are found by sums and minima of each (group, value), never by pairs: both aggregates combine before they
    shuffle, so a group of a third of all rows is a few partial rows a task, and no shuffle carries the determinants.
    """
    checks = []
    for rule, (determinants, dependent) in rules.items():
        parts = [F.sha2(F.col(d).cast("string"), 256) for d in determinants]
        whole = F.sha2(F.concat(*parts), 256) if len(parts) > 1 else parts[0]
        value = F.col(dependent).cast("string")
        checks.append(F.when(whole.isNotNull() & value.isNotNull(), F.struct(F.lit(rule).alias("rule_id"), whole.alias("determinant"), value.alias("value"))))
    each = rows.select(F.col(key).alias("key"), F.inline(F.array_compact(F.array(*checks))))
    values = each.groupBy("rule_id", "determinant", "value").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    groups = values.groupBy("rule_id", "determinant").agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_rows"), F.min("low").alias("first_key"), F.max("high").alias("last_key"),
        F.min("value").alias("least_value"), F.max("value").alias("most_value"),
    )
    return groups.where("n_values > 1")
