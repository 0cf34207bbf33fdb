"""Fields of documents: extraction, records, validation, routing, links and consolidation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """Every match of a pattern. `guard` goes before it in Spark only, and says where a match can start at all."""

    pattern: str
    guard: str = ""

    def sql_pattern(self) -> str:
        return self.pattern

    def hits(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.guard + self.pattern), F.lit(0))


@dataclass(frozen=True)
class Line:
    """Whole lines that hold a wording, and of other lines what follows `opening`, if they have it.

    Each line is looked at once: as one pattern, `[^\\n]*wording[^\\n]*` tries every place of a line to its end.
    """

    wording: str
    opening: str

    def sql_pattern(self) -> str:
        return rf"[^\n]*{self.wording}[^\n]*|{self.opening}[^\n]*"

    def hits(self, text: Column) -> Column:
        def of_line(line: Column) -> Column:
            at = F.instr(line, self.opening)
            return F.when(line.rlike(self.wording), line).when(at > 0, F.substring(line, at, F.length(line)))

        return F.array_compact(F.transform(F.split(text, "\n"), of_line))


#: Field name to rule. An address can only start where a run of its letters does, or where the last match ended.
RULES = {
    "email": Pattern(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]+", guard=r"(?:\G|(?<![A-Za-z0-9._]))"),
    "ip": Pattern(r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    "card": Pattern(r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"),
    "licence": Line("[Ll]icen[sc]ed? under", "Released under"),
    "secret": Pattern(r'token = "[^"]*"'),
}


def extract(docs: DataFrame, rules: dict = RULES, keep: list[str] = ["doc_id"], text: str = "text") -> DataFrame:  # noqa: B006
    """The kept columns, field, ordinal (from 0), value: every match of every rule. Null texts have none. No shuffle."""
    found = [F.struct(F.lit(name).alias("field"), rule.hits(F.col(text)).alias("hits")) for name, rule in rules.items()]
    per_rule = docs.where(F.col(text).isNotNull()).select(*keep, F.explode(F.array(*found)).alias("r")).where(F.size("r.hits") > 0)
    return per_rule.select(*keep, F.col("r.field").alias("field"), F.posexplode("r.hits").alias("ordinal", "value"))


def to_record(fields: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """One row per key with each named field's smallest value, and the number of values: one map-side-combined shuffle."""
    least = [F.min(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names]
    return fields.groupBy(key).agg(*least, F.count("*").alias("n_values"))


def judge(records: DataFrame, rules: dict) -> DataFrame:
    """Add violations, an array of (rule_id, field), for rules (rule_id: (field, condition that must hold)) that a record
    breaks; null conditions hold. A record's own columns tell, so nothing is joined."""
    checks = [F.when(~condition, F.struct(F.lit(rule).alias("rule_id"), F.lit(field).alias("field"))) for rule, (field, condition) in rules.items()]
    return records.withColumn("violations", F.array_compact(F.array(*checks)))


def violations(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rule_id, field: a row for each rule that a record breaks."""
    return judged.select(key, F.explode("violations").alias("v")).select(key, "v.*")


def route(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without a violation, quarantined records with theirs)."""
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def link(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """field, value, key, first_doc: each document with the first that has the value, for values of several documents.

    A star and not all pairs: a value in very many documents makes a row for each. Minima combine before the shuffle, and
    the join back, whose sizes Spark can't tell, is a sort-merge join that splits where a value is common.
    """
    once = fields.select("field", "value", key).distinct()
    first = once.groupBy("field", "value").agg(F.min(key).alias("first_doc"), F.max(key).alias("last_doc")).where("first_doc <> last_doc").drop("last_doc")
    return once.join(first.hint("merge"), ["field", "value"]).where(F.col(key) != F.col("first_doc"))


def consolidate(fields: DataFrame, key: str = "doc_id") -> DataFrame:
    """field, value, first_doc, n_docs, n_values: one row per value, from the document that has it first."""
    return fields.groupBy("field", "value").agg(F.min(key).alias("first_doc"), F.countDistinct(key).alias("n_docs"), F.count("*").alias("n_values"))


def preferred(fields: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """by, field, value, n_docs, first_doc: of each group's values of a field the one that comes first in precedence: in
    most documents, then in the earliest document, then the smallest. Both aggregates combine before they shuffle."""
    counted = fields.groupBy(by, "field", "value").agg(F.countDistinct(key).alias("n_docs"), F.min(key).alias("first_doc"))
    best = F.min(F.struct((-F.col("n_docs")).alias("rank"), "first_doc", "value", "n_docs")).alias("best")
    return counted.groupBy(by, "field").agg(best).select(by, "field", "best.value", "best.n_docs", "best.first_doc")
