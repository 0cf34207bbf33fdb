"""Form-shaped documents: sections, repeated groups and `Name: value` fields with values of several lines.

    [Section]
    Name: value
        continued
    Name: value of the next group

Everything is splits of one row's text at places that a look-ahead finds, each linear in the text: at section lines, then
at lines where the section's first name comes again, then at lines that start a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME, SECTION = r"[A-Za-z][A-Za-z0-9 _-]{0,39}", r"\[[^\[\]\n]{1,80}\]"
_FIELD = rf"^{NAME}:"


def _value(block: Column) -> Column:
    """What follows the name, lines trimmed and joined by line feeds."""
    return F.trim(F.regexp_replace(F.regexp_replace(block, _FIELD, ""), r"[ \t\r]*\n[ \t\r\n]*", "\n"), F.lit(" \t\r\n"))


def parse_forms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_no, section, group_no, ordinal, name, value: a row for each field, numbers from 0.

    Lines before the first section are section 0 with an empty name, where there are any fields. A group starts where the
    first name of its section comes again. Lines that start neither a field nor a section go on with the value before
    them; before the first field of a section they are left out. Null texts have no fields. No shuffle.
    """
    lined = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r\n?", "\n"))
    sections = docs.select(key, F.posexplode(F.split(lined, rf"\n(?={SECTION}[ \t]*(?:\n|$))")).alias("section_no", "chunk"))
    head = rf"^({SECTION})[ \t]*(?:\n|$)"
    # from the section's first field on: what stands before it belongs to none
    body = F.regexp_extract(F.concat(F.lit("\n"), F.regexp_replace("chunk", head, "")), rf"(?s)\n({NAME}:.*)$", 1)
    parts = sections.select(key, "section_no", F.regexp_replace(F.regexp_extract("chunk", head, 1), r"[\[\]]", "").alias("section"), body.alias("body")).where("body <> ''")
    first = F.regexp_extract("body", rf"^({NAME}):", 1)
    groups = parts.select(key, "section_no", "section", F.posexplode(F.split(F.col("body"), F.concat(F.lit("\n(?="), first, F.lit(":)")))).alias("group_no", "group"))
    fields = groups.select(key, "section_no", "section", "group_no", F.posexplode(F.split("group", rf"\n(?={NAME}:)")).alias("ordinal", "block"))
    return fields.select(key, "section_no", "section", "group_no", "ordinal", F.regexp_extract("block", rf"^({NAME}):", 1).alias("name"), _value(F.col("block")).alias("value"))
