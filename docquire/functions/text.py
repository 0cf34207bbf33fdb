"""Text expressions. Patterns keep to what Java's and RE2's syntax share, so the same string runs in both engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a page without text, removed in this order, before tags.
NO_TEXT = [r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"(?is)<nav.*?</nav>"]
#: Entities decoded in a page's text, the ampersand last so that none is decoded twice (fixed values).
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&copy;": "\u00a9",
    "&amp;": "&",
}
TAG, BLANKS = r"<[^>]*>", r"[ \t\r\n]+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def normalise(text: Column) -> Column:
    """Lower case with single blanks; null stays null."""
    return collapse(F.lower(text))


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments, navigation or tags, entities decoded; null stays null."""
    for pattern in [*NO_TEXT, TAG]:
        html = F.regexp_replace(html, pattern, " ")
    for entity, character in ENTITIES.items():
        html = F.replace(html, F.lit(entity), F.lit(character))
    return collapse(html)


def word_count(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    clean = collapse(F.coalesce(text, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")
