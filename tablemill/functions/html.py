"""Column expressions over HTML and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that the page text uses.
ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def page_title(html: Column) -> Column:
    return unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; blanks squeezed."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(bare), "[ \\t\\n\\r\\f]+", " "))


def anchors(html: Column) -> Column:
    """Array of (attributes, href, text) of all ``a`` elements."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*>.*?</a>"), F.lit(0))
    return F.transform(tags, lambda a: F.struct(
        F.regexp_extract(a, "(?is)<a\\s+([^>]*)>", 1).alias("attributes"),
        F.regexp_extract(a, "(?is)href=\"([^\"]*)\"", 1).alias("href"),
        F.regexp_extract(a, "(?is)>(.*)</a>", 1).alias("text")))


def absolute_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="(http://.*?)"'), F.lit(1))


def table_cells(html: Column) -> Column:
    """Array of tables, each an array of rows, each an array of cell texts."""
    tables = F.regexp_extract_all(html, F.lit("(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    return F.transform(tables, lambda tab: F.transform(
        F.regexp_extract_all(tab, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)),
        lambda row: F.transform(
            F.regexp_extract_all(row, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(unescape(c)))))
