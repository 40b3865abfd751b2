"""Links of landed index pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text that is not markup: comments, scripts and styles; one that is never closed runs to the end of the page.
NOT_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"

# What stands in an anchor tag after its name, up to its end, the next anchor or a quote that is never closed. Every
# part is possessive: no character is read again, and the repeat is a loop, not a recursion.
ANCHOR = r"""(?i)<a(\s(?:[^<>"']++|<(?!a\s)|"[^"]*+"|'[^']*+')*+)"""

# The href value of a tag with its quotes if it has any; quoted values of other attributes match without the group.
HREF = r"""(?i)(?<=\s)href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|"[^"]*+"|'[^']*+'"""

# The character references that occur in link text.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def page_links(html: Column) -> Column:
    """All anchor targets of a page in document order, in time linear in the page."""
    tags = F.regexp_extract_all(F.regexp_replace(html, NOT_MARKUP, ""), F.lit(ANCHOR), 1)
    return F.transform(F.array_compact(F.transform(tags, _target)), _plain)


def _target(tag: Column) -> Column:
    """The first href of a tag as written, or NULL."""
    values = F.regexp_extract_all(tag, F.lit(HREF), 1)
    return F.get(F.filter(values, lambda value: value != ""), F.lit(0))


def _plain(value: Column) -> Column:
    text = F.regexp_replace(value, r"""^["']|["']$""", "")
    text = F.array_join(F.transform(F.split(text, _AROUND_NUMBERS), _character), "")
    for reference, character in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


# Between a numeric character reference and the text around it.
_AROUND_NUMBERS = r"(?=&#(?:[0-9]+|[xX][0-9a-fA-F]+);)|(?<=;)"


def _character(piece: Column) -> Column:
    """The character of a numeric reference; other text as it is."""
    number = F.coalesce(
        F.nullif(F.regexp_extract(piece, r"^&#([0-9]{1,7});$", 1), F.lit("")).cast("int"),
        F.conv(F.nullif(F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10).cast("int"),
    )
    in_range = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    return F.when(in_range, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(piece)


def link_manifest(pages: DataFrame, suffix: str = ".zip") -> DataFrame:
    """One row per link of a page that ends with ``suffix`` (case-sensitive), the page's other columns kept."""
    others = [c for c in pages.columns if c != "html"]
    return (
        pages.withColumn("link", F.explode(page_links(F.col("html"))))
        .where(F.endswith("link", F.lit(suffix)))
        .select(*others, "link")
    )


def resolve_links(links: DataFrame, base_url: Column, domain: Column) -> DataFrame:
    """Add the absolute ``full_url`` and the ``filename`` of every link.

    An absolute link stays, one from the root is put behind ``domain``, any other behind ``base_url``.
    """
    link = F.col("link")
    full = (
        F.when(link.startswith("http"), link)
        .when(link.startswith("/"), F.concat(domain, link))
        .otherwise(F.concat(base_url, link))
    )
    return links.withColumns({"full_url": full, "filename": F.element_at(F.split(link, "/"), -1)})
