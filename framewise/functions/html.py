"""HTML expressions: title and links of a page.

Regular expressions, not a tree parser: comments, scripts and styles are
removed first. Malformed markup is where the two part ways; see README.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip

# Every pattern is linear in the page: what is never closed runs to the end of
# the text, and the body of a tag ends at the next '<'.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)"
META = r"""<(?i:meta)\b(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>"""
SHARE_TITLE = r"""(?i:[\s"']property)\s*+=\s*+["']?og:title["'\s/>]"""
CONTENT = r"""(?is)[\s"']content\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TITLE = r"(?is)<title\b[^<>]*+>(.*?)(?:</title>|\z)"
H1 = r"(?is)<h1\b[^<>]*+>(.*?)(?:</h1>|\z)"
NUMBER = r"^((?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?)"
ANCHOR = r"""(?is)<a\b[^<>]*?[\s"']href\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>]++)"""
HREF = r"""(?is)[\s"']href\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

# Named references as HTML defines them; some are known without their semicolon too.
NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
SHORT = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
NAME = r"^([A-Za-z][A-Za-z0-9]*+;)"
SHORT_NAME = "^(" + "|".join(SHORT) + ")"


def visible(html: Column | str) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(col(html), HIDDEN, "")


def _char(code: Column) -> Column:
    """The character with this Unicode number; U+FFFD where there is none."""
    ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.lpad(F.hex(F.when(ok, code).otherwise(F.lit(0xFFFD))), 8, "0")
    return F.decode(F.unhex(number), "UTF-32")


def _numeric_entity(part: Column) -> Column:
    """``part`` follows '&#'; put the character in place of the number."""

    def decoded(number: Column) -> Column:
        digits = F.regexp_replace(number, ";$", "")
        code = F.when(
            digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 6), 16, 10)
        ).otherwise(digits)
        rest = F.substring(part, F.length(number) + 1, F.length(part))
        return F.when(number == "", F.concat(F.lit("&#"), part)).otherwise(
            F.concat(let(code.cast("bigint"), _char), rest)
        )

    return let(F.regexp_extract(part, NUMBER, 1), decoded)


def _named_entity(part: Column) -> Column:
    """``part`` follows '&'; put the character in place of the name."""
    table = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def decoded(names: Column) -> Column:
        known = F.element_at(table, F.rtrim(names["long"], F.lit(";")))
        short = F.element_at(table, names["short"])

        def rest(name: Column) -> Column:
            return F.substring(part, F.length(name) + 1, F.length(part))

        return (
            F.when(known.isNotNull(), F.concat(known, rest(names["long"])))
            .when(short.isNotNull(), F.concat(short, rest(names["short"])))
            .when(part.startswith("#"), _numeric_entity(F.substring(part, 2, F.length(part))))
            .otherwise(F.concat(F.lit("&"), part))
        )

    both = F.struct(
        F.regexp_extract(part, NAME, 1).alias("long"), F.regexp_extract(part, SHORT_NAME, 1).alias("short")
    )
    return let(both, decoded)


def _decode(c: Column) -> Column:
    """Each reference stands after one '&', so nothing is decoded twice."""
    return let(
        F.split(c, "&"),
        lambda p: F.concat(
            p[0],
            F.array_join(
                F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), _named_entity), ""
            ),
        ),
    )


def decode_entities(c: Column | str) -> Column:
    """Replace character references, numeric and named."""
    return let(col(c), lambda x: F.when(x.contains("&"), _decode(x)).otherwise(x))


def _attribute(tag: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def headline_of(markup: Column) -> Column:
    """Title of already ``visible`` markup: og:title, else <title>, else <h1>, else null."""
    metas = F.regexp_extract_all(markup, F.lit(META), F.lit(0))
    first = F.coalesce(F.get(F.filter(metas, lambda t: t.rlike(SHARE_TITLE)), 0), F.lit(""))
    share = decode_entities(let(first, lambda tag: _attribute(tag, CONTENT)))
    heading = F.regexp_replace(F.regexp_extract(markup, H1, 1), "<[^>]*>", "")
    own = (
        F.when(markup.rlike(TITLE), decode_entities(F.regexp_extract(markup, TITLE, 1)))
        .when(markup.rlike(H1), decode_entities(heading))
    )
    return let(share, lambda s: strip(F.when(s != "", s).otherwise(own)))


def hrefs_of(markup: Column) -> Column:
    """All link targets of already ``visible`` markup, in page order."""
    anchors = F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(0))
    return F.transform(anchors, lambda a: decode_entities(_attribute(a, HREF)))


def extract_headline(html: Column | str) -> Column:
    return headline_of(visible(html))


def extract_links(html: Column | str) -> Column:
    return hrefs_of(visible(html))
