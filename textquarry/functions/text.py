"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it; Java's \s lacks the no-break space and the Unicode spaces.
WS = "[ \\t\\n\\x0B\\f\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


def js_trim(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def _chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, c)


# The seven references that a title may hold; the ampersand is last, so that nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_entities(c: Column) -> Column:
    """The seven named references decoded, once."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def page_title(html: Column) -> Column:
    """Trimmed and decoded content of the first title element, empty without one."""
    return decode_entities(js_trim(F.regexp_extract(html, "(?i)<title[^>]*>([\\s\\S]*?)</title>", 1)))


def strip_html(c: Column) -> Column:
    """Tags and no-break references as spaces, white space squeezed and trimmed."""
    return js_trim(squeeze(_chain(c, [("<[^>]+>", " "), ("&nbsp;", " ")])))


#: Scripts, styles and comments.
MACHINE_PARTS = [("(?i)<script\\b[\\s\\S]*?</script>", ""), ("(?i)<style\\b[\\s\\S]*?</style>", ""), ("<!--[\\s\\S]*?-->", "")]
#: HTML to markdown, in this order. Short tag names also match longer ones (<b…> is <body> too), which is part of the result.
MARKDOWN_STEPS = [
    *[(f"(?i)<h{n}[^>]*>([\\s\\S]*?)</h{n}>", "\n" + "#" * n + " $1\n") for n in range(1, 7)],
    ("(?i)<p[^>]*>([\\s\\S]*?)</p>", "\n$1\n"),
    ("(?i)<br\\s*/?>", "\n"),
    ("(?i)<li[^>]*>([\\s\\S]*?)</li>", "- $1\n"),
    ("(?i)</?[ou]l[^>]*>", "\n"),
    ("(?i)<(?:strong|b)[^>]*>([\\s\\S]*?)</(?:strong|b)>", "**$1**"),
    ("(?i)<(?:em|i)[^>]*>([\\s\\S]*?)</(?:em|i)>", "*$1*"),
    ("(?i)<a[^>]*href=[\"']([^\"']+)[\"'][^>]*>([\\s\\S]*?)</a>", "[$2]($1)"),
]


def without_machine_parts(html: Column) -> Column:
    return _chain(html, MACHINE_PARTS)


def html_to_markdown(html: Column) -> Column:
    """One line of markdown: the final squeeze takes all line feeds."""
    return strip_html(_chain(without_machine_parts(html), MARKDOWN_STEPS))


def split_paragraphs(c: Column) -> Column:
    """Trimmed paragraphs (blank lines between) that are not empty."""
    return F.filter(F.transform(F.split(c, "\\n\\n+"), js_trim), lambda x: x != "")


def split_sentences(c: Column) -> Column:
    """Pieces between sentence marks and ASCII capitals that are not blank."""
    return F.filter(F.split(c, f"(?<=[.!?]){WS}+(?=[A-Z])"), lambda x: js_trim(x) != "")


def truncate(c: Column, most: int, tail: str) -> Column:
    """The first ``most`` characters and the tail; shorter texts as they are."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(tail))).otherwise(c)


def excerpt(c: Column, most: int = 300) -> Column:
    """The first characters and three dots, which are always there."""
    return F.concat(F.substring(c, 1, most), F.lit("..."))


def token_count(c: Column) -> Column:
    """The default token estimate: a token for every four characters begun."""
    return F.ceil(F.length(c) / 4).cast("int")


def long_enough(c: Column, least: int) -> Column:
    """Not null, and at least so many characters when trimmed."""
    return c.isNotNull() & (F.length(js_trim(c)) >= least)
