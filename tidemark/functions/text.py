"""Text as Column expressions: trimming, cleaning, clipping, escaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space when a text is trimmed: all of Unicode's, unlike trim() without arguments.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_ENDS = "\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it: a condition's branches share nothing, and
    nested expressions would grow exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """No carriage returns, runs of blanks as one, no blanks before a line end, at most one blank line."""
    text = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), "[ \\t\\u3000]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " +\\n", "\n"), "\\n{3,}", "\n\n")


def clean(text: Column) -> Column:
    return strip(collapse(text))


def clip(text: Column, limit: int) -> Column:
    """At most `limit` characters, the rest shown by an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(rstrip(F.substring(text, 1, limit)), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def without_title(title: Column, body: Column) -> Column:
    """The body without a first line that repeats the title."""
    first = F.element_at(F.split(body, LINE_ENDS), 1)
    rest = lstrip(F.array_join(F.slice(F.split(body, LINE_ENDS), 2, 1 << 30), "\n"))
    near = F.contains(F.substring(body, F.lit(1), F.length(title) + 5), title)
    return F.when((F.length(title) > 0) & near & F.contains(first, strip(title)), rest).otherwise(body)


def composed(title: Column, body: Column, most: int) -> Column:
    """Title, blank line and body, cleaned and cut."""
    whole = clean(F.when(F.length(title) > 0, F.concat(title, F.lit("\n\n"), body)).otherwise(body))
    return let(whole, lambda x: F.when(F.length(x) > most, rstrip(F.substring(x, 1, most))).otherwise(x))


def language_sample(ok: Column, title: Column, body: Column, most: int, least_body: int) -> Column:
    """What the language is decided on: the start of the body, with the title before a short one; blank where scraping failed."""
    def sample(x: Column) -> Column:
        return F.when(F.length(x["body"]) < least_body, strip(F.concat(x["title"], F.lit("\n"), x["body"]))).otherwise(x["body"])

    both = F.struct(strip(F.coalesce(title, F.lit(""))).alias("title"), strip(F.coalesce(body, F.lit(""))).alias("body"))
    return F.when(F.coalesce(ok, F.lit(False)), F.substring(let(both, sample), 1, most)).otherwise(F.lit(""))


def chosen_source(body: Column, text: Column) -> Column:
    """The stripped body, or the text where the body is blank."""
    return F.coalesce(F.nullif(strip(F.coalesce(body, F.lit(""))), F.lit("")), text, F.lit(""))
