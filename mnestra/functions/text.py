"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain letters the index folds them to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
MAX_QUERY_TERMS = 12
LABEL_CHARS = 160
ZERO_WIDTH_SPACE = "​"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: Column) -> Column:
    """Folded runs of letters and digits, in order, repeated ones kept."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_terms(text: Column, most: int = MAX_QUERY_TERMS) -> Column:
    """At most ``most`` terms of a query: the longest (the earlier of equals), in the order of the query."""
    all_terms = terms(text)
    numbered = F.transform(all_terms, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(numbered), 1, most), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    return F.transform(kept, lambda x: x["t"])


def match_expression(text: Column) -> Column:
    """The full-text expression of a query: quoted prefix terms joined by OR; null without terms."""
    found = query_terms(text)
    return F.when(F.size(found) > 0, F.concat_ws(" OR ", F.transform(found, lambda t: F.concat(F.lit('"'), t, F.lit('"*')))))


def collapse(text: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def count_words(text: Column) -> Column:
    """The default size of a text: its number of runs without white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def label(text: Column, most: int = LABEL_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def truncate(text: Column, most: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def slug(name: Column) -> Column:
    """A name for the file system: anything but letters, digits, dot, dash and underscore becomes a dash."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "-")


def percent_encode(segment: Column) -> Column:
    """A path segment; blanks become %20, and the unreserved marks stay."""
    return F.replace(F.replace(F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def clean_tags(tags: Column, most: int = 32, chars: int = 128) -> Column:
    """Trimmed tags without empty, overlong or control-character ones; the first ``most``."""
    trimmed = F.transform(tags, lambda t: F.trim(t))
    return F.slice(F.filter(trimmed, lambda t: t.isNotNull() & (t != "") & (F.length(t) <= chars) & ~t.rlike(r"\p{Cntrl}")), 1, most)


def strip_blocks(text: Column, tags: list[str]) -> Column:
    """Without ``<tag>...</tag>`` blocks; a block that is not closed stays."""
    for tag in tags:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    return text


def defang(text: Column, tag: str) -> Column:
    """Break up a closing or opening tag inside a text, so that it cannot end the block around it."""
    return F.replace(F.replace(text, F.lit(f"</{tag}"), F.lit(f"<{ZERO_WIDTH_SPACE}/{tag}")), F.lit(f"<{tag}"), F.lit(f"<{ZERO_WIDTH_SPACE}{tag}"))


#: Texts and characters that carry no information.
JUNK = ("...", "…", "-", "--", "---", ".", "..", "•", "·", "*", "**", "***", "_,_", "_, _, _")
_MARKS = "[.,;:!?\\-–—…\"'`´ \\t\\n\\r]*"


def degenerate(text: Column) -> Column:
    """Whether a text carries no information."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    short = (F.length(bare) <= 2) & ~bare.rlike(r"[\p{L}\p{N}]")
    return text.isNull() | (bare == "") | bare.isin(*JUNK) | bare.rlike(f"^{_MARKS}$") | short


def truthy(value: Column) -> Column:
    """Null for the ways a reply says that it has nothing."""
    return F.when((value != "") & (F.lower(value) != "n/a"), value)


#: Parts of the names of tool calls that only operate the store itself.
OPERATIONAL = ("recall", "retain", "reflect", "search", "extract", "create_", "delete_", "update_", "get_", "list_")


def operational_tool(name: Column) -> Column:
    """Whether a namespaced tool only operates the store."""
    last = F.lower(F.element_at(F.split(name, "__"), -1))
    return F.coalesce(name.startswith("mcp__") & last.rlike("|".join(OPERATIONAL)), F.lit(False))


def clock(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm 'UTC'")


def month_and_year(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "MMMM yyyy")


def long_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "MMMM dd, yyyy")


def day_name_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "EEEE, MMMM dd, yyyy")
