"""Body text columns: quoting, links, trailers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of links worth following.
LINK_SCHEMES = ("http", "https", "ftp", "ftps", "news", "snews", "nntp", "nntps", "imap", "imaps", "gopher")
# A scheme, "://" and the characters RFC 3986 allows in a URI.
_URI = r"(?i)\b(?:" + "|".join(LINK_SCHEMES) + r")://[\w\-.~:/?#\[\]@!$&'()*+,;=%]+"
# The trailers two list hosts appended.
VGER_TRAILER = (
    r"-+\nTo unsubscribe from this list: send the line \"unsubscribe [\w-]+\" in\n"
    r"the body of a message to majordomo@vger\.kernel\.org\n"
    r"More majordomo info at +http://vger\.kernel\.org/majordomo-info\.html\n"
    r"(?:Please read the FAQ at +http://www\.tux\.org/lkml/\n)?\n*\z"
)
RUBY_TRAILER = (
    r"\n?Unsubscribe:\s<mailto:ruby-\w+-request@ruby-lang\.org\?subject=unsubscribe>\n"
    r"<http://lists\.ruby-lang\.org/cgi-bin/mailman/options/ruby-\w+>\n\z"
)
QUOTE_BLOCKS = r"(?:>[^\n]*+\n)++|(?:(?!>)[^\n]*+\n)++"
WORD = r"[\p{L}\p{N}_]+"


def quote_blocks(body: Column) -> Column:
    """Alternating quoted and unquoted blocks as (pos, quoted, text) structs."""
    closed = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    blocks = F.regexp_extract_all(closed, F.lit(QUOTE_BLOCKS), F.lit(0))
    return F.transform(
        blocks,
        lambda b, i: F.struct(
            i.alias("pos"), b.startswith(">").alias("quoted"), b.alias("text")
        ),
    )


def _trim_link(url: Column) -> Column:
    """Drop what ends a sentence or closes a bracket opened before the link.

    Characters are judged from the right: stops and quotes go, and so does a closing
    bracket that nothing inside the link opens.
    """
    tail = F.reverse(F.regexp_extract(url, r"[.,;:!?'*)\]]*$", 0))

    def count(text: Column, char: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    def judge(kept: Column, char: Column) -> Column:
        unopened = (
            F.when(char == ")", count(kept, ")") > count(kept, "("))
            .when(char == "]", count(kept, "]") > count(kept, "[")).otherwise(True)
        )
        return F.when(F.endswith(kept, char) & unopened, F.left(kept, F.length(kept) - 1)).otherwise(kept)

    # Once a character stays, the ones before it no longer end the text.
    state = F.struct(url.alias("kept"), F.lit(True).alias("going"))

    def step(s: Column, char: Column) -> Column:
        shorter = judge(s["kept"], char)
        return F.struct(
            F.when(s["going"], shorter).otherwise(s["kept"]).alias("kept"), (s["going"] & (shorter != s["kept"])).alias("going")
        )

    chars = F.when(tail == "", F.array().cast("array<string>")).otherwise(F.split(tail, ""))
    return F.aggregate(F.filter(chars, lambda c: c != ""), state, step)["kept"]


def links(text: Column) -> Column:
    """Links in order, without closing punctuation or unpaired brackets."""
    return F.transform(F.regexp_extract_all(text, F.lit(_URI), F.lit(0)), _trim_link)


def without_trailer(text: Column, trailer: str = VGER_TRAILER) -> Column:
    """Drop a list trailer at the very end of the text."""
    return F.regexp_replace(text, trailer, "")


def words(text: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def unescape_from(body: Column, variant: str) -> Column:
    """Undo the `From ` escaping of a mailbox variant."""
    if variant == "mboxrd":
        return F.regexp_replace(body, r"(?md)^>(>*From )", "$1")
    if variant in ("mboxo", "mboxcl"):
        return F.regexp_replace(body, r"(?md)^>(From )", "$1")
    return body


def escape_from(body: Column, variant: str) -> Column:
    """Escape `From ` lines for a mailbox variant."""
    if variant == "mboxrd":
        return F.regexp_replace(body, r"(?md)^(>*From )", ">$1")
    if variant in ("mboxo", "mboxcl"):
        return F.regexp_replace(body, r"(?md)^From ", ">From ")
    return body
