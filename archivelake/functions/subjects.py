"""Subject columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivelake.functions.ids import compress_id


def normalized(subject: Column) -> Column:
    """Trim, squeeze spaces, drop trailing dots and one leading `re:`."""
    s = F.regexp_replace(subject, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"\.+$", "")
    return F.regexp_replace(s, r"(?i)^re:\s+", "")


def subject_path(subject: Column) -> Column:
    """Normalised subject with every non-word run replaced by `_`."""
    s = F.regexp_replace(normalized(subject), r"[^\p{L}\p{M}\p{N}_.~/-]+", "_")
    return F.lower(s)


def subject_key(subject: Column) -> Column:
    """Grouping key of a subject; null when the subject is empty."""
    path = subject_path(subject)
    empty = subject.isNull() | (subject == "") | (path == "")
    return F.when(~empty, compress_id(path))


def file_name(subject: Column) -> Column:
    """Safe file name made of the first line; null when nothing is left."""
    s = F.split(subject, "\n", 2)[0]
    s = F.regexp_replace(s, r"[^A-Za-z0-9_.]+", "-")
    s = F.regexp_replace(s, r"\.+", ".")
    s = F.regexp_replace(s, r"[.-]+$", "")
    s = F.regexp_replace(s, r"^[.-]+", "")
    return F.when(s != "", s)


def without_tag(subject: Column, tag: str) -> Column:
    """Drop a list tag at the front, keeping a `Re: ` before it."""
    return F.regexp_replace(subject, r"(?i)^\s*(re:\s+|)" + re.escape(tag) + r"\s*", "$1")


def elide_against(previous: Column, subject: Column) -> Column:
    """Elide the words a subject shares with the end of the previous one.

    Returns the words kept followed by ` "` when at least two words were
    elided. A single shared word is kept.
    """
    prev = F.split(previous, " ")
    cur = F.split(subject, " ")
    a, b = F.reverse(prev), F.reverse(cur)
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(
        F.sequence(F.lit(0), shorter),
        lambda i: (i == shorter) | (F.get(a, i) != F.get(b, i)),
    )
    shared = F.coalesce(F.get(differ, F.lit(0)), F.lit(0))
    kept = F.slice(cur, F.lit(1), F.size(cur) - shared)
    tail_re = F.size(kept) > 0
    last = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))
    kept = F.when(
        tail_re & last.rlike(r"(?i)^re:\s*"), F.slice(kept, F.lit(1), F.size(kept) - 1)
    ).otherwise(kept)
    one = F.slice(cur, F.size(cur), F.lit(1))
    kept = F.when(shared == 1, F.concat(kept, one)).otherwise(kept)
    mark = F.when(shared >= 2, F.lit(' "')).otherwise(F.lit(""))
    return F.when(previous.isNull(), subject).otherwise(
        F.concat(F.array_join(kept, " "), mark)
    )
