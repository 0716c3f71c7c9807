"""English stems (the published Porter2 rules), applied to distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.operators.skew import salted_lookup

# Fixed values of the published algorithm: exceptions and suffix tables.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive",
    "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "al", "er", "ic",
]
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VALID_LI = "cdeghkmnrt"


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
        return m.end() if m else len(word)

    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else after(0)
    return r1, after(r1)


def _ends_short(word: str) -> bool:
    return bool(re.search(rf"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$", word))


def stem(word: str) -> str:
    """Porter2 stem of a lower-case word; other text is returned as it is."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    elif (s := _longest(w, ("ed", "edly", "ing", "ingly"))) and re.search(f"[{VOWELS}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # 2
    s = _longest(w, [*STEP_2, "ogi", "li"])
    if s and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif s == "li":
            w = base if base[-1:] and base[-1] in VALID_LI else w
        else:
            w = base + STEP_2[s]
    # 3
    s = _longest(w, [*STEP_3, "ative"])
    if s and len(w) - len(s) >= r1:
        if s != "ative":
            w = w[: -len(s)] + STEP_3[s]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    s = _longest(w, [*STEP_4, "ion"])
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -3].endswith(("s", "t"))):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _stem_batch(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def stems(term: Column) -> Column:
    """Stem of each term; one Arrow batch at a time."""
    return F.pandas_udf(_stem_batch, "string")(term)


def with_stems(postings: DataFrame, like: list[str] | None = None) -> DataFrame:
    """Postings with a `stem` column; each distinct term is stemmed once.

    With `like`, only the postings of words that share the stem of one of these. The
    forms of these words are collected, so no other posting is built, stemmed or joined.
    """
    dictionary = postings.select("term").distinct().withColumn("stem", stems(F.col("term")))
    if like is None:
        return salted_lookup(postings, dictionary, ["term"], spread_on="docid")
    wanted = sorted({stem(w.lower()) for w in like})
    form_of = {r.term: r.stem for r in dictionary.where(F.col("stem").isin(wanted)).collect()}
    rest = ["term", *(c for c in postings.columns if c != "term")]
    if not form_of:
        return postings.where("false").select(*rest, F.lit(None).cast("string").alias("stem"))
    table = F.create_map(*[F.lit(x) for pair in sorted(form_of.items()) for x in pair])
    return postings.where(F.col("term").isin(sorted(form_of))).select(*rest, table[F.col("term")].alias("stem"))
