"""Quality rules: base rules, then robust multivariate outliers.

Every text is described by a few counts. Texts that pass the base rules become
vectors of transformed statistics, and for each language and source the minimum
covariance determinant (MCD) estimate of their centre and scatter is sought: the
most tightly packed three quarters of the vectors. Concentration steps run from
several starts until no determinant falls, and the least determinant counts. Vectors
far from the centre in Mahalanobis distance are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelake.llm.base import SPACES, unit_hash
from archivelake.operators.skew import salted_lookup
from archivelake.session import durable, durable_count

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Share of vectors in the tight part.
SUPPORT = 0.75
#: Starts drawn by hash beside the median start, and the expected number of texts of each:
#: twice the least that span the statistics.
DRAWN_STARTS = 3
DRAWN_TEXTS = 12
#: A start has settled once a step lowers the logarithm of its determinant by no more.
SETTLED = 1e-3
#: Squared distance above which a vector is rejected: the chi-square quantile of five
#: degrees of freedom at 0.999.
CUTOFF = 20.515
#: Median of the chi-square law of five degrees of freedom: fixed value.
CHI_SQUARE_MEDIAN = 4.3515
#: Groups below this size are pooled within their language; what is left is judged by the
#: whole language, or pooled over all if that is below this size too, or else by all texts.
MIN_GROUP = 50
#: Least standard deviation of each statistic: where (almost) all values are equal, a
#: trifle must not reject a text.
FLOORS = {"length": 0.25, "word_length": 0.05, "symbols": 0.3, "repeats": 0.6, "lines": 0.6}
NAMES = list(FLOORS)
#: Stratum of the leftovers that are judged by all texts.
ALL = "all"

#: Up to this many groups are broadcast; beyond it they are joined with salted keys.
BROADCAST_GROUPS = 20_000


def with_counts(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of `text`.

    All counts are of the whole text; a null text counts as an empty one. A window
    repeats if the 64-bit hash of its words does; only texts with a repeated window
    sort theirs, with their places, to find which words are covered.
    """
    blank = F.lit(SPACES)
    body = F.coalesce("text", F.lit(""))
    core = F.btrim(body, blank)
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, blank) != "")
    cut = docs.withColumn(
        "_words", F.when(core == "", none).otherwise(F.split(core, "[\\x20\\x09-\\x0D]+"))
    ).withColumn("_lines", lines)
    hashed = cut.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).select(
        *docs.columns, "_hashes",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(body, "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    last = F.size("_hashes") - WINDOW_WORDS
    places = F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = hashed.withColumn(
        "_windows", F.transform(places, lambda i: F.xxhash64(F.slice("_hashes", i + 1, WINDOW_WORDS)))
    ).drop("_hashes")
    n = F.size("_windows")
    repeated = F.size(F.array_distinct("_windows")) < n
    # In hash order with places; a window repeats if a neighbour has its hash.
    ordered = windows.withColumn("_sorted", F.when(repeated, F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )))
    hashes = F.transform("_sorted", lambda x: x["h"])
    same = ordered.withColumn("_same", F.when(repeated, F.zip_with(
        F.slice(hashes, 1, n - 1), F.slice(hashes, 2, n - 1), lambda a, b: a == b
    )))
    marked = F.filter(
        "_sorted",
        lambda x, k: F.coalesce(F.get("_same", k), F.lit(False)) | F.coalesce(F.get("_same", k - 1), F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(marked, lambda x: x["i"])),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda s, i: F.struct(
            (s["words"] + i + WINDOW_WORDS - F.greatest(s["end"], i)).alias("words"),
            (i + WINDOW_WORDS).alias("end"),
        ),
    )["words"]
    return same.withColumn(
        "n_repeat_words", F.when(repeated, covered).otherwise(0).cast("long")
    ).drop("_windows", "_sorted", "_same")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _statistics() -> list[Column]:
    """Transformed statistics of a text with words, one for each of NAMES."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log(words).alias("length"), F.log(chars / words).alias("word_length"),
        F.log1p(100 * F.col("n_symbols") / chars).alias("symbols"),
        F.log1p(100 * F.col("n_repeat_words") / words).alias("repeats"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("lines"),
    ]


def _attach(rows: DataFrame, table: DataFrame, n_groups: int, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group; `table` has a row per group."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), keys)
    return salted_lookup(rows, table, keys, spread_on="row_hash")


def _stratum(counted: DataFrame) -> tuple[DataFrame, int]:
    """(group_lang, group_source, stratum, whole) per group: a stratum for every text.

    What is left of a language with enough texts has the `whole` language as its stratum,
    which takes in the texts of the other strata too; what is left of the other languages
    is pooled, or has all texts as its stratum if the pool is too small as well.
    """
    sizes = counted.groupBy("group_lang", "group_source").agg(F.count("*").alias("n"))
    big = F.col("n") >= MIN_GROUP
    pools = sizes.groupBy("group_lang").agg(
        F.sum(F.when(big, 0).otherwise(F.col("n"))).alias("pooled"), F.sum("n").alias("spoken")
    )
    rest = pools.where(F.col("spoken") < MIN_GROUP).agg(F.coalesce(F.sum("pooled"), F.lit(0)).alias("rest"))
    language = ~big & (F.col("pooled") < MIN_GROUP) & (F.col("spoken") >= MIN_GROUP)
    name = (
        F.when(big, F.concat_ws("\u0000", F.lit("group"), "group_lang", "group_source"))
        .when(F.col("pooled") >= MIN_GROUP, F.concat_ws("\u0000", F.lit("language"), "group_lang"))
        .when(language, F.concat_ws("\u0000", F.lit("whole"), "group_lang"))
        .when(F.col("rest") >= MIN_GROUP, F.lit("rest")).otherwise(F.lit(ALL))
    )
    named = sizes.join(pools, "group_lang", "left").crossJoin(F.broadcast(rest))  # `rest` is one row
    named = named.select("group_lang", "group_source", name.alias("stratum"))
    whole = F.col("stratum").startswith("whole\u0000") | (F.col("stratum") == ALL)
    return durable_count(named.withColumn("whole", whole), F.lit(True))


def _distance(rows: DataFrame, estimates: DataFrame, n_groups: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Add `distance`, the squared Mahalanobis distance from each estimate of the stratum.

    Solves L y = x - centre by forward substitution; `distance` is the square of y.
    `also` names columns of the estimates to keep.
    """
    joined = _attach(rows, estimates, n_groups, ["stratum"])
    for i, a in enumerate(NAMES):
        y = F.col(a) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    square = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(NAMES))), F.col("y0") * F.col("y0"))
    return joined.select(*rows.columns, *also, square.alias("distance"))


SIZE = len(NAMES)
CENTRE = [f"m{i}" for i in range(SIZE)]
FACTOR = [f"l{i}{j}" for i in range(SIZE) for j in range(i + 1)]


def _estimate(rows: DataFrame) -> DataFrame:
    """Centre m, Cholesky factor l and log_det of the scatter of every (stratum, start)."""
    moments = rows.groupBy("stratum", "start").agg(
        *[F.avg(a).alias(f"m{i}") for i, a in enumerate(NAMES)],
        *[F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i in range(SIZE) for j in range(i + 1)],
    )
    for i in range(SIZE):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") + (F.lit(FLOORS[NAMES[i]] ** 2) if i == j else 0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            moments = moments.withColumn(
                f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-6))) if i == j else value / F.col(f"l{j}{j}")
            )
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(SIZE)), F.lit(0.0))
    return moments.select("stratum", "start", *CENTRE, *FACTOR, log_det.alias("log_det"))


def _starts(rows: DataFrame, n_groups: int) -> DataFrame:
    """First estimates: start 0 has medians as centre and scaled median deviations as a
    diagonal scatter, the others are of about DRAWN_TEXTS texts drawn by a hash. A draw
    without a text is no start.
    """
    middle = durable(rows.groupBy("stratum").agg(
        *[F.percentile_approx(a, 0.5).alias(f"m{i}") for i, a in enumerate(NAMES)], F.count("*").alias("n")
    ))
    near = _attach(rows, middle, n_groups, ["stratum"])
    spread = near.groupBy("stratum").agg(
        *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, a in enumerate(NAMES)]
    )
    medians = middle.join(spread, "stratum").select(
        "stratum", F.lit(0).alias("start"), *CENTRE,
        *[
            (F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + FLOORS[NAMES[i]] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
            for i in range(SIZE) for j in range(i + 1)
        ],
    )
    drawn = near.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(DRAWN_STARTS)))).where(
        unit_hash("row_hash", "start") < DRAWN_TEXTS / F.col("n")
    )
    return medians.unionByName(_estimate(drawn).drop("log_det"))


def outlyingness(rows: DataFrame) -> DataFrame:
    """(row_hash, distance) of rows with a stratum and the statistics of NAMES.

    A concentration step takes the SUPPORT share of a stratum nearest to the last
    estimate and estimates centre and scatter anew, for all starts at once; each one
    lowers the determinant. A start that has settled takes part no longer; as the least
    deviations bound determinants from below, all settle. The estimate of least
    determinant is the stratum's. Distances are scaled down to the median of a normal
    law, but not up to it: where a statistic hardly varies the median is small although
    nothing is far. Every group value is a partial aggregate, so no task holds a group.
    """
    n_groups = rows.select("stratum").distinct().count()
    n_starts = n_groups * (1 + DRAWN_STARTS)
    # The determinant of a start is none of a tight part, so the first step always counts.
    going, found = durable(_starts(rows, n_groups).withColumn("log_det", F.lit(float("inf")))), []
    while True:
        far = _distance(rows, going, n_starts, ("start",))
        edge = durable(far.groupBy("stratum", "start").agg(F.percentile_approx("distance", SUPPORT).alias("edge")))
        tight = _attach(far, edge, n_starts, ["stratum", "start"]).where(F.col("distance") <= F.col("edge"))
        before = going.select("stratum", "start", F.col("log_det").alias("was"))
        going, left = durable_count(
            _estimate(tight).join(before, ["stratum", "start"]).withColumn(
                "falls", F.col("log_det") < F.col("was") - SETTLED
            ), F.col("falls"),
        )
        found.append(going.where("not falls").drop("was", "falls"))
        if not left:
            break
        going = going.where("falls").drop("was", "falls")
    settled = reduce(DataFrame.unionByName, found)
    best = durable(settled.groupBy("stratum").agg(
        F.min(F.struct("log_det", "start", *CENTRE, *FACTOR)).alias("e")
    ).select("stratum", *[F.col(f"e.{c}").alias(c) for c in [*CENTRE, *FACTOR]]))
    far = _distance(rows, best, n_groups)
    scale = durable(far.groupBy("stratum").agg(F.percentile_approx("distance", 0.5).alias("middle")))
    scaled = F.col("distance") * CHI_SQUARE_MEDIAN / F.greatest("middle", F.lit(CHI_SQUARE_MEDIAN))
    return _attach(far, scale, n_groups, ["stratum"]).select(*rows.columns, scaled.alias("distance"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, distance) of every row of (doc_id, text, lang, source).

    A null language or source is a value of its own. A text that fails a base rule is
    not kept, has no distance and takes no part in the estimates; every other text is
    judged, be it the only one. The counts are stored once, without the texts; the steps
    read that narrow table.
    """
    described = with_counts(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("group_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("group_source"),
    )).drop("text")
    counted = durable(described.withColumn("base_failed", base_failed()).withColumn(
        "row_hash", F.xxhash64("doc_id", *COUNTS)
    ))
    passed = counted.where("not base_failed")
    groups, n_groups = _stratum(passed)
    keys = ["group_lang", "group_source"]
    kept = ["doc_id", *COUNTS, "base_failed"]
    own = _attach(passed, groups, n_groups, keys).select(
        *kept, "row_hash", "group_lang", "stratum", "whole", *_statistics(), F.lit(True).alias("judged")
    )
    # Leftovers are judged among all texts of their language, or of all languages, which
    # stand there as well.
    wholes = groups.where(F.col("whole") & (F.col("stratum") != ALL)).select(
        "group_lang", F.col("stratum").alias("among")
    ).distinct()
    witnesses = _attach(own.where("not whole"), wholes, n_groups, ["group_lang"])
    if not groups.where(F.col("stratum") == ALL).isEmpty():
        witnesses = witnesses.unionByName(own.where(F.col("stratum") != ALL).withColumn("among", F.lit(ALL)))
    witnesses = witnesses.withColumns({"stratum": F.col("among"), "judged": F.lit(False)})
    measured = own.unionByName(witnesses.drop("among")).drop("group_lang", "whole")
    far = outlyingness(durable(measured)).where("judged")
    told = far.select(*kept, (F.col("distance") <= CUTOFF).alias("kept"), "distance")
    failed = counted.where("base_failed").select(
        *kept, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")
    )
    return told.unionByName(failed)
