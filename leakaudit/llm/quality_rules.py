"""Quality rules: text statistics and robust multivariate outliers, DataFrame operations only.

Each text gives counts (words, symbols, repeated lines, repeated word windows). From them
a vector of four statistics is formed: log mean word length, root of symbols per word,
share of repeated lines, share of repeated words. All are smoothed by pseudo-counts, so a short text
does not look extreme by chance.

Per (language, source) a minimum-covariance-determinant estimate is made: from the median
on, concentration steps take the ``SUPPORT`` part of the rows nearest by Mahalanobis
distance and estimate mean and covariance from these alone, until the number of steps is
up. Small groups are drawn towards the estimate of all rows by ``PRIOR_ROWS`` pseudo-rows, and
``RESOLUTION`` bounds each variance from below, because most texts have no symbol or
repeat at all and their covariance would be singular. A text is rejected when its squared
distance exceeds the chi-squared quantile of ``TAIL``.

Every step reads a narrow table of statistics: two aggregations with partial sums, one row
per group and bin afterwards. Sums run over integers, so reruns agree bit for bit.

Defined results: null and empty texts have all counts 0 and fail the base rule; null
languages and sources are groups of their own; repeated rows count each; an empty table
gives an empty result; other columns pass through under any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakaudit.llm.common import SPACE, WORD, fresh, materialise

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SUPPORT = 0.75
STEPS = 4
PRIOR_ROWS = 20
TAIL = 1e-6
PSEUDO_WORDS, PSEUDO_LENGTH, PSEUDO_LINES = 50, 5.0, 10
RESOLUTION = (0.05, 0.1, 0.1, 0.1)
DIMS = 4
SCALE = 4096  # statistics are kept as integers, in these parts
ALL = "*"


def _chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with an even number of degrees of freedom > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(df // 2))


def _chi2_quantile(tail: float, df: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_tail(middle, df) > tail else (low, middle)
    return high


CUTOFF = _chi2_quantile(TAIL, DIMS)
# the covariance of the nearest part of a normal sample, brought back to that of all
CONSISTENCY = SUPPORT / (1 - _chi2_tail(_chi2_quantile(1 - SUPPORT, DIMS), DIMS + 2))


def counts(text: str) -> F.Column:
    """A struct of all counts of a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))

    def repeated(w):
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))
        return F.when(F.size(w) > WINDOW, F.transform(F.array(windows), _covered)[0]).otherwise(F.lit(0))

    def _covered(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.transform(F.array(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))), _places)[0])

    def _places(s):
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.transform(F.array(F.sort_array(F.transform(twice, lambda x: x["at"]))), _spread)[0]

    def _spread(p):
        reach = F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, k + 1) - x)).otherwise(F.lit(WINDOW)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    of_words = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).cast("long").alias("n_repeat_words")))[0]
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    of_lines = F.transform(F.array(lines), lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))[0]
    return F.struct(
        of_words.alias("w"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        of_lines.alias("l"),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def with_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(row, group, counts, base_failed, x0..x3): ``row`` holds all given columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    group = F.concat_ws("\x00", mark(lang), mark(source)).alias("group")
    found = docs.select(row, group, counts(text).alias("c"))
    found = found.select("row", "group", "c.w.n_words", "c.word_chars", "c.n_symbols", "c.l.n_dup_lines", "c.w.n_repeat_words", "c.l.n_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    n = F.col("n_words") + PSEUDO_WORDS
    vector = [
        F.log((F.col("word_chars") + PSEUDO_WORDS * PSEUDO_LENGTH) / n),
        F.sqrt(F.col("n_symbols") / n),
        F.col("n_dup_lines") / (F.col("n_lines") + PSEUDO_LINES),
        F.col("n_repeat_words") / n,
    ]
    return found.withColumn("base_failed", failed).select("*", *[F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(vector)])


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _distance(x: list, estimate: str = "") -> F.Column:
    """Squared Mahalanobis distance by forward substitution with the stored factor."""
    z: list = []
    for i in range(DIMS):
        rest = x[i] / F.lit(float(SCALE)) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum(v * v for v in z)


def _factor(estimates: DataFrame) -> DataFrame:
    """Lower triangular factor l of the covariance s, column by column."""
    for j in range(DIMS):
        inner = F.col(f"s{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        estimates = estimates.withColumn(f"l{j}{j}", F.sqrt(F.greatest(inner, F.lit(RESOLUTION[j] ** 2 / 16))))
        below = {f"l{i}{j}": (F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, DIMS)}
        estimates = estimates.withColumns(below) if below else estimates
    return estimates.select("group", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in _PAIRS])


def _start(both: DataFrame) -> DataFrame:
    """Medians per group, read from exact counts of integer values."""
    long = both.select("group", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(f"x{i}") / 64).alias("bin")) for i in range(DIMS)])).alias("v"))
    bins = long.groupBy("group", "v.dim", "v.bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group", "dim")
    below = F.sum("n").over(w.orderBy("bin"))
    middle = bins.withColumn("below", below).withColumn("all", F.sum("n").over(w)).where("2 * below >= all").groupBy("group", "dim").agg(F.min("bin").alias("bin"))
    columns = [F.max(F.when(F.col("dim") == i, (F.col("bin") * 64 + 32) / F.lit(float(SCALE)))).alias(f"m{i}") for i in range(DIMS)]
    flat = middle.groupBy("group").agg(*columns)
    return _factor(flat.select("*", *[F.lit(RESOLUTION[i] ** 2 if i == j else 0.0).alias(f"s{i}{j}") for i, j in _PAIRS]))


def _concentrate(both: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: estimates from the nearest part of each group's rows."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    near = both.join(estimates, "group").select("group", *x, F.floor(F.log1p(_distance(x)) * 1024).alias("bin"))
    bins = near.groupBy("group", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group")
    reach = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w)).where(F.col("upto") >= F.ceil(F.col("all") * SUPPORT))
    reach = materialise(reach.groupBy("group").agg(F.min("bin").alias("reach")), "reach")  # a row per group, of known size
    kept = near.join(reach, "group").where("bin <= reach")
    total = lambda c: F.sum(c.cast("decimal(20,0)")).cast("double")
    sums = kept.groupBy("group").agg(F.count("*").cast("double").alias("n"), *[total(x[i]).alias(f"t{i}") for i in range(DIMS)], *[total(x[i] * x[j]).alias(f"q{i}{j}") for i, j in _PAIRS])
    own = sums.select("group", "n", *[(F.col(f"t{i}") / F.col("n")).alias(f"a{i}") for i in range(DIMS)], *[f"q{i}{j}" for i, j in _PAIRS])
    unit = float(SCALE) ** 2
    own = own.select("group", "n", *[(F.col(f"a{i}") / float(SCALE)).alias(f"m{i}") for i in range(DIMS)], *[((F.col(f"q{i}{j}") / F.col("n") - F.col(f"a{i}") * F.col(f"a{j}")) / unit).alias(f"s{i}{j}") for i, j in _PAIRS])
    own = materialise(own, "moments")
    whole = own.where(F.col("group") == ALL).first()  # one row of plain numbers
    drawn = lambda c: (F.col("n") * F.col(c) + PRIOR_ROWS * F.lit(whole[c] if whole else 0.0)) / (F.col("n") + PRIOR_ROWS)
    floor = lambda i, j: F.lit(RESOLUTION[i] ** 2 if i == j else 0.0)
    shrunk = own.select(
        "group",
        *[drawn(f"m{i}").alias(f"m{i}") for i in range(DIMS)],
        *[(drawn(f"s{i}{j}") * CONSISTENCY + floor(i, j)).alias(f"s{i}{j}") for i, j in _PAIRS],
    )
    return _factor(shrunk)


def estimate(found: DataFrame, steps: int = STEPS) -> DataFrame:
    """Location and covariance factor per group, from rows that passed the base rule."""
    vectors = materialise(found.where(~F.col("base_failed")).select("group", *[f"x{i}" for i in range(DIMS)]), "vectors")
    both = vectors.select(F.explode(F.array("group", F.lit(ALL))).alias("group"), *[f"x{i}" for i in range(DIMS)])
    estimates = materialise(_start(both), "estimates")
    for _ in range(steps):
        estimates = materialise(_concentrate(both, estimates), "estimates")
    return estimates


def judge(found: DataFrame, estimates: DataFrame) -> DataFrame:
    """``found`` with distance and kept."""
    distance = _distance([F.col(f"x{i}") for i in range(DIMS)])
    judged = found.join(estimates.withColumnRenamed("group", "of"), F.col("group") == F.col("of"), "left").withColumn("distance", distance)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def score_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document: id, all counts, base_failed, distance, kept."""
    found = with_counts(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")), "text", "lang", "source")
    names = [*COUNTS, "base_failed", *[f"x{i}" for i in range(DIMS)]]
    table = materialise(found.select(F.col("row.id").alias("id"), "group", *names), "counts")
    return judge(table, estimate(table)).select("id", *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, columns unchanged. Rows and counts are written once, side by side: counts aren't formed
    again, and texts aren't shuffled to them."""
    found = materialise(with_counts(docs, text, lang, source), "counted")
    return judge(found, estimate(found)).where("kept").select("row.*")
