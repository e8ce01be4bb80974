"""Robust multivariate outlier rules, in DataFrame functions only.

Each text gives a vector of transformed statistics. Per language and source, a
minimum-covariance-determinant estimate (a deterministic start from medians and
median deviations, then concentration steps on the rows with the smallest
Mahalanobis distances) describes what is usual there; a text whose distance to it
is beyond `cut` is rejected, as are texts that fail the base rules.

Every estimate is a grouped aggregate that Spark combines before it shuffles, so
a source with a third of all rows costs no more than others. Medians and the share
of rows to concentrate on are exact quantiles of values on a grid, held as counts and
sums by value: the grid bounds their number whatever the rows, and no order of rows
changes them. Steps go on until no group's determinant falls any more; a group keeps
the estimate with its smallest. Groups, languages and all rows are estimated side by
side, and each estimate is then drawn towards the next wider one: a group of n rows has a
share of n / (n + `prior_rows`) in the centre and scatter that judge it. So a
single row is judged by its language, a large group by itself, and no number of rows is a
threshold between the two.

Nulls: a null text has no words and fails the base rules; null languages and
sources form groups of their own. Empty texts: likewise no words. Repeated rows
count as often as they occur. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import fresh_path, let, materialize, removed

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Statistics by name: (expression, least standard deviation). The floors keep a statistic that is the same in most texts of a group from condemning small departures.
FEATURES: dict[str, tuple[Callable[[], Column], float]] = {
    "length": (lambda: F.log1p(F.col("n_words")), 1.0),
    "word_length": (lambda: F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), 0.15),
    "symbols": (lambda: F.sqrt(F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1))), 0.1),
    "dup_lines": (lambda: F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), 0.12),
    "repeats": (lambda: F.sqrt(F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))), 0.12),
}
# The median of the chi-squared distribution with as many degrees of freedom as there are features (5), and its 1 - 1e-7 quantile.
CHI2_MEDIAN, CHI2_CUT = 4.35146, 40.8631
#: Most concentration steps (they end by themselves before), share of rows to concentrate on, and rows that the wider estimate counts for.
STEPS, KEEP_SHARE, PRIOR_ROWS = 40, 0.75, 40
#: Steps of the grid in a unit: of statistics, and of the logarithm of distances.
GRID, RINGS = 1_024, 64
#: The fall of a determinant's logarithm under which an estimate stands.
STILL = 1e-3


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that are found twice or more (windows are compared by a 64-bit hash of their words)."""
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.array_sort(F.transform(F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])), lambda e: e["i"]))
        steps = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return let(let(placed, twice), steps)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, group columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_words = let(
        F.array_remove(F.split(text, SPACE), ""),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    by_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")),
    )
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint")
    return materialize(docs.select(F.col(id_col), *group, by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols")), "op7-statistics").select(id_col, *group, "w.*", "l.*", "n_symbols")


def _joined(rows: DataFrame, params: DataFrame, group: list[str]) -> DataFrame:
    """rows with the columns of params by group; null groups match null groups."""
    p = params.select(*(F.col(g).alias(f"_{g}") for g in group), *(c for c in params.columns if c not in group))
    on = reduce(and_, (rows[g].eqNullSafe(p[f"_{g}"]) for g in group))
    return rows.join(p, on, "left").drop(*(f"_{g}" for g in group))


def _distance(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds d2, by forward substitution through the Cholesky factor l_i_j around m_i."""
    for i, x in enumerate(names):
        y = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        rows = rows.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(names))), F.col("y_0") * F.col("y_0")))


def _cholesky(params: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Adds l_i_j for the covariance c_i_j, whose diagonal is raised to the floors."""
    for i in range(len(names)):
        for j in range(i + 1):
            s = F.col(f"c_{j}_{i}")
            if i == j:
                s = F.coalesce(s, F.lit(0.0)) + F.lit(floors[i] ** 2)
            else:
                s = F.coalesce(s, F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(floors[i] ** 2 / 4))) if i == j else s / F.col(f"l_{j}_{j}"))
    return params


def _on_grid(x: Column) -> Column:
    return F.round(x * GRID).cast("bigint")


def _estimates(rows: DataFrame, by: list[str], names: list[str], floors: list[float], steps: int, keep_share: float) -> DataFrame:
    """(by, m_i, l_i_j, group_rows) of each group."""
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    start = rows.groupBy(*by).agg(F.count("*").alias("group_rows"), *(F.percentile(_on_grid(F.col(n)), q).alias(f"q_{i}") for i, n in enumerate(names)))
    start = start.select(*by, "group_rows", *((F.col(f"q_{i}")[1] / GRID).alias(f"m_{i}") for i in range(len(names))), *((((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / GRID / 1.349) ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(len(names)) for j in range(i, len(names))))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    path = fresh_path(rows.sparkSession, "op7-estimates")
    params, old = materialize(_cholesky(start, names, floors), "", f"{path}-start"), ""
    group_rows = params.select(*by, "group_rows")
    upto = Window.partitionBy(*by).orderBy("ring")
    for step in range(steps):
        # Rows by rings around the centre: the inner ones, up to the share to concentrate on, give the next estimate.
        far = _distance(_joined(rows, params, by), names).select(*by, *names, F.floor(F.log1p("d2") * RINGS).alias("ring"))
        sums = [F.sum(n).alias(f"s_{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in pairs]
        rings = far.groupBy(*by, "ring").agg(F.count("*").alias("n"), *sums)
        before = F.sum("n").over(upto) - F.col("n")
        inner = rings.withColumns({"_before": before, "_all": F.sum("n").over(Window.partitionBy(*by))}).where(F.col("_before") < keep_share * F.col("_all"))
        whole = inner.groupBy(*by).agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in (*(f"s_{i}" for i in range(len(names))), *(f"p_{i}_{j}" for i, j in pairs))))
        mean = [(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(names))]
        moments = whole.select(*by, *mean, *((F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n")).alias(f"c_{i}_{j}") for i, j in pairs))
        newer = _cholesky(moments, names, floors).withColumn("spread", sum((F.log(f"l_{i}_{i}") for i in range(1, len(names))), F.log("l_0_0")))
        if step:
            # Of a group whose spread does not fall the estimate stays.
            held = [c for c in newer.columns if c not in by]
            both = _joined(newer, params.select(*by, F.struct(*held).alias("old")), by)
            best = F.when(F.col("spread") < F.col("old.spread"), F.struct(*held)).otherwise(F.col("old"))
            newer = both.select(*by, best.alias("best"), F.coalesce(F.col("old.spread") - F.col("spread") > STILL, F.lit(False)).alias("falls")).select(*by, "best.*", "falls")
        params = materialize(newer, "", f"{path}-{step}")
        going = not step or params.where("falls").limit(1).count()
        params = params.drop("falls")
        if old:
            removed(rows.sparkSession, old)
        old = f"{path}-{step}"
        if not going:
            break
    levels = materialize(_joined(params.drop("group_rows"), group_rows, by), "op7-levels")
    removed(rows.sparkSession, f"{path}-*")
    return levels


def _drawn(params: DataFrame, keys: list[str], names: list[str], floors: list[float], prior_rows: int) -> DataFrame:
    """(keys, m_i, l_i_j, own): each group's centre and scatter mixed with the next wider level's, which was mixed before; own is the group's share.

    How far the centres lie apart adds nothing to the scatter, or a few strange rows would make themselves usual.
    """
    n, wide = len(names), None
    # What the factor was made of: without the floors, which come on again at the end.
    scatter = lambda i, j: sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j + 1)), F.lit(-(floors[i] ** 2) if i == j else 0.0))
    plain = params.select(*keys, "group_rows", *(f"m_{i}" for i in range(n)), *(scatter(i, j).alias(f"c_{j}_{i}") for i in range(n) for j in range(i + 1)))
    out = None
    for level in range(len(keys) - 1, -1, -1):
        mine = plain.where(F.col("_level") == level)
        if wide is None:
            mixed = mine.withColumn("own", F.lit(1.0))
        else:
            # The wider group is that of one column fewer.
            up = wide.select(F.struct(*(c for c in wide.columns if c not in keys)).alias("w"), *keys).select("w", *(F.col(c).alias(f"_up{c}") for c in keys))
            on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_up{c}")) for c in keys[1 : len(keys) - level - 1]), F.col("_level") + 1 == F.col("_up_level"))
            own = F.col("group_rows") / (F.col("group_rows") + F.lit(prior_rows))
            both = mine.join(up, on, "left").withColumn("own", own)
            mix = lambda c: F.col("own") * F.col(c) + (1 - F.col("own")) * F.col(f"w.{c}")
            mixed = both.select(*keys, "group_rows", "own", *(mix(f"m_{i}").alias(f"m_{i}") for i in range(n)), *(mix(f"c_{j}_{i}").alias(f"c_{j}_{i}") for i in range(n) for j in range(i + 1)))
        wide = mixed
        out = mixed if out is None else out.unionByName(mixed)
    return _cholesky(out, names, floors).select(*keys, "own", *(f"m_{i}" for i in range(n)), *(f"l_{i}_{j}" for i in range(n) for j in range(i + 1)))


def outliers(stats: DataFrame, group: tuple[str, ...] = ("lang", "source"), steps: int = STEPS, keep_share: float = KEEP_SHARE, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """stats with distance (double): the squared Mahalanobis distance, scaled to a chi-squared median.

    The wider estimate that a group is mixed with is the one without its last column, and so on to all rows.
    """
    names, floors = list(FEATURES), [f for _, f in FEATURES.values()]
    plain = stats.columns
    rows = stats.select("*", *(f().alias(n) for n, (f, _) in FEATURES.items()))
    kinds = {g: stats.schema[g].dataType for g in group}
    keys = ["_level", *(f"_{g}" for g in group)]
    at = lambda k: F.struct(F.lit(k).alias("_level"), *((F.col(g) if i < len(group) - k else F.lit(None).cast(kinds[g])).alias(f"_{g}") for i, g in enumerate(group)))
    levels = [at(k) for k in range(len(group) + 1)]
    every = rows.select(*names, F.explode(F.array(*levels)).alias("_at")).select("_at.*", *names)
    drawn = materialize(_drawn(_estimates(every, keys, names, floors, steps, keep_share), keys, names, floors, prior_rows), "op7-drawn")
    far = _distance(_joined(every, drawn, keys), names).select(*keys, _on_grid(F.log1p("d2")).alias("far"))
    # A group more concentrated than a normal one is not stretched: small departures there stay small.
    stretch = F.greatest(F.expm1(F.percentile("far", F.lit(0.5)) / GRID) / F.lit(CHI2_MEDIAN), F.lit(1.0))
    scales = materialize(_joined(drawn.select(*keys, "own"), far.groupBy(*keys).agg(stretch.alias("scale")), keys), "op7-scale")
    out = rows
    for k in range(len(levels)):
        mine = scales.where(F.col("_level") == k).select(*keys, F.col("own").alias(f"own_{k}"), F.col("scale").alias(f"scale_{k}"))
        if not k:
            mine = _joined(mine, drawn.drop("own"), keys)
        out = _joined(out.select("*", levels[k].alias("_at")).select("*", "_at.*").drop("_at"), mine, keys).drop(*keys)
    # Scales are mixed by their logarithms: a small group of strange rows has a very large one.
    scale = F.log(f"scale_{len(group)}")
    for k in range(len(group) - 1, -1, -1):
        scale = F.col(f"own_{k}") * F.log(f"scale_{k}") + (1 - F.col(f"own_{k}")) * scale
    return _distance(out, names).select(*plain, (F.col("d2") / F.exp(scale)).alias("distance"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, ...] = ("lang", "source"), cut: float = CHI2_CUT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = outliers(statistics(docs, id_col, text_col, group), group)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("distance") <= cut)).alias("kept"), "distance")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
