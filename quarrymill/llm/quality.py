"""Document quality: base counts, and robust multivariate outliers by the minimum covariance determinant."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import discard, free_name, materialize

SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"[!?;:]")
SHOUT = re.compile(r"(?<=[A-ZÀ-ÖØ-Þ])[A-ZÀ-ÖØ-Þ]")
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_shout", "n_lines")

#: (feature, transformation of numerator / denominator, least standard deviation).  The least deviation keeps a
#: statistic that is constant among ordinary texts (most have no symbol at all) from rejecting the first text that differs a little.
FEATURES = (
    ("word_length", "ln", "word_chars", "n_words", 0.05),
    ("symbols", "asinh", "n_symbols", "n_words", 0.2),
    ("dup_lines", "asinh", "n_dup_lines", "n_lines", 0.6),
    ("repeats", "asinh", "n_repeat_words", "n_words", 0.6),
    ("marks", "asinh", "n_marks", "n_words", 0.2),
    ("shouting", "asinh", "n_shout", "word_chars", 0.2),
)


def features(row: dict[str, Column]) -> list[Column]:
    """The transformed statistics: logarithms, and for shares that may be zero asinh of ten times the share."""
    return [F.ln(F.try_divide(row[a], row[b])) if kind == "ln" else F.asinh(F.lit(10.0) * F.try_divide(row[a], row[b])) for _, kind, a, b, _ in FEATURES]


def base_failed(row: dict[str, Column]) -> Column:
    return (row["n_words"] < 50) | (100 * row["n_repeat_words"] > 50 * row["n_words"])


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of that many words which occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    marked = bytearray(n)
    ones = b"\x01" * width
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            marked[i : i + width] = ones
            marked[j : j + width] = ones
    return marked.count(1)


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text.  Words are runs of anything but ASCII white space; null has none.

    A line (split at newlines alone) counts if it holds a word; it is a duplicate if an earlier one equals it.
    """
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, BLANK))
    return (len(words), chars, len(SYMBOLS.findall(text)), dup, repeated_words(words), len(MARKS.findall(text)), len(SHOUT.findall(text)), lines)


def text_counts(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The kept columns and COUNTS of every row's text."""
    src = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("text"))
    names = [*keep, *COUNTS]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counts(t) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names)

    return src.mapInArrow(run, f"{kinds}, {', '.join(f'{c} long' for c in COUNTS)}")


def chi2_cdf(x: float, even: int) -> float:
    """Of an even number of degrees of freedom, where it has a closed form."""
    term = total = 1.0
    for i in range(1, even // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, even: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, even) < p else (lo, mid)
    return hi


def _model(center: np.ndarray, cov: np.ndarray, floors: np.ndarray) -> tuple[list[float], list[float]]:
    inverse = np.linalg.inv(cov + np.diag(floors**2))
    return center.tolist(), ((inverse + inverse.T) / 2).ravel().tolist()


MODEL_SCHEMA = "grp string, center array<double>, inverse array<double>"


def _distance(values: list[Column], center: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of values from center under inverse, as one codegen expression."""
    p = len(values)
    diff = [v - center[i] for i, v in enumerate(values)]
    total = F.lit(0.0)
    for i in range(p):
        total = total + diff[i] * diff[i] * inverse[i * p + i]
        for j in range(i):
            total = total + F.lit(2.0) * diff[i] * diff[j] * inverse[i * p + j]
    return total


def _distances(rows: DataFrame, model: DataFrame, p: int) -> DataFrame:
    return rows.join(model, rows["grp"] == model["grp"]).select(rows["grp"], *[f"f{i}" for i in range(p)], _distance([F.col(f"f{i}") for i in range(p)], F.col("center"), F.col("inverse")).alias("d2"))


def mcd_models(rows: DataFrame, floors: list[float], share: float = 0.5, steps: int = 3) -> DataFrame:
    """(grp, center, inverse): the minimum-covariance-determinant estimate of each group of rows (grp, f0, f1, ...).

    Deterministic MCD with concentration steps over all rows: from medians and median deviations, each step ranks the
    rows of a group by distance, takes the share with the smallest, and re-estimates center and covariance from it.
    Ranks come from a fine histogram of distances and estimates from sums, so a group is never gathered in one task.
    The result is scaled to be consistent for normal data.
    """
    p = len(floors)
    low = np.array(floors)
    names = [f"f{i}" for i in range(p)]
    scale = share / chi2_cdf(chi2_quantile(share, p), p + 2)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_model(np.array(c), np.diag((1.4826 * np.array(m)) ** 2), low) for c, m in zip(b["c"], b["m"], strict=True)]
            yield pd.DataFrame({"grp": b["grp"], "center": [o[0] for o in out], "inverse": [o[1] for o in out]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, s, ss in zip(b["n"], b["s"], b["ss"], strict=True):
                center, moments = np.array(s) / n, np.zeros((p, p))
                moments[np.tril_indices(p)] = np.array(ss) / n
                moments = np.tril(moments) + np.tril(moments, -1).T
                out.append(_model(center, scale * (moments - np.outer(center, center)), low))
            yield pd.DataFrame({"grp": b["grp"], "center": [o[0] for o in out], "inverse": [o[1] for o in out]})

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.col("grp").alias("g"), *df.columns[1:])

    mid = materialize(rows.groupBy("grp").agg(F.array(*[F.percentile_approx(c, 0.5, 10_000) for c in names]).alias("c")), "mcd-median")
    off = rows.join(keyed(mid), F.col("grp") == F.col("g")).groupBy("grp").agg(F.array(*[F.percentile_approx(F.abs(F.col(f"f{i}") - F.col("c")[i]), 0.5, 10_000) for i in range(p)]).alias("m"))
    model = materialize(mid.join(keyed(off), F.col("grp") == F.col("g")).select("grp", "c", "m").mapInPandas(start, MODEL_SCHEMA), "mcd-model")
    discard(mid)
    for _ in range(steps):
        near = _distances(rows, model, p)
        bucket = F.floor(F.log(F.col("d2") + 1e-9) * 16)
        bars = near.groupBy("grp", bucket.alias("bar")).agg(F.count("*").alias("n"))
        up_to = Window.partitionBy("grp").orderBy("bar")
        cut = bars.select("grp", "bar", F.sum("n").over(up_to).alias("below"), F.sum("n").over(Window.partitionBy("grp")).alias("all"))
        cut = materialize(cut.where(F.col("below") >= F.col("all") * share).groupBy(F.col("grp").alias("g")).agg(F.min("bar").alias("cut")), "mcd-cut")
        inside = near.join(cut, F.col("grp") == F.col("g")).where(bucket <= F.col("cut"))
        sums = inside.groupBy("grp").agg(
            F.count("*").alias("n"),
            F.array(*[F.sum(c) for c in names]).alias("s"),
            F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i in range(p) for j in range(i + 1)]).alias("ss"),
        )
        nxt = materialize(sums.mapInPandas(again, MODEL_SCHEMA), "mcd-model")
        discard(model, cut)
        model = nxt
    return model


def _groups(group_cols: tuple[str, ...]) -> dict[str, Column]:
    return {f"g{i}": F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for i, c in enumerate(group_cols)}


def fit(stats: DataFrame, n_cols: int, least_group: int) -> tuple[DataFrame, DataFrame]:
    """(groups, models) of stats, which has COUNTS and g0, g1, ..: groups (h0, h1, .., grp: null without an estimate)
    says which model a row of a group is held against."""
    row = {c: F.col(c) for c in COUNTS}
    failed = base_failed(row)
    gs = [f"g{i}" for i in range(n_cols)]
    levels = [F.concat_ws("\x01", *[F.col(g) if i < n else F.lit("\x02") for i, g in enumerate(gs)]) for n in range(n_cols, -1, -1)]
    chosen = stats.where(~failed).groupBy(*gs).agg(F.count("*").alias("n")).withColumn("grp", levels[0])
    for level in levels[1:]:
        chosen = chosen.withColumn("held", F.sum("n").over(Window.partitionBy("grp"))).withColumn("grp", F.when(F.col("held") >= least_group, F.col("grp")).otherwise(level)).drop("held")
    chosen = chosen.withColumn("held", F.sum("n").over(Window.partitionBy("grp")))
    groups = materialize(chosen.select(*[F.col(g).alias(f"h{i}") for i, g in enumerate(gs)], F.when(F.col("held") >= least_group, F.col("grp")).alias("grp")), "quality-groups")
    rated = stats.where(~failed).join(groups, [F.col(g) == F.col(f"h{i}") for i, g in enumerate(gs)]).where("grp is not null")
    rated = materialize(rated.select("grp", *[f.alias(f"f{i}") for i, f in enumerate(features(row))]), "quality-features")
    models = mcd_models(rated, [f[-1] for f in FEATURES])
    discard(rated)
    return groups, models


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
    least_group: int = 50,
    tail: float = 1e-6,
) -> DataFrame:
    """One row for each row of docs: (id_col, COUNTS, grp, base_failed, distance2, kept).

    base_failed: under 50 words, or over half of the words repeat.  Other rows are rejected if their squared
    Mahalanobis distance from the robust estimate of their group (language and source) exceeds the chi-square
    quantile of the tail.  Groups of under least_group such rows are pooled by language, then altogether; rows of a
    pool that is still smaller have no estimate (distance2 null) and are kept.  Null languages and sources are
    groups of their own.  Null and empty texts have zero counts and fail.  Repeated rows and ties are judged alike.
    Other columns are not read.  An empty table gives an empty result.
    """
    stats = materialize(text_counts(docs, {"id": F.col(id_col)} | _groups(group_cols), text_col), "quality-counts")
    groups, models = fit(stats, len(group_cols), least_group)
    near = stats.join(groups, [F.col(f"g{i}") == F.col(f"h{i}") for i in range(len(group_cols))], "left")
    near = near.join(models.withColumnRenamed("grp", "grp_"), F.col("grp") == F.col("grp_"), "left")
    row = {c: F.col(c) for c in COUNTS}
    failed = base_failed(row)
    distance = F.when(~failed, _distance(features(row), F.col("center"), F.col("inverse")))
    kept = ~failed & (F.coalesce(distance, F.lit(0.0)) <= chi2_quantile(1 - tail, len(FEATURES)))
    return near.select(F.col("id").alias(id_col), *COUNTS, "grp", failed.alias("base_failed"), distance.alias("distance2"), kept.alias("kept"))


def keep_good(
    docs: DataFrame,
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
    least_group: int = 50,
    tail: float = 1e-6,
) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs.

    docs is read twice, once for the estimates and once to hold each row against its group's; only the small tables of
    groups and estimates are joined to it, so no text is shuffled.  Rows need no id.
    """
    stats = materialize(text_counts(docs, _groups(group_cols), text_col), "quality-counts")
    groups, models = fit(stats, len(group_cols), least_group)
    known = groups.join(models.withColumnRenamed("grp", "grp_"), F.col("grp") == F.col("grp_"), "left")
    known = materialize(known.select(F.array(*[f"h{i}" for i in range(len(group_cols))]).alias("of"), "center", "inverse"), "quality-known")
    discard(stats, groups, models)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS))

    name = free_name(docs, "quality_counts")
    own = docs.withColumn(name, counted(F.col(text_col)))
    row = {c: F.col(name)[c] for c in COUNTS}
    joined = own.join(known, F.array(*[F.coalesce(docs[c].cast("string"), F.lit("\x00")) for c in group_cols]) == known["of"], "left")
    failed = base_failed(row)
    distance = F.when(~failed, _distance(features(row), known["center"], known["inverse"]))
    good = ~failed & (F.coalesce(distance, F.lit(0.0)) <= chi2_quantile(1 - tail, len(FEATURES)))
    return joined.where(good).select(*[docs[c] for c in docs.columns])
