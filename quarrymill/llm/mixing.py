"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import discard, free_name, materialize

#: Seeds of the stand-in topics: documents carry no topic, so the family of endings that is most frequent is taken.
#: Pass topic= for a classifier's column.
TOPIC_SEEDS = (("action", "tion"), ("process", "ing"), ("state", "ed "), ("agent", "er "))
#: Rounds of raking; each scales to every marginal once.
ROUNDS = 10
#: Exponent of the default targets: the corpus's own shares raised to it and brought back to one.
ALPHA = 0.85
SEED = "mix-1"
DIMS = ("source", "lang", "topic")


def topic_of(text: Column, seeds: tuple[tuple[str, str], ...] = TOPIC_SEEDS) -> Column:
    """The topic whose seed occurs most often (ties: the first listed); other where none does."""
    hits = [((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / F.lit(float(len(s)))).alias(t) for t, s in seeds]
    best = F.greatest(*hits)
    found = F.lit("other")
    for (topic, _), n in reversed(list(zip(seeds, hits, strict=True))):
        found = F.when(n == best, F.lit(topic)).otherwise(found)
    return F.when(best > 0, found).otherwise(F.lit("other"))


def tokens_of(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def uniform_of(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the row's id (its text where that is null) and the seed decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.md5(text.cast("binary")))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def rake(cells: DataFrame, weight: str, targets: Mapping[str, Mapping[str, float] | None], rounds: int = ROUNDS, alpha: float = ALPHA) -> DataFrame:
    """cells with share (of the weight now) and raked (share fitted to the targets).

    cells has one row for each combination of the marginal columns, so windows over it hold combinations, not documents.
    A target maps levels to weights; levels that cells lack are left out and the rest is brought back to a sum of one;
    levels without a weight get none.  None takes the shares of cells raised to alpha.
    """
    total = Window.partitionBy()
    sums = cells.agg(F.sum(weight).alias("w")).first()["w"]
    cur = cells.withColumn("share", F.col(weight) / F.lit(float(sums or 1))).withColumn("raked", F.col("share"))
    for dim, given in targets.items():
        if given is None:
            level = cells.groupBy(dim).agg(F.pow(F.sum(weight) / F.lit(float(sums or 1)), F.lit(alpha)).alias("goal"))
        else:
            goal = F.lit(0.0)
            for name, w in given.items():
                goal = F.when(F.col(dim) == name, F.lit(float(w))).otherwise(goal)
            level = cells.select(dim).distinct().withColumn("goal", goal)
        level = level.select(F.col(dim).alias(f"{dim}_level"), (F.col("goal") / F.sum("goal").over(total)).alias(f"{dim}_goal"))
        cur = cur.join(level, F.col(dim) == F.col(f"{dim}_level")).drop(f"{dim}_level")
    start = cur = materialize(cur, "mix-start")
    for done in range(rounds):
        if done and done % 5 == 0:  # keeps the plan short
            cur = materialize(cur, "mix-round")
            discard(start)
            start = cur
        for dim in targets:
            held = F.sum("raked").over(Window.partitionBy(dim))
            cur = cur.withColumn("raked", F.when(held > 0, F.col("raked") * F.col(f"{dim}_goal") / held).otherwise(F.lit(0.0)))
    return cur.drop(*[f"{d}_goal" for d in targets])


def _levels(docs: DataFrame, id_col: str, text_col: str, source: Column | None, lang: Column | None, topic: Column | None, seed: str) -> dict[str, Column]:
    text = F.coalesce(docs[text_col], F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return {
        "source": blank(docs["source"] if source is None else source),
        "lang": blank(docs["lang"] if lang is None else lang),
        "topic": blank(topic_of(text) if topic is None else topic),
        "tokens": tokens_of(text),
        "u": uniform_of(docs[id_col], text, seed),
    }


def _fit(rows: DataFrame, targets: Mapping[str, Mapping[str, float] | None] | None, rounds: int, alpha: float) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, mix_probability) of each cell of rows (source, lang, topic, tokens)."""
    cells = materialize(rows.where("tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("weight")), "mix-cells")
    raked = rake(cells, "weight", {d: (targets or {}).get(d) for d in DIMS}, rounds, alpha)
    raked = materialize(raked.select(*[F.col(d).alias(f"mix_{d}") for d in DIMS], (F.col("raked") / F.col("share")).alias("ratio")), "mix-raked")
    top = raked.agg(F.max("ratio")).first()[0] or 1.0
    discard(cells)
    return raked.select(*[f"mix_{d}" for d in DIMS], (F.col("ratio") / F.lit(float(top))).alias("mix_probability"))


def _probability(tokens: Column, fitted: Column) -> Column:
    return F.when(tokens == 0, F.lit(1.0)).otherwise(F.coalesce(fitted, F.lit(0.0)))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | None] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source: Column | None = None,
    lang: Column | None = None,
    topic: Column | None = None,
    rounds: int = ROUNDS,
    alpha: float = ALPHA,
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of docs: (id_col, source, lang, topic, tokens, probability, sampled).

    Token weights of the cells (source, language, topic) are raked to the targets' marginals (see rake); a row's
    probability is its cell's raked share over its share, scaled so that the largest is one, so the expected tokens of
    the sample have the target shares.  sampled: a hash of the id falls below the probability; the same rows in every run.
    Null sources and languages are the level '' ; null and empty texts have no tokens, weigh nothing and keep
    probability one.  Rows that repeat an id have one hash.  Other columns are not read.  An empty table gives
    an empty result.

    Only DataFrame operations are used.  Documents are summed to cells before anything is gathered, so one source with
    a third of the rows is a row in each of its cells.
    """
    levels = _levels(docs, id_col, text_col, source, lang, topic, seed)
    rows = materialize(docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in levels.items()]), "mix-rows")
    joined = rows.join(_fit(rows, targets, rounds, alpha), [F.col(d) == F.col(f"mix_{d}") for d in DIMS], "left")
    p = _probability(F.col("tokens"), F.col("mix_probability"))
    return joined.select(F.col("id").alias(id_col), *DIMS, "tokens", p.alias("probability"), (F.col("u") < p).alias("sampled"))


def sample_mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | None] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source: Column | None = None,
    lang: Column | None = None,
    topic: Column | None = None,
    rounds: int = ROUNDS,
    alpha: float = ALPHA,
    seed: str = SEED,
) -> DataFrame:
    """The rows of docs that mix() samples, with the columns of docs.  docs is read twice; only cells are joined to it."""
    levels = _levels(docs, id_col, text_col, source, lang, topic, seed)
    fitted = _fit(docs.select(*[c.alias(k) for k, c in levels.items()]), targets, rounds, alpha)
    fitted = fitted.select(F.struct(*[f"mix_{d}" for d in DIMS]).alias(name := free_name(docs, "mix_cell")), F.col("mix_probability").alias(chance := free_name(docs, "mix_probability")))
    same = [levels[d] == fitted[name][f"mix_{d}"] for d in DIMS]
    joined = docs.join(fitted, same, "left").where(levels["u"] < _probability(levels["tokens"], F.col(chance)))
    return joined.select(*[docs[c] for c in docs.columns])


def oracle(rounds: int = ROUNDS, alpha: float = ALPHA, seed: str = SEED) -> str:
    """The query op1 for DuckDB: every scaling step is a table expression."""
    n = [f"(length(t) - length(replace(t, '{s}', ''))) / {float(len(s))}" for _, s in TOPIC_SEEDS]
    best = f"greatest({', '.join(n)})"
    topic = f"CASE WHEN {best} > 0 THEN CASE " + " ".join(f"WHEN {x} = {best} THEN '{name}'" for (name, _), x in zip(TOPIC_SEEDS, n, strict=True)) + " END ELSE 'other' END"
    goals = ", ".join(f"g_{d} AS (SELECT {d}, power(sum(w) / (SELECT sum(w) FROM cells), {alpha}) AS g FROM cells GROUP BY 1), t_{d} AS (SELECT {d}, g / sum(g) OVER () AS goal_{d} FROM g_{d})" for d in DIMS)
    steps, last = [], "s0"
    for i in range(rounds):
        for d in DIMS:
            name = f"s{i}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (raked * goal_{d} / sum(raked) OVER (PARTITION BY {d}) AS raked) FROM {last})")
            last = name
    return f"""
    WITH d AS (SELECT *, coalesce(text, '') AS t FROM documents),
    r AS (
      SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, CAST(ceil(strlen(t) / 4) AS BIGINT) AS tokens,
        CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(t))), 1, 13) AS UBIGINT) AS DOUBLE) / {float(16**13)} AS u
      FROM d
    ), cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS w FROM r WHERE tokens > 0 GROUP BY ALL),
    {goals},
    s0 AS (SELECT *, w / sum(w) OVER () AS share, w / sum(w) OVER () AS raked FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
    {", ".join(steps)},
    f AS (SELECT source, lang, topic, raked / share / max(raked / share) OVER () AS p FROM {last}),
    j AS (SELECT r.*, CASE WHEN tokens = 0 THEN 1.0 ELSE coalesce(p, 0) END AS q FROM r LEFT JOIN f USING (source, lang, topic))
    SELECT doc_id, source, lang, topic, tokens, round(q, 6) AS probability, u < q AS sampled FROM j
    """
