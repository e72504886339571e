"""Exact lookup of identifiers over the chunk store."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import written


#: Store rows with the same values found, and queries of those values, that meet in one row of the join before pairs are made.
ROW_BLOCK, QUERY_BLOCK = 1024, 1024


def _field_matches(wanted: DataFrame, store: DataFrame, field: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    values = wanted.select("value").distinct()
    return store.select(*keys, F.col(field).alias("value")).join(values, "value"), wanted


def _delimited_matches(wanted: DataFrame, store: DataFrame, field: str, keys: list[str], sep: str = ";") -> tuple[DataFrame, DataFrame]:
    values = wanted.select("value").distinct()
    rows = store.where(F.col(field).isNotNull()).select(*keys, F.col(field).alias("whole"))
    rest = values.join(rows.select(F.col("whole").alias("value")).distinct(), "value", "left_anti")
    parts = rows.select(*keys, F.explode(F.array_distinct(F.transform(F.split("whole", sep), lambda p: F.lower(F.trim(p))))).alias("part"))
    listed = parts.join(rest, F.col("part") == F.lower("value")).select(*keys, "value")
    exact = rows.join(values, F.col("whole") == F.col("value")).select(*keys, "value")
    return exact.union(listed), wanted


def _text_matches(wanted: DataFrame, store: DataFrame, keys: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    asked = wanted.select("query_id", F.lower("value").alias("value"))
    listed = [r["value"] for r in asked.where("value IS NOT NULL").select("value").distinct().collect()]
    values = F.lit(listed) if listed else F.array().cast("array<string>")
    # a text is lower-cased once, not for each value
    hits = F.flatten(F.transform(F.array(F.lower(F.col(text_col))), lambda t: F.filter(values, lambda v: F.contains(t, v))))
    return store.select(*keys, F.explode(hits).alias("value")), asked


def _pairs(found: list[tuple[DataFrame, DataFrame]], keys: list[str]) -> DataFrame:
    """(query_id, keys), each once, of matches (keys, value) and askers (query_id, value), value by value.

    There may be as many pairs as queries times rows, so no pair is shuffled: a row's values are gathered, the queries of
    each set of values are listed once in blocks, and pairs are made last, by tasks of a bounded share of rows.
    """
    tag = lambda i: F.concat(F.lit(f"{i}:"), "value").alias("value")
    matches = reduce(DataFrame.union, [m.select(*keys, tag(i)) for i, (m, _) in enumerate(found)])
    askers = reduce(DataFrame.union, [w.select("query_id", tag(i)) for i, (_, w) in enumerate(found)]).where("query_id IS NOT NULL").distinct()
    rows = written(matches.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("values")), "lookup-rows")
    sets = rows.groupBy("values").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("shares"))
    n_q = max(1, math.ceil(askers.select("query_id").distinct().count() / QUERY_BLOCK))
    each = sets.select("values", "shares", F.explode("values").alias("value")).join(askers, "value").select("values", "shares", "query_id").distinct()
    blocks = each.groupBy("values", "shares", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("block")).agg(F.collect_list("query_id").alias("queries"))
    blocks = blocks.select("values", "queries", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = rows.join(sets, "values").withColumn("share", F.pmod(F.xxhash64(*keys), F.col("shares")).cast("int"))
    # few bytes make many pairs, so the number of tasks must not follow the bytes
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, blocks = (x.repartition(n, "values", "share") for x in (dealt, blocks))
    return dealt.join(blocks, ["values", "share"]).select(F.explode("queries").alias("query_id"), *keys)


def by_field(wanted: DataFrame, store: DataFrame, field: str, keys: list[str]) -> DataFrame:
    """(query_id, keys): rows whose field equals one of the query's values (query_id, value)."""
    return _pairs([_field_matches(wanted, store, field, keys)], keys)


def by_delimited(wanted: DataFrame, store: DataFrame, field: str, keys: list[str], sep: str = ";") -> DataFrame:
    """(query_id, keys): rows whose whole field equals the value; for a value without any, rows that list it, whatever the case.

    One exact row therefore hides rows that list the value among others.
    """
    return _pairs([_delimited_matches(wanted, store, field, keys, sep)], keys)


def by_text(wanted: DataFrame, store: DataFrame, keys: list[str], text_col: str = "text", limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(query_id, keys): rows whose text holds the value, whatever the case.  All rows are read unless limit asks for the
    first so many in the order given.

    The values wanted are few identifiers of the queries; each text is tested against them in one pass, without joining pairs.
    """
    rows = store
    if limit is not None:
        first = Window.orderBy(*(order or keys))
        rows = store.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit).drop("nth")
    return _pairs([_text_matches(wanted, rows, keys, text_col)], keys)


def exact_lookup(wanted: dict[str, DataFrame], store: DataFrame, keys: list[str], text_col: str = "text", columns: dict[str, str] | None = None) -> DataFrame:
    """(query_id, keys, score 1.0) for identifiers by kind: test_case by field, requirement and cross_reference by
    delimited field, component by text.  Every hit once, none cut, in no order.  An absent kind finds nothing."""
    names = {"test_case": "test_case_id", "requirement": "requirement_ids", "cross_reference": "traceability_ids"} | (columns or {})
    found = []
    for kind, rows in wanted.items():
        if kind == "test_case":
            found.append(_field_matches(rows, store, names[kind], keys))
        elif kind == "component":
            found.append(_text_matches(rows, store, keys, text_col))
        else:
            found.append(_delimited_matches(rows, store, names[kind], keys))
    return _pairs(found, keys).withColumn("score", F.lit(1.0))


def lists(column: Column) -> Column:
    """A list column as the store's delimited text."""
    return F.nullif(F.array_join(column, ";"), F.lit(""))
