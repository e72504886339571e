"""Markdown structure by windows over lines: headings, sections, separators, typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Line shapes.
HEADING = r"(?s)^(#{1,6})\s+(.+)$"
SECTION_NUMBER = r"(?s)^(\d+(?:\.\d+)*\.?)\s+(.*)"
SEPARATOR = r"^\s*-{3}\s*$"
TABLE_ROW = r"(?s)^\|.*\|\s*$"
LIST_ITEM = r"^(\s*[-*+]\s|\s*\d+[.)]\s)"
FIGURE = r"(?i)\[VLM\s*-|\[Figure\s*[—–-]|^Figure\s+\d+:"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def section_number(heading: Column) -> Column:
    number = F.regexp_replace(F.regexp_extract(stripped(heading), SECTION_NUMBER, 1), r"\.+$", "")
    return F.when(number != "", number)


def line_type(line: Column) -> Column:
    return F.when(line.rlike(TABLE_ROW), "table").when(line.rlike(LIST_ITEM), "list").when(line.rlike(FIGURE), "figure").otherwise("prose")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """(doc_id, line from 1, text, level, heading, section_number); level is null on lines that are no heading."""
    split = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("at", "text"))
    level = F.length(F.regexp_extract("text", HEADING, 1))
    heading = F.when(level > 0, stripped(F.regexp_extract("text", HEADING, 2)))
    return split.select(id_col, (F.col("at") + 1).alias("line"), "text", F.when(level > 0, level).alias("level"), heading.alias("heading"), section_number(heading).alias("section_number"))


def sections(lined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """lines() with node (its section's heading line, 0 before the first), root (that of the top-level section) and, on
    headings, parent (0: the document).

    A heading is top-level if no earlier one has a lower level; its parent is the last earlier one of a lower level.
    """
    before = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lasts = [F.max(F.when(F.col("level") == n, F.col("line"))).over(before).alias(f"last{n}") for n in range(1, 6)]
    lowest = F.min("level").over(before)
    seen = lined.select("*", *lasts, lowest.alias("lowest"))
    top = F.col("level").isNotNull() & F.coalesce(F.col("level") <= F.col("lowest"), F.lit(True))
    parent = F.lit(None).cast("int")
    for n in range(6, 0, -1):
        higher = [F.coalesce(F.col(f"last{m}"), F.lit(0)) for m in range(1, n)]
        found = F.lit(0) if not higher else higher[0] if len(higher) == 1 else F.greatest(*higher)
        parent = F.when(F.col("level") == n, found).otherwise(parent)
    placed = seen.withColumn("parent", F.when(top, F.lit(0)).otherwise(parent)).withColumn("top", top)
    return placed.select(
        *lined.columns,
        F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("line"))).over(to_here), F.lit(0)).alias("node"),
        F.coalesce(F.max(F.when(F.col("top"), F.col("line"))).over(to_here), F.lit(0)).alias("root"),
        F.when(F.col("level").isNotNull(), F.col("parent")).alias("parent"),
    )


def regions(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Content lines with region: 1, 2, .. between consecutive separators of a section, 0 before the first, -1 after the last.

    Separators divide; they do not open and close.
    """
    content = placed.where("level IS NULL")
    node = Window.partitionBy(id_col, "node")
    is_sep = F.col("text").rlike(SEPARATOR)
    counted = content.select("*", is_sep.alias("is_sep"), F.sum(is_sep.cast("int")).over(node.orderBy("line")).alias("c"), F.sum(is_sep.cast("int")).over(node).alias("n"))
    region = F.when(F.col("c") == 0, 0).when(F.col("c") == F.col("n"), -1).otherwise(F.col("c"))
    return counted.where(~F.col("is_sep")).select(*placed.columns, region.cast("int").alias("region"))


def islands(content: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """regions() with block_type and island: runs of lines of one type outside of separated regions.

    Indented prose belongs to a list if the last line that is neither blank nor indented prose is a list item.  A blank
    line ends a table and is part of any other run.  Separated regions are one island each.
    """
    gap = Window.partitionBy(id_col, "node", "region").orderBy("line")
    blank = stripped(F.col("text")) == ""
    kind = F.when(~blank, line_type(F.col("text")))
    loose = (kind == "prose") & F.col("text").rlike(r"^(  |\t)")
    typed = content.select("*", kind.alias("kind"), loose.alias("loose"))
    firm = F.last(F.when(F.col("kind").isNotNull() & ~F.col("loose"), F.col("kind")), ignorenulls=True).over(gap.rowsBetween(Window.unboundedPreceding, 0))
    effective = typed.withColumn("effective", F.when(F.col("loose") & (firm == "list"), F.lit("list")).otherwise(F.col("kind")))
    past = gap.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("effective", ignorenulls=True).over(past)
    after_blank = F.lag("kind").over(gap).isNull()
    starts = F.col("effective").isNotNull() & (before.isNull() | (F.col("effective") != before) | ((F.col("effective") == "table") & after_blank))
    cut = effective.withColumn("starts", starts.cast("int"))
    cut = cut.withColumn("run", F.sum("starts").over(gap))
    run = Window.partitionBy(id_col, "node", "region", "run")
    atomic = F.col("region") > 0
    return cut.select(
        *content.columns,
        F.when(atomic, F.lit("atomic_delimited")).otherwise(F.max(F.when(F.col("starts") == 1, F.col("effective"))).over(run)).alias("block_type"),
        F.when(atomic, F.lit(1)).otherwise(F.col("run")).cast("int").alias("island"),
    )


def blocks(typed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, root, node, start_line, block_type, text): the blocks of each section in order; empty ones are left out."""
    grouped = typed.where("island > 0").groupBy(id_col, "root", "node", "region", "island").agg(
        F.min("line").alias("start_line"), F.max("block_type").alias("block_type"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("said")
    )
    text = stripped(F.array_join(F.transform("said", lambda x: x["text"]), "\n"))
    return grouped.select(id_col, "root", "node", "start_line", "block_type", text.alias("text")).where("text <> ''")


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) of whole documents."""
    placed = sections(lines(docs, id_col, text_col), id_col)
    return placed.where("level IS NOT NULL"), blocks(islands(regions(placed, id_col), id_col), id_col)
