"""Operators over text boxes on pages: overlaps, groups, reading order, roles, checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lookups as L
from ..functions.kernels import collision_labels
from ..session import cut_lineage
from .components import connected_components

CELL = 100.0
#: A page with this many boxes at most is compared in one piece; larger ones are spread over the grid.
PAGE = 512
#: Boxes of the pages that a call compares, on average.
PAGES = 20_000


def _edges(df: DataFrame) -> DataFrame:
    """left, top, right, bottom whatever the sign of the width."""
    other = F.col("left_pt") + F.col("width_pt")
    return df.select(
        "*",
        F.least("left_pt", other).alias("x0"),
        F.greatest("left_pt", other).alias("x1"),
        F.col("top_pt").alias("y0"),
        (F.col("top_pt") + F.col("height_pt")).alias("y1"),
    )


def _meeting_boxes(boxes: DataFrame, cell: float) -> DataFrame:
    """Pairs (a.box_id < b.box_id) of one page whose rectangles touch, through a grid.

    A box is entered in every cell it covers and pairs meet per cell, so a page with
    very many boxes is spread over its cells. A pair is reported only by the cell that
    holds the upper left corner of its intersection, so it comes out once.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    placed = (
        _edges(boxes).select("page_id", "box_id", "x0", "x1", "y0", "y1", "top_pt", "width_pt")
        .withColumn("_cx", cells("x0", "x1")).withColumn("_cy", cells("y0", "y1"))
    )
    a, b = placed.alias("a"), placed.alias("b")
    here = (
        (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    )
    touching = (
        (F.col("a.box_id") < F.col("b.box_id"))
        & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
        & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    )
    corner = (F.floor(F.greatest("a.x0", "b.x0") / cell) == F.col("a._cx")) & (
        F.floor(F.greatest("a.y0", "b.y0") / cell) == F.col("a._cy")
    )
    return a.join(b, here & touching & corner)


def box_overlaps(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """(page_id, box_a, box_b, area) of boxes whose rectangles intersect."""
    width = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    height = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    return _meeting_boxes(boxes, cell).select(
        F.col("a.page_id").alias("page_id"), F.col("a.box_id").alias("box_a"), F.col("b.box_id").alias("box_b"), (width * height).alias("area")
    )


def box_collisions(boxes: DataFrame, min_ratio: float = 0.20, cell: float = CELL) -> DataFrame:
    """Overlaps that cover more than `min_ratio` of the narrower box; upper box first."""
    met = _meeting_boxes(boxes, cell)
    width = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    narrow = F.least(F.abs("a.width_pt"), F.abs("b.width_pt"))
    a_first = F.col("a.y0") <= F.col("b.y0")
    return met.filter((narrow > 0) & (width / narrow > min_ratio)).select(
        F.col("a.page_id").alias("page_id"),
        F.when(a_first, F.col("a.box_id")).otherwise(F.col("b.box_id")).alias("upper_id"),
        F.when(a_first, F.col("b.box_id")).otherwise(F.col("a.box_id")).alias("lower_id"),
        F.when(a_first, F.col("a.y1") - F.col("b.y0")).otherwise(F.col("b.y1") - F.col("a.y0")).alias("overlap_pt"),
    )


def collision_groups(boxes: DataFrame, min_ratio: float = 0.20) -> DataFrame:
    """Connected components of colliding boxes; group_id is the smallest box id of the group.

    No group leaves its page. Pages of `PAGE` boxes at most are compared and labelled whole, many
    to a call, after one shuffle; the boxes of larger ones meet in the grid and go through the rounds
    of `connected_components`. A box without a page or an id is a group of its own.
    """
    boxes = boxes.select("page_id", "box_id", "left_pt", "top_pt", "width_pt", "height_pt")
    named = boxes.filter("page_id IS NOT NULL AND box_id IS NOT NULL")
    rest = boxes.filter("page_id IS NULL OR box_id IS NULL").select("page_id", "box_id", F.col("box_id").cast("long").alias("group_id"))
    counts = named.groupBy("page_id").count()
    total, large = counts.agg(F.sum("count"), F.count_if(F.col("count") > PAGE)).first()
    if not large:
        return _groups_of_pages(named, min_ratio, total or 0).unionByName(rest)
    pages = cut_lineage(counts.filter(F.col("count") > PAGE).select("page_id"))
    small, wide = named.join(pages, "page_id", "left_anti"), named.join(pages, "page_id", "left_semi")
    return _groups_of_pages(small, min_ratio, total).unionByName(_groups_by_rounds(wide, min_ratio)).unionByName(rest)


def _groups_of_pages(boxes: DataFrame, min_ratio: float, total: int) -> DataFrame:
    """`collision_groups` of pages that a call can hold; coordinates are compared as doubles."""

    sides = ["left_pt", "top_pt", "width_pt", "height_pt"]

    def label(table: pa.Table) -> pa.Table:
        page = table.column("page_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        columns = [table.column(c).to_numpy() for c in ("_box", *sides)]
        groups = collision_labels(page, *columns, min_ratio)
        return table.select(["page_id", "box_id"]).append_column("group_id", pa.array(groups, pa.int64()))

    complete = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in sides))
    dealt = boxes.select(
        F.pmod(F.xxhash64("page_id"), F.lit(total // PAGES + 1)).alias("_bucket"), "page_id", "box_id", F.col("box_id").cast("long").alias("_box"),
        *[F.when(complete, F.col(c).cast("double")).otherwise(F.lit(0.0)).alias(c) for c in sides],
    )  # a box with an unknown side touches none, as one without width
    kind = {f.name: f.dataType.simpleString() for f in boxes.schema}
    return dealt.groupBy("_bucket").applyInArrow(label, f"page_id {kind['page_id']}, box_id {kind['box_id']}, group_id BIGINT")


def _groups_by_rounds(boxes: DataFrame, min_ratio: float) -> DataFrame:
    """`collision_groups` of pages of any size."""
    name = lambda box: F.concat_ws(":", F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lpad(F.col(box).cast("string"), 20, "0"))
    edges = box_collisions(boxes, min_ratio).select(name("upper_id").alias("u"), name("lower_id").alias("v"))
    groups = connected_components(edges)
    own = name("box_id")
    smallest = F.split_part("component", F.lit(":"), F.lit(2)).cast("long")
    return (
        boxes.select("page_id", "box_id", own.alias("node")).join(groups, "node", "left")
        .select("page_id", "box_id", F.coalesce(smallest, F.col("box_id").cast("long")).alias("group_id"))
    )


def assign_to_blocks(spans: DataFrame, blocks: DataFrame, cell: float | None = None) -> DataFrame:
    """Span origin inside a block rectangle, edges included; one row per match.

    Spans and blocks meet in grid cells. Without `cell` these are twice as wide and high as the
    mean block, so that a block is entered in about two; the rows are the same for every grid.
    """
    if cell is None:
        wide, high = blocks.agg(F.avg(F.col("bx1") - F.col("bx0")), F.avg(F.col("by1") - F.col("by0"))).first()
        wide, high = (float(2 * x) if x and x > 0 else CELL for x in (wide, high))
    else:
        wide = high = cell
    cells = lambda lo, hi, size: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    b = (
        blocks.select("page_id", "block_id", "bx0", "by0", "bx1", "by1").filter("bx0 <= bx1 AND by0 <= by1")
        .withColumn("_cx", cells("bx0", "bx1", wide)).withColumn("_cy", cells("by0", "by1", high))
    )
    s = spans.withColumn("_cx", F.floor(F.col("left_pt") / wide)).withColumn("_cy", F.floor(F.col("top_pt") / high))
    inside = F.col("left_pt").between(F.col("bx0"), F.col("bx1")) & F.col("top_pt").between(F.col("by0"), F.col("by1"))
    return s.join(b, ["page_id", "_cx", "_cy"]).filter(inside).drop("_cx", "_cy", "bx0", "by0", "bx1", "by1")


def above_table(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Boxes that end above some table of their page and share an x-range with it."""
    b, t = _edges(boxes).alias("b"), tables.alias("t")
    above = (
        (F.col("b.page_id") == F.col("t.page_id"))
        & (F.col("b.y1") <= F.col("t.ty0")) & (F.col("b.x0") < F.col("t.tx1")) & (F.col("b.x1") > F.col("t.tx0"))
    )
    return b.join(t, above, "left_semi").drop("x0", "x1", "y0", "y1")


def _islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, out: str) -> DataFrame:
    """Number consecutive rows; a new number starts where `breaks` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_new", F.when(breaks, 1).otherwise(0))
    return marked.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _merged(df: DataFrame, keys: list[str], order: list[str], joiner: str) -> DataFrame:
    """Bounding box, text in order, mean font of each cluster."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col("text").alias("text"))))
    return df.groupBy(*keys).agg(
        F.min("left_pt").alias("left_pt"),
        F.min("top_pt").alias("top_pt"),
        (F.max(F.col("left_pt") + F.col("width_pt")) - F.min("left_pt")).alias("width_pt"),
        (F.max(F.col("top_pt") + F.col("height_pt")) - F.min("top_pt")).alias("height_pt"),
        F.avg("font_size").alias("font_size"),
        F.count("*").alias("members"),
        F.array_join(F.transform(parts, lambda p: p["text"]), joiner).alias("text"),
    )


def line_clusters(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Merge spans into lines: same height within half a font, gap within 0.3 font."""
    keys = keys or ["page_id"]
    order = ["top_pt", "left_pt", "box_id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col("left_pt") - F.lag(F.col("left_pt") + F.col("width_pt")).over(w)
    drop = F.abs(F.col("top_pt") - F.lag("top_pt").over(w))
    fits = (gap <= F.col("font_size") * 0.3) & (drop < F.col("font_size") * 0.5)
    lined = _islands(spans.withColumn("_break", ~F.coalesce(fits, F.lit(False))), keys, order, F.col("_break"), "line_id")
    return _merged(lined, [*keys, "line_id"], order, " ")


def block_clusters(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Merge lines into blocks: next line within 1.5 font down and 2 font across."""
    keys = keys or ["page_id"]
    order = ["top_pt", "left_pt", "line_id"]
    w = Window.partitionBy(*keys).orderBy(*order)
    drop = F.abs(F.col("top_pt") - F.lag("top_pt").over(w))
    gap = F.col("left_pt") - F.lag(F.col("left_pt") + F.col("width_pt")).over(w)
    fits = (drop < F.col("font_size") * 1.5) & (gap < F.col("font_size") * 2)
    blocked = _islands(lines.withColumn("_break", ~F.coalesce(fits, F.lit(False))), keys, order, F.col("_break"), "block_id")
    return _merged(blocked, [*keys, "block_id"], order, "\n")


def vertical_stacks(boxes: DataFrame, page_height: float, tolerance: float = 0.10, gap_multiplier: float = 1.5) -> DataFrame:
    """Boxes of one column that follow each other closely; (page_id, box_id, column_id, stack_id, anchor_id).

    Left edges chained within the tolerance form a column: in one dimension that is
    where sorted neighbours are no further apart than the tolerance.
    """
    reach = max(page_height, 1.0) * tolerance
    by_left = Window.partitionBy("page_id").orderBy("left_pt", "box_id")
    far = F.col("left_pt") - F.lag("left_pt").over(by_left) > reach
    columns = _islands(boxes.withColumn("_far", F.coalesce(far, F.lit(True))), ["page_id"], ["left_pt", "box_id"], F.col("_far"), "column_id")
    by_top = Window.partitionBy("page_id", "column_id").orderBy("top_pt", "box_id")
    gap = F.col("top_pt") - F.lag(F.col("top_pt") + F.col("height_pt")).over(by_top)
    font = (F.col("font_size") + F.lag("font_size").over(by_top)) / 2
    follows = F.coalesce((gap >= 0) & (gap <= font * gap_multiplier), F.lit(False))
    stacked = _islands(columns.withColumn("_cut", ~follows), ["page_id", "column_id"], ["top_pt", "box_id"], F.col("_cut"), "stack_id")
    sizes = stacked.groupBy("page_id", "column_id", "stack_id").agg(
        F.count("*").alias("members"), F.min_by("box_id", F.struct("top_pt", "box_id")).alias("anchor_id")
    ).filter("members >= 2")
    return stacked.join(sizes, ["page_id", "column_id", "stack_id"]).select("page_id", "box_id", "column_id", "stack_id", "anchor_id", "members")


def column_gaps(blocks: DataFrame) -> DataFrame:
    """Layout complexity of each page: several columns, or many overlapping blocks."""
    center = F.col("left_pt") + F.col("width_pt") / 2
    w = Window.partitionBy("page_id").orderBy("center", "box_id")
    gaps = blocks.withColumn("center", center).withColumn("gap", F.col("center") - F.lag("center").over(w)).withColumn("_i", F.row_number().over(w))
    size = blocks.groupBy("page_id").agg(F.count("*").alias("n"))
    ranked = gaps.join(size, "page_id")
    stats = ranked.groupBy("page_id").agg(
        F.first("n").alias("n"), F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"),
        F.max(F.when(F.col("_i") == F.floor(F.col("n") / 2) + 1, F.col("center"))).alias("median"),
    )
    sides = gaps.join(stats.select("page_id", "median"), "page_id").groupBy("page_id").agg(F.count_if(F.col("center") < F.col("median")).alias("left_n"))
    overlaps = box_overlaps(blocks).groupBy("page_id").agg(F.count("*").alias("overlaps"))
    c = F.col
    joined = stats.join(sides, "page_id").join(overlaps, "page_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    columns = (c("max_gap") > c("avg_gap") * 3) & (F.least("left_n", c("n") - c("left_n")) > 2)
    enough = c("n") >= 3
    return joined.select(
        "page_id", "n", "overlaps",
        (enough & columns).alias("multi_column"),
        (enough & (columns | (c("overlaps") > c("n") * 0.3))).alias("complex"),
    )


def reading_order(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """Position by an external order matched on coordinates to 0.1; unmatched last, stable."""
    key = lambda c: F.round(F.col(c), 1)
    # a coordinate listed twice keeps its last place
    known = order.groupBy("page_id", key("x").alias("_x"), key("y").alias("_y")).agg(F.max("order_no").alias("_o"))
    total = order.groupBy("page_id").agg((F.max("order_no") + 1).alias("_last"))
    joined = (
        blocks.withColumn("_x", key("left_pt")).withColumn("_y", key("top_pt"))
        .join(known, ["page_id", "_x", "_y"], "left").join(total, "page_id", "left")
        .withColumn("_place", F.coalesce("_o", "_last", F.lit(0)))
    )
    w = Window.partitionBy("page_id").orderBy("_place", "box_id")
    return joined.withColumn("position", F.row_number().over(w)).drop("_x", "_y", "_o", "_last", "_place")


def semantic_roles(boxes: DataFrame, page_height: float, body_font: float, tables: DataFrame | None = None) -> DataFrame:
    """Role of each box by ordered rules; title and subtitle are the two largest fonts near the top."""
    by_font = [F.col("font_size").desc(), F.col("box_id")]
    pick = lambda df, share, name: (
        df.filter(F.col("top_pt") <= page_height * share)
        .groupBy("page_id").agg(F.min_by("box_id", F.struct((-F.col("font_size")).alias("f"), "box_id")).alias(name))
    )
    titles = pick(boxes, 0.20, "_title")
    with_title = boxes.join(titles, "page_id", "left")
    rest = with_title.filter("_title IS NULL OR box_id <> _title")
    subtitles = pick(rest, 0.30, "_subtitle")
    joined = with_title.join(subtitles, "page_id", "left")
    if tables is not None:
        marks = above_table(boxes, tables).select("page_id", "box_id", F.lit(True).alias("_above"))
        joined = joined.join(marks, ["page_id", "box_id"], "left")
    else:
        joined = joined.withColumn("_above", F.lit(False))
    c = F.col
    bold = F.lower(c("font_name")).contains("bold") if "font_name" in boxes.columns else F.lit(False)
    role = (
        F.when(c("box_id") == c("_title"), "title")
        .when(c("box_id") == c("_subtitle"), "subtitle")
        .when(bold & F.coalesce("_above", F.lit(False)), "column_header")
        .when(c("text").rlike(L.LIST_ITEM_PATTERN), "list_item")
        .when((c("top_pt") <= page_height * 0.08) & (c("font_size") > body_font), "header")
        .when((c("top_pt") + c("height_pt") >= page_height * 0.92) & (c("font_size") < body_font * 0.85), "footer")
        .when((c("top_pt") >= page_height * 0.85) & (c("font_size") < body_font * 0.85), "caption")
        .otherwise("body")
    )
    return joined.withColumn("role", role).drop("_title", "_subtitle", "_above")


def table_validity(cells: DataFrame) -> DataFrame:
    """Reject tables of an impossible grid or with more than 70 % empty cells."""
    empty = F.trim(F.coalesce("value", F.lit(""))) == ""
    stats = cells.groupBy("table_id").agg(
        F.countDistinct("row_no").alias("n_rows"), F.countDistinct("col_no").alias("n_cols"),
        F.count("*").alias("cells"), F.count_if(empty).alias("empty_cells"),
    )
    return stats.withColumn(
        "verdict",
        F.when((F.col("n_rows") > 20) & (F.col("n_cols") > 10), F.format_string("grid_hallucination_%dx%d", "n_rows", "n_cols"))
        .when(F.col("empty_cells") / F.col("cells") > 0.7, "sparse_data")
        .otherwise("valid"),
    )


def box_checks(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Per page: boxes failing each check, and whether all checks pass."""
    c = F.col
    right, bottom = c("left_pt") + c("width_pt"), c("top_pt") + c("height_pt")
    outside = (c("left_pt") < 0) | (c("top_pt") < 0) | (right > width) | (bottom > height)
    sane = (
        c("left_pt").between(0, width * 2) & c("top_pt").between(0, height * 2)
        & (c("width_pt") > 0) & (c("width_pt") <= width * 2) & (c("height_pt") > 0) & (c("height_pt") <= height * 2)
    )
    stats = boxes.groupBy("page_id").agg(
        F.count("*").alias("shapes"),
        F.count_if(~((c("width_pt") > 0) & (c("height_pt") > 0))).alias("zero_dimension"),
        F.count_if(outside).alias("out_of_bounds"),
        F.count_if(~sane).alias("insane"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_text"),
    )
    overlaps = box_overlaps(boxes).groupBy("page_id").agg(F.count("*").alias("overlaps"))
    joined = stats.join(overlaps, "page_id", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    passed = [c("overlaps") == 0, c("zero_dimension") == 0, c("out_of_bounds") == 0, c("insane") == 0, c("empty_text") == 0, c("shapes") <= L.MAX_SHAPES]
    score = sum((p.cast("int") for p in passed), F.lit(1)) / (len(passed) + 1)
    return joined.withColumn("score", F.round(score, 6))
