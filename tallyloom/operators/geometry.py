"""Boxes on pages: lines from words, columns, nearest anchors. A page's rows meet only their own page's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import normalize as N

COLUMN_SHARE = 0.22
_BOX = ("x0", "y0", "x1", "y1")


def lines_from_words(words: DataFrame, page: list[str]) -> DataFrame:
    """words (page columns, block, line, text, x0, y0, x1, y1) joined to lines in reading order with their common box."""
    out = words.groupBy(*page, "block", "line").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.withColumn("text", F.array_join(F.transform("w", lambda w: w.text), " ")).drop("w")


def centre(p: str = "") -> tuple[Column, Column]:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2, (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def distance(a: str, b: str) -> Column:
    """Between the centres of two boxes whose columns have these prefixes."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def same_column(a: str, b: str, width: Column) -> Column:
    """The boxes overlap from left to right, or their centres are near."""
    overlap = (F.col(f"{a}x0") <= F.col(f"{b}x1")) & (F.col(f"{b}x0") <= F.col(f"{a}x1"))
    return overlap | (F.abs(centre(a)[0] - centre(b)[0]) <= COLUMN_SHARE * width)


def distance_score(d: Column, diagonal: Column, most: float = 70.0, reach: float = 0.28) -> Column:
    """Whole points, from `most` at the anchor to 0 at `reach` of a page's diagonal and beyond."""
    limit = F.greatest(F.lit(1.0), reach * diagonal)
    return F.floor(F.greatest(F.lit(0.0), most * (1 - d / limit))).cast("int")


def is_below(anchor: str, box: str) -> Column:
    return F.col(f"{box}y0") >= F.col(f"{anchor}y0") - 5


def is_beside(anchor: str, box: str, height: Column) -> Column:
    """To the right of the anchor and about as high on the page."""
    return (F.col(f"{box}x0") >= F.col(f"{anchor}x1") - 5) & (F.abs(centre(box)[1] - centre(anchor)[1]) <= 0.06 * height)


def position(anchor: str, box: str, height: Column) -> Column:
    return F.when(is_below(anchor, box), "below").when(is_beside(anchor, box, height), "right").otherwise("above")


def relation_score(anchor: str, box: str, width: Column, height: Column, directional: bool = False) -> Column:
    """Points for a near box, more in the anchor's column, below it or beside it; directional: others count a quarter."""
    near = distance_score(distance(anchor, box), F.hypot(width, height), 45.0, 0.55) + F.when(same_column(anchor, box, width), 15).otherwise(0)
    below, beside = is_below(anchor, box), is_beside(anchor, box, height)
    if directional:
        near = F.when(below | beside, near).otherwise(F.floor(near * 0.25))
    return (near + F.when(below, 10).when(beside, 8).otherwise(0)).cast("int")


def column_band(box: str, width: Column) -> Column:
    middle = centre(box)[0]
    return F.when(middle <= 0.42 * width, "left").when(middle >= 0.58 * width, "right").otherwise("center")


def nearest_anchor(boxes: DataFrame, anchors: DataFrame, page: list[str], box_id: str, anchor_id: str) -> DataFrame:
    """(page, box_id, anchor_id, distance) of the closest anchor of each box's page; of equal ones the first."""
    a = boxes.select(*page, box_id, *(F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")))
    b = anchors.select(*page, anchor_id, *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    near = a.join(b, page).withColumn("distance", distance("a_", "b_"))
    best = near.groupBy(*page, box_id).agg(F.min(F.struct("distance", anchor_id)).alias("x"))
    return best.select(*page, box_id, F.col(f"x.{anchor_id}").alias(anchor_id), F.col("x.distance").alias("distance"))


def split_anchors(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page, box) of labels in two parts: a line that ends with `lieu de` and a line `livraison` under or beside it. lines: page, text, width, height, box."""
    folded = N.fold_text(F.trim("text"))
    a = lines.filter(F.endswith(folded, F.lit("lieu de"))).select(*page, "width", "height", *(F.col(c).alias(f"a_{c}") for c in _BOX))
    b = lines.filter(folded.isin("livraison", "livraison:")).select(*page, *(F.col(c).alias(f"b_{c}") for c in _BOX))
    slack, gap = 0.03 * F.col("height"), F.col("b_y0") - F.col("a_y1")
    under = gap.between(-slack, 3 * slack) | (F.abs(F.col("b_y0") - F.col("a_y0")) <= slack)
    column = same_column("a_", "b_", F.col("width")) | (F.abs(F.col("a_x0") - F.col("b_x0")) <= 0.2 * F.col("width"))
    low, high = (lambda c: F.least(f"a_{c}", f"b_{c}").alias(c)), (lambda c: F.greatest(f"a_{c}", f"b_{c}").alias(c))
    return a.join(b, page).filter(under & column).select(*page, low("x0"), low("y0"), high("x1"), high("y1"))


# fixed values: points of an address candidate and of its place on the page
POSTAL, CITY, STREET, NAME, PAIR, MISMATCH = 25, 20, 25, 10, 15, -35
NEGATIVE_SHARE, ABOVE_SHARE, COLUMN, OTHER_COLUMN, MOST = 0.65, 0.35, 12, 45, 100
BLOCK, VOCABULARY, MOST_VOCABULARY, LEAST_MARGIN = 25, 400, 35, 0.01


def quality(postal: Column, city: Column, street: Column, name: Column, validation: Column) -> Column:
    """Points for the parts that an address has, and whether its postal code and city fit."""
    has = lambda c, points: F.when(F.coalesce(F.trim(c) != "", F.lit(False)), points).otherwise(0)
    pair = F.when(validation.isin("ok", "cedex_ok"), PAIR).when(validation == "ville_incompatible", MISMATCH).otherwise(0)
    return has(postal, POSTAL) + has(city, CITY) + has(street, STREET) + has(name, NAME) + pair


def placed_candidates(candidates: DataFrame, anchors: DataFrame, page: list[str], candidate_id: str) -> DataFrame:
    """(page, candidate_id, total, position) of each candidate.

    candidates: page, candidate_id, quality, width, height, box, and if known block (it was built from a delivery
    anchor's own block) and margin (how much nearer to delivery words than to billing words, as a share of the page).
    anchors: page, kind (positive or negative), place (their order; the first of equal ones counts), box.

    The best positive anchor adds its distance score, the best negative one takes a share of its relation score; above
    the anchor the sum shrinks; blocks, the margin and the column follow. From 0 to MOST. Null block or margin: none.
    """
    for name, kind in (("block", "boolean"), ("margin", "double")):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(None).cast(kind))
    own = [*page, candidate_id, "quality", "width", "height", "block", "margin"]
    a = candidates.select(*own, *(F.col(c).alias(f"a_{c}") for c in _BOX))
    b = anchors.select(*page, "kind", "place", *(F.col(c).alias(f"b_{c}") for c in _BOX))
    width, height = F.col("width"), F.col("height")
    near = a.join(b, page, "left").withColumns({
        "points": F.when(F.col("kind") == "positive", distance_score(distance("b_", "a_"), F.hypot(width, height))).otherwise(relation_score("b_", "a_", width, height)),
        "position": position("b_", "a_", height), "band": column_band("b_", width), "own_band": column_band("a_", width), "same": same_column("b_", "a_", width),
    })
    best = lambda kind: F.max_by(F.struct("points", "position", "band", "same"), F.when(F.col("kind") == kind, F.struct("points", -F.col("place"))))
    found = near.groupBy(*own, "own_band").agg(best("positive").alias("p"), best("negative").alias("n"))
    has_p, has_n = F.col("p").isNotNull(), F.col("n").isNotNull()
    block = F.coalesce("block", F.lit(False))
    total = F.greatest(F.lit(0), F.col("quality") + F.coalesce(F.col("p.points"), F.lit(0)) - F.floor(NEGATIVE_SHARE * F.coalesce(F.col("n.points"), F.lit(0))))
    total = F.when(has_p & (F.col("p.position") == "above"), F.floor(ABOVE_SHARE * total)).otherwise(total)
    total = total + F.when(block & has_p, BLOCK).otherwise(0)
    total = total + F.when(F.col("margin") >= LEAST_MARGIN, F.floor(F.least(F.lit(float(MOST_VOCABULARY)), VOCABULARY * F.col("margin")))).otherwise(0)
    billing = (F.col("p.band") != F.col("n.band")) & (F.col("own_band") == F.col("n.band"))
    total = F.when(~(has_p & has_n), total).when(block, total + COLUMN).when(billing, F.greatest(F.lit(0), total - OTHER_COLUMN)).when(F.col("p.same"), total + COLUMN).otherwise(total)
    return found.select(*page, candidate_id, F.least(F.lit(MOST), total).cast("int").alias("total"), F.col("p.position").alias("position"))
