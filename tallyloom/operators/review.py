"""Documents under review: pages put together, corrections and overrides applied, results compared, cases reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MISSING_ARTICLE = "ARTICLE_MANQUANT"  # fixed value: stands for an article that the reviewer could not name


def filled(x: Column) -> Column:
    """x trimmed, null where nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def carried(pages: DataFrame, doc: str, page: str, order_number: str, soldto: str) -> DataFrame:
    """pages with known_order and known_soldto, what earlier pages of the document have told: the first order number, the last customer."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumns({"known_order": F.first(filled(F.col(order_number)), ignorenulls=True).over(before), "known_soldto": F.last(filled(F.col(soldto)), ignorenulls=True).over(before)})


def merged_pages(values: DataFrame, doc: str, page: str, key: str, value: str, most_pages: int | None = None) -> DataFrame:
    """(doc, key, value): of each key the last page's value, even an empty or null one. values: doc, page, key, value; of pages up to most_pages, if given."""
    rows = values if most_pages is None else values.filter(F.col(page) <= most_pages)
    return rows.groupBy(doc, key).agg(F.max_by(value, page).alias(value))


def corrected_lines(extracted: DataFrame, corrections: DataFrame, doc: str, reviewed: DataFrame | None = None) -> DataFrame:
    """extracted and corrections (doc, place, article, description, quantity, unit_price, unit: texts) as one table with source and skipped.

    A document's corrections replace all its extracted lines; so they do, even if there are none, for documents in
    reviewed (doc). Lines without an article are kept and marked skipped. Corrected lines without a quantity have 1,
    lines without a unit PCE.
    """
    touched = corrections.select(doc)
    if reviewed is not None:
        touched = touched.union(reviewed.select(doc))
    columns = [doc, "place", "article", "description", "quantity", "unit_price", "unit"]
    rows = extracted.select(columns).join(touched.distinct(), doc, "left_anti").withColumn("source", F.lit("extraction"))
    rows = rows.unionByName(corrections.select(columns).withColumn("source", F.lit("review")))
    article = filled(F.col("article"))
    quantity = F.when(F.col("source") == "review", F.coalesce(F.nullif("quantity", F.lit("")), F.lit("1"))).otherwise(F.col("quantity"))
    skipped = article.isNull() | F.startswith(F.upper(article), F.lit(MISSING_ARTICLE))
    return rows.withColumns({"article": article, "quantity": quantity, "unit": F.coalesce(filled(F.col("unit")), F.lit("PCE")), "skipped": skipped})


def overridden(base: DataFrame, override: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """base with the fields of override wherever these are not blank. override: key (each once) and fields."""
    over = override.select(key, *(F.col(x).alias(f"_{x}") for x in fields))
    return base.join(over, key, "left").withColumns({x: F.coalesce(filled(F.col(f"_{x}")), F.col(x)) for x in fields}).select(base.columns)


def cross_checked(order_status: Column, kunnr: Column, soldto: Column) -> Column:
    """How an order number and a customer go together. order_status: confirmed, unknown or none."""
    customer = filled(soldto).isNotNull()
    return (
        F.when((order_status == "none") & ~customer, "insufficient").when((order_status == "confirmed") & customer & (filled(kunnr) == filled(soldto)), "consistent")
        .when((order_status == "confirmed") & customer, "conflict").when((order_status == "unknown") & customer, "order_unknown").when((order_status == "confirmed") & ~customer, "site_not_validated").otherwise("to_check")
    )


def generation_gate(master_loaded: Column, mandatory: Mapping[str, Column], lines: Column) -> Column:
    """Why a message may not be built yet, the first reason; null if it may. mandatory: names and values of the fields that must be filled."""
    out = F.when(~master_loaded, "master_data_missing")
    for name, value in mandatory.items():
        out = out.when(filled(value).isNull(), f"{name}_missing")
    return out.when(F.coalesce(lines, F.lit(0)) == 0, "no_lines")


def detection_score(status: Column, postal: Column, city: Column, street: Column, fits: Column) -> Column:
    """0 to 100: how much of a delivery address was found. status: detected, detected_by_layout, label_only, none or other."""
    has = lambda c, n: F.when(filled(c).isNotNull(), n).otherwise(0)
    parts = has(postal, 15) + has(city, 10) + has(street, 5) + F.when(F.coalesce(fits, F.lit(False)), 10).otherwise(0)
    points = F.least(F.lit(100), F.when(F.startswith(status, F.lit("detected")), 70).otherwise(40) + parts)
    return F.when(status == "label_only", 25).when(status == "none", 0).otherwise(points)


def site_score(status: Column, soldto: Column, shipto: Column) -> Column:
    """0 to 100: how far the delivery site is settled. status: validated, to_check or other."""
    sold, ship = filled(soldto).isNotNull(), filled(shipto).isNotNull()
    return F.when((status == "validated") & ship, 100).when((status == "validated") & sold, 75).when((status == "to_check") & sold, 50).when(sold | ship, 40).otherwise(0)


def order_score(order_number: Column, confirmed: Column) -> Column:
    return F.when(filled(order_number).isNull(), 0).when(F.coalesce(confirmed, F.lit(False)), 100).otherwise(25)


def batch_report(cases: DataFrame) -> DataFrame:
    """One row: totals, errors, addresses of 70 and more, validated sites, customers without a site, cases without a customer, and shares in percent. cases: error, address_score, site_score, site_status."""
    share = lambda c: F.coalesce(F.bround(100.0 * F.count_if(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0))
    found, valid = F.col("address_score") >= 70, F.col("site_score") == 100
    return cases.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(filled(F.col("error")).isNotNull()).alias("errors"), F.count_if(found).alias("addresses"), share(found).alias("address_share"),
        F.count_if(valid).alias("sites"), share(valid).alias("site_share"), F.count_if(F.col("site_score") == 75).alias("customers_only"), F.count_if(F.col("site_status") == "no_customer").alias("no_customer"),
    )


def differences(actual: DataFrame, expected: DataFrame, doc: str) -> DataFrame:
    """(doc, path, expected, got) of expectations that do not hold. actual: doc, body (JSON). expected: doc, path (dotted), value.

    A path that ends in _min_count asks for a list of at least so many items; all others for an equal value, as text. A
    path or document that is missing has a null value (0 items).
    """
    rows = expected.join(actual.select(doc, "body"), doc, "left")
    counted = F.endswith("path", F.lit("_min_count"))
    value = F.expr("get_json_object(body, concat('$.', regexp_replace(path, '_min_count$', '')))")
    got = F.when(counted, F.coalesce(F.json_array_length(value), F.lit(0)).cast("string")).otherwise(value)
    holds = F.when(counted, F.coalesce(F.expr("try_cast(_got as int) >= try_cast(value as int)"), F.lit(False))).otherwise(F.col("_got").eqNullSafe(F.col("value")))
    return rows.withColumn("_got", got).filter(~holds).select(doc, "path", F.col("value").alias("expected"), F.col("_got").alias("got"))


def boxes(answer: Column, width: Column, height: Column) -> Column:
    """The boxes <box><x1><y1><x2><y2></box> of a model's answer, in thousandths of the image, as pixels."""
    pattern = F.lit(r"<box><([0-9]+)><([0-9]+)><([0-9]+)><([0-9]+)></box>")
    sides = [F.regexp_extract_all(answer, pattern, F.lit(k)) for k in (1, 2, 3, 4)]
    size = (width, height, width, height)
    scaled = lambda x: F.struct(*((x[str(k)].cast("double") / 1000 * size[k]).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))
    return F.transform(F.arrays_zip(*(s.alias(str(k)) for k, s in enumerate(sides))), scaled)


def points(answer: Column, width: Column, height: Column) -> Column:
    """The points <box><x><y></box> of a model's answer, likewise."""
    x, y = (F.regexp_extract_all(answer, F.lit("<box><([0-9]+)><([0-9]+)></box>"), F.lit(k)) for k in (1, 2))
    return F.zip_with(x, y, lambda a, b: F.struct((a.cast("double") / 1000 * width).alias("x"), (b.cast("double") / 1000 * height).alias("y")))


def settings(raw: Column, texts: Sequence[str], flags: Sequence[str], numbers: Mapping[str, tuple[int, int, int]]) -> Column:
    """A map of texts cleaned: only named keys stay; texts are trimmed, flags true or false, numbers (least, most, default) held within bounds, the default where they are none."""

    def clean(k: Column, v: Column) -> Column:
        out = F.when(k.isin(*texts), F.trim(F.coalesce(v, F.lit("")))).when(k.isin(*flags), F.when(F.lower(F.trim(v)).isin("1", "true", "yes", "on", "y"), "true").otherwise("false"))
        for name, (least, most, default) in numbers.items():
            n = F.coalesce(F.try_to_number(F.trim(v), F.lit("S9999999999")).cast("long"), F.lit(default))
            out = out.when(k == name, F.greatest(F.lit(least), F.least(F.lit(most), n)).cast("string"))
        return out

    return F.transform_values(F.map_filter(raw, lambda k, v: k.isin(*texts, *flags, *numbers)), clean)


def search_memo(lines: DataFrame, group: str, ordinal: str, text: str, word: str, around: int = 2) -> DataFrame:
    """The lines that have word in them, letters of either case, each with the lines around it as context."""
    from tallyloom.operators.ranking import context

    return context(lines, group, ordinal, text, around).filter(F.contains(F.lower(text), F.lit(word.lower())))


def section(lines: DataFrame, group: str, ordinal: str, text: str, word: str) -> DataFrame:
    """The lines of the first section of each group whose heading (## ...) has word in it, letters of either case, up to the next heading."""
    heading = F.startswith(text, F.lit("## "))
    upto = Window.partitionBy(group).orderBy(ordinal)
    rows = lines.withColumn("_n", F.count_if(heading).over(upto))
    hit = heading & F.contains(F.lower(text), F.lit(word.lower()))
    chosen = rows.filter(hit).groupBy(group).agg(F.min("_n").alias("_n"))
    return rows.join(chosen, [group, "_n"], "left_semi").drop("_n")
