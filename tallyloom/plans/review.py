"""Pages put together, corrections, overrides, cross-checks, preferred matches, cross-resolution, reports. QUERIES: name to (plan, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import resolution as S, review as V
from tallyloom.plans.tables import table


def page_carry(spark, d):
    """The turns of a conversation as pages: what the pages before have told."""
    head = F.substring("text", 1, 8)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", head).otherwise("").alias("o"), F.when(F.col("role") != "user", head).alias("s"))
    return V.carried(rows, "conv_id", "turn", "o", "s").select("conv_id", "turn", "known_order", "known_soldto")


PAGE_CARRY = """WITH r AS (SELECT conv_id, turn, nullif(trim(CASE WHEN role = 'user' THEN text[1:8] ELSE '' END), '') AS o, nullif(trim(CASE WHEN role <> 'user' THEN text[1:8] END), '') AS s FROM conversations)
SELECT conv_id, turn, first_value(o IGNORE NULLS) OVER w AS known_order, last_value(s IGNORE NULLS) OVER w AS known_soldto
FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def page_merge(spark, d):
    """Of each role the last of a conversation's first five turns."""
    return V.merged_pages(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", 5)


PAGE_MERGE = "SELECT conv_id, role, text FROM conversations WHERE turn <= 5 QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1"


def corrected_lines(spark, d):
    """Orders with some lines corrected: number of lines, skipped ones, and the quantity of the rest."""
    lines = table(spark, d, "lineitem")
    part, text = F.col("l_partkey"), F.lit(None).cast("string")
    row = lambda article, quantity: [F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("place"), article.alias("article"), text.alias("description"), quantity.alias("quantity"), F.col("l_extendedprice").cast("string").alias("unit_price"), F.lit(" ").alias("unit")]
    code, n = F.concat(F.lit("A"), part.cast("string")), F.col("l_quantity").cast("int").cast("string")
    extracted = lines.select(*row(F.when(part % 11 != 0, code), n))
    corrections = lines.filter((F.col("l_returnflag") == "R") & (part % 2 == 0)).select(*row(F.when(part % 7 == 0, "article_manquant_1").otherwise(code), F.when(part % 5 == 0, "").otherwise(n)))
    out = V.corrected_lines(extracted, corrections, "o")
    return out.groupBy(F.col("o").alias("l_orderkey"), "source", "unit").agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"), F.sum(F.when(~F.col("skipped"), F.col("quantity").cast("long"))).alias("quantity"))


CORRECTED_LINES = """WITH c AS (SELECT l_orderkey, l_partkey % 7 = 0 AS skip, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE l_quantity::BIGINT END AS q FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0),
u AS (SELECT l_orderkey, 'review' AS source, skip, q FROM c UNION ALL
  SELECT l_orderkey, 'extraction', l_partkey % 11 = 0, l_quantity::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM c))
SELECT l_orderkey, source, 'PCE' AS unit, count(*) AS n, count(*) FILTER (skip) AS skipped, sum(q) FILTER (NOT skip)::BIGINT AS quantity FROM u GROUP BY 1, 2"""


def field_override(spark, d):
    """Customers with the names of suppliers of the same number; blank fields change nothing."""
    over = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")).alias("c_name"), F.lit("  ").alias("c_mktsegment"))
    return V.overridden(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), over, "c_custkey", ["c_name", "c_mktsegment"])


FIELD_OVERRIDE = "SELECT c_custkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE c_name END AS c_name, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"


def cross_check(spark, d):
    """Orders by how their number and customer go together."""
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "unknown").otherwise("none")
    soldto = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") + (F.col("o_orderkey") % 5 == 0).cast("int")).cast("string"))
    return table(spark, d, "orders").groupBy(V.cross_checked(status, F.col("o_custkey").cast("string"), soldto).alias("result")).agg(F.count("*").alias("n"))


CROSS_CHECK = """SELECT CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'site_not_validated' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'consistent' END
  WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'O' THEN 'to_check' ELSE 'insufficient' END WHEN o_orderstatus = 'O' THEN 'order_unknown' ELSE 'to_check' END AS result, count(*) AS n FROM orders GROUP BY 1"""


def case_report(spark, d):
    """Orders as cases: scores of what was found in each, summed up for the batch."""
    key = F.col("o_orderkey")
    text = lambda n: F.when(key % n != 0, "x")
    status = F.when(key % 4 == 0, "validated").when(key % 4 == 1, "to_check").otherwise("no_customer")
    rows = table(spark, d, "orders").select(
        F.when(key % 50 == 0, "broken").alias("error"), V.detection_score(F.when(key % 5 == 0, "label_only").when(key % 5 == 1, "other").otherwise("detected"), text(2), text(3), text(7), key % 2 == 1).alias("address_score"),
        V.site_score(status, text(3), text(8)).alias("site_score"), status.alias("site_status"),
    )
    return V.batch_report(rows)


CASE_REPORT = """WITH r AS (SELECT o_orderkey AS k, (o_orderkey % 2 <> 0)::INT * 15 + (o_orderkey % 3 <> 0)::INT * 10 + (o_orderkey % 7 <> 0)::INT * 5 + (o_orderkey % 2 = 1)::INT * 10 AS p FROM orders),
s AS (SELECT k, CASE WHEN k % 5 = 0 THEN 25 WHEN k % 5 = 1 THEN least(100, 40 + p) ELSE least(100, 70 + p) END AS a,
  CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN 100 WHEN k % 4 = 0 AND k % 3 <> 0 THEN 75 WHEN k % 4 = 1 AND k % 3 <> 0 THEN 50 WHEN k % 3 <> 0 OR k % 8 <> 0 THEN 40 ELSE 0 END AS b FROM r)
SELECT count(*) AS files, count(*) FILTER (k % 50 = 0) AS errors, count(*) FILTER (a >= 70) AS addresses, round_even(100.0 * count(*) FILTER (a >= 70) / count(*), 1)::DOUBLE AS address_share,
  count(*) FILTER (b = 100) AS sites, round_even(100.0 * count(*) FILTER (b = 100) / count(*), 1)::DOUBLE AS site_share, count(*) FILTER (b = 75) AS customers_only, count(*) FILTER (k % 4 > 1) AS no_customer FROM s"""


def preferred_matches(spark, d):
    """Customers of a nation as scored matches, those of some numbers allowed."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", (100 - F.col("c_custkey") % 40).cast("double").alias("score"))
    return S.preferred(rows, "c_nationkey", "score", "c_custkey", F.col("c_custkey") % 5 == 0).select("c_nationkey", "c_custkey", "score", "rank", "filtered")


PREFERRED = """WITH m AS (SELECT c_nationkey, c_custkey, (100 - c_custkey % 40)::DOUBLE AS score FROM customer),
f AS (SELECT *, c_custkey % 5 = 0 AND max(score) OVER (PARTITION BY c_nationkey) - score < 15 AS first FROM m)
SELECT c_nationkey, c_custkey, score, row_number() OVER (PARTITION BY c_nationkey ORDER BY first DESC, score DESC, c_custkey)::INT AS rank, bool_or(first) OVER (PARTITION BY c_nationkey) AS filtered FROM f"""


def payload_differences(spark, d):
    """Events whose properties are not as expected."""
    events = table(spark, d, "events")
    expected = events.select("event_id", F.lit("k").alias("path"), (F.col("event_id") % 100).cast("string").alias("value"))
    return V.differences(events.select("event_id", F.col("props").alias("body")), expected, "event_id")


PAYLOAD_DIFFERENCES = """SELECT event_id, 'k' AS path, (event_id % 100)::VARCHAR AS expected, json_extract_string(props, '$.k') AS got FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM (event_id % 100)::VARCHAR"""


def cross_resolution(spark, d):
    """Documents that name a supplier's postal code and nation, led to nations by order number or by name, and to the sites there."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.lower("n_name").alias("city"))
    customers, nation = table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), "c_nationkey"), F.col("c_nationkey")
    postal = lambda x: F.lpad(x.cast("string"), 5, "1")
    docs = customers.join(F.broadcast(nations), nation == F.col("nation")).select("doc", F.concat(F.lit("livraison "), postal(F.col("doc") % 10), F.lit(" "), F.upper("city"), F.lit(" ")).alias("text"), F.when(F.col("doc") % 2 == 0, postal(F.col("doc") % 10)).alias("postal"), F.lit(None).cast("string").alias("city"))
    by_order = customers.filter("doc % 3 = 0").select("doc", F.lit("order_bstnk").alias("path"), F.lit(1).alias("place"), nation.cast("string").alias("soldto"))
    by_name = customers.select("doc", F.lit("name_match").alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("place"), nation).select("doc", "path", "place", ((nation + F.col("place") - 1) % 25).cast("string").alias("soldto"))
    sites = table(spark, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("nation")).select(F.col("s_nationkey").cast("string").alias("soldto"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"), F.lit("").alias("street"), postal(F.col("s_suppkey")).alias("postal"), "city")
    return S.cross_resolve(docs, by_order.unionByName(by_name), sites, "doc")


CROSS_RESOLUTION = """WITH d AS (SELECT c_custkey AS doc, c_nationkey AS nk, 'livraison ' || lpad((c_custkey % 10)::VARCHAR, 5, '1') || ' ' || lower(n_name) || ' ' AS text, CASE WHEN c_custkey % 2 = 0 THEN lpad((c_custkey % 10)::VARCHAR, 5, '1') END AS seen FROM customer JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT doc, 'order_bstnk' AS path, 1 AS place, nk FROM d WHERE doc % 3 = 0 UNION ALL SELECT doc, 'name_match_scored', k, (nk + k - 1) % 25 FROM d, (VALUES (1), (2)) v(k) WHERE doc % 3 <> 0),
s AS (SELECT s_nationkey AS nk, s_suppkey AS k, 's' || s_suppkey AS id, lpad(s_suppkey::VARCHAR, 5, '1') AS postal, lower(n_name) AS city, lower(s_name) AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
r AS (SELECT l.doc, l.path, l.place, l.nk, k, id, CASE WHEN id IS NULL THEN -1 ELSE
    contains(text, postal)::INT * 40 + (contains(text, postal) AND seen IS NOT DISTINCT FROM postal)::INT * 20 + contains(text, city)::INT * 30 + contains(text, name)::INT * 20 END AS points
  FROM l JOIN d ON d.doc = l.doc LEFT JOIN s ON s.nk = l.nk),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY points DESC, place, coalesce(k, 0)) AS n, count(id) OVER (PARTITION BY doc, nk) AS c FROM r)
SELECT doc, nk::VARCHAR AS soldto, path, id, CASE WHEN id IS NOT NULL THEN points END AS points,
  CASE WHEN id IS NULL THEN NULL WHEN points >= 80 THEN 95 WHEN points >= 50 THEN 75 WHEN points >= 20 THEN 50 WHEN c = 1 THEN 70 ELSE 30 END AS confidence,
  CASE WHEN id IS NULL THEN 'no_site' WHEN points >= 80 THEN 'validated' WHEN points >= 50 THEN 'probable' WHEN points >= 20 THEN 'to_check' WHEN c = 1 THEN 'only_site' ELSE 'weak' END AS status, c AS candidates
FROM b WHERE n = 1"""


QUERIES = {
    "page_carry": (page_carry, PAGE_CARRY), "page_merge": (page_merge, PAGE_MERGE), "corrected_lines": (corrected_lines, CORRECTED_LINES), "field_override": (field_override, FIELD_OVERRIDE),
    "cross_check": (cross_check, CROSS_CHECK), "case_report": (case_report, CASE_REPORT), "preferred_matches": (preferred_matches, PREFERRED), "payload_differences": (payload_differences, PAYLOAD_DIFFERENCES),
    "cross_resolution": (cross_resolution, CROSS_RESOLUTION),
}
