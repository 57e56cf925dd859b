"""Documents rendered from the tables and read back, boxes on pages, sequence similarity. QUERIES: name to (plan, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import normalize as N
from tallyloom.operators import addresses as A, buyers as B, candidates as C, evidence as E, geometry as G, line_items as L, rules
from tallyloom.plans.tables import table


def _rendered(spark, d):
    """The lines of each order as the text of a document: table rows, lines that begin with the article, and articles with the quantity on the next line."""
    k, quantity = F.col("l_partkey"), F.col("l_quantity").cast("int").cast("string")
    each = k % 900 + 1.5
    price = F.format_string("%.2f", each)
    row = F.concat_ws(" ", F.concat(F.lit("A"), F.lpad(k.cast("string"), 8, "0")), F.lit("spare part"), quantity, F.lit("PCE"), price, F.format_string("%.2f", F.col("l_quantity") * each))
    first = F.concat_ws(" ", F.concat(F.lit("1"), F.lpad(k.cast("string"), 7, "0")), F.lit("spare part"), quantity, F.lit("PCE"))
    around = F.concat(F.lit("\nref W"), F.lpad(k.cast("string"), 7, "0"), F.lit("\n"), quantity, F.lit(" PCE "), price, F.lit(" € /\n"))
    line = F.when(k % 3 == 0, row).when(k % 3 == 1, first).otherwise(around)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", line.alias("line")).alias("x"))
    texts = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return texts.select("l_orderkey", F.concat(F.lit("Article Designation Qte PU Total\n"), F.array_join(F.transform("x", lambda x: x.line), "\n"), F.lit("\nTotal 10,00")).alias("text"))


def order_lines_from_text(spark, d):
    """Order lines read back from rendered documents: of equal articles in an order the first."""
    materials = table(spark, d, "part").filter("p_partkey % 3 = 2").select(F.concat(F.lit("W"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("matnr"))
    return L.order_lines(_rendered(spark, d), materials, "l_orderkey").select("l_orderkey", "line_number", "article", "parser", F.col("quantity").cast("int").alias("quantity"), F.round("total", 2).alias("total"))


ORDER_LINES = """WITH f AS (SELECT *, l_partkey % 3 AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice) = 1)
SELECT l_orderkey, (10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS line_number, CASE v WHEN 0 THEN 'A' || lpad(l_partkey::VARCHAR, 8, '0') WHEN 1 THEN '1' || lpad(l_partkey::VARCHAR, 7, '0') ELSE 'W' || lpad(l_partkey::VARCHAR, 7, '0') END AS article,
  ['table', 'article_first', 'window'][v + 1] AS parser, l_quantity::INT AS quantity, CASE WHEN v <> 1 THEN (l_quantity * (l_partkey % 900 + 1.5))::DOUBLE END AS total FROM f"""


def _places(spark, d, name, key, label):
    """Rows of a table at made-up addresses: of each nation one town and postal code, five streets, some written longer."""
    k, n = F.col(key), F.col(f"{name}_nationkey")
    letter = lambda c, of: F.element_at(F.array(*map(F.lit, of)), (c + 1).cast("int"))
    street = F.concat(F.repeat(letter(k % 5, "bcdfg"), 12), F.when(k % 10 > 6, "xxxxxx").otherwise("") if name == "s" else F.lit(""))
    town = F.concat(F.lit("Ville "), F.repeat(letter(n, "abcdefghijklmnopqrstuvwxy"), 4), F.when(k % 3 == 0, " Cedex 4").otherwise(""))
    return table(spark, d, label).select(k.alias("k"), n.cast("string").alias("soldto"), street.alias("street"), n.cast("string").alias("postal"), town.alias("city"))


def _sites(spark, d):
    return _places(spark, d, "s", "s_suppkey", "supplier").withColumns({"id": F.col("k"), "ordinal": F.col("k")}).drop("k")


def direct_matches(spark, d):
    """Customers as detected addresses against the suppliers as sites: same postal code, town and street, or a street much like it."""
    return A.direct_matches(_places(spark, d, "c", "c_custkey", "customer").drop("soldto"), _sites(spark, d), "k").select("k", "soldto", "id", "score", F.round("ratio", 4).alias("ratio"))


_PLACES = "m AS (SELECT c_custkey AS k, s_nationkey::VARCHAR AS soldto, s_suppkey AS id, CASE WHEN s_suppkey % 10 > 6 THEN 0.8 ELSE 1.0 END::DOUBLE AS ratio FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 5 = s_suppkey % 5)"
DIRECT_MATCHES = f"WITH {_PLACES} SELECT k, soldto, id, CASE WHEN ratio = 1 THEN 110 ELSE 95 END AS score, ratio FROM m"


def billing_matches(spark, d):
    return A.billing_matches(_places(spark, d, "c", "c_custkey", "customer").drop("soldto"), _sites(spark, d).drop("soldto"), "k").select("k", "id", "score", F.round("ratio", 4).alias("ratio"))


BILLING_MATCHES = f"WITH {_PLACES} SELECT k, id, CASE WHEN ratio = 1 THEN 115 ELSE 100 END AS score, ratio FROM m"


def guided_sites(spark, d):
    """The site of each detected address by the first tier with a clear winner; the customers of the second tier are the even suppliers."""
    docs = _places(spark, d, "c", "c_custkey", "customer").drop("soldto")
    return B.guided_sites(docs, _sites(spark, d).filter("id % 2 = 0").drop("soldto").withColumn("id", F.col("id").cast("string")), _sites(spark, d).withColumn("id", F.col("id").cast("string")), "k")


GUIDED_SITES = f"""WITH {_PLACES},
t AS (SELECT 1 AS tier, 'direct' AS strategy, k, soldto, id::VARCHAR AS id, CASE WHEN ratio = 1 THEN 110 ELSE 95 END::DOUBLE AS score FROM m
  UNION ALL SELECT 2, 'billing', k, id::VARCHAR, id::VARCHAR, CASE WHEN ratio = 1 THEN 115 ELSE 100 END FROM m WHERE id % 2 = 0
  UNION ALL SELECT 3, 'postal', c_custkey, s_nationkey::VARCHAR, s_suppkey::VARCHAR, 80 + CASE WHEN c_custkey % 5 <> s_suppkey % 5 THEN 0 WHEN s_suppkey % 10 > 6 THEN 15 ELSE 30 END FROM customer JOIN supplier ON c_nationkey = s_nationkey),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM t WINDOW w AS (PARTITION BY k, tier ORDER BY score DESC, soldto, id)),
b AS (SELECT * FROM r WHERE n = 1 AND (second IS NULL OR score - second >= 15) QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier) = 1)
SELECT c_custkey AS k, soldto, id, score, strategy FROM customer LEFT JOIN b ON k = c_custkey"""


def order_numbers(spark, d):
    """Order numbers of letters that also hold a date in digits; every third is known from the sales."""
    number = F.concat(F.lit("AB"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    docs = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Bon de commande : "), number, F.lit("\nLyon\n"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" fin")).alias("text"))
    return C.order_numbers(docs, table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(number.alias("order_no")), "o_orderkey").select("o_orderkey", "candidate", "score", "confirmed")


ORDER_NUMBERS = """SELECT o_orderkey, 'AB' || lpad(o_orderkey::VARCHAR, 8, '0') AS candidate, 100 + CASE WHEN o_orderkey % 3 = 0 THEN 120 ELSE 0 END AS score, o_orderkey % 3 = 0 AS confirmed FROM orders
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d'), -40, false FROM orders"""


def amounts(spark, d):
    """Amounts of orders beside and under their totals."""
    n = F.col("o_orderkey") % 900 + 100
    docs = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("prix "), n.cast("string"), F.lit(",10\n"), F.when(F.col("o_orderkey") % 2 == 0, "Total TTC").otherwise("Total HT"), F.lit("\n"), n.cast("string"), F.lit(",20\nx\ny "), n.cast("string"), F.lit(",30")).alias("text"))
    return C.amounts(docs, "o_orderkey").select("o_orderkey", "line", "amount", "score", "reason")


AMOUNTS = """SELECT o_orderkey, line, (o_orderkey % 900 + 100) || tail AS amount, CASE WHEN line = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN a ELSE b END AS score,
CASE WHEN line = 0 THEN 'none' ELSE CASE WHEN line = 2 THEN 'under' ELSE 'near' END || '_total_' || CASE WHEN o_orderkey % 2 = 0 THEN 'ttc' ELSE 'ht' END END AS reason
FROM orders, (VALUES (0, ',10', 0, 0), (2, ',20', 150, 90), (4, ',30', 70, 30)) v(line, tail, a, b)"""


def resolved_sites(spark, d):
    """Customers' letters against the sites of their nation: postal code, street, town or name in the text, some delivered to before."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("soldto"), F.concat(F.lit("ville "), F.repeat(F.chr(F.col("n_nationkey") + 97), 4)).alias("town"))
    k = F.col("c_custkey")
    street = lambda x: F.concat(x.cast("string"), F.lit(" chaussee "), F.repeat(F.lit("z"), 3))
    postal = lambda x: F.lpad((x % 40).cast("string"), 5, "9")
    docs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("soldto")).join(F.broadcast(n), "soldto")
    text = F.concat_ws(" ", F.lit("bon pour"), F.when(k % 4 != 0, postal(k)), F.lit("-"), F.when(k % 3 == 0, street(k % 40)), F.lit("-"), F.when(k % 5 != 0, F.col("town")), F.lit("fin"))
    docs = docs.select("c_custkey", "soldto", text.alias("text"), F.lit("").alias("soldto_postal"))
    s = F.col("s_suppkey")
    sites = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("soldto"), s.alias("id"), s.alias("ordinal"), F.col("s_name").alias("name"), street(s % 40).alias("street"), postal(s).alias("postal")).join(F.broadcast(n), "soldto").withColumnRenamed("town", "city")
    out = E.resolve_sites(docs, sites, "c_custkey", sites.filter("id % 4 = 0").select("soldto", "id"))
    return out.select("c_custkey", "id", "score", "second", "decision", "confidence", F.array_join("reasons", ",").alias("reasons"))


RESOLVED_SITES = """WITH p AS (SELECT c_custkey AS k, s_suppkey AS id, c_custkey % 4 <> 0 AND c_custkey % 40 = s_suppkey % 40 AS po, c_custkey % 3 = 0 AND (c_custkey % 40 = s_suppkey % 40 OR s_suppkey % 40 < 10 AND c_custkey % 10 = s_suppkey % 40) AS st, c_custkey % 5 <> 0 AS ci, s_suppkey % 4 = 0 AS hi
  FROM customer JOIN supplier ON c_nationkey = s_nationkey),
q AS (SELECT *, po::INT * 30 + st::INT * 30 + ci::INT * 20 + hi::INT * 20 - CASE WHEN po OR st OR ci THEN 0 ELSE 30 END AS score,
  concat_ws(',', CASE WHEN po THEN 'POSTAL_IN_TEXT' END, CASE WHEN st THEN 'STREET_IN_TEXT' END, CASE WHEN ci THEN 'CITY_IN_TEXT' END, CASE WHEN hi THEN 'ORDER_HISTORY_MATCH' END, CASE WHEN NOT (po OR st OR ci) THEN 'NO_ADDRESS_EVIDENCE' END) AS reasons FROM p),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second, count(*) OVER (PARTITION BY k) AS c FROM q WINDOW w AS (PARTITION BY k ORDER BY score DESC, id)),
d AS (SELECT *, CASE WHEN score >= 95 AND coalesce(score - second, score) >= 15 THEN 'ACCEPTED' WHEN score >= 70 OR c = 1 THEN 'REVIEW' ELSE 'REJECTED' END AS d0 FROM r WHERE n = 1),
e AS (SELECT *, CASE WHEN d0 = 'ACCEPTED' AND NOT po THEN 'REVIEW' ELSE d0 END AS decision FROM d)
SELECT c_custkey, id, score::DOUBLE AS score, second::DOUBLE AS second, decision, CASE WHEN decision = 'ACCEPTED' THEN 100 WHEN decision = 'REJECTED' THEN 0 WHEN decision = 'REVIEW' THEN CASE WHEN c = 1 AND score < 70 THEN 80 ELSE least(85, score) END END::INT AS confidence, reasons
FROM customer LEFT JOIN e ON k = c_custkey"""


def buyers(spark, d):
    """The buyer of each letter: by the order's number, else by VAT number, name, postal code and town in the text and by the address."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    vat = lambda x: N.siren_vat(F.lpad((x * 7919 + 300000007).cast("string"), 9, "0"))
    code = lambda x: F.lpad((x % 60 + 20000).cast("string"), 5, "0")
    target = k % 80 + 1
    text = F.concat_ws(" . ", F.when(k % 3 == 0, vat(target)), F.when(k % 4 == 0, F.concat(F.lit("depot numero "), target.cast("string"))), F.when(k % 5 == 0, code(target)))
    docs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("x "), text).alias("text"), F.when(k % 11 == 0, F.concat(F.lit("po"), k.cast("string"))).alias("order_no"), *(F.lit(None).cast("string").alias(c) for c in ("street", "postal", "city")))
    customers = table(spark, d, "supplier").select(s.cast("string").alias("id"), s.alias("ordinal"), F.concat(F.lit("Depot Numero "), s.cast("string")).alias("name"), F.lit("").alias("street"), code(s).alias("postal"), F.lit("nulle part").alias("city"), vat(s).alias("vat"))
    sites = customers.select(F.col("id").alias("soldto"), "street", "postal", "city").limit(0)
    sales = table(spark, d, "customer").filter("c_custkey % 22 = 0").select(F.concat(F.lit("PO "), k.cast("string")).alias("order_no"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("soldto")).withColumns({"at": F.col("soldto").cast("int"), "ordinal": F.col("soldto").cast("int")})
    return B.infer_buyers(docs, customers, sites, sales, "c_custkey", [])


BUYERS = """WITH c AS (SELECT c_custkey AS k, c_custkey % 80 + 1 AS t FROM customer),
p AS (SELECT k, s_suppkey AS s, (k % 3 = 0 AND s_suppkey = t)::INT * 100 + (k % 4 = 0 AND s_suppkey = t)::INT * 35 + (k % 5 = 0 AND s_suppkey % 60 = t % 60)::INT * 10 AS score FROM c, supplier),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM p WHERE score > 0 WINDOW w AS (PARTITION BY k ORDER BY score DESC, s)),
b AS (SELECT *, score >= 45 AND (second IS NULL OR score - second >= 10 OR score >= 140) AS ok FROM r WHERE n = 1)
SELECT c.k AS c_custkey, CASE WHEN c.k % 22 = 0 THEN '2' ELSE s::VARCHAR END AS id, CASE WHEN c.k % 22 = 0 THEN 200 ELSE score END::DOUBLE AS score, CASE WHEN c.k % 22 <> 0 THEN second END::DOUBLE AS second, CASE WHEN c.k % 22 = 0 THEN true ELSE ok END AS accepted,
  CASE WHEN c.k % 22 = 0 THEN 'order' WHEN s IS NOT NULL THEN 'score' END AS how FROM c LEFT JOIN b ON b.k = c.k"""


def rule_set_b(spark, d):
    """Findings of rule set B on order lines and of the rules on orders, by code and severity."""
    k = F.col("l_partkey")
    lines = table(spark, d, "lineitem").select(rules.line_rules("B", F.when(k % 11 != 0, k.cast("string")).otherwise("-"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).otherwise(0.0), F.when(F.col("l_suppkey") % 5 != 0, F.lit(0.0)), k % 7 != 0).alias("f"))
    o = F.col("o_orderkey")
    text = lambda n: F.when(o % n != 0, "x")
    orders = table(spark, d, "orders").select(rules.order_rules(text(3), text(5), text(7), text(2), o % 13 == 0, o % 17 != 0).alias("f"))
    each = lines.unionAll(orders).select(F.explode("f").alias("x")).select("x.code", "x.severity")
    return each.groupBy("code", "severity").agg(F.count("*").alias("n"))


RULE_SET_B = """WITH l AS (SELECT l_partkey % 11 = 0 AS a, l_partkey % 11 <> 0 AND l_partkey % 7 = 0 AS u, l_linenumber = 3 AS q, l_suppkey % 5 = 0 AS p FROM lineitem), o AS (SELECT o_orderkey AS k FROM orders)
SELECT * FROM (SELECT 'ARTICLE_MISSING' AS code, 'blocking' AS severity, count(*) FILTER (a) AS n FROM l UNION ALL SELECT 'ARTICLE_UNKNOWN', 'warning', count(*) FILTER (u) FROM l UNION ALL SELECT 'QUANTITY_MISSING', 'blocking', count(*) FILTER (q) FROM l
UNION ALL SELECT 'PRICE_MISSING', 'warning', count(*) FILTER (p) FROM l UNION ALL SELECT 'NOT_AN_ORDER', 'blocking', count(*) FILTER (k % 17 = 0) FROM o UNION ALL SELECT 'PO_NUMBER_MISSING', 'blocking', count(*) FILTER (k % 3 = 0) FROM o
UNION ALL SELECT 'PO_DUPLICATE', 'blocking', count(*) FILTER (k % 13 = 0) FROM o UNION ALL SELECT 'CUSTOMER_UNKNOWN', 'blocking', count(*) FILTER (k % 5 = 0) FROM o UNION ALL SELECT 'DELIVERY_UNKNOWN', 'blocking', count(*) FILTER (k % 7 = 0) FROM o
UNION ALL SELECT 'DELIVERY_INCOMPLETE', 'warning', count(*) FILTER (k % 7 <> 0 AND k % 2 = 0) FROM o) WHERE n > 0"""


def tax_numbers_from_text(spark, d):
    """VAT numbers in texts of customers, each third with a wrong key."""
    siren = F.lpad((F.col("c_custkey") * 7919 + 300000007).cast("string"), 9, "0")
    vat = N.siren_vat(siren)
    wrong = F.concat(F.lit("FR"), F.lpad(((F.substring(vat, 3, 2).cast("int") + 1) % 97).cast("string"), 2, "0"), F.right(vat, F.lit(9)))
    text = F.concat(F.lit("TVA "), F.when(F.col("c_custkey") % 3 == 0, wrong).otherwise(vat), F.lit(" merci"))
    out = C.tax_numbers(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey")
    return out.select("c_custkey", F.size("vats").alias("good"), F.size("rejected").alias("bad"))


TAX_NUMBERS = "SELECT c_custkey, (c_custkey % 3 <> 0)::INT AS good, (c_custkey % 3 = 0)::INT AS bad FROM customer"


def _boxes(spark, d):
    """Words with boxes: the lines of an order are a page, each part a word."""
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 7 * 20).cast("double")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(0).alias("block"), (F.col("l_suppkey") % 7).cast("int").alias("line"), F.col("l_partkey").cast("string").alias("text"), F.col("l_partkey").alias("word"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1")).dropDuplicates(["page", "word", "line"])


def words_to_lines(spark, d):
    return G.lines_from_words(_boxes(spark, d), ["page"]).select("page", "line", "text", "x0", "y0", "x1", "y1")


_BOXES = """WITH b AS (SELECT DISTINCT l_orderkey AS page, (l_suppkey % 7)::INT AS line, l_partkey AS word, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 7 * 20)::DOUBLE AS y0 FROM lineitem)"""
WORDS_TO_LINES = _BOXES + " SELECT page, line, string_agg(word::VARCHAR, ' ' ORDER BY x0, word::VARCHAR) AS text, min(x0) AS x0, min(y0) AS y0, max(x0) + 30 AS x1, max(y0) + 10 AS y1 FROM b GROUP BY page, line"


def nearest_anchor(spark, d):
    """For every word with an odd number the nearest one with an even number on its page."""
    b = _boxes(spark, d).groupBy("page", "word").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    out = G.nearest_anchor(b.filter("word % 2 = 1"), b.filter("word % 2 = 0").withColumnRenamed("word", "anchor"), ["page"], "word", "anchor")
    return out.select("page", "word", "anchor", F.round("distance", 4).alias("distance"))


NEAREST_ANCHOR = _BOXES + """, w AS (SELECT page, word, min(x0) AS x, min(y0) AS y FROM b GROUP BY page, word)
SELECT u.page, u.word, v.word AS anchor, round(sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2), 4) AS distance FROM w u JOIN w v ON u.page = v.page AND u.word % 2 = 1 AND v.word % 2 = 0
QUALIFY row_number() OVER (PARTITION BY u.page, u.word ORDER BY sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2), v.word) = 1"""


def seq_ratio_match(spark, d):
    """Distinct part names that begin alike, with their sequence ratio."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).distinct()
    pairs = names.select(F.col("name").alias("a"), F.left("name", F.lit(3)).alias("k")).join(names.select(F.col("name").alias("b"), F.left("name", F.lit(3)).alias("k")), "k").filter("a < b")
    return A.street_ratio(pairs, "a", "b").filter(F.col("ratio") >= A.FUZZY).select("a", "b", F.round("ratio", 6).alias("ratio"))


QUERIES = {
    "order_lines_from_text": (order_lines_from_text, ORDER_LINES), "tax_numbers_from_text": (tax_numbers_from_text, TAX_NUMBERS), "words_to_lines": (words_to_lines, WORDS_TO_LINES),
    "nearest_anchor": (nearest_anchor, NEAREST_ANCHOR), "seq_ratio_match": (seq_ratio_match, None), "direct_matches": (direct_matches, DIRECT_MATCHES), "billing_matches": (billing_matches, BILLING_MATCHES), "guided_sites": (guided_sites, GUIDED_SITES),
    "order_numbers": (order_numbers, ORDER_NUMBERS), "amounts": (amounts, AMOUNTS), "resolved_sites": (resolved_sites, RESOLVED_SITES), "buyers": (buyers, BUYERS), "rule_set_b": (rule_set_b, RULE_SET_B),
}
