"""Candidate fields, tax numbers, checklists and numbered rows over the tables. QUERIES: name to (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import extract as X, normalize as N
from tallyloom.operators import candidates as C, edifact, joins as J, ranking as R, rules, store
from tallyloom.plans.resolving import _MESSAGES, _messages
from tallyloom.plans.tables import table
from tallyloom.sources import tables as S
from tallyloom.sources.pages import read_pages, selected_pages


def tax_identification(spark, d):
    """Letters of customers with SIRET, SIREN and VAT numbers: right ones, wrong keys, others' numbers, broken forms."""
    k = F.col("c_custkey")
    nine = F.lpad((k * 7919 + 300000007).cast("string"), 9, "0")
    other = F.lpad((k * 104729 + 500000003).cast("string"), 9, "0")
    spaced = lambda x: F.concat_ws(" ", F.substring(x, 1, 3), F.substring(x, 4, 3), F.substring(x, 7, 3))
    wrong = F.concat(F.lit("FR00"), nine)
    parts = [
        F.when(k % 2 == 0, F.concat(F.lit("SIRET "), spaced(nine), F.lit(" 00017"))), F.when(k % 3 == 0, F.concat(F.lit("Siren: "), spaced(nine))), F.when(k % 5 == 0, F.concat(F.lit("fr"), F.substring(N.siren_vat(nine), 3, 11))),
        F.when(k % 5 == 1, F.concat(F.lit("TVA "), wrong)), F.when(k % 7 == 0, N.siren_vat(other)), F.when(k % 11 == 0, F.concat(F.lit("FRXX "), spaced(nine))), F.when(k % 13 == 0, N.siren_vat(nine)),
    ]
    found = C.tax_identification(table(spark, d, "customer").select("c_custkey", F.concat_ws(" ; ", *parts).alias("text")), "c_custkey")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("c_custkey", "status", *map(joined, ("vats", "sirens", "valid_sirens", "sirets", "expected")), F.array_join(F.transform("rejected", lambda x: F.concat_ws(":", x.value, x.reason)), ",").alias("rejected"))


TAX_IDENTIFICATION = r"""WITH c AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 + 300000007)::VARCHAR, 9, '0') AS n, lpad((c_custkey * 104729 + 500000003)::VARCHAR, 9, '0') AS o FROM customer),
v AS (SELECT *, 'FR' || lpad(((12 + 3 * (n::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || n AS nv, 'FR' || lpad(((12 + 3 * (o::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || o AS ov, n[1:3] || ' ' || n[4:6] || ' ' || n[7:9] AS s FROM c),
t AS (SELECT *, concat_ws(' ; ', CASE WHEN k % 2 = 0 THEN 'SIRET ' || s || ' 00017' END, CASE WHEN k % 3 = 0 THEN 'Siren: ' || s END, CASE WHEN k % 5 = 0 THEN 'fr' || nv[3:] END, CASE WHEN k % 5 = 1 THEN 'TVA FR00' || n END, CASE WHEN k % 7 = 0 THEN ov END, CASE WHEN k % 11 = 0 THEN 'FRXX ' || s END, CASE WHEN k % 13 = 0 THEN nv END) AS text FROM v),
e AS (SELECT k, list_distinct(regexp_extract_all(text, '\b\d{3}\s?\d{3}\s?\d{3}\s?\d{5}\b')) AS sirets, list_transform(regexp_extract_all(text, '\b\d{3}\s?\d{3}\s?\d{3}\b'), lambda x: replace(x, ' ', '')) AS alone,
  list_transform(regexp_extract_all(text, '(?i)\bFR\s?[A-Z0-9]{2}(?:\s?\d){9,12}\b'), lambda x: upper(replace(x, ' ', ''))) AS found FROM t),
s AS (SELECT *, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS sirens, list_filter(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN list_position(found, found[i]) = i THEN found[i] END), lambda x: x IS NOT NULL) AS fs FROM (SELECT *, list_transform(sirets, lambda x: replace(x, ' ', '')[1:9]) || alone AS a FROM e)),
l AS (SELECT *, list_filter(sirens, lambda x: list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 0 THEN (2 * x[i]::INT) - 9 * (x[i]::INT > 4)::INT ELSE x[i]::INT END)) % 10 = 0) AS valid FROM s),
w AS (SELECT *, CASE WHEN len(valid) > 0 THEN valid ELSE sirens END AS known FROM l),
r AS (SELECT *, list_transform(fs, lambda v: CASE WHEN NOT regexp_full_match(v, 'FR\d{11}') THEN 'format_invalide' WHEN v[3:4]::INT <> (12 + 3 * (v[5:13]::BIGINT % 97)) % 97 THEN 'cle_tva_incoherente' WHEN len(known) > 0 AND NOT list_contains(known, v[5:13]) THEN 'siren_non_detecte_dans_document' ELSE '' END) AS why FROM w),
g AS (SELECT *, list_filter(fs, lambda v, i: why[i] = '') AS vats, list_transform(known, lambda x: 'FR' || lpad(((12 + 3 * (x::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || x) AS hoped FROM r)
SELECT k AS c_custkey, CASE WHEN len(vats) > 0 THEN 'valide' WHEN len(list_filter(hoped, lambda x: NOT list_contains(vats, x))) > 0 THEN 'tva_attendue_depuis_siren' ELSE 'non_valide' END AS status, array_to_string(vats, ',') AS vats, array_to_string(sirens, ',') AS sirens, array_to_string(valid, ',') AS valid_sirens,
array_to_string(sirets, ',') AS sirets, array_to_string(list_filter(hoped, lambda x: NOT list_contains(vats, x)), ',') AS expected, array_to_string(list_filter(list_transform(fs, lambda v, i: CASE WHEN why[i] <> '' THEN v || ':' || why[i] END), lambda x: x IS NOT NULL), ',') AS rejected FROM g"""


def candidate_fields(spark, d):
    """What documents and conversations may have as fields: how many of each kind, and the first of some."""
    texts = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text").unionByName(table(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text"))
    rows = texts.filter("id is not null").select("id", X.candidate_fields(F.col("text")).alias("x")).select("id", "x.*")
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("-")).alias(c)
    return rows.select("id", first("phones"), first("dates"), *(F.size(c).alias(f"n_{c}") for c in ("phones", "dates", "iban")), F.size(F.filter("iban", X.valid_iban)).alias("good_iban"))


CANDIDATE_FIELDS = r"""WITH t AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT concat_ws('-', 'c', conv_id, turn), coalesce(text, '') FROM conversations),
f AS (SELECT id, regexp_extract_all(t, '\b(?:0\d(?:[\s.-]?\d{2}){4}|(?:(?:\+|00)33\s?)[1-9](?:[\s.-]?\d{2}){4})\b') AS p, regexp_extract_all(t, '\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b') AS d, regexp_extract_all(t, '(?i)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\b') AS b FROM t),
c AS (SELECT id, list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS p, d, list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS b FROM f),
u AS (SELECT id, p, d, list_slice(list_filter(b, lambda x, i: list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i), 1, 20) AS b FROM c),
w AS (SELECT *, list_transform(b, lambda x: upper(replace(x, ' ', ''))) AS bare FROM u)
SELECT id, coalesce(p[1], '-') AS phones, coalesce(d[1], '-') AS dates, least(20, len(list_distinct(p)))::INT AS n_phones, least(20, len(list_distinct(d)))::INT AS n_dates, len(b)::INT AS n_iban,
len(list_filter(bare, lambda x: list_reduce(list_prepend(0::BIGINT, list_transform(string_split(x[5:] || x[1:4], ''), lambda s: CASE WHEN s BETWEEN '0' AND '9' THEN s::BIGINT ELSE ascii(s)::BIGINT - 55 END)), lambda r, y: (r * (CASE WHEN y > 9 THEN 100 ELSE 10 END) + y) % 97) = 1))::INT AS good_iban FROM w"""


def message_checklist(spark, d):
    """The points of the checklist that messages fail, some of them cut or changed."""
    k, m = F.col("o_orderkey") % 6, F.col("message")
    changed = F.when(k == 0, F.replace(m, F.lit("UNA"), F.lit("una"))).when(k == 1, F.replace(m, F.lit("SENDER"), F.lit("NOBODY"))).when(k == 2, F.replace(m, F.lit("QTY+21"), F.lit("QTX+21"))).when(k == 3, F.left(m, F.lit(200))).when(k == 4, F.replace(m, F.lit("PIA+5+"), F.lit("PIB+5+")))
    rows = _messages(spark, d).select("o_orderkey", edifact.checklist(F.coalesce(changed, m), "SENDER", "RECEIVER").alias("points"))
    failed = F.transform(F.filter("points", lambda x: ~x.ok), lambda x: F.concat(x.key, F.when(x.required, "!").otherwise("")))
    return rows.select("o_orderkey", F.size("points").alias("points"), F.array_join(failed, ",").alias("failed"))


MESSAGE_CHECKLIST = "WITH " + _MESSAGES + """,
b AS (SELECT k, CASE k % 6 WHEN 0 THEN replace(message, 'UNA', 'una') WHEN 1 THEN replace(message, 'SENDER', 'NOBODY') WHEN 2 THEN replace(message, 'QTY+21', 'QTX+21') WHEN 3 THEN left(message, 200) WHEN 4 THEN replace(message, 'PIA+5+', 'PIB+5+') ELSE message END AS t FROM m),
z AS (SELECT *, len(string_split(t, 'LIN+')) AS l, len(string_split(t, 'PIA+')) AS p, len(string_split(t, 'QTY+')) AS q FROM b)
SELECT k AS o_orderkey, 13 AS points, concat_ws(',', CASE WHEN NOT starts_with(t, 'UNA') THEN 'UNA!' END, CASE WHEN NOT contains(t, 'UNB+UNOC:3') THEN 'UNB+UNOC:3!' END, CASE WHEN NOT contains(t, 'SENDER') THEN 'sender_gln!' END, CASE WHEN NOT contains(t, 'RECEIVER') THEN 'receiver_gln!' END, CASE WHEN NOT contains(t, 'UNH+') THEN 'UNH!' END, CASE WHEN NOT contains(t, 'BGM+') THEN 'BGM!' END,
CASE WHEN NOT contains(t, 'DTM+137:') THEN 'DTM_137!' END, CASE WHEN NOT contains(t, 'NAD+BY+') THEN 'NAD_BY!' END, CASE WHEN NOT contains(t, 'NAD+DP+') THEN 'NAD_DP!' END, CASE WHEN l = 1 THEN 'LIN!' END, CASE WHEN NOT contains(t, 'UNZ+') THEN 'UNZ!' END, CASE WHEN p <> l OR l = 1 THEN 'PIA_equals_LIN' END, CASE WHEN q <> l OR l = 1 THEN 'QTY_equals_LIN' END) AS failed FROM z"""


def appended_lines(spark, d):
    """Lines added to orders, numbered on from the greatest number that each order has."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("l_partkey")).withColumn("l_linenumber", F.lit(0))
    return R.appended(lines, new, "l_orderkey", [F.asc("l_partkey")], "l_linenumber")


APPENDED_LINES = """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem UNION ALL
SELECT o_orderkey, (i + coalesce(m, 0))::INT, o_custkey + i - 1 FROM (SELECT *, unnest([1, 2]) AS i FROM orders WHERE o_orderkey % 3 = 0) LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def longest_mentions(spark, d):
    """The five longest part names that the texts of customers' letters mention, of names made of one word up to all of a part's."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("name")).unionByName(table(spark, d, "part").select(F.lower(F.split("p_name", " ")[0]).alias("name"))).distinct()
    parts = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name")
    texts = parts.groupBy("l_orderkey").agg(F.concat_ws(", ", F.sort_array(F.collect_set("p_name"))).alias("text"))
    return J.longest_mentions(J.mentions(texts, names, "l_orderkey", "text", "name"), "l_orderkey", "name").select("l_orderkey", "name", "place")


LONGEST_MENTIONS = r"""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT lower(string_split(p_name, ' ')[1]) FROM part),
t AS (SELECT l_orderkey, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
w AS (SELECT l_orderkey, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM t),
c AS (SELECT name, ' ' || trim(regexp_replace(name, '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS p FROM n)
SELECT l_orderkey, name, place::INT AS place FROM (SELECT l_orderkey, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY length(name) DESC, name) AS place FROM w JOIN c ON contains(t, p) AND length(name) >= 4) WHERE place <= 5"""


def search_with_status(spark, d):
    """Orders with a text in any of four columns and a status, of one day's and all, the report's order by two keys."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    hit = F.lit(False)
    for c in ("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("12"))
    rows = rows.filter(hit & F.col("o_orderstatus").isin("F", "O"))
    day = F.to_date("o_orderdate")
    last = F.broadcast(table(spark, d, "orders").agg(F.max(day).alias("_day")))  # one row: the day that counts as today
    return rows.join(last, F.lit(True)).select("o_orderkey", "o_orderstatus", "c_name", (day == F.col("_day")).alias("today")).orderBy("o_orderstatus", "o_orderkey")


SEARCH_WITH_STATUS = """SELECT o_orderkey, o_orderstatus, c_name, o_orderdate::DATE = (SELECT max(o_orderdate)::DATE FROM orders) AS today FROM orders LEFT JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus IN ('F', 'O') AND (contains(o_orderkey::VARCHAR, '12') OR contains(lower(o_orderpriority), '12') OR contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12')) ORDER BY o_orderstatus, o_orderkey"""

def edited_lines(spark, d):
    """Order lines with what users corrected on them: the last value of each field, who set it, and the amount worked out again."""
    base = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("price"), F.min("l_partkey").alias("article"))
    price = F.when(F.col("l_linenumber") % 5 > 0, F.col("price").cast("decimal(18,2)").cast("double"))
    log = base.select("l_orderkey", "l_linenumber", F.lit(0).alias("seq"), F.lit("engine").alias("actor"), F.col("quantity").alias("quantity"), price.alias("unit_price"), F.col("article").cast("string").alias("article"), F.lit(None).cast("double").alias("amount"))
    k = F.col("l_orderkey") + F.col("l_linenumber")
    edits = base.filter(k % 3 == 0).select("l_orderkey", "l_linenumber", (1 + k % 2).cast("int").alias("seq"), F.lit("user").alias("actor"), F.when(k % 2 == 0, F.col("quantity") + 1).alias("quantity"), F.lit(None).cast("double").alias("unit_price"), F.when(k % 4 == 1, F.concat(F.lit("X"), F.col("article"))).alias("article"), F.lit(None).cast("double").alias("amount"))
    engine = base.filter(k % 9 == 0).select("l_orderkey", "l_linenumber", F.lit(3).alias("seq"), F.lit("engine").alias("actor"), (F.col("quantity") * 2).alias("quantity"), F.lit(9.5).alias("unit_price"), F.lit(None).cast("string").alias("article"), F.lit(None).cast("double").alias("amount"))
    rows = store.edited_state(log.unionByName(edits).unionByName(engine), ["l_orderkey", "l_linenumber"], ["quantity", "unit_price", "article", "amount"])
    out = store.with_amounts(rows)
    return out.select("l_orderkey", "l_linenumber", "quantity", "article", F.coalesce("amount", F.lit(-1.0)).alias("amount"), F.array_join(F.sort_array(F.map_keys("sources")), ",").alias("edited"))


EDITED_LINES = """WITH b AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS k, min(l_quantity) AS q, min(l_extendedprice)::DECIMAL(18,2)::DOUBLE AS p, min(l_partkey)::VARCHAR AS a FROM lineitem GROUP BY ALL),
e AS (SELECT *, CASE WHEN k % 9 = 0 THEN q * 2 WHEN k % 6 = 0 THEN q + 1 ELSE q END AS quantity, CASE WHEN k % 9 = 0 THEN 9.5 WHEN l_linenumber % 5 > 0 THEN p END AS price, k % 6 = 0 AND k % 9 > 0 AS by_q, k % 3 = 0 AND k % 4 = 1 AS by_a FROM b)
SELECT l_orderkey, l_linenumber, quantity, CASE WHEN by_a THEN 'X' || a ELSE a END AS article, coalesce(round(quantity * price, 2), -1.0) AS amount, concat_ws(',', CASE WHEN by_a THEN 'article' END, CASE WHEN by_q THEN 'quantity' END) AS edited FROM e"""

def prevalidated_orders(spark, d):
    """Orders before they become messages: some without a number, a date or lines, some lines with quantities that are none."""
    k, n = F.col("o_orderkey"), F.col("l_linenumber") + F.col("l_partkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.when(k % 17 > 0, F.concat(F.lit("PO"), k)).otherwise("-").alias("order_number"), F.when(k % 19 > 0, F.date_format("o_orderdate", "yyyyMMdd")).alias("order_date"))
    quantity = F.when(n % 23 == 0, "0").when(n % 29 == 0, "n/a").when(n % 31 == 0, "-1,5").when(n % 37 > 0, F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(",")))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line_number")).agg(F.min_by(quantity, "l_partkey").alias("quantity")).filter("o_orderkey % 13 > 0")
    return rules.prevalidated(orders, lines, "o_orderkey").select("o_orderkey", F.coalesce("failure", F.lit("")).alias("failure"))


PREVALIDATED_ORDERS = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem WHERE l_orderkey % 13 > 0 GROUP BY ALL),
q AS (SELECT l.*, CASE WHEN (n + p) % 23 = 0 THEN '0' WHEN (n + p) % 29 = 0 THEN 'n/a' WHEN (n + p) % 31 = 0 THEN '-1,5' WHEN (n + p) % 37 = 0 THEN '' END AS bad FROM l),
b AS (SELECT k, min(n) FILTER (bad IS NOT NULL) AS n, arg_min(bad, n) FILTER (bad IS NOT NULL) AS v FROM q GROUP BY k)
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'ORDER_NUMBER_MISSING' WHEN o_orderkey % 19 = 0 THEN 'ORDER_DATE_MISSING' WHEN k IS NULL THEN 'NO_ORDER_LINES' WHEN n IS NOT NULL THEN 'INVALID_QUANTITY: line ' || n || ' has ' || v ELSE '' END AS failure FROM orders LEFT JOIN b ON k = o_orderkey"""


def party_projection(spark, d):
    """Customers and suppliers as rows of a master file with its headers, as parties, and customers as partners of their own; the tables' status."""
    def rows(name, p, key):
        k = F.col(key)
        own = table(spark, d, name).select(k.alias("KUNNR"), F.concat(F.lit("  "), f"{p}_name").alias("NAME"), F.when(k % 3 > 0, F.concat(k % 99, F.lit(" rue"))).alias("stras"), F.lpad((k % 100000).cast("string"), (k % 4 + 2).cast("int"), "0").alias("PSTLZ"), F.when(k % 5 == 0, "be").alias("LAND1"), F.concat(F.lit(" fr 0"), k.cast("string"), F.lit(".")).alias("VAT_NR"))
        return own.drop("LAND1") if p == "s" else own

    customers, suppliers = (S.parties(rows(*x), "kunnr") for x in (("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey")))
    status = S.table_status([S.load_audit(customers, "customers", ["id", "vat"]), S.load_audit(suppliers, "suppliers", ["id", "iban"])])
    one = status.select(F.lit("status").alias("kind"), F.col("tables").cast("string").alias("id"), F.concat_ws(" ", "rows", F.col("all_valid").cast("string"), "invalid").alias("text"))
    text = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id", F.concat_ws("|", *df.columns).alias("text"))
    return text("customer", customers).unionByName(text("supplier", suppliers)).unionByName(text("partner", S.as_partners(customers))).unionByName(one)


PARTY_PROJECTION = """WITH r AS (SELECT 'customer' AS kind, c_custkey AS k, c_name AS n, CASE WHEN c_custkey % 5 = 0 THEN 'be' ELSE 'FR' END AS c FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, 'FR' FROM supplier),
f AS (SELECT *, CASE WHEN k % 3 > 0 THEN (k % 99) || ' rue' ELSE '' END AS s, lpad(lpad((k % 100000)::VARCHAR, (k % 4 + 2)::INT, '0'), 5, '0') AS p, 'FR0' || k AS v FROM r)
SELECT kind, k::VARCHAR AS id, concat_ws('|', k, n, s, '', p, c, v) AS text FROM f UNION ALL SELECT 'partner', k::VARCHAR, concat_ws('|', k, k, n, s, '', p, c) FROM f WHERE kind = 'customer'
UNION ALL SELECT 'status', '2', (SELECT count(*) FROM r) || ' false suppliers'"""


def forbidden_words(spark, d):
    """Documents, pages and turns of conversations that hold a word of a list, here the longest words of benchmark items, with the words."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).filter(F.length("w") >= 12).distinct()
    texts = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(table(spark, d, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text"))
    return rules.forbidden_in(texts, "text", words, "w").filter("size(forbidden) > 0").select("id", F.array_join("forbidden", ",").alias("forbidden"))


FORBIDDEN_WORDS = """WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 12), t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT concat_ws('-', 'c', conv_id, turn), text FROM conversations)
SELECT id, string_agg(w, ',' ORDER BY w) AS forbidden FROM (SELECT row_number() OVER () AS r, * FROM t) JOIN w ON contains(text, w) GROUP BY r, id"""

def converted_files(spark, d):
    """Letters of customers as files of one to three pages, some in another encoding, too short or locked: read by the first reader that can, the pages that are asked for, with errors kept to their own file."""
    k = F.col("c_custkey")
    page = lambda n: F.concat(F.lit(f"Page {n} de "), "c_name", F.lit(" été "), F.repeat(F.col("c_mktsegment"), 8))
    text = F.concat_ws("\f", page(1), F.when(k % 3 > 0, page(2)), F.when(k % 3 == 2, page(3)))
    content = F.when(k % 7 == 0, F.encode(F.lit("court"), "UTF-8")).when(k % 11 == 0, F.encode(F.concat(F.lit("%LOCKED"), text), "UTF-8")).when(k % 5 == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    files = table(spark, d, "customer").select(F.concat(F.lit("f"), k).alias("path"), content.alias("content"))
    wanted = table(spark, d, "customer").filter(k % 4 == 0).select(F.concat(F.lit("f"), k).alias("path"), F.when(k % 8 == 0, "1,3").otherwise("1-2").alias("selection"))

    def reader(encoding):
        def pages(content: bytes) -> list[str]:
            if content.startswith(b"%LOCKED"):
                raise ValueError("locked")
            return content.decode(encoding).split("\f")

        return pages

    pages = read_pages(files, [("utf8", reader("utf-8")), ("western", reader("cp1252"))])
    good = selected_pages(pages.filter("error is null"), wanted)
    rows = good.unionByName(pages.filter("error is not null"))
    return rows.select("path", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("reader", F.lit("-")).alias("reader"), F.coalesce(F.length("text"), F.lit(0)).alias("characters"), F.col("error").isNotNull().alias("failed"))


CONVERTED_FILES = """WITH f AS (SELECT c_custkey AS k, 'f' || c_custkey AS path, length(c_name) + 8 * length(c_mktsegment) + 15 AS n, (c_custkey % 3 + 1)::INT AS pages, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'western' ELSE 'utf8' END AS how FROM customer),
p AS (SELECT *, unnest(range(1, pages + 1))::INT AS page FROM f WHERE how <> 'failed')
SELECT path, page, how AS reader, n::INT AS characters, false AS failed FROM p WHERE k % 4 > 0 OR (k % 8 = 0 AND page IN (1, 3)) OR (k % 8 = 4 AND page <= 2)
UNION ALL SELECT path, 0, '-', 0, true FROM f WHERE how = 'failed'"""

QUERIES = {
    "tax_identification": (tax_identification, TAX_IDENTIFICATION), "candidate_fields": (candidate_fields, CANDIDATE_FIELDS), "message_checklist": (message_checklist, MESSAGE_CHECKLIST),
    "appended_lines": (appended_lines, APPENDED_LINES), "longest_mentions": (longest_mentions, LONGEST_MENTIONS), "search_with_status": (search_with_status, SEARCH_WITH_STATUS), "edited_lines": (edited_lines, EDITED_LINES),
    "prevalidated_orders": (prevalidated_orders, PREVALIDATED_ORDERS), "party_projection": (party_projection, PARTY_PROJECTION), "forbidden_words": (forbidden_words, FORBIDDEN_WORDS), "converted_files": (converted_files, CONVERTED_FILES),
}
