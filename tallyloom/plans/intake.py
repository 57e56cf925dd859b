"""Engine results as reviews, state changes, dates and references over the tables. QUERIES: name to (plan, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import extract as X, normalize as N
from tallyloom.operators import intake as I
from tallyloom.plans.tables import table


def review_lines(spark, d):
    """The lines of orders under the names that engines use, some without price, amount or article: what is left by order."""
    k, text = F.col("l_partkey"), lambda c: F.col(c).cast("string")
    fields = F.create_map(
        F.lit("Quantite"), F.when(k % 9 == 0, "").otherwise(text("l_quantity")), F.lit("qty"), F.lit("7"), F.lit("prix_unitaire_ht"), F.when(k % 4 != 0, text("l_extendedprice")), F.lit("amount"), F.when(k % 3 == 0, text("l_extendedprice")),
        F.lit("matnr"), F.when(k % 10 == 0, F.concat(text("l_partkey"), F.lit("?"))).otherwise(text("l_partkey")), F.lit("confidence"), F.when(k % 6 == 0, "79"),
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("place"), fields.alias("fields"))
    return I.review_lines(lines, "l_orderkey", "place").select("l_orderkey", "line_number", "article", "quantity", F.round("amount", 2).alias("amount"), "status")


REVIEW_LINES = """WITH r AS (SELECT l_orderkey, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::INT AS line_number,
  CASE WHEN l_partkey % 9 = 0 THEN 7.0 ELSE l_quantity END::DOUBLE AS quantity, CASE WHEN l_partkey % 4 <> 0 THEN l_extendedprice ELSE 0 END::DOUBLE AS price, l_extendedprice::DOUBLE AS e FROM lineitem)
SELECT l_orderkey, line_number, k::VARCHAR || CASE WHEN k % 10 = 0 THEN '?' ELSE '' END AS article, quantity, round(CASE WHEN k % 3 = 0 THEN e ELSE quantity * price END, 2) AS amount,
  CASE WHEN k % 10 = 0 OR k % 6 = 0 THEN 'À vérifier' ELSE 'OK' END AS status FROM r"""


def review_status(spark, d):
    """Orders by how they are shown, with the label of a list and the platform's state."""
    k = F.col("o_orderkey")
    decision = F.when(k % 7 == 0, "rejected").when(k % 7 == 1, "REVIEW_REQUIRED").otherwise("ACCEPTED")
    confidence = F.when(k % 11 != 0, (80 + k % 21).cast("int"))
    rows = table(spark, d, "orders").select(I.result_status(decision, confidence, k % 2 == 0).alias("status"), confidence.alias("confidence"), F.when(k % 13 == 0, "refused").alias("message"), F.when(k % 5 != 4, F.element_at(F.array(*map(F.lit, ("COMPLETED", "FAILED", "PROCESSING", "SFTP_FAILED"))), (k % 5 + 1).cast("int"))).alias("state"))
    rows = rows.select("status", I.issue_label(F.col("message"), F.col("status"), F.col("confidence")).alias("issue"), I.platform_status(F.col("state")).alias("platform"))
    return rows.groupBy("status", "issue", "platform").agg(F.count("*").alias("n"))


REVIEW_STATUS = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN 80 + o_orderkey % 21 END AS c FROM orders),
s AS (SELECT k, c, CASE WHEN k % 7 = 0 THEN 'Rejeté' WHEN k % 7 = 1 OR coalesce(c, 0) < 90 THEN 'Revue requise' WHEN k % 2 = 0 THEN 'Généré' ELSE 'À revoir' END AS status FROM r)
SELECT status, CASE WHEN k % 13 = 0 THEN 'refused' WHEN status = 'Rejeté' THEN 'Commande rejetée par le moteur' WHEN status = 'Généré' THEN 'EDIFACT généré' WHEN coalesce(c, 100) < 90 THEN 'Confiance insuffisante' ELSE 'Revue requise' END AS issue,
  CASE k % 5 WHEN 0 THEN 'Généré' WHEN 1 THEN 'Rejeté' WHEN 3 THEN 'SFTP échoué' ELSE 'À revoir' END AS platform, count(*) AS n FROM s GROUP BY ALL"""


def _results(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("order_id"), F.when(k % 3 != 0, k.cast("string")).alias("soldto"), F.when(k % 4 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("shipto"), F.col("c_name").alias("customer_name"), (k % 100).cast("int").alias("confidence"),
        F.when(k % 5 != 0, "12 rue a").alias("master_street"), F.lit("75001").alias("master_postal"), F.when(k % 2 == 0, " ").otherwise("paris").alias("master_city"), F.lit("site").alias("detected_name"), F.lit("3 rue b").alias("detected_street"), F.lit("69001").alias("detected_postal"), F.lit("lyon").alias("detected_city"),
    )


def review_partners(spark, d):
    return I.review_partners(_results(spark, d), "order_id")


REVIEW_PARTNERS = """WITH r AS (SELECT c_custkey AS k, c_name AS n, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS so, CASE WHEN c_custkey % 4 <> 0 THEN 'S' || c_custkey END AS sh, CASE WHEN c_custkey % 5 <> 0 THEN '12 rue a' END AS st, CASE WHEN c_custkey % 2 <> 0 THEN 'paris' END AS ci FROM customer)
SELECT k AS order_id, 'soldto' AS function, coalesce(so, n) AS code, n AS name, coalesce(st, '3 rue b') AS street, '75001' AS postal, coalesce(ci, 'lyon') AS city, (k % 100)::INT AS confidence FROM r
UNION ALL SELECT k, 'shipto', coalesce(sh, 'site'), 'site', '3 rue b', '69001', 'lyon', (k % 100)::INT FROM r
UNION ALL SELECT k, f, coalesce(so, n), n, coalesce(st, ''), '75001', coalesce(ci, ''), (k % 100)::INT FROM r, (VALUES ('billto'), ('payer')) v(f)"""


def review_findings(spark, d):
    """Findings on orders from their lines, of which several have one code, and those of orders without a date."""
    details = table(spark, d, "lineitem").filter("l_partkey % 6 = 0").select(F.col("l_orderkey").alias("o"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("p"), F.when(F.col("l_partkey") % 12 == 0, "blocking").otherwise("low").alias("severity"), F.concat(F.lit("C"), (F.col("l_partkey") % 3).cast("string")).alias("code"), F.lit(" ").alias("message"))
    details = details.withColumn("place", F.expr("row_number() over (partition by o order by p)")).drop("p")
    results = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.when(F.col("o_orderkey") % 9 == 0, "Invalid date").otherwise("2024-01-01").alias("order_date"))
    return I.findings(details, results, "o").select("o", "anomaly_id", "severity", "field", "message", "status")


REVIEW_FINDINGS = """WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, 'C' || (l_partkey % 3) AS c, l_partkey % 12 = 0 AS b FROM lineitem WHERE l_partkey % 6 = 0)
SELECT o, o || '-' || c || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS anomaly_id, CASE WHEN b THEN 'error' ELSE 'warning' END AS severity, c AS field, c AS message, CASE WHEN b THEN 'Bloquante' ELSE 'Ouverte' END AS status FROM l
UNION ALL SELECT o_orderkey, 'an-date-' || o_orderkey, 'error', 'orderDate', 'La date de commande extraite n''est pas valide', 'Ouverte' FROM orders WHERE o_orderkey % 9 = 0"""


def missing_fields(spark, d):
    """What stands against the messages of orders with gaps, as one text."""
    k = F.col("o_orderkey")
    reviews = table(spark, d, "orders").select("o_orderkey", F.when(k % 4 != 0, "P").alias("po_number"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("order_date"), F.when(k % 6 == 0, " ").otherwise("1").alias("soldto"), F.lit("2").alias("shipto"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line_number"), F.when(F.col("l_partkey") % 50 != 0, "a").alias("article"), F.when(F.col("l_partkey") % 51 != 0, F.col("l_quantity")).alias("quantity"))
    anomalies = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select("o_orderkey", F.when(k % 20 == 0, "Ouverte").otherwise("Corrigée").alias("status"), F.lit("m").alias("message"))
    return I.missing_fields(reviews, lines, anomalies, "o_orderkey").select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


MISSING_FIELDS = """WITH l AS (SELECT l_orderkey AS o, count(*) AS n, string_agg(CASE WHEN l_partkey % 50 = 0 THEN 'Ligne ' || l_linenumber || ' : article manquant' WHEN l_partkey % 51 = 0 THEN 'Ligne ' || l_linenumber || ' : quantité manquante' END, '; '
  ORDER BY l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END) AS bad FROM lineitem GROUP BY 1)
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'N° de commande client manquant' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Date de commande manquante' END, CASE WHEN o_orderkey % 6 = 0 THEN 'Code sold-to manquant' END,
  CASE WHEN n IS NULL THEN 'Aucune ligne de commande' END, bad, CASE WHEN o_orderkey % 20 = 0 THEN '1 anomalie(s) en attente; Anomalie : m' END) AS errors FROM orders LEFT JOIN l ON o = o_orderkey"""


def primary_only(spark, d):
    """Customers as candidate addresses of their nation; a nation's primary place is sure, unsure, or nobody's."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    candidates = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("doc"), F.lpad((k % 7).cast("string"), 5, "0").alias("postal"), F.when(k % 3 == 0, "lyon").otherwise("paris").alias("city"))
    primary = table(spark, d, "nation").select(n.alias("doc"), F.when(n % 4 == 1, "99999").otherwise((n % 7).cast("string")).alias("postal"), F.when(n % 2 == 0, "Lyon cedex 2").alias("city"), (70 + n).cast("int").alias("score"))
    return I.primary_only(candidates, primary, "doc").select("c_custkey", "doc")


PRIMARY_ONLY = """WITH r AS (SELECT c_custkey, c_nationkey AS doc, 70 + c_nationkey >= 80 AS sure, c_nationkey % 4 <> 1 AND c_custkey % 7 = c_nationkey % 7 OR c_nationkey % 2 = 0 AND c_custkey % 3 = 0 AS same FROM customer)
SELECT c_custkey, doc FROM r QUALIFY NOT sure OR NOT bool_or(same) OVER (PARTITION BY doc) OR same"""


def state_changes(spark, d):
    """Orders after decisions and generated messages, by status and message."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", F.lit("f").alias("file_name"), F.lit("NEW").alias("status"), F.lit(None).cast("string").alias("message_file"), F.lit(True).alias("review_required"), F.lit(90).alias("confidence"), F.col("o_orderdate").alias("updated_at"))
    decisions = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", F.explode(F.array(F.struct(F.lit("save").alias("decision"), F.lit(1).alias("seq")), F.struct(F.when(k % 2 == 0, "approve").otherwise("reject").alias("decision"), F.lit(2).alias("seq")))).alias("x")).select("o_orderkey", "x.*")
    messages = table(spark, d, "orders").filter("o_orderkey % 6 = 0 and o_orderkey % 12 <> 0").select("o_orderkey", F.concat(F.lit("m"), k.cast("string")).alias("file"), F.lit("").alias("content"))
    rows, history = I.generated(I.decided(orders, decisions, "o_orderkey"), messages, "o_orderkey", F.lit("2024-05-01").cast("timestamp"))
    both = rows.select("o_orderkey", "status", "message_file", "review_required", F.lit("order").alias("kind")).unionByName(history.select("o_orderkey", "status", "message_file", F.lit(None).cast("boolean").alias("review_required"), F.lit("history").alias("kind")))
    return both


STATE_CHANGES = """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0 THEN 'm' || o_orderkey END AS m FROM orders)
SELECT o_orderkey, CASE WHEN m IS NOT NULL THEN 'Généré' WHEN o_orderkey % 6 = 0 THEN 'APPROVED' WHEN o_orderkey % 3 = 0 THEN 'REJECTED' ELSE 'NEW' END AS status, m AS message_file, m IS NULL AS review_required, 'order' AS kind FROM r
UNION ALL SELECT o_orderkey, 'Généré', m, NULL, 'history' FROM r WHERE m IS NOT NULL"""


def resolved_anomalies(spark, d):
    """Events as anomalies and, for errors, as actions on them: the last action of each user decides."""
    e = table(spark, d, "events")
    anomalies = e.select("user_id").distinct().withColumn("status", F.lit("Ouverte"))
    actions = e.filter("event_type = 'error'").select("user_id", F.element_at(F.array(*map(F.lit, ("corrected", "ignored", "blocking", "other"))), (F.col("event_id") % 4 + 1).cast("int")).alias("action"), F.struct("ts", "event_id").alias("seq"))
    return I.resolved_anomalies(anomalies, actions, "user_id")


RESOLVED_ANOMALIES = """WITH a AS (SELECT user_id, ['Corrigée', 'Ignorée', 'Bloquante', 'Corrigée'][event_id % 4 + 1] AS s FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT u.user_id, coalesce(s, 'Ouverte') AS status FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a ON a.user_id = u.user_id"""


def claimed_jobs(spark, d):
    """The oldest four open orders, one to each worker."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "RECEIVED").when(F.col("o_orderstatus") == "P", "RETRY").otherwise("COMPLETED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return I.claimed(jobs, 4)


CLAIMED_JOBS = "SELECT o_orderkey AS job_id, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::INT AS worker FROM orders WHERE o_orderstatus IN ('O', 'P') QUALIFY worker < 4"


def converted_orders(spark, d):
    """Totals from a first engine, or from a second where it has none, and rows that a store lacks made from reviews."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    found = I.converted(o.filter("id % 3 = 0"), o.filter("id % 2 = 0").withColumn("o_totalprice", F.lit(1.0)), "id", "o_totalprice")
    return I.with_missing_conversions(found, o.filter("id % 5 = 0").select("id", F.lit("review").alias("engine")), )


CONVERTED_ORDERS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN 1.0 END::DOUBLE AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'primary' WHEN o_orderkey % 2 = 0 THEN 'legacy' ELSE 'review' END AS engine
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0"""


def document_paths(spark, d):
    """Where the documents of parts lie: their own path, their upload's, or a file whose name has theirs in it."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("order"), k.cast("string"))
    orders = table(spark, d, "part").select("p_partkey", F.when(k % 4 == 0, F.concat(F.lit("/a/"), name)).alias("path"), F.when(k % 3 == 0, k.cast("string")).alias("upload_id"), F.concat(F.upper(name), F.lit("_x.pdf")).alias("file_name"))
    uploads = table(spark, d, "part").filter("p_partkey % 6 = 0").select(k.cast("string").alias("upload_id"), F.concat(F.lit("/u/"), k.cast("string")).alias("path"))
    files = table(spark, d, "part").select(F.when(k % 8 == 0, F.concat(F.lit("/a/"), name)).otherwise(F.concat(F.lit("/f/upl-"), name)).alias("path"), F.concat(F.lit("upl-"), name, F.lit("_x.pdf")).alias("name"))
    return I.document_paths(orders, uploads, files, "p_partkey")


DOCUMENT_PATHS = """SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN '/a/order' || p_partkey WHEN p_partkey % 6 = 0 THEN '/u/' || p_partkey ELSE '/f/upl-order' || p_partkey END AS path FROM part"""


def merged_lines(spark, d):
    """The lines of documents, and those of the next document that the first lacks."""
    docs = table(spark, d, "documents")
    lines = lambda shift: docs.select((F.col("doc_id") - shift).alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line")).filter("doc % 2 = 0")
    out = I.merged_lines([lines(0), lines(1)], "doc", "i", "line")
    return out.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.col("i") * F.length("line")).alias("weighed"))


MERGED_LINES = """WITH l AS (SELECT doc_id - doc_id % 2 AS doc, doc_id % 2 AS part, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, lower(strip_accents(line)) AS key FROM l WHERE line <> ''),
m AS (SELECT *, min(part) OVER (PARTITION BY doc, key) AS first, row_number() OVER (PARTITION BY doc, key, part ORDER BY i) AS nth FROM k),
n AS (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY part, i) AS i FROM m WHERE part = first AND (part = 0 OR nth = 1))
SELECT doc, count(*) AS n, sum(i * length(line))::BIGINT AS weighed FROM n GROUP BY doc"""


def date_variants(spark, d):
    """Dates in loose forms, and times with and without an offset."""
    o, k = F.col("o_orderdate"), F.col("o_orderkey")
    loose = F.when(k % 5 == 0, F.date_format(o, "d/M/yyyy")).when(k % 5 == 1, F.date_format(o, "d.M.yy")).when(k % 5 == 2, F.date_format(o, "yyyy-M-d")).when(k % 5 == 3, F.concat(F.lit("le "), F.date_format(o, "yyyyMMdd"))).otherwise("soon")
    time = F.concat(F.date_format(o, "yyyy-MM-dd'T'12:30:00"), F.when(k % 4 == 0, "Z").when(k % 4 == 1, "+02:00").when(k % 4 == 2, "").otherwise("?"))
    return table(spark, d, "orders").select("o_orderkey", N.loose_date(loose).alias("day"), N.utc_time(time).cast("string").alias("at"))


DATE_VARIANTS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN '' WHEN 1 THEN '20' || strftime(o_orderdate, '%y%m%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS day,
CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 10:30:00') ELSE strftime(o_orderdate, '%Y-%m-%d 12:30:00') END AS at FROM orders"""


def references(spark, d):
    """File names, control references, departments and actors of orders."""
    k = F.col("o_orderkey").cast("string")
    who = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit(' "A'), k, F.lit('@X.fr"'))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Users: U"), k)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("dom\\a/B"), k)).otherwise(F.lit(None).cast("string"))
    at = F.lit("2024-05-01 07:08:09").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", N.message_file(F.lit("a-1"), F.concat(F.lit("po/"), k), at).alias("file"), N.control_reference(F.concat(F.lit("po-12345678"), k), at).alias("reference"), N.department(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("F-"), k, F.lit("999"))).otherwise("x")).alias("department"), N.actor(who).alias("actor"))


REFERENCES = """SELECT o_orderkey, 'ORDERS_A1_PO' || o_orderkey || '_20240501070809.tst' AS file, right('PO12345678' || o_orderkey, 9) || '0708' AS reference, CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderkey || '999', 2) ELSE 'NA' END AS department,
CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey || '@x.fr' WHEN 1 THEN 'u' || o_orderkey WHEN 2 THEN 'b' || o_orderkey ELSE '' END AS actor FROM orders"""


def salvaged_rows(spark, d):
    """Lists in answers: alone, in fences, or inside an object."""
    k = F.col("event_id")
    rows = F.concat(F.lit('[{"k":'), k.cast("string"), F.lit("}]"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Here: "), rows)).when(k % 3 == 1, F.concat(F.lit("```json\n{\"lines\":"), rows, F.lit("}\n```"))).otherwise("nothing [ at all")
    return table(spark, d, "events").select("event_id", F.get_json_object(X.salvaged_rows(text), "$[0].k").cast("long").alias("k"))


SALVAGED_ROWS = "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS k FROM events"

QUERIES = {
    "review_lines": (review_lines, REVIEW_LINES), "review_status": (review_status, REVIEW_STATUS), "review_partners": (review_partners, REVIEW_PARTNERS), "review_findings": (review_findings, REVIEW_FINDINGS),
    "missing_fields": (missing_fields, MISSING_FIELDS), "primary_only": (primary_only, PRIMARY_ONLY), "state_changes": (state_changes, STATE_CHANGES), "resolved_anomalies": (resolved_anomalies, RESOLVED_ANOMALIES),
    "claimed_jobs": (claimed_jobs, CLAIMED_JOBS), "converted_orders": (converted_orders, CONVERTED_ORDERS), "document_paths": (document_paths, DOCUMENT_PATHS), "merged_lines": (merged_lines, MERGED_LINES),
    "date_variants": (date_variants, DATE_VARIANTS), "references": (references, REFERENCES), "salvaged_rows": (salvaged_rows, SALVAGED_ROWS),
}
