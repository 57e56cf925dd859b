"""Listings, searches, dashboards and state views over orders, customers and the event log. QUERIES: name to (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import ranking as R, rules, store
from tallyloom.operators.joins import full_outer_newest
from tallyloom.plans.tables import table


def list_orders(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("customer"), "o_orderstatus", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200)


LIST_ORDERS = """SELECT o_orderkey, coalesce(c_name, 'customer ' || o_custkey) AS customer, o_orderstatus, o_totalprice
FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200"""


def search_any_column(spark, d):
    """Parts with a text in any column, letters of either case."""
    parts = table(spark, d, "part")
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.contains(F.lower(c), F.lit("eco"))
    return parts.filter(hit).select("p_partkey", "p_name", "p_brand", "p_type")


SEARCH_ANY_COLUMN = "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_brand), 'eco') OR contains(lower(p_type), 'eco')"


def search_regex(spark, d):
    return table(spark, d, "part").filter(F.lower("p_name").rlike("^(cold|hot).*") | F.lower("p_brand").rlike("#1[1-3]$")).select("p_partkey", "p_name", "p_brand")


SEARCH_REGEX = "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(lower(p_name), '^(cold|hot).*') OR regexp_matches(lower(p_brand), '#1[1-3]$')"


def search_haystack(spark, d):
    """A text that may run across columns."""
    return table(spark, d, "customer").filter(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("7 b"))).select("c_custkey", "c_name", "c_mktsegment")


SEARCH_HAYSTACK = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '7 b')"


def history_page(spark, d):
    """The third page of 25 of the orders of one status in a range of dates, with the number of all of them."""
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1998-01-01'")
    found = rows.join(F.broadcast(rows.agg(F.count("*").alias("found"))), F.lit(True))  # one row
    return found.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_custkey", "found")


HISTORY_PAGE = """WITH r AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM r) AS found FROM r ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50"""


def work_queue(spark, d):
    """The 20 oldest open orders."""
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderstatus", "o_orderdate")


WORK_QUEUE = "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 20"


def status_dashboard(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.to_date("o_orderdate") == F.lit("1996-01-02").cast("date")).alias("n_day"), F.round(F.sum("o_totalprice"), 2).alias("total"))


STATUS_DASHBOARD = "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderdate::DATE = DATE '1996-01-02') AS n_day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus"


def kpi_rates(spark, d):
    n = F.greatest(F.count("*"), F.lit(1))
    auto = F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= 150000))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), auto.alias("auto"), F.bround(F.lit(100.0) * auto / n, 1).alias("rate"))


KPI_RATES = """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice >= 150000) AS auto,
round_even(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F' AND o_totalprice >= 150000) / greatest(count(*), 1), 1) AS rate FROM orders GROUP BY o_orderpriority"""


def recalc_totals(spark, d):
    orders, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem")
    sums = lines.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("c"), F.max("l_linenumber").alias("m"))
    rows = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"), F.coalesce("c", F.lit(0)).alias("n_lines"), (F.coalesce("m", F.lit(0)) + 1).alias("next_line"))


RECALC_TOTALS = """SELECT o_orderkey, round(coalesce(sum(l_extendedprice), 0), 2) AS total, count(l_orderkey) AS n_lines, coalesce(max(l_linenumber), 0) + 1 AS next_line
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


def team_routing(spark, d):
    """Orders whose parts all begin with 7, and those without any that begins with 8."""
    first = F.left(F.col("l_partkey").cast("string"), F.lit(1))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(first == "7").alias("all_7"), F.bool_or(first == "8").alias("any_8"))
    return rows.select("l_orderkey", F.when(F.col("all_7"), "spare parts").when(~F.col("any_8"), "accessories").otherwise("equipment").alias("team"))


TEAM_ROUTING = """SELECT l_orderkey, CASE WHEN bool_and(left(l_partkey::VARCHAR, 1) = '7') THEN 'spare parts' WHEN NOT bool_or(left(l_partkey::VARCHAR, 1) = '8') THEN 'accessories' ELSE 'equipment' END AS team
FROM lineitem GROUP BY l_orderkey"""


def latest_order_per_customer(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return R.latest_per_key(orders, "o_custkey", "o_orderdate", "o_orderkey")


LATEST_ORDER = """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def line_numbering(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.numbered(rows, "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])


LINE_NUMBERING = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 10 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_number
FROM lineitem WHERE l_returnflag <> 'R'"""


def duplicate_suffix(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("code"), "event_id")
    return R.suffixed(rows, "user_id", "code", [F.asc("event_id")])


DUPLICATE_SUFFIX = """SELECT user_id, event_id, event_type || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS code
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)"""


def ties_with_best(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return R.ties_with_best(rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")), "l_orderkey", "l_quantity", "l_linenumber")


TIES_WITH_BEST = """WITH g AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM g) WHERE r = 1 AND k BETWEEN 2 AND 6"""


def hint_boost(spark, d):
    """The best line of each order when discounted lines count 25 more."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    rows = R.boosted(rows, "l_quantity", F.col("l_discount") >= 0.08)
    return R.top_k(rows, "l_orderkey", [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


HINT_BOOST = """SELECT l_orderkey, l_linenumber, l_partkey, q AS l_quantity FROM (SELECT *, l_quantity + CASE WHEN l_discount >= 0.08 THEN 25 ELSE 0 END AS q FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_linenumber, l_partkey) = 1"""


def filter_or_all(spark, d):
    """Of each order the lines by one ship mode, or all where none is."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return R.flagged_or_all(rows, "l_orderkey", F.col("l_returnflag") == "R")


FILTER_OR_ALL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem
QUALIFY l_returnflag = 'R' OR NOT bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey)"""


def orders_newest_source(spark, d):
    """Two overlapping sets of orders, of which the second replaces only where it is newer."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    shifted = F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, cast(o_orderkey % 3 - 1 as int))")
    return full_outer_newest(rows.filter("o_orderkey % 4 <> 0"), rows.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), shifted.alias("o_orderdate")), "o_orderkey", "o_orderdate")


ORDERS_NEWEST = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 4 <> 0),
b AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_orderdate + to_days((o_orderkey % 3 - 1)::INT) AS o_orderdate FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN t THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus, CASE WHEN t THEN b.o_orderdate ELSE a.o_orderdate END AS o_orderdate, t AS from_right
FROM (SELECT *, b.o_orderkey IS NOT NULL AND (a.o_orderkey IS NULL OR b.o_orderdate > a.o_orderdate) AS t FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) x(ak, ast, ad, bk, bst, bd, t), LATERAL (SELECT ak AS o_orderkey, ast AS o_orderstatus, ad AS o_orderdate) a, LATERAL (SELECT bk AS o_orderkey, bst AS o_orderstatus, bd AS o_orderdate) b"""


def order_assembly(spark, d):
    """Orders with their lines as one array, shown by its size, first and last."""
    orders = table(spark, d, "orders").select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    out = store.assembled(orders, {"lines": (lines, ["l_linenumber"])}, "o_orderkey")
    return out.select("o_orderkey", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0.0), lambda a, x: a + x.l_quantity).alias("quantity"), F.array_join(F.transform("lines", lambda x: x.l_linenumber.cast("string")), ",").alias("numbers"))


ORDER_ASSEMBLY = """SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(sum(l_quantity), 0) AS quantity, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS numbers
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""


def latest_state(spark, d):
    """The last event of each user; those that end with a refund count as deleted."""
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", "value", (F.col("event_type") == "error").alias("deleted"))
    return store.latest_state(log, "user_id").drop("deleted")


LATEST_STATE = """SELECT user_id, event_id AS seq, event_type, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"""


def patched_state(spark, d):
    """For each user the last value of each field that any event set."""
    e = table(spark, d, "events")
    fields = e.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.when(F.col("event_type") == "click", F.col("props")).alias("clicked"))
    return store.patched_state(fields, "user_id", ["paid", "clicked"])


PATCHED_STATE = """SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS paid, arg_max(props, event_id) FILTER (event_type = 'click') AS clicked FROM events GROUP BY user_id"""


def dedupe_hits(spark, d):
    return store.hits(table(spark, d, "events"), ["user_id", "event_type"], "ts")


DEDUPE_HITS = "SELECT user_id, event_type, count(*) AS hit_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL"


def insert_missing(spark, d):
    orders = table(spark, d, "orders")
    return store.insert_missing(orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer").select("c_custkey"), "c_custkey")


INSERT_MISSING = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def role_resolution(spark, d):
    """Roles from a database, else from the environment, else the default: by priority of order and nation."""
    nation = table(spark, d, "nation")
    db = nation.filter("n_nationkey % 4 = 0").select("n_name", F.lit("admin").alias("db"))
    env = nation.filter("n_nationkey % 3 = 0").select("n_name", F.lit("reviewer").alias("env"))
    return nation.select("n_name").join(db.join(env, "n_name", "full"), "n_name", "left").select("n_name", F.coalesce("db", "env", F.lit("adv")).alias("role"))


ROLE_RESOLUTION = "SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'admin' WHEN n_nationkey % 3 = 0 THEN 'reviewer' ELSE 'adv' END AS role FROM nation"


def rules_decision(spark, d):
    """Findings of rule set A on order lines with gaps, decided by order."""
    lines = table(spark, d, "lineitem")
    article = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey").cast("string")).otherwise("-")
    quantity = F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).otherwise(0.0)
    price = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_extendedprice"))
    found = lines.select("l_orderkey", rules.line_rules("A", article, quantity, price, F.col("l_partkey") % 7 != 0).alias("f"))
    each = found.select("l_orderkey", F.explode_outer("f").alias("x"))
    rows = each.groupBy("l_orderkey").agg(F.count_if(F.col("x.severity") == "blocking").alias("blocking"), F.count_if(F.col("x.severity") == "warning").alias("warnings"))
    return rows.withColumn("decision", F.when(F.col("blocking") > 0, "REJECTED").when(F.col("warnings") > 0, "REVIEW_REQUIRED").otherwise("ACCEPTED"))


RULES_DECISION = """WITH r AS (SELECT l_orderkey, (l_partkey % 11 = 0)::INT + (l_partkey % 11 <> 0 AND l_partkey % 7 = 0)::INT + (l_linenumber = 3)::INT AS b, (l_suppkey % 5 = 0)::INT AS w FROM lineitem),
s AS (SELECT l_orderkey, sum(b)::BIGINT AS blocking, sum(w)::BIGINT AS warnings FROM r GROUP BY l_orderkey)
SELECT *, CASE WHEN blocking > 0 THEN 'REJECTED' WHEN warnings > 0 THEN 'REVIEW_REQUIRED' ELSE 'ACCEPTED' END AS decision FROM s"""


def event_windows(spark, d):
    """Beyond the listings: counts in windows of an hour that begin every half hour, the batch form of a streaming query."""
    from tallyloom.streaming.flows import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "30 minutes")


EVENT_WINDOWS = """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL"""


def event_sessions(spark, d):
    from tallyloom.streaming.flows import session_counts

    return session_counts(table(spark, d, "events"), "ts", "user_id", "30 minutes")


EVENT_SESSIONS = """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "list_left_join_coalesce": (list_orders, LIST_ORDERS), "search_any_column": (search_any_column, SEARCH_ANY_COLUMN), "search_regex": (search_regex, SEARCH_REGEX), "search_haystack": (search_haystack, SEARCH_HAYSTACK),
    "page_offset": (history_page, HISTORY_PAGE), "work_queue": (work_queue, WORK_QUEUE), "status_dashboard": (status_dashboard, STATUS_DASHBOARD), "kpi_rates": (kpi_rates, KPI_RATES), "recalc_totals": (recalc_totals, RECALC_TOTALS),
    "team_routing": (team_routing, TEAM_ROUTING), "latest_order_per_customer": (latest_order_per_customer, LATEST_ORDER), "line_numbering": (line_numbering, LINE_NUMBERING), "duplicate_suffix": (duplicate_suffix, DUPLICATE_SUFFIX),
    "ties_with_best": (ties_with_best, TIES_WITH_BEST), "hint_boost": (hint_boost, HINT_BOOST), "filter_or_all": (filter_or_all, FILTER_OR_ALL), "full_outer_newest": (orders_newest_source, ORDERS_NEWEST), "nested_assembly": (order_assembly, ORDER_ASSEMBLY),
    "latest_state": (latest_state, LATEST_STATE), "patched_state": (patched_state, PATCHED_STATE), "dedupe_hits": (dedupe_hits, DEDUPE_HITS), "insert_missing": (insert_missing, INSERT_MISSING), "role_resolution": (role_resolution, ROLE_RESOLUTION),
    "rules_decision": (rules_decision, RULES_DECISION), "event_windows": (event_windows, EVENT_WINDOWS), "event_sessions": (event_sessions, EVENT_SESSIONS),
}
