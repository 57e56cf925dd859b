"""What an extraction engine returns, as rows for review: statuses, lines, partners, findings, and the answers built from them.

results: order_id, upload_id, file_name, po_number, order_date, delivery_date, soldto, shipto, customer_name, confidence,
decision, generated, and detected (street, postal, city) and master addresses. Everything is a projection or an equi-join
on the order; no text of a document travels with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import normalize as N
from tallyloom.operators.addresses import city_compatible
from tallyloom.operators.answers import answer_fields, value
from tallyloom.operators.review import filled

# fixed values: states as they are shown, and the confidence from which an order needs no review
REJECTED, TO_REVIEW, REVIEW, GENERATED, DELIVERY_FAILED, PARTIAL = "Rejeté", "À revoir", "Revue requise", "Généré", "SFTP échoué", "Partiel"
PLATFORM_STATUS = {"REVIEW_REQUIRED": REVIEW, "COMPLETED": GENERATED, "FAILED": REJECTED, "REJECTED": REJECTED, "PROCESSING": TO_REVIEW, "SFTP_FAILED": DELIVERY_FAILED}
RESOLUTIONS = {"corrected": "Corrigée", "ignored": "Ignorée", "blocking": "Bloquante"}
SURE, LINE_SURE, PRIMARY_SURE = 90, 80, 80
# fixed values: the names under which engines give a line's fields, the first filled one counts
LINE_FIELDS = {
    "quantity": ("Quantite", "quantite", "quantity", "qty"), "unit_price": ("Prix unitaire", "prix_unitaire_ht", "unit_price", "price"), "amount": ("Montant", "montant_ligne_ht", "amount"),
    "article": ("code_article", "article", "matnr"), "customer_reference": ("Reference client", "customer_reference"), "description": ("Designation", "description", "designation"), "unit": ("Unite", "unit"), "confidence": ("Confiance", "confidence"),
}
COMMON = 10000  # fixed value: files of a word that are many
PARTNERS = ("soldto", "shipto", "billto", "payer")


def mapped(value: Column, table: Mapping[str, str], default: str) -> Column:
    """The value that table has for it, else default."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def platform_status(status: Column) -> Column:
    return mapped(status, PLATFORM_STATUS, TO_REVIEW)


def result_status(decision: Column, confidence: Column, generated: Column) -> Column:
    """How an engine's result is shown: rejected, for review (asked for, or not sure enough), generated, else to look at."""
    doubt = (F.upper(decision) == "REVIEW_REQUIRED") | (F.coalesce(confidence, F.lit(0)) < SURE)
    return F.when(F.upper(decision) == "REJECTED", REJECTED).when(F.coalesce(doubt, F.lit(True)), REVIEW).when(F.coalesce(generated, F.lit(False)), GENERATED).otherwise(TO_REVIEW)


def issue_label(message: Column, status: Column, confidence: Column) -> Column:
    """What a list says of an order; a missing confidence counts as full."""
    return (
        F.when(filled(message).isNotNull(), message).when(status == REJECTED, "Commande rejetée par le moteur").when(status == GENERATED, "EDIFACT généré")
        .when(status == PARTIAL, "Extraction partielle").when(F.coalesce(confidence, F.lit(100)) < SURE, "Confiance insuffisante").otherwise(REVIEW)
    )


def list_items(orders: DataFrame) -> DataFrame:
    """order_id, file_name, client_name, confidence, issue, at, status of orders (these, rejection_message, created_at and updated_at)."""
    return orders.select(
        "order_id", "file_name", F.coalesce(filled(F.col("client_name")), F.lit("—")).alias("client_name"), F.coalesce("confidence", F.lit(0)).alias("confidence"),
        issue_label(F.col("rejection_message"), F.col("status"), F.col("confidence")).alias("issue"), F.coalesce("updated_at", "created_at").alias("at"), F.coalesce("status", F.lit(TO_REVIEW)).alias("status"),
    )


def review_lines(lines: DataFrame, order: str, place: str, fields: str = "fields") -> DataFrame:
    """Lines for review of lines (order, place, fields: a map of texts under any of LINE_FIELDS): numbered from 1, the amount worked out where it is missing, unsure ones marked."""
    first = lambda name: F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(x)), F.lit("")) for x in LINE_FIELDS[name]))
    number = lambda name: F.coalesce(F.nullif(first(name).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = lines.select(order, F.row_number().over(Window.partitionBy(order).orderBy(place)).alias("line_number"), F.coalesce(first("article"), F.lit("")).alias("article"), F.coalesce(first("customer_reference"), F.lit("")).alias("customer_reference"), F.coalesce(first("description"), F.lit("")).alias("description"), F.coalesce(first("unit"), F.lit("PCE")).alias("unit"), number("quantity").alias("quantity"), number("unit_price").alias("unit_price"), number("amount").alias("_amount"), F.coalesce(F.nullif(first("confidence").try_cast("int"), F.lit(0)), F.lit(SURE)).alias("confidence"))
    amount = F.when(F.col("_amount") != 0, F.col("_amount")).otherwise(F.col("quantity") * F.col("unit_price"))
    unsure = F.contains("article", F.lit("?")) | (F.col("confidence") < LINE_SURE)
    return rows.withColumns({"amount": amount, "status": F.when(unsure, "À vérifier").otherwise("OK")}).drop("_amount")


def review_partners(results: DataFrame, order: str) -> DataFrame:
    """One row to each of PARTNERS: order, function, code, name, street, postal, city, confidence. results: soldto, shipto, customer_name, confidence, and detected_ and master_ name, street, postal, city."""
    get = lambda *names: F.coalesce(*(filled(F.col(x)) for x in names), F.lit(""))
    own = {"code": get("soldto", "customer_name"), "street": get("master_street"), "postal": get("master_postal"), "city": get("master_city")}
    parts = {
        "soldto": own | {"name": get("customer_name", "soldto"), "street": get("master_street", "detected_street"), "postal": get("master_postal", "detected_postal"), "city": get("master_city", "detected_city")},
        "shipto": {"code": get("shipto", "detected_name"), "name": get("detected_name", "shipto"), "street": get("detected_street", "master_street"), "postal": get("detected_postal"), "city": get("detected_city")},
        "billto": own | {"name": get("customer_name")}, "payer": own | {"name": get("customer_name")},
    }
    fields = ("code", "name", "street", "postal", "city")
    rows = F.array(*(F.struct(F.lit(p).alias("function"), *(parts[p][x].alias(x) for x in fields)) for p in PARTNERS))
    return results.select(order, F.explode(rows).alias("x"), F.coalesce("confidence", F.lit(0)).alias("confidence")).select(order, "x.*", "confidence")


def findings(details: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """Anomalies of each order: order, anomaly_id, severity, field, message, status. details: order, place, code, severity, message; results: order_date. Equal ids get -2, -3 and so on."""
    bad = F.col("severity") == "blocking"
    code = F.coalesce(filled(F.col("code")), F.concat(F.lit("rej-"), F.col("place").cast("string")))
    given = details.select(order, "place", F.concat_ws("-", F.col(order).cast("string"), code).alias("id"), F.when(bad, "error").otherwise("warning").alias("severity"), F.col("code").alias("field"), F.coalesce(filled(F.col("message")), "code", F.lit("")).alias("message"), F.when(bad, "Bloquante").otherwise("Ouverte").alias("status"))
    undated = results.filter(F.coalesce(F.lower(F.trim("order_date")), F.lit("")).isin("", "none", "invalid date"))
    dates = undated.select(order, F.lit(None).cast("int").alias("place"), F.concat(F.lit("an-date-"), F.col(order).cast("string")).alias("id"), F.lit("error").alias("severity"), F.lit("orderDate").alias("field"), F.lit("La date de commande extraite n'est pas valide").alias("message"), F.lit("Ouverte").alias("status"))
    rows = given.unionByName(dates)
    n = F.row_number().over(Window.partitionBy(order, "id").orderBy(F.asc_nulls_last("place")))
    return rows.withColumn("_n", n).select(order, F.when(F.col("_n") == 1, F.col("id")).otherwise(F.concat_ws("-", "id", F.col("_n").cast("string"))).alias("anomaly_id"), "severity", "field", "message", "status")


def trace(status: Column, generated: Column) -> Column:
    """The seven steps of an order and how far each is."""
    done = lambda c: F.when(F.coalesce(c, F.lit(False)), "completed")
    steps = [("PDF reçu", F.lit("completed")), ("Extraction OCR", F.lit("completed")), ("Mapping client", F.lit("completed")), ("Contrôles métier", F.lit("completed")), ("Revue manuelle", F.when(status.isin(REVIEW, TO_REVIEW), "current").otherwise("completed")), ("Génération EDIFACT", done(generated).otherwise("pending")), ("Export SFTP", F.lit("pending"))]
    return F.array(*(F.struct(F.lit(k).alias("step"), F.lit(label).alias("label"), state.alias("state")) for k, (label, state) in enumerate(steps, 1)))


def missing_fields(reviews: DataFrame, lines: DataFrame, anomalies: DataFrame, order: str) -> DataFrame:
    """(order, errors) of every review: what stands against generating its message. reviews: po_number, order_date, soldto, shipto; lines: line_number, article, quantity; anomalies: status, message."""
    of_line = F.when(filled(F.col("article")).isNull(), F.concat(F.lit("Ligne "), F.col("line_number").cast("string"), F.lit(" : article manquant"))).when(F.coalesce("quantity", F.lit(0.0)) == 0, F.concat(F.lit("Ligne "), F.col("line_number").cast("string"), F.lit(" : quantité manquante")))
    by_line = lines.select(order, F.struct("line_number", of_line.alias("e")).alias("x")).groupBy(order).agg(F.count("*").alias("_lines"), F.sort_array(F.collect_list(F.when(F.col("x.e").isNotNull(), F.col("x")))).alias("_bad"))
    pending = anomalies.filter(F.col("status").isin("Ouverte", "Bloquante")).groupBy(order).agg(F.sort_array(F.collect_list(F.coalesce(filled(F.col("message")), F.lit("—")))).alias("_open"))
    rows = reviews.join(by_line, order, "left").join(pending, order, "left")
    lacks = lambda c, text: F.when(filled(F.col(c).cast("string")).isNull(), text)
    fixed = F.array_compact(F.array(lacks("po_number", "N° de commande client manquant"), lacks("order_date", "Date de commande manquante"), lacks("soldto", "Code sold-to manquant"), lacks("shipto", "Code ship-to manquant"), F.when(F.coalesce("_lines", F.lit(0)) == 0, "Aucune ligne de commande")))
    none = F.array().cast("array<string>")
    waiting = F.when(F.size("_open") > 0, F.concat(F.array(F.concat(F.size("_open").cast("string"), F.lit(" anomalie(s) en attente"))), F.transform("_open", lambda m: F.concat(F.lit("Anomalie : "), m)))).otherwise(none)
    return rows.select(order, F.concat(fixed, F.coalesce(F.transform("_bad", lambda x: x.e), none), F.coalesce(waiting, none)).alias("errors"))


def conversions(results: DataFrame, order: str) -> DataFrame:
    """The stored row of each result. results: as in the module's text, with n_lines, reason and first_message."""
    return results.select(
        F.col(order).alias("id"), F.col("upload_id").alias("correlation_id"), F.col("file_name").alias("source_filename"), F.when(F.upper("decision") == "REVIEW_REQUIRED", "REVIEW_REQUIRED").otherwise("COMPLETED").alias("status"),
        "po_number", "order_date", "delivery_date", "soldto", "shipto", "customer_name", F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("n_lines", F.lit(0)).alias("line_count"), F.col("reason").alias("rejection_code"), F.col("first_message").alias("rejection_message"),
    )


def with_missing_conversions(existing: DataFrame, made: DataFrame) -> DataFrame:
    """existing and, for ids that it lacks, the rows made from their reviews (id and any of its columns; others are null)."""
    return existing.unionByName(made.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True).select(existing.columns)


def converted(primary: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, engine): the primary engine's value, or that of the other where it has none."""
    a, b = primary.select(key, F.col(value).alias("_a")), other.select(key, F.col(value).alias("_b"))
    engine = F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "legacy")
    return a.join(b, key, "full").select(key, F.coalesce("_a", "_b").alias(value), engine.alias("engine"))


def primary_only(candidates: DataFrame, primary: DataFrame, doc: str) -> DataFrame:
    """candidates (doc, postal, city) at the place of the primary detection (doc, postal, city, score) where that is sure; all where it is not, or where none is there."""
    p = primary.select(doc, N.postal_padded(F.col("postal")).alias("_postal"), F.col("city").alias("_city"), F.col("score").alias("_score"))
    same = (filled(F.col("_postal")).isNotNull() & (N.postal_padded(F.col("postal")) == F.col("_postal"))) | city_compatible(F.coalesce("_city", F.lit("")), F.coalesce("city", F.lit("")))
    sure = (F.coalesce("_score", F.lit(0)) >= PRIMARY_SURE) & F.coalesce(filled(F.col("_postal")), filled(F.col("_city"))).isNotNull()
    rows = candidates.join(p, doc, "left").withColumns({"_same": F.coalesce(same, F.lit(False)), "_sure": F.coalesce(sure, F.lit(False))})
    rows = rows.withColumn("_any", F.bool_or("_same").over(Window.partitionBy(doc)))
    return rows.filter(~F.col("_sure") | ~F.col("_any") | F.col("_same")).select(candidates.columns)


def resolved_anomalies(anomalies: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """anomalies with the status that the last action (key, action, seq) on each gives; unknown actions count as corrected."""
    last = actions.groupBy(key).agg(F.max_by("action", "seq").alias("_action"))
    rows = anomalies.join(last, key, "left")
    return rows.withColumn("status", F.when(F.col("_action").isNull(), F.col("status")).otherwise(mapped(F.col("_action"), RESOLUTIONS, RESOLUTIONS["corrected"]))).select(anomalies.columns)


def generated(orders: DataFrame, messages: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """orders with the state of those that messages (key, file, content) were made for, and the history rows to append, which replace older ones of the key."""
    made = messages.select(key, F.col("file").alias("_file"))
    rows = orders.join(made, key, "left")
    hit = F.col("_file").isNotNull()
    state = {"status": F.when(hit, GENERATED).otherwise(F.col("status")), "message_file": F.coalesce("_file", "message_file"), "review_required": F.when(hit, False).otherwise(F.col("review_required")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}
    history = rows.filter(hit).select(key, "file_name", F.lit(GENERATED).alias("status"), "confidence", F.col("_file").alias("message_file"), at.alias("processed_at"))
    return rows.withColumns(state).select(orders.columns), history


def decided(orders: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """orders with the status of the last decision (key, decision: approve, reject or save, seq); a saved review stays for review."""
    last = decisions.groupBy(key).agg(F.max_by("decision", "seq").alias("_decision"))
    status = F.when(F.col("_decision") == "approve", "APPROVED").when(F.col("_decision") == "reject", "REJECTED").when(F.col("_decision") == "save", "REVIEW_REQUIRED").otherwise(F.col("status"))
    return orders.join(last, key, "left").withColumn("status", status).select(orders.columns)


def claimed(jobs: DataFrame, workers: int, job: str = "job_id", at: str = "created_at") -> DataFrame:
    """The oldest `workers` open jobs, one to each worker: job, worker (from 0). One writer appends the rows, so that no job is claimed twice."""
    oldest = jobs.filter(F.col("status").isin("RECEIVED", "RETRY")).orderBy(at, job).limit(workers)  # a top-k
    return oldest.select(job, (F.row_number().over(Window.orderBy(at, job)) - 1).alias("worker"))


def document_paths(orders: DataFrame, uploads: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, path): of orders (key, path, upload_id, file_name) their own path if files (path, name) has it, else their upload's, else that of the first file whose name has theirs in it.

    Names meet by their first word of three letters or more, so that no order meets all files. Words of more than COMMON files that no
    order asks for are dropped before the files are shuffled by word: they would all come to one task.
    """
    known = files.select(F.col("path").alias("_own")).distinct()
    up = uploads.select("upload_id", F.col("path").alias("_upload")).dropDuplicates(["upload_id"])
    rows = orders.select(key, "path", "upload_id", F.lower("file_name").alias("_name")).join(known, F.col("path") == F.col("_own"), "left").join(up, "upload_id", "left")
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    lacking = rows.filter("_own is null and _upload is null and _name is not null")
    asked = lacking.select(key, "_name", F.get(words("_name"), F.lit(0)).alias("_word"))
    named = files.select(F.lower("name").alias("_file"), F.col("path").alias("_found")).select("_file", "_found", F.explode(F.array_distinct(words(F.col("_file")))).alias("_word"))
    common = named.groupBy("_word").agg(F.count("*").alias("_n")).filter(F.col("_n") > COMMON).select("_word")
    named = named.join(F.broadcast(common.join(asked.select("_word").distinct(), "_word", "left_anti")), "_word", "left_anti")  # one word in COMMON files at most
    first = asked.join(named, "_word").filter(F.contains("_file", F.col("_name"))).groupBy(key).agg(F.min_by("_found", "_file").alias("_found"))
    return rows.join(first, key, "left").select(key, F.coalesce("_own", "_upload", "_found").alias("path"))


def merged_lines(parts: Sequence[DataFrame], group: str, ordinal: str, text: str) -> DataFrame:
    """(group, ordinal, text): the lines of the first part, and of the others those that none before has, letters folded; numbered anew from 1."""
    rows = None
    for k, part in enumerate(parts):
        own = part.select(group, F.lit(k).alias("_part"), F.col(ordinal).alias("_at"), F.trim(text).alias(text)).filter(F.col(text) != "")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("_key", N.fold_text(F.col(text)))
    first = rows.groupBy(group, "_key").agg(F.min("_part").alias("_first"))
    # the base keeps its own repeats; a later part adds a line once
    kept = rows.join(first, [group, "_key"]).withColumn("_nth", F.row_number().over(Window.partitionBy(group, "_key", "_part").orderBy("_at"))).filter("_part = _first and (_part = 0 or _nth = 1)")
    return kept.select(group, F.row_number().over(Window.partitionBy(group).orderBy("_part", "_at")).alias(ordinal), text)


def copied_once(target: DataFrame, source: DataFrame, key: str, done: bool) -> DataFrame:
    """The rows of source that a move of a store still has to append: none if it is done, else those whose key target lacks."""
    return source.limit(0) if done else source.join(target.select(key), key, "left_anti")


def deep_merge(base: Mapping, override: Mapping) -> dict:
    """base with the values of override, mappings within mappings merged; for settings, which are read on the driver."""
    return {k: deep_merge(base[k], override[k]) if isinstance(base.get(k), Mapping) and isinstance(override.get(k), Mapping) else override.get(k, base.get(k)) for k in {**base, **override}}


def preview(orders: DataFrame, lines: DataFrame, order: str) -> DataFrame:
    """orders with line_count, unique_articles and total_amount of their lines (article, amount); 0 without lines."""
    sums = lines.groupBy(order).agg(F.count("*").alias("line_count"), F.count_distinct("article").alias("unique_articles"), F.sum("amount").alias("total_amount"))
    rows = orders.join(sums, order, "left")
    return rows.withColumns({"line_count": F.coalesce("line_count", F.lit(0)), "unique_articles": F.coalesce("unique_articles", F.lit(0)), "total_amount": F.coalesce("total_amount", F.lit(0.0))})


# fixed values: what a model's line must not begin with, and the form of its answers
CHARGES = ("PORT", "PORTSFAB", "ECOTAXE", "FRAIS DE PORT", "PARTICIPATION TRANSPORT")
PARTY = ("vat", "name", "street", "city", "postal", "country")
ANSWER = {
    "order_key": (["$.order_key", "$.order_number", "$.order.number", "$.po_number"], "text"), "document_date": (["$.document_date", "$.order_date", "$.order.date"], "text"), "delivery_date": (["$.delivery_date", "$.requested_delivery_date"], "text"),
    **{f"soldto_{c}": ([f"$.soldto_keys.{c}", f"$.soldto.{c}", f"$.buyer.{c}"], "text") for c in PARTY}, **{f"shipto_{c}": ([f"$.shipto_keys.{c}", f"$.shipto.{c}", f"$.delivery.{c}"], "text") for c in PARTY},
    "line_items": (["$.line_items", "$.lines", "$.lignes"], "list"), "confidence": (["$.confidence"], "number"),
}
ANSWER_LINE = {"article": (["$.article_code", "$.article", "$.ref"], "text"), "description": (["$.description", "$.designation"], "text"), "qty": (["$.qty", "$.quantity"], "number"), "unit_price": (["$.unit_price", "$.price"], "number")}


def build_parameters(answers: DataFrame, key: str, body: str) -> DataFrame:
    """What a message is built from, of a model's answers (key, body: JSON, or text that has it): key, order_number, order_date, delivery_date, soldto, shipto (structs), lines, confidence, warnings, drift and whole.

    Charges are no lines, a quantity that is none is 1, the delivery falls back on the buyer. Fields may come under several names and as
    other types; drift says which did, and whole is the answer as a variant, so that fields nobody asked for are kept.
    """
    rows = answer_fields(answers.select(key, body), body, ANSWER, "whole")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    given = lambda who: {c: F.col(f"{who}_{c}") for c in PARTY}
    s, t = given("soldto"), given("shipto")
    of = lambda v, name: F.coalesce(*(value(v, path, ANSWER_LINE[name][1]) for path in ANSWER_LINE[name][0]))
    read = F.transform(F.coalesce("line_items", F.array().cast("array<variant>")), lambda v: F.struct(F.upper(text(of(v, "article"))).alias("article"), of(v, "description").alias("description"), F.coalesce(of(v, "qty"), F.lit(0.0)).alias("quantity"), F.coalesce(of(v, "unit_price"), F.lit(0.0)).alias("unit_price")))
    kept = F.filter(read, lambda x: ~F.exists(F.array(*map(F.lit, CHARGES)), lambda w: F.startswith(x.article, w)))
    lines = F.transform(kept, lambda x: F.struct(x.article.alias("article"), F.coalesce(filled(x.description), x.article).alias("description"), F.when(x.quantity > 0, x.quantity).otherwise(1.0).alias("quantity"), x.unit_price.alias("unit_price")))
    soldto = F.struct(F.coalesce(F.nullif(N.vat_key(text(s["vat"])), F.lit("")), F.left(text(s["name"]), F.lit(12))).alias("code"), *(text(s[c]).alias(c) for c in ("name", "street", "city", "postal")))
    other = lambda c: F.coalesce(filled(t[c]), text(s[c]))
    shipto = F.struct(*(other(c).alias(c) for c in ("name", "street", "city", "postal")), F.coalesce(filled(t["country"]), F.lit("FR")).alias("country"))
    warn = lambda test, message: F.when(test, message)
    rows = rows.withColumn("_lines", lines)
    warnings = F.array_compact(F.array(warn(text(F.col("order_key")) == "", "order_key missing"), warn(N.loose_date(F.col("document_date")) == "", "document_date missing"), warn(text(s["name"]) == "", "soldto name missing"), warn(F.size("_lines") == 0, "no valid article lines extracted")))
    return rows.select(key, text(F.col("order_key")).alias("order_number"), N.loose_date(F.col("document_date")).alias("order_date"), N.loose_date(F.col("delivery_date")).alias("delivery_date"), soldto.alias("soldto"), shipto.alias("shipto"), F.col("_lines").alias("lines"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), warnings.alias("warnings"), "drift", "whole")