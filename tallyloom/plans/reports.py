"""Audit tables of a reconciliation, as DataFrames, and their renderings."""

from __future__ import annotations

import html
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyloom.config import MICRO
from tallyloom.functions.amounts import two_places
from tallyloom.operators.prefilter import inner_joined, left_joined
from tallyloom.operators.scoring import SIGNALS, outgoing
from tallyloom.plans.reconcile import Reconciliation

STATUSES = ("CONFIRMED", "PROBABLE", "MISSING")
# What the summary says of each status.
LEGEND = {
    "CONFIRMED": "Strong supporting evidence: exact amount and currency, plus a strong merchant or an exact reference.",
    "PROBABLE": "Plausible match requiring review. Credible evidence is present, and the confirmed rule is not met.",
    "MISSING": "No sufficiently credible supporting document found.",
}


def population_gaps(result: Reconciliation) -> DataFrame:
    """Ids of outgoing transactions without a match row, and of match rows
    without such a transaction; none in a sound result."""
    paid = outgoing(result.transactions).select("scope_id", "id")
    matched = result.matches.select("scope_id", F.col("transaction_id").alias("id"))
    lost = paid.join(matched, ["scope_id", "id"], "left_anti").select("*", F.lit("not matched").alias("gap"))
    extra = matched.join(paid, ["scope_id", "id"], "left_anti").select("*", F.lit("not supplied").alias("gap"))
    return lost.unionByName(extra)


def supplied_gaps(result: Reconciliation, supplied: DataFrame) -> DataFrame:
    """What keeps a list of transactions from being the one that was matched:
    ids listed twice, outgoing ids on one side only, and rows that differ in a
    column that both sides have.  None for the list itself."""
    twice = supplied.groupBy("scope_id", "id").agg(F.count("*").alias("c")).where("c > 1").select("scope_id", "id", F.lit("listed twice").alias("gap"))
    ours, given = outgoing(result.transactions), outgoing(supplied)
    keys = ["scope_id", "id"]
    lost = given.join(ours, keys, "left_anti").select(*keys, F.lit("missing from result").alias("gap"))
    extra = ours.join(given, keys, "left_anti").select(*keys, F.lit("extra in result").alias("gap"))
    both = sorted(set(ours.columns) & set(given.columns) - set(keys))
    one = ours.select(*keys, F.struct(*both).alias("ours"))
    two = given.select(*keys, F.struct(*both).alias("given"))
    other = one.join(two, keys).where(~F.col("ours").eqNullSafe(F.col("given"))).select(*keys, F.lit("differs from result").alias("gap"))
    return twice.unionByName(lost).unionByName(extra).unionByName(other.distinct())


def count_gaps(result: Reconciliation) -> DataFrame:
    """Scopes whose documents, counted as used and as unmatched, are not all."""
    used = result.references().groupBy("scope_id").agg(F.count_if(F.size("transaction_ids") > 0).alias("matched"), F.count("*").alias("documents"))
    rest = result.unmatched_documents().groupBy("scope_id").agg(F.count("*").alias("unmatched"))
    both = used.join(rest, "scope_id", "full").na.fill(0, ["matched", "documents", "unmatched"])
    return both.where("matched + unmatched <> documents")


def sheet(result: Reconciliation) -> DataFrame:
    """Every transaction with its match, if it has one, and the names of its
    documents: the table behind the sheets."""
    docs = result.documents.select("scope_id", F.col("id").alias("document_id"), "filename")
    links = inner_joined(docs, result.links(), ["scope_id", "document_id"])
    names = links.groupBy("scope_id", "transaction_id").agg(F.array_sort(F.collect_list(F.struct("pos", "document_id", "filename"))).alias("d"))
    named = names.select(
        "scope_id", "transaction_id", F.array_join(F.transform("d", lambda x: x["document_id"]), "; ").alias("document_ids"),
        F.array_join(F.transform("d", lambda x: x["filename"]), "; ").alias("filenames"),
    )
    rows = result.transactions.withColumnRenamed("id", "transaction_id").join(result.matches.drop("documents"), ["scope_id", "transaction_id"], "left")
    combined = F.when(F.col("status") != "MISSING", F.when(F.col("group_amount_exact"), "Yes").otherwise("No"))
    return rows.join(named, ["scope_id", "transaction_id"], "left").withColumn("combination", combined)


def transactions_sheet(result: Reconciliation) -> DataFrame:
    """All transactions: outgoing, incoming, unknown; by date and id."""
    place = F.when(F.col("direction") == "outgoing", 0).when(F.col("direction") == "incoming", 1).otherwise(2)
    return sheet(result).orderBy("scope_id", place, "posted_date", "transaction_id")


def missing_sheet(result: Reconciliation) -> DataFrame:
    return sheet(result).where("status = 'MISSING'").orderBy("scope_id", "posted_date", "amount", "transaction_id")


def probable_sheet(result: Reconciliation) -> DataFrame:
    return sheet(result).where("status = 'PROBABLE'").orderBy("scope_id", F.coalesce("score", F.lit(2_000_000)), "posted_date", "transaction_id")


def documents_sheet(result: Reconciliation) -> DataFrame:
    """The inventory of documents with their use, dated ones first."""
    n = F.size("transaction_ids")
    use = F.when(n == 0, "UNUSED").when(n == 1, "USED ONCE").otherwise("USED MULTIPLE TIMES")
    rows = result.references().withColumn("usage", use).withColumn("transaction_ids", F.array_join("transaction_ids", "; "))
    return rows.orderBy("scope_id", F.col("issued_date").asc_nulls_last(), "filename", "document_id")


def duplicates_sheet(result: Reconciliation) -> DataFrame:
    """Documents that more than one transaction cites; only foreign results have any."""
    return documents_sheet(result).where("usage = 'USED MULTIPLE TIMES'")


def status_summary(result: Reconciliation) -> DataFrame:
    """Counts of each scope: transactions by direction and status, documents by use."""
    moves = result.transactions.groupBy("scope_id").agg(
        F.count_if(F.col("direction") == "outgoing").alias("outgoing"), F.count_if(F.col("direction") == "incoming").alias("incoming"),
        F.min("posted_date").alias("first_date"), F.max("posted_date").alias("last_date"),
    )
    states = result.matches.groupBy("scope_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    used = result.links().select("scope_id", F.col("document_id").alias("id"), F.lit(1).alias("u")).distinct()
    docs = left_joined(result.documents.select("scope_id", "id"), used, ["scope_id", "id"]).groupBy("scope_id")
    docs = docs.agg(F.count("*").alias("documents"), F.count("u").alias("used_documents"))
    counts = moves.join(states, "scope_id", "full").join(docs, "scope_id", "full")
    numbers = ["outgoing", "incoming", *map(str.lower, STATUSES), "documents", "used_documents"]
    rows = counts.select("scope_id", "first_date", "last_date", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers])
    return rows.withColumn("unmatched_documents", F.col("documents") - F.col("used_documents"))


def currency_totals(result: Reconciliation) -> DataFrame:
    """Sums of each scope and currency, in all and by status."""
    rows = result.matches.select("scope_id", "transaction_id", "status")
    paid = outgoing(result.transactions).withColumnRenamed("id", "transaction_id").join(rows, ["scope_id", "transaction_id"])
    part = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("amount"))), F.lit(0)).cast("decimal(38,8)").alias(s.lower())
    sums = paid.groupBy("scope_id", "currency").agg(F.sum("amount").alias("total"), *map(part, STATUSES))
    return sums.orderBy("scope_id", "currency")


def coverage(result: Reconciliation) -> DataFrame:
    """Confirmed over outgoing, by count and by amount; null without outgoing."""
    totals = currency_totals(result).groupBy("scope_id").agg(F.sum("total").alias("t"), F.sum("confirmed").alias("c"), F.count("*").alias("n"))
    counts = status_summary(result).select("scope_id", "confirmed", "outgoing").join(totals, "scope_id", "left")
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    by_amount = F.when(F.col("n") == 1, ratio("c", "t"))  # amounts of several currencies do not add up
    return counts.select("scope_id", ratio("confirmed", "outgoing").alias("by_count"), by_amount.alias("by_amount"))


def summary_sheet(result: Reconciliation, supplied: bool = True) -> DataFrame:
    """The summary as rows scope_id, place, section, metric and value, all text.

    Without a ``supplied`` list of all transactions the population is the
    outgoing ones, and the number of incoming ones is unknown.  A row of
    unclassified transactions stands only where there are some; amounts have a
    row for each currency of the scope."""
    people = result.transactions if supplied else outgoing(result.transactions)
    general = people.groupBy("scope_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("direction") == "unknown").alias("unknown"),
        F.min("posted_date").alias("a"), F.max("posted_date").alias("b"), F.array_join(F.array_sort(F.collect_set("source_file")), "; ").alias("files"),
    )
    sums = currency_totals(result).groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("currency", "total", *map(str.lower, STATUSES)))).alias("sums"))
    counts = status_summary(result).drop("first_date", "last_date")
    rows = counts.join(general, "scope_id", "left").join(sums, "scope_id", "left")

    def row(section, metric, value):
        metric = F.lit(metric) if isinstance(metric, str) else metric
        return F.struct(F.lit(section).alias("section"), metric.alias("metric"), value.cast("string").alias("value"))

    def ratio(a, b):
        return F.round(F.try_divide(a.cast("double"), b.cast("double")), 4).cast("decimal(9,4)")

    named = lambda text, s: F.concat(F.lit(f"{text} ("), s["currency"], F.lit(")"))
    of = {"Outgoing": "total"} | {s.capitalize(): s.lower() for s in STATUSES}
    amounts = F.flatten(F.transform(F.coalesce("sums", F.array()), lambda s: F.array(
        *[row("Reconciliation", named(f"{label} amount", s), two_places(s[name])) for label, name in of.items()]
    )))
    shares = F.transform(F.coalesce("sums", F.array()), lambda s: row("Coverage", named("Coverage by amount", s), ratio(s["confirmed"], s["total"])))
    period = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws(" to ", F.col("a").cast("string"), F.col("b").cast("string")))
    first = F.array(
        row("General", "Reporting period", F.when(F.col("a").isNotNull(), period)), row("General", "Bank statements", F.col("files")),
        row("General", "Total transactions", F.coalesce("total", F.lit(0))), row("General", "Outgoing transactions", F.col("outgoing")),
        row("General", "Incoming transactions", F.col("incoming") if supplied else F.lit(None)),
        F.when(F.col("unknown") > 0, row("General", "Unclassified transactions", F.col("unknown"))),
        *[row("Reconciliation", f"{s.capitalize()} transactions", F.col(s.lower())) for s in STATUSES],
        row("Reconciliation", "Supporting documents", F.col("documents")), row("Reconciliation", "Matched documents", F.col("used_documents")),
        row("Reconciliation", "Unmatched documents", F.col("unmatched_documents")),
    )
    by_count = F.array(row("Coverage", "Coverage by count", ratio(F.col("confirmed"), F.col("outgoing"))))
    legend = F.array(*[row("Status", s, F.lit(LEGEND[s])) for s in STATUSES])
    listed = F.array_compact(F.concat(first, amounts, by_count, shares, legend))
    return rows.select("scope_id", F.posexplode(listed).alias("place", "m")).select("scope_id", "place", "m.*")


#: A match as JSON: whole numbers and flags as they are, decimals as text.
MATCH_JSON = """
transaction_id string, status string, score string, amount_score string, currency_score string, merchant_score string, date_score string,
reference_score string, group_amount_exact boolean,
documents array<struct<document_id:string,amount_exact:boolean,merchant_similarity:string,date_delta_days:int>>, reason string
"""
_DECIMALS = ("score", *SIGNALS)
_FIELDS = ("transaction_id", "status", *_DECIMALS, "group_amount_exact", "documents", "reason")


def match_json(matches: DataFrame, unit: str = "decimal(9,6)") -> Column:
    """A match with scores of type ``unit`` as JSON text; nulls are written, so
    that a signal that is missing stays apart from one that is 0.  Similarities of
    documents are whole millionths in ``matches`` and units in the text."""
    million = F.lit(MICRO)
    documents = F.transform("documents", lambda d: F.struct(
        d["document_id"].alias("document_id"), d["amount_exact"].alias("amount_exact"),
        (d["merchant_similarity"] / million).cast(unit).cast("string").alias("merchant_similarity"), d["date_delta_days"].cast("int").alias("date_delta_days"),
    ))
    scores = [F.col(c).cast("string").alias(c) for c in _DECIMALS]
    whole = F.struct("transaction_id", "status", *scores, "group_amount_exact", documents.alias("documents"), "reason")
    return F.to_json(whole, {"ignoreNullFields": "false"})


def match_of_json(text: Column, unit: str = "decimal(9,6)") -> Column:
    """What ``match_json`` wrote, with its types again; null for text that is no
    JSON object.  A field that a match does not have is an error."""
    read = F.from_json(text, MATCH_JSON)
    unknown = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, _FIELDS)))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown fields of a match: "), F.array_join(unknown, ", "))).cast("string"))
    scores = [read[c].cast(unit).alias(c) for c in _DECIMALS]
    documents = F.transform(read["documents"], lambda d: F.struct(
        d["document_id"].alias("document_id"), d["amount_exact"].alias("amount_exact"),
        (d["merchant_similarity"].cast(unit) * MICRO).cast("long").alias("merchant_similarity"), d["date_delta_days"].alias("date_delta_days"),
    ))
    first = F.coalesce(checked, read["transaction_id"])
    whole = F.struct(first.alias("transaction_id"), read["status"].alias("status"), *scores, read["group_amount_exact"].alias("group_amount_exact"), documents.alias("documents"), read["reason"].alias("reason"))
    return F.when(F.json_object_keys(text).isNotNull(), whole)


def html_rows(result: Reconciliation) -> DataFrame:
    """What the page shows of each transaction, in input order if the
    transactions carry ``ord``."""
    shown = F.when((F.col("direction") != "outgoing") | F.col("status").isNull() | (F.col("status") == "PROBABLE"), "UNKNOWN")
    shown = shown.when(F.col("status") == "CONFIRMED", "IDENTIFIED").otherwise("NOT IDENTIFIED")
    first = F.element_at(F.split("description", r"\r\n|\r|\n"), 1)
    text = F.when(F.col("merchant_raw").isNotNull() & (F.col("merchant_raw") != ""), F.col("merchant_raw")).otherwise(first)
    rows = sheet(result).withColumn("shown", shown)
    keep = ["scope_id", "transaction_id", *(["ord"] if "ord" in rows.columns else [])]
    files = F.when(F.col("shown") == "IDENTIFIED", F.col("filenames"))
    return rows.select(
        *keep, F.date_format("posted_date", "yyyy-MM-dd").alias("date"), text.alias("text"), two_places(F.col("amount")).alias("amount_text"),
        "currency", F.col("shown").alias("status"), files.alias("files"),
    )


# The page's headings.
PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Bank statement</title>
<style>
body {{ font-family: sans-serif; margin: 2em }}
table {{ border-collapse: collapse; width: 100% }}
th, td {{ text-align: left; padding: .4em .8em; border-bottom: 1px solid #ccc }}
.amount {{ text-align: right }} .identified {{ color: green }} .not-identified {{ color: darkred }} .unknown {{ color: chocolate }}
</style></head><body><table>
<thead><tr><th>Date</th><th>Description</th><th>Amount</th><th>Currency</th><th>Status</th><th>Document</th></tr></thead>
<tbody>
{rows}
</tbody></table></body></html>
"""


def html_row(r: Row) -> str:
    """A row of ``html_rows`` as a row of the page."""
    css = r["status"].lower().replace(" ", "-")
    links = "<br>".join(f'<a href="{html.escape(quote(f))}">{html.escape(f)}</a>' for f in (r["files"] or "").split("; ") if f) or "—"
    cells = [f"<td>{html.escape(r[c] or '')}</td>" for c in ("date", "text")]
    cells += [f'<td class="amount">{html.escape(r["amount_text"])}</td>', f"<td>{html.escape(r['currency'])}</td>"]
    return f'<tr>{"".join(cells)}<td class="{css}">{html.escape(r["status"])}</td><td>{links}</td></tr>'


def render_html(rows: DataFrame) -> Iterator[str]:
    """Table rows of one scope as HTML, a partition at a time on the driver."""
    return map(html_row, rows.toLocalIterator())


def write_html(rows: DataFrame, path: str | Path) -> None:
    """Write the page next to its place and move it there, so that a failure
    leaves an older page as it was."""
    path = Path(path)
    part = path.with_name(path.name + ".part")
    part.write_text(PAGE.format(rows="\n".join(render_html(rows))), encoding="utf-8")
    part.replace(path)


def write_workbook(result: Reconciliation, folder: str) -> None:
    """Write every sheet as a Parquet table below ``folder``.

    All sheets are written beside it first and moved there when they are whole,
    so that a failure leaves an older workbook as it was."""
    if bad := count_gaps(result).limit(1).collect():
        raise ValueError(f"{bad[0]['scope_id']}: used and unmatched documents are not all documents")
    sheets = {
        "summary": summary_sheet(result).orderBy("scope_id", "place"), "counts": status_summary(result), "currency_totals": currency_totals(result), "transactions": transactions_sheet(result),
        "missing": missing_sheet(result), "probable": probable_sheet(result), "unmatched_documents": result.unmatched_documents(),
        "documents": documents_sheet(result), "duplicates": duplicates_sheet(result),
    }
    part = f"{folder.rstrip('/')}.part-{uuid.uuid4().hex}"
    for name, rows in sheets.items():
        rows.write.parquet(f"{part}/{name}")
    spark = result.matches.sparkSession
    at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, part, f"{part}-old")]
    files = at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at[0]):
        files.rename(at[0], at[2])
    files.rename(at[1], at[0])
    files.delete(at[2], True)
