"""Queries over the driver's tables and the SQL that gives the same rows.

Scores leave as ``decimal(9,6)``; inside they are whole millionths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import domain
from tallyloom.config import MICRO, Combinations, Settings
from tallyloom.functions import amounts, checks, dates, merchants, references
from tallyloom.operators import scoring
from tallyloom.operators.assignment import greedy_assign, numbered, ranked
from tallyloom.operators.combining import combination_pool, combination_proposals, summing_sets
from tallyloom.operators.prefilter import semi_joined
from tallyloom.plans import contract, extraction, folders, glyphs, reconcile, reports, statement
from tallyloom.scratch import cut

SETTINGS = Settings()
_DONE: dict[tuple[str, str], reconcile.Reconciliation] = {}
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def _table(make: Callable[[SparkSession, object], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain's rows, made of the driver's tables; the lines are written once a
    session, and the others are read off them."""
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _TABLES:
        _TABLES[key] = make(spark, sf_dir if make is domain.lines else _table(domain.lines, spark, sf_dir))
    return _TABLES[key]


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(domain.transactions, spark, sf_dir)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(domain.documents, spark, sf_dir)


def _result(spark: SparkSession, sf_dir: str) -> reconcile.Reconciliation:
    """The reconciliation of the driver's tables, made once a session; its
    matches are a written table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DONE:
        _DONE[key] = reconcile.match_transactions(_transactions(spark, sf_dir), _documents(spark, sf_dir), SETTINGS)
    return _DONE[key]


def unit(score: str) -> Column:
    return (F.col(score) / F.lit(MICRO)).cast("decimal(9,6)").alias(score)


SCORES = ("score", *scoring.SIGNALS)


def outgoing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outgoing(_transactions(spark, sf_dir)).select("scope_id", "id", "posted_date", "amount", "currency")


def parse_amount_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    value = F.col("o_totalprice").cast("decimal(18,2)")
    english = F.format_number(value, 2)
    dots = F.translate(english, ",.", ".,")
    spaced = F.translate(english, ",.", " ,")
    bare = F.replace(english, F.lit(","), F.lit(""))
    styles = [english, dots, spaced, bare, F.translate(bare, ".", ",")]
    sign = [F.concat(F.lit("€"), F.col("t")), F.concat("t", F.lit(" EUR")), F.concat(F.lit("USD "), F.col("t")), F.concat(F.lit("£"), F.col("t")), F.col("t")]
    rows = orders.select("o_orderkey", F.element_at(F.array(*styles), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int")).alias("t"))
    rows = rows.select("o_orderkey", F.element_at(F.array(*sign), (F.pmod(F.expr("o_orderkey div 5"), F.lit(5)) + 1).cast("int")).alias("t"))
    return rows.select("o_orderkey", amounts.parse_amount(F.col("t")).alias("p")).select("o_orderkey", "p.amount", "p.currency", "p.error")


def parse_amount_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    whole = (1 + F.col("o_orderkey") % 900).cast("string")
    bad = [F.concat(F.lit("$"), whole), F.concat(F.lit("€"), whole, F.lit(" USD")), F.concat(whole, F.lit(",123")), F.concat(F.lit("-"), whole)]
    rows = orders.select("o_orderkey", F.element_at(F.array(*bad), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int")).alias("t"))
    return rows.select("o_orderkey", amounts.parse_amount(F.col("t")).alias("p")).select("o_orderkey", "p.amount", "p.error")


def parse_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    forms = [F.date_format("o_orderdate", f) for f in ("dd.MM.yyyy", "yyyy-MM-dd", "d/M/yyyy")]
    forms.append(F.concat(F.lit("31.04."), F.date_format("o_orderdate", "yyyy")))
    text = F.element_at(F.array(*forms), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    return orders.select("o_orderkey", dates.parse_date(text).alias("parsed"))


def normalize_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    tails = [" SIA", ", L.L.C.", " Ltd Inc", "'s & Co", "_x"]
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    return parts.select("p_partkey", merchants.normalize_merchant(F.concat("p_name", tail)).alias("name"))


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = parts.select(merchants.normalize_merchant(F.col("p_name")).alias("name"), "p_brand", "p_size")
    a = names.select(F.col("name").alias("a"), "p_brand", "p_size").distinct()
    b = names.select(F.col("name").alias("b"), "p_brand", "p_size").distinct()
    return a.join(b, ["p_brand", "p_size"]).where("a < b").select("a", "b").distinct()


def merchant_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _name_pairs(spark, sf_dir)
    return pairs.withColumn("similarity", merchants.similarity(F.col("a"), F.col("b"))).select("a", "b", unit("similarity"))


def merchant_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _name_pairs(spark, sf_dir)
    return pairs.withColumn("signal", merchants.merchant_signal(F.col("a"), F.col("b"), SETTINGS)).select("a", "b", unit("signal"))


def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", references.document_id(F.encode("p_name", "utf-8")).alias("document_id"))


def transaction_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transactions(spark, sf_dir).where("id is not null")
    page, row = F.lit(1), F.lit(None).cast("int")
    made = references.transaction_id(
        F.col("source_file"), F.col("posted_date"), F.col("direction"), F.col("amount"), F.col("currency"), F.col("description"), page, row
    )
    return rows.select("id", made.alias("transaction_id"))


def reference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = references.reference_tokens(F.col("description"), SETTINGS.reference_minimum_length)
    return _transactions(spark, sf_dir).select("id", F.array_join(tokens, " ").alias("tokens"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's transaction with the documents of its own lines."""
    t = _transactions(spark, sf_dir).withColumn("k", F.regexp_extract("id", r"(\d+)$", 1).cast("long"))
    d = _documents(spark, sf_dir).withColumn("k", F.regexp_extract("id", r"^doc-(\d+)-", 1).cast("long"))
    return t.alias("t").join(d.alias("d"), "k")


def reference_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = references.reference_signal(F.col("t.description"), F.col("d.invoice_number"), F.col("d.extracted_text"), SETTINGS.reference_minimum_length)
    return _paired(spark, sf_dir).select(F.col("d.id").alias("id"), found.alias("reference")).select("id", unit("reference"))


def date_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.datediff("t.posted_date", "d.issued_date"))
    found = scoring.date_signal(gap, SETTINGS)
    return _paired(spark, sf_dir).select(F.col("d.id").alias("id"), gap.alias("gap"), found.alias("date_score")).select("id", "gap", unit("date_score"))


def currency_safe_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    equal = amounts.currency_safe_equal(F.col("t.amount"), F.col("t.currency"), F.col("d.amount"), F.col("d.currency"), "0.01")
    return _paired(spark, sf_dir).select(F.col("d.id").alias("id"), equal.alias("equal"))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of receipts put together from line items."""
    day = F.date_format("issued_date", "dd.MM.yyyy")
    price = F.col("amount").cast("decimal(18,2)").cast("string")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Supplier: "), "merchant_raw"), F.concat(F.lit("Invoice no. "), "invoice_number"), F.concat(F.lit("Issued "), day),
        F.lit("Subtotal 1.00 EUR"), F.concat(F.lit("Total "), price, F.lit(" "), F.coalesce("currency", F.lit(""))),
    )
    return _documents(spark, sf_dir).select("id", "issued_date", lines.alias("text"))


FIELDS = ("issued_date", "amount", "currency", "merchant_raw", "invoice_number")


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_fields(_receipts(spark, sf_dir).select("id", "text")).select("id", *FIELDS)


def extract_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.date_format(F.date_add("issued_date", 1), "yyyy-MM-dd")
    doubled = F.concat("text", F.lit("\nPaid "), later, F.lit("\nSupplier: another\nAmount due 0.50 EUR"))
    return extraction.extract_fields(_receipts(spark, sf_dir).select("id", doubled.alias("text"))).select("id", *FIELDS)


def invoice_period_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    odd = F.substring("id", -1, 1) == "3"
    shown = F.when(odd, F.add_months("issued_date", 1)).otherwise(F.col("issued_date"))
    name = F.concat(F.lit("invoice_"), F.date_format(shown, "MM_yyyy"), F.lit(".pdf"))
    text = F.concat(F.lit("For "), F.date_format("issued_date", "MMMM yyyy"))
    return docs.select("id", dates.vote(F.col("issued_date"), text, name).alias("period"))


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract for each customer; key and fee vary the form."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("scope_id"))
    k = F.col("scope_id")
    fee, months = (100 + k % 50).cast("string"), (k % 14).cast("int")
    first = F.make_date((2020 + k % 3).cast("int"), (1 + k % 12).cast("int"), F.lit(1))
    last = F.add_months(first, months)
    point = lambda d: F.when(k % 2 == 0, F.date_format(d, "MMMM yyyy")).otherwise(F.date_format(d, "yyyy-MM"))
    monthly = F.concat(
        F.lit("Service agreement\nMonthly service fee: EUR "), fee, F.when(k % 7 != 3, "\nInvoices issued monthly").otherwise(""),
        F.when(k % 11 != 4, F.concat(F.lit("\nContract period: "), point(first), F.lit(" - "), point(last))).otherwise(""),
    )
    explicit = F.concat(F.lit("Agreement\n"), point(first), F.lit(" — EUR "), fee, F.lit("\n"), point(F.add_months(first, 2)), F.lit(" "), fee, F.lit(" EUR\n"))
    return c.select("scope_id", F.when(k % 5 == 2, explicit).otherwise(monthly).alias("text"), fee.alias("fee"), first.alias("first"))


def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.required_invoices(_contracts(spark, sf_dir)).select("scope_id", "determined", "reason", F.size("invoices").cast("long").alias("n"))


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = contract.required_invoices(_contracts(spark, sf_dir)).where("determined")
    return read.select("scope_id", F.posexplode("invoices").alias("ord", "i")).select("scope_id", "ord", "i.*")


def contract_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _required(spark, sf_dir).where("description is not null").select("scope_id", "ord", "period", "amount", "currency")


def contract_explicit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _required(spark, sf_dir).where("description is null").select("scope_id", "ord", "period", "amount", "currency")


def expected_vs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices stand in the folder for even months, two of them for month 6."""
    made = _contracts(spark, sf_dir).select("scope_id", "fee", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6), F.lit(6))).alias("m"), F.year("first").alias("y"))
    order = F.row_number().over(scoring_window()).cast("int")
    found = made.withColumn("ord", order).select(
        "scope_id", "ord", F.concat(F.lit("f"), "ord").alias("filename"), F.lit(None).cast("string").alias("invoice_number"),
        F.concat_ws("-", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"),
        F.col("fee").cast("decimal(28,8)").alias("amount"), F.lit("EUR").alias("currency"),
    )
    return contract.match_invoices(_required(spark, sf_dir), found).select("scope_id", "ord", "period", "found")


def scoring_window():
    from pyspark.sql import Window

    return Window.partitionBy("scope_id").orderBy("m")


def score_single_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = scoring.scored_pairs(_transactions(spark, sf_dir), _documents(spark, sf_dir), SETTINGS)
    return pairs.select("transaction_id", "document_id", "status", *map(unit, SCORES))


def combination_pool_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = combination_pool(_transactions(spark, sf_dir), _documents(spark, sf_dir), SETTINGS)
    return pool.select("transaction_id", "document_id", "place", unit("pool_merchant"))


def combination_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summing_sets(_transactions(spark, sf_dir), _documents(spark, sf_dir), SETTINGS)
    return found.select("transaction_id", F.array_join("places", "-").alias("places"))


def score_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = combination_proposals(_transactions(spark, sf_dir), _documents(spark, sf_dir), SETTINGS)
    return found.select("transaction_id", F.array_join("document_ids", ";").alias("document_ids"), "status", *map(unit, SCORES))


def proposal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = _transactions(spark, sf_dir), _documents(spark, sf_dir)
    return numbered(reconcile.proposals(t, d, SETTINGS)).select("scope_id", "transaction_id", F.array_join("document_ids", ";").alias("document_ids"), "place")


def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense instance: a customer's orders want the parts they hold and the
    next ones, of which there are eight kinds."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("scope_id"))
    want = F.explode(F.array("p", F.col("p") + 1, F.col("p") + 2))
    made = items.join(orders, "l_orderkey").select("scope_id", "l_orderkey", "s", want.alias("w"))
    offers = made.select(
        "scope_id", F.lit("CONFIRMED").alias("status"), (F.pmod(F.col("s") * 7 + F.col("w") * 13, F.lit(1000))).alias("score"),
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("transaction_id"),
        F.array(F.concat(F.lit("d"), (F.pmod("w", F.lit(8))).cast("string"))).alias("document_ids"),
    ).distinct()
    offers = cut(ranked(offers), "dense")
    taken = greedy_assign(offers, small=0)
    return semi_joined(offers, taken, ["scope_id", "rank"]).select("scope_id", "transaction_id", F.array_join("document_ids", ";").alias("document_id"))


def match_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform("documents", lambda c: c["document_id"]), ";").alias("document_ids")
    return _result(spark, sf_dir).matches.select("scope_id", "transaction_id", "status", *map(unit, SCORES), "group_amount_exact", ids)


def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).matches.select("transaction_id", "reason")


def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).references().select("document_id", F.array_join("transaction_ids", ";").alias("transaction_ids"))


def unmatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(spark, sf_dir).unmatched_documents().select("scope_id", "id", "amount", "currency")


def population_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _result(spark, sf_dir)
    gaps = reports.population_gaps(result).select("id", "gap").unionByName(reconcile.broken_rules(result).select("id", F.col("rule").alias("gap")))
    return gaps.agg(F.count("*").alias("problems"))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_summary(_result(spark, sf_dir))


def currency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.currency_totals(_result(spark, sf_dir))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(_result(spark, sf_dir)).select("scope_id", *[F.col(c).cast("decimal(9,4)").alias(c) for c in ("by_count", "by_amount")])


def summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_sheet(_result(spark, sf_dir)).select("scope_id", "place", "section", "metric", "value")


def summary_without_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.summary_sheet(_result(spark, sf_dir), supplied=False).where("section = 'General'")
    return rows.select("scope_id", "metric", "value")


def supplied_list_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of transactions with every 9th left out, the amounts of
    those with remainder 2 changed, and those with remainder 5 listed twice."""
    result = _result(spark, sf_dir)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 9
    kept = result.transactions.where(k != 0).withColumn("amount", F.when(k == 2, F.col("amount") + 1).otherwise(F.col("amount")).cast(domain.MONEY))
    given = kept.unionByName(kept.where(k == 5))
    return reports.supplied_gaps(result, given)


def document_counts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_gaps(_result(spark, sf_dir)).agg(F.count("*").alias("scopes"))


def _sheet(rows: DataFrame) -> DataFrame:
    names = ("scope_id", "transaction_id", "direction", "posted_date", "amount", "currency", "merchant_raw", "status", "document_ids", "filenames", "combination")
    return rows.select(*names)


def report_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(reports.transactions_sheet(_result(spark, sf_dir)))


def report_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(reports.missing_sheet(_result(spark, sf_dir)))


def report_probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(reports.probable_sheet(_result(spark, sf_dir)))


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.documents_sheet(_result(spark, sf_dir)).select("scope_id", "document_id", "filename", "issued_date", "amount", "usage", "transaction_ids")


def report_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates_sheet(_result(spark, sf_dir)).select("scope_id", "document_id", "usage")


def report_reused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that was not made here: every outgoing transaction of a scope and
    currency cites the scope's first document of that currency, and those of odd
    orders their own first one too, so documents are cited several times."""
    result = _result(spark, sf_dir)
    docs = result.documents.where("currency is not null")
    first = docs.groupBy("scope_id", "currency").agg(F.min("id").alias("first"))
    k = F.regexp_extract("id", r"(\d+)$", 1)
    own = F.concat(F.lit("doc-"), k, F.lit("-1"))
    paid = scoring.outgoing(result.transactions).join(first, ["scope_id", "currency"])
    cited = F.when(k.cast("long") % 2 == 1, F.array_distinct(F.array("first", own))).otherwise(F.array("first"))
    none = lambda kind: F.lit(None).cast(kind)
    evidence = lambda d: F.struct(
        d.alias("document_id"), none("boolean").alias("amount_exact"), none("long").alias("merchant_similarity"), none("int").alias("date_delta_days"), none("date").alias("issued_date")
    )
    matches = paid.select(
        "scope_id", F.col("id").alias("transaction_id"), F.lit("PROBABLE").alias("status"), F.lit(700_000).cast("long").alias("score"), F.transform(cited, evidence).alias("documents")
    )
    foreign = reconcile.Reconciliation(result.transactions, result.documents, cut(matches, "foreign-matches"))
    return reports.duplicates_sheet(foreign).select("scope_id", "document_id", "filename", "usage", "transaction_ids")


def match_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written as JSON and read again, with the text of their score."""
    matches = _result(spark, sf_dir).matches.withColumns({c: unit(c) for c in SCORES})
    written = matches.select("transaction_id", reports.match_json(matches).alias("json"))
    back = written.select(reports.match_of_json(F.col("json")).alias("m")).select("m.*")
    ids = F.array_join(F.transform("documents", lambda c: c["document_id"]), ";")
    kept = back.select("transaction_id", "status", *SCORES, "group_amount_exact", ids.alias("document_ids"))
    return kept.join(written.select("transaction_id", F.get_json_object("json", "$.score").alias("score_text")), "transaction_id")


def combination_sets_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = Settings(combinations=Combinations(max_documents=5))
    found = summing_sets(_transactions(spark, sf_dir), _documents(spark, sf_dir), five)
    return found.select("transaction_id", F.array_join("places", "-").alias("places"))


def html_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.html_rows(_result(spark, sf_dir)).select("transaction_id", "date", "text", "amount_text", "status", "files")


def _glyphs(spark: SparkSession, sf_dir: str, broken: bool = False) -> tuple[DataFrame, DataFrame]:
    """Statements laid out from the transactions: one file for each scope, 20
    rows a page, with a summary before and after; glyph ids are characters'.
    ``broken`` ones have a word outside the columns, a repeated sum, or a row
    before the balances, each a quarter of the scopes."""
    from pyspark.sql import Window

    t = _transactions(spark, sf_dir).where("direction <> 'unknown'")
    by = Window.partitionBy("scope_id").orderBy("id")
    n = F.row_number().over(by) - 1
    money = F.format_string("%s%s", F.when(F.col("direction") == "outgoing", "-").otherwise("+"), F.col("amount").cast("decimal(18,2)").cast("string"))
    y = 100 + 30 * (n % 20)
    rows = t.select("scope_id", (1 + F.floor(n / 20)).cast("int").alias("page"), y.cast("double").alias("y"), "id", "posted_date", "merchant_raw", "currency", money.alias("money"))
    day = F.date_format("posted_date", "dd.MM.yyyy")
    cells = F.array(
        F.struct(F.lit(62.0).alias("x"), F.lit(0.0).alias("dy"), F.col("id").alias("t")), F.struct(F.lit(161.0).alias("x"), F.lit(0.3).alias("dy"), day.alias("t")),
        F.struct(F.lit(218.0).alias("x"), F.lit(0.6).alias("dy"), F.col("merchant_raw").alias("t")),
        F.struct(F.lit(401.0).alias("x"), F.lit(0.0).alias("dy"), F.col("money").alias("t")),
        F.struct(F.lit(218.0).alias("x"), F.lit(10.0).alias("dy"), F.lit("Card payment").alias("t")),
        F.struct(F.lit(60.0).alias("x"), F.lit(790.0).alias("dy"), F.lit("footer").alias("t")),
    )
    placed = rows.select("scope_id", "page", "y", F.inline(cells)).select("scope_id", "page", (F.col("y") + F.col("dy")).alias("y0"), "x", "t")
    amount = F.col("amount").cast("decimal(18,2)")
    paid, got = (F.sum(F.when(F.col("direction") == d, amount).otherwise(0)) for d in ("outgoing", "incoming"))
    sums = t.groupBy("scope_id").agg(
        paid.alias("paid"), got.alias("got"), F.count_if(F.col("direction") == "outgoing").alias("np"), F.count_if(F.col("direction") == "incoming").alias("ng"),
        F.max("currency").alias("cur"), (1 + F.floor((F.count("*") - 1) / 20)).cast("int").alias("last"),
    )
    text = lambda c: F.concat("cur", F.when(F.col(c) < 0, "-").otherwise("+"), F.abs(c).cast("decimal(18,2)").cast("string"))
    sums = sums.withColumn("open", F.lit(10).cast("decimal(18,2)")).withColumn("close", F.col("open") + F.col("got") - F.col("paid")).withColumn("minus", -F.col("paid"))
    layout = statement.Layout()
    totals = F.array(
        F.struct(F.lit(1).alias("page"), F.lit(80.0).alias("y0"), F.lit(layout.opening).alias("l"), text("open").alias("t")),
        F.struct(F.col("last").alias("page"), F.lit(740.0).alias("y0"), F.format_string(layout.debited + " (%d)", "np").alias("l"), text("minus").alias("t")),
        F.struct(F.col("last").alias("page"), F.lit(750.0).alias("y0"), F.format_string(layout.credited + " (%d)", "ng").alias("l"), text("got").alias("t")),
        F.struct(F.col("last").alias("page"), F.lit(760.0).alias("y0"), F.lit(layout.closing).alias("l"), text("close").alias("t")),
    )
    labels = sums.select("scope_id", F.inline(totals))
    placed = placed.unionByName(labels.select("scope_id", "page", "y0", F.lit(218.0).alias("x"), F.col("l").alias("t")))
    placed = placed.unionByName(labels.select("scope_id", "page", "y0", F.lit(401.0).alias("x"), "t"))
    if broken:
        cell = lambda page, y, x, text: F.struct(page.cast("int").alias("page"), F.lit(y).alias("y0"), F.lit(x).alias("x"), text.alias("t"))
        one, last, kind = F.lit(1), F.col("last"), F.pmod(F.col("scope_id"), F.lit(4))
        faults = (
            F.when(kind == 1, F.array(cell(one, 90.0, 590.0, F.lit("odd"))))
            .when(kind == 2, F.array(cell(last, 770.0, 218.0, F.format_string(layout.debited + " (%d)", "np")), cell(last, 770.0, 401.0, text("minus"))))
            .when(kind == 3, F.array(cell(one, 60.0, 161.0, F.lit("01.02.2020")), cell(one, 60.0, 218.0, F.lit("early")), cell(one, 60.0, 401.0, F.lit("-1.00"))))
        )
        placed = placed.unionByName(sums.select("scope_id", F.inline(faults)))
    # A blank is a gap of two points; letters are four points wide.
    letters = placed.select("scope_id", "page", "y0", "x", F.posexplode(F.split("t", "")).alias("i", "c")).where("c not in ('', ' ')")
    placed = letters.select(
        "scope_id", F.lit("statement.pdf").alias("file"), "page", F.lit("f").alias("font"), F.ascii(F.col("c")).cast("int").alias("glyph_id"),
        (F.col("x") + 4.0 * F.col("i")).alias("x0"), (F.col("x") + 4.0 * F.col("i") + 4.0).alias("x1"), "y0",
    )
    placed = cut(placed, "glyphs")
    return placed, cut(placed.select("font", "glyph_id").distinct().withColumn("ch", _char(F.col("glyph_id"))), "glyph-names")


def _char(code: Column) -> Column:
    """The character of a code point of at most 16 bits."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _shape(k: Column, x: Column, y: Column, tail: Column) -> Column:
    """The pixels of drawn shape ``k``: a block on the baseline at (x, y), with a
    tail of 0, 2 or 3 pixels below it, and a light pixel that is no ink."""
    pixel = lambda a, b, level=0: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"), F.lit(level).alias("level"))
    across, up = F.sequence(F.lit(0), 2 + k % 7), F.sequence(F.lit(1), (5 + F.floor(k / 7)).cast("int"))
    block = F.flatten(F.transform(across, lambda a: F.transform(up, lambda b: pixel(x + a, y - b))))
    tails = F.when(tail == 1, F.array(pixel(x + 1, y + 2), pixel(x + 1, y + 3))).when(tail == 2, F.array(pixel(x + 1, y + 2), pixel(x + 2, y + 2), pixel(x + 2, y + 3)))
    return F.concat(block, F.coalesce(tails, F.array().cast("array<struct<x:int,y:int,level:int>>")), F.array(pixel(F.lit(2), F.lit(2), 200)))


def glyph_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is an embedded glyph, its size a shape, bold or not; a third has
    a tail, a third another tail than its character, and some are unknown.  Size 9
    is drawn like two letters, size 10 like two other characters."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bold, k, p = F.col("p_partkey") % 2 == 0, F.col("p_size").cast("int"), F.col("p_partkey")
    x, y = F.when(bold, 9).otherwise(8), F.lit(glyphs.BASELINE)
    odd = F.when(p % 11 == 0, F.array(F.struct((x + 5 + k % 7).cast("int").alias("x"), (y - 5).cast("int").alias("y"), F.lit(0).alias("level"))))
    shape = F.concat(_shape(k, x, y, (p % 3).cast("int")), F.coalesce(odd, F.array().cast("array<struct<x:int,y:int,level:int>>")))
    pixels = part.select("p_partkey", bold.alias("bold"), F.inline(shape))
    known = part.select(k.alias("k"), F.explode(F.array(F.lit(False), F.lit(True))).alias("bold")).distinct()
    plain = F.when(F.col("k") == 9, F.array(F.lit("I"), F.lit("l"))).when(F.col("k") == 10, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(_char(F.col("k") + 0x4E00)))
    forms = F.concat(F.transform(plain, lambda c: F.struct(c.alias("ch"), F.lit(0).alias("tail"))), F.array(F.struct(_char(F.col("k") + 0x5E00).alias("ch"), F.lit(1).alias("tail"))))
    known = known.select("k", "bold", F.inline(forms))
    drawn = known.select("bold", "ch", F.inline(_shape(F.col("k"), F.when(F.col("bold"), 9).otherwise(8), F.lit(glyphs.BASELINE), F.col("tail"))))
    found = glyphs.identify(glyphs.ink(pixels, ["p_partkey", "bold"]), glyphs.ink(drawn, ["bold", "ch"]))
    return found.select("p_partkey", "bold", "x0", "y0", "x1", "y1", "n", "below", "ch", "twin", "problem")


def font_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's statement embeds its nation's two faces, the standard font
    and an empty one; equal faces are one, and are counted over all files."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("face "), F.col("c_nationkey").cast("string"))
    fonts = F.array(
        *[F.struct(F.lit(name).alias("font"), F.encode(content, "utf-8").alias("content")) for name, content in (
            ("ABCDEF+ArialMT", text), ("GHIJKL+Arial-BoldMT", text), (glyphs.STANDARD_FONT, text), ("Empty", F.lit("")),
        )]
    )
    faces = glyphs.font_faces(c.select(F.col("c_custkey").alias("scope_id"), F.inline(fonts)), ["scope_id"])
    counted = faces.groupBy("face").agg(F.count("*").alias("files"))
    return faces.join(counted, "face").select("scope_id", "font", "bold", "face", "files")


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, as a line's parts would else be made once for the kind and once for themselves.
    lines = cut(statement.line_kinds(statement.columns_of_words(statement.worded_lines(*_glyphs(spark, sf_dir)))), "statement-lines")
    return lines.where("kind = 'start'").select("scope_id", "reference", "date_text", "details", "amount_text")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = statement.read_statements(*_glyphs(spark, sf_dir))
    return rows.select("scope_id", "source_page", "source_row", "posted_date", "direction", "amount", "currency", "description", "merchant_raw")


def statement_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, check = statement.read_statements(*_glyphs(spark, sf_dir))
    return check.select("scope_id", *[F.col(c).cast("decimal(28,8)").alias(c) for c in ("opening", "closing", "paid", "received")], "problem")


def statement_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, names = _glyphs(spark, sf_dir)
    rows, check = statement.read_statements(placed, names)
    found = statement.statement_profile(rows, check, placed.select(*statement.FILE, "page"))
    balances = [F.col(c).cast("decimal(28,8)").alias(c) for c in ("opening", "closing")]
    return found.select("scope_id", "pages", "transaction_pages", "n", "n_outgoing", "n_incoming", *balances, "currency", "samples")


def statement_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, check = statement.read_statements(*_glyphs(spark, sf_dir, broken=True))
    return check.select("scope_id", "problem")


def statement_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's folder holds invoices and none, one or two statements."""
    k = F.col("s_suppkey")
    names = F.array(
        F.lit("invoice.pdf"), F.when(k % 4 > 0, "2024/Statement_01.PDF"), F.when(k % 4 == 2, "a/parskats.pdf"), F.when(k % 4 == 3, "statement.png")
    )
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("scope_id"), F.explode(F.array_compact(names)).alias("rel_path"))
    files = files.withColumn("filename", F.element_at(F.split("rel_path", "/"), -1)).withColumn("document_type", F.lower(F.element_at(F.split("rel_path", r"\."), -1)))
    picks = folders.pick_statements(files)
    rest = folders.supporting(files, picks).groupBy("scope_id").agg(F.count("*").alias("others"))
    return picks.join(rest, "scope_id", "left")


def document_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _receipts(spark, sf_dir).select(
        F.lit("s").alias("scope_id"), F.concat("id", F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("document_type"),
        F.encode(F.concat(F.lit("%PDF "), "id"), "utf-8").alias("content"), "text",
    )
    return folders.build_documents(files).select("id", "filename", "issued_date", "amount", "currency", "invoice_number", "extraction_method", "file_hash")


def input_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(28,8)")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.when(k % 11 == 3, "  ").otherwise(k.cast("string")).alias("id"), F.when(k % 17 != 4, F.col("o_orderdate")).alias("posted_date"),
        F.when(k % 19 == 6, "sideways").otherwise("incoming").alias("direction"), F.when(k % 7 == 2, -price).when(k % 7 == 4, 0).otherwise(price).alias("amount"),
        F.when(k % 5 == 1, "EU").when(k % 5 == 2, "e1r").when(k % 5 == 3, " usd ").otherwise("EUR").alias("currency"),
        F.when(k % 13 == 5, "\n").otherwise("x").alias("description"), F.when(k % 3 == 0, (k % 4).cast("int")).alias("source_row"),
    )
    return checks.checked_transactions(rows).select("o_orderkey", "id", "currency", F.array_join("problems", "; ").alias("problems"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return statement.page_ranges(items, ["l_orderkey"], "l_linenumber")


QUERIES = (
    outgoing_filter, parse_amount_formats, parse_amount_rejects, parse_date_formats, normalize_merchant, merchant_similarity, merchant_signal,
    document_id, transaction_id, reference_tokens, reference_signal, date_bands, currency_safe_equal, extract_fields, extract_ambiguous,
    invoice_period_vote, contract_status, contract_months, contract_explicit_lines, expected_vs_found, score_single_pairs, combination_pool_topk,
    combination_subsets, score_combinations, proposal_rank, greedy_assignment, match_transactions, match_reasons, document_references,
    unmatched_documents, population_check, status_summary, currency_totals, coverage, report_transactions, report_missing, report_probable,
    report_documents, report_duplicates, report_reused_documents, match_json_round_trip, combination_sets_of_five, glyph_characters,
    font_dimension, html_status, statement_lines, statement_rows, statement_balance_check, statement_problems,
    statement_pick, document_build, input_problems, page_ranges, statement_profile, summary_sheet, summary_without_list,
    supplied_list_check, document_counts_check,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from tallyloom import oracles

    return oracles.oracle_sql()
