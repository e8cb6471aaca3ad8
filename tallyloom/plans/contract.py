"""Invoices that a contract requires, and those that a folder lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.amounts import parse_amount, plain
from tallyloom.functions.columns import let, only, stripped
from tallyloom.functions.dates import MONTH_NAMES, period_point
from tallyloom.functions.references import compact
from tallyloom.operators.assignment import greedy_assign
from tallyloom.plans.extraction import found_invoices
from tallyloom.scratch import cut

# Patterns of a contract's statements, limits and report texts.
POINT = rf"(?:(?:{MONTH_NAMES})\s+20\d{{2}}|20\d{{2}}-(?:0[1-9]|1[0-2])|\d{{1,2}}\.\d{{1,2}}\.20\d{{2}})"
RANGE = rf"(?Udi)(?:contract|service)\s+period\s*[:\-]?\s*({POINT})\s*(?:-|–|—|\bto\b)\s*({POINT})"
MONTHLY = r"(?Udi)\binvoices?\s+(?:are\s+)?issued\s+monthly\b|\bmonthly\s+invoices?\b|\bissued\s+monthly\b"
FEE = r"(?Udi)monthly\s+(?:service\s+)?fee\b(.*)"
EXPLICIT = (
    rf"(?Udim)^[ \t]*((?:{MONTH_NAMES})\s+20\d{{2}}|20\d{{2}}-(?:0[1-9]|1[0-2]))"
    r"[ \t]+(?:—|-|–)?[ \t]*((?:EUR|USD|GBP)[ \t]+\d[\d.,]*|\d[\d.,]*[ \t]+(?:EUR|USD|GBP))[ \t]*$"
)
CONTRACT_NAME = r"(?Ui)contract|agreement|ligums|līgums"
MAX_MONTHS = 60
UNABLE = "The contract does not clearly specify the invoice schedule/amount."
REASONS = {
    "empty": "The contract text is empty.",
    "line": "An invoice line does not give a period, amount, and currency.",
    "twice": "The same invoice period is listed more than once.",
    "schedule": "No monthly invoice schedule was stated.",
    "fee": "No single monthly fee was stated.",
    "period": "No contract period was stated.",
    "unread": "The contract period could not be read.",
    "long": "The contract period is too long to list reliably.",
}
MONTHLY_FEE, NO_READABLE_TEXT = "Monthly service fee", "The contract file has no readable text."
REPORT = {
    "none": 'No contract file was found in the folder.\nA contract filename should contain "contract" or "agreement".',
    "several": "Several possible contracts were found. The folder was not checked.\n\n",
    "contract": "Contract: ",
    "unclear": "\n\nI could not reliably determine the expected invoices from the contract.\n\nReason:\n",
    "expected": "\n\nInvoices expected: ",
    "found": "\nInvoices found: ",
    "missing": "\nInvoices missing: ",
    "all": "All expected invoices are present.",
    "list": "Missing invoices:\n\n",
}
INVOICES = "array<struct<period:string,amount:decimal(28,8),currency:string,description:string,invoice_number:string>>"


def _invoice(period: Column, money: Column, description: Column) -> Column:
    return F.struct(
        period.alias("period"), money["amount"].alias("amount"), money["currency"].alias("currency"),
        description.alias("description"), F.lit(None).cast("string").alias("invoice_number"),
    )


def _money(fragment: Column) -> Column:
    """The amount of a fragment without the marks around it, or null."""
    clean = F.regexp_replace(fragment, "^[ :\\-\t—–]+|[ :\\-\t—–]+$", "")
    return let(parse_amount(clean), lambda p: F.when(p["amount"].isNotNull() & p["currency"].isNotNull(), p))


def _month_start(period: Column) -> Column:
    return F.try_to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd")


def required_invoices(contracts: DataFrame, text_col: str = "text") -> DataFrame:
    """Add determined, reason and invoices to contracts.

    Lines that state a period and an amount win over a monthly fee with a
    contract period.  A contract that states neither clearly is undetermined
    and has a reason instead of invoices.

    Contracts are few bytes and much work, so they are dealt over all tasks, and
    what is read of a text is written before it is used more than once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_text = F.lit(None).cast("string")
    width = int(contracts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = contracts.repartition(width).withColumn(
        "lines",
        F.transform(
            F.arrays_zip(
                F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(1)).alias("p"), F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(2)).alias("m")
            ),
            lambda x: F.struct(period_point(x["p"]).alias("period"), _money(x["m"]).alias("money")),
        ),
    )
    fees = F.transform(F.regexp_extract_all(text, F.lit(FEE), F.lit(1)), _money)
    known = F.size(fees) > 0
    steps = steps.withColumn("fee", F.when(known & ~F.exists(fees, lambda f: f.isNull()), only(fees)))
    steps = steps.withColumn("stated", text.rlike(RANGE))
    steps = steps.withColumn("first", _month_start(period_point(F.regexp_extract(text, RANGE, 1))))
    steps = steps.withColumn("last", _month_start(period_point(F.regexp_extract(text, RANGE, 2))))
    steps = cut(steps, "contracts-read")
    periods = F.transform("lines", lambda x: x["period"])
    months = F.months_between("last", "first") + 1
    listed = F.size("lines") > 0
    why = (
        F.when(stripped(text) == "", "empty")
        .when(listed & F.exists("lines", lambda x: x["period"].isNull() | x["money"].isNull()), "line")
        .when(listed & (F.size(F.array_distinct(periods)) < F.size(periods)), "twice")
        .when(listed, None)
        .when(~text.rlike(MONTHLY), "schedule")
        .when(F.col("fee").isNull(), "fee")
        .when(~F.col("stated"), "period")
        .when(F.col("first").isNull() | F.col("last").isNull() | (F.col("first") > F.col("last")), "unread")
        .when(months > MAX_MONTHS, "long")
    )
    texts = F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (k, f"{UNABLE} {v}")])
    steps = steps.withColumn("why", why)
    explicit = F.transform("lines", lambda x: _invoice(x["period"], x["money"], no_text))
    monthly = F.transform(
        F.sequence("first", "last", F.expr("interval 1 month")),
        lambda m: _invoice(F.date_format(m, "yyyy-MM"), F.col("fee"), F.lit(MONTHLY_FEE)),
    )
    invoices = F.when(F.col("why").isNotNull(), F.array().cast(INVOICES)).when(listed, explicit).otherwise(monthly)
    return (
        steps.withColumn("determined", F.col("why").isNull())
        .withColumn("reason", F.element_at(texts, F.col("why")))
        .withColumn("invoices", invoices)
        .drop("lines", "fee", "stated", "first", "last", "why")
    )


def clear_match() -> Column:
    """Whether found invoice ``f`` clearly is the expected invoice ``e``."""
    e, f = (lambda n: F.col(f"e.{n}")), (lambda n: F.col(f"f.{n}"))
    given = lambda c: c.isNotNull() & (c != "")
    both = given(e("invoice_number")) & given(f("invoice_number"))
    agree = both & (compact(e("invoice_number")) == compact(f("invoice_number")))
    clash = F.coalesce(e("amount") != f("amount"), F.lit(False)) | F.coalesce(e("currency") != f("currency"), F.lit(False))
    same = (e("period") == f("period")) & (e("amount") == f("amount")) & (e("currency").isNull() | f("currency").isNotNull())
    return F.coalesce(~(both & ~agree) & ~clash & (agree | same), F.lit(False))


def match_invoices(expected: DataFrame, found: DataFrame, small: int = 50_000) -> DataFrame:
    """Add ``found`` (a file's name or null) to expected(scope_id, ord, ...).

    In contract order each expected invoice takes the first file, by ``ord``,
    that clearly matches and is not taken.  Periods or numbers are equi-join
    keys; the assignment is the one of proposals.  Both sides are read several
    times and so written.
    """
    expected, found = cut(expected, "invoices-expected"), cut(found, "invoices-found")
    e, f = expected.alias("e"), found.alias("f")
    scope = F.col("e.scope_id") == F.col("f.scope_id")
    pick = lambda pairs: pairs.where(clear_match()).select(
        F.col("e.scope_id").alias("scope_id"), F.col("e.ord").alias("eo"), F.col("f.ord").alias("fo"), F.col("f.filename").alias("filename")
    )
    by_period = pick(e.join(f, scope & (F.col("e.period") == F.col("f.period"))))
    numbered = compact(F.col("e.invoice_number")) == compact(F.col("f.invoice_number"))
    by_number = pick(e.where(compact(F.col("invoice_number")) != "").alias("e").join(f, scope & numbered))
    pairs = by_period.unionByName(by_number).distinct()
    offers = pairs.select(
        "scope_id", F.struct("eo", "fo").alias("rank"), F.col("eo").cast("string").alias("transaction_id"),
        F.array(F.col("fo").cast("string")).alias("document_ids"), "eo", "filename",
    )
    offers = cut(offers, "invoice-offers")
    taken = offers.join(greedy_assign(offers, small), ["scope_id", "rank"], "left_semi")
    taken = taken.select("scope_id", F.col("eo").alias("ord"), F.col("filename").alias("found"))
    return expected.join(taken, ["scope_id", "ord"], "left")


def check_folders(files: DataFrame, analyze: Callable[[DataFrame], DataFrame] = required_invoices) -> tuple[DataFrame, DataFrame]:
    """Check the folders of files(scope_id, filename, text), many at once.

    Found invoices are taken in the order of the files' rel_path, the one of a
    scan, if there is such a column, else of their names; of rows with one path
    the order is that of their texts.

    Returns one row per folder (scope_id, status, contract_name, reason,
    ambiguous, n_expected, n_found, n_missing) and the expected invoices with
    the file found for each.  ``analyze`` adds determined, reason and invoices.
    """
    path = F.col("rel_path") if "rel_path" in files.columns else F.col("filename")
    files = files.withColumn("place", F.struct(path.alias("path"), F.coalesce("text", F.lit("")).alias("text")))
    named = files.withColumn("is_contract", F.col("filename").rlike(CONTRACT_NAME))
    folders = named.groupBy("scope_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_contract"), F.col("filename")))).alias("names"),
        F.max(F.when(F.col("is_contract"), F.col("text"))).alias("text"),
    )
    single = folders.where(F.size("names") == 1)
    read = cut(analyze(single), "contracts")
    expected = read.where("determined").select("scope_id", F.posexplode("invoices").alias("ord", "i")).select("scope_id", "ord", "i.*")
    order = Window.partitionBy("scope_id").orderBy("place", "filename")
    others = named.where("not is_contract").join(read.where("determined").select("scope_id"), "scope_id", "left_semi")
    found = found_invoices(others).withColumn("ord", F.row_number().over(order))
    expected = cut(match_invoices(expected, found), "expected")
    counts = expected.groupBy("scope_id").agg(F.count("*").alias("n_expected"), F.count("found").alias("n_found"))
    status = (
        F.when(F.size("names") == 0, "NO_CONTRACT")
        .when(F.size("names") > 1, "AMBIGUOUS")
        .when(stripped(F.coalesce(F.col("text"), F.lit(""))) == "", "UNREADABLE")
        .when(F.col("determined"), "COMPLETE")
        .otherwise("UNABLE")
    )
    zero = F.lit(0).cast("long")
    rows = folders.join(read.select("scope_id", "determined", "reason"), "scope_id", "left").join(counts, "scope_id", "left")
    rows = rows.withColumn("status", status)
    reason = F.when(F.col("status") == "UNREADABLE", NO_READABLE_TEXT).otherwise(F.col("reason"))
    return rows.select(
        "scope_id", "status", F.when(F.size("names") == 1, F.element_at("names", 1)).alias("contract_name"), reason.alias("reason"),
        F.when(F.size("names") > 1, F.col("names")).alias("ambiguous"), F.coalesce("n_expected", zero).alias("n_expected"),
        F.coalesce("n_found", zero).alias("n_found"), F.coalesce(F.col("n_expected") - F.col("n_found"), zero).alias("n_missing"),
    ), expected


def described() -> Column:
    """An expected invoice in words."""
    label = F.coalesce(F.date_format(_month_start(F.col("period")), "MMMM yyyy"), F.lit("Invoice"))
    return F.concat(label, F.coalesce(F.concat(F.lit(" — "), F.concat_ws(" ", "currency", plain(F.col("amount")))), F.lit("")))


def report_texts(folders: DataFrame, expected: DataFrame) -> DataFrame:
    """The text report of every folder."""
    missing = expected.where("found is null").groupBy("scope_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), described()).alias("t")))).alias("m")
    )
    unclear = F.concat(
        F.lit(REPORT["contract"]), "contract_name", F.lit(REPORT["unclear"]), "reason"
    )
    counts = F.concat(
        F.lit(REPORT["contract"]), "contract_name", F.lit(REPORT["expected"]), "n_expected", F.lit(REPORT["found"]), "n_found",
        F.lit(REPORT["missing"]), "n_missing", F.lit("\n\n"),
    )
    listed = F.concat(F.lit(REPORT["list"]), F.array_join(F.transform("m", lambda x: x["t"]), "\n"))
    text = (
        F.when(F.col("status") == "NO_CONTRACT", REPORT["none"])
        .when(
            F.col("status") == "AMBIGUOUS",
            F.concat(F.lit(REPORT["several"]), F.array_join(F.transform("ambiguous", lambda n: F.concat(F.lit("- "), n)), "\n")),
        )
        .when(F.col("status").isin("UNREADABLE", "UNABLE"), unclear)
        .otherwise(F.concat(counts, F.when(F.col("n_missing") == 0, REPORT["all"]).otherwise(listed)))
    )
    return folders.join(missing, "scope_id", "left").select("scope_id", "status", text.alias("report"))
