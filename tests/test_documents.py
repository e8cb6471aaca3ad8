"""Extraction, contracts, statements, file sources and the entry point."""

from datetime import date
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom import catalog
from tallyloom.__main__ import check_folder, main, statement_report
from tallyloom.config import ConfigError, ocr_languages
from tallyloom.functions import checks
from tallyloom.operators import numbering
from tallyloom.plans import contract, extraction, glyphs, statement
from tallyloom.plans.statement import StatementError
from tallyloom.scratch import cut
from tallyloom.sources.files import OcrError, joined_pages, scan_documents, threshold, with_text
from tallyloom.sources.statements import CsvStatements, PdfStatements
from tallyloom.streaming.intake import stream_invoices

SF = "/root/testdata/sf0.001"
CONTRACT = "Service agreement\nMonthly service fee: EUR 500\nInvoices issued monthly\nContract period: January 2026 - March 2026"


def invoice(month, amount=500):
    return f"Invoice\nDate: 15.{month:02d}.2026\nTotal EUR {amount}\nSupplier: Example Services"


def test_fields(spark):
    texts = [
        "Supplier: Rimi Latvia SIA\nInvoice: INV-9\nIssued 04.10.2026\nSubtotal 10.00 EUR\nTotal 12.50 EUR",
        "Thank you for visiting\nINV-9", "04.10.2026\n05.10.2026", "10.00 EUR\n12.00 EUR", "Rimi Latvia SIA\nTotal 10.00 EUR", "Total 43.21",
        "PIEGĀDĀTĀJS: Līgums\nRēķins Nr. A-17\nKopā 5,00 EUR", None,
    ]
    rows = extraction.extract_fields(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i")
    got = [(r.issued_date, r.amount, r.currency, r.merchant_raw, r.invoice_number) for r in rows.collect()]
    none = (None,) * 5
    assert got == [
        (date(2026, 10, 4), Decimal("12.5"), "EUR", "Rimi Latvia SIA", "INV-9"), none, none, none,
        (None, Decimal(10), "EUR", None, None), (None, Decimal("43.21"), None, None, None), (None, Decimal(5), "EUR", "Līgums", "A-17"), none,
    ]


FOLDERS = {
    "complete": [("service_agreement.pdf", CONTRACT), *[(f"i{m}.pdf", invoice(m)) for m in (1, 2, 3)]],
    "missing": [("service_agreement.pdf", CONTRACT), *[(f"i{m}.pdf", invoice(m)) for m in (1, 2)]],
    "by_name": [("service_agreement.pdf", CONTRACT), ("service_invoice_03_2026.pdf", invoice(3))],
    "mismatch": [("service_agreement.pdf", CONTRACT), ("i1.pdf", invoice(1)), ("i2.pdf", invoice(2)), ("i3.pdf", invoice(3, 450))],
    "vague": [("service contract.pdf", "General terms only.")],
    "two": [("service_agreement.pdf", CONTRACT), ("second_contract.pdf", CONTRACT)],
    "none": [("x.pdf", "x")],
    "blank": [("LĪGUMS.pdf", " ")],
    "explicit": [("contract.pdf", "January 2026 — EUR 500\n2026-02 500 EUR"), ("b.pdf", invoice(2))],
    "twice": [("contract.pdf", "January 2026 — EUR 500\n2026-01 500 EUR")],
    "long": [("contract.pdf", CONTRACT.replace("March 2026", "March 2032"))],
    "fees": [("contract.pdf", CONTRACT + "\nMonthly fee: EUR 400")],
}


def test_folders(spark):
    rows = [(s, *f) for s, files in FOLDERS.items() for f in files]
    folders, expected = contract.check_folders(spark.createDataFrame(rows, "scope_id string, filename string, text string"))
    got = {r.scope_id: r for r in folders.collect()}
    assert {s: r.status for s, r in got.items()} == {
        **dict.fromkeys(("complete", "missing", "by_name", "mismatch", "explicit"), "COMPLETE"), "vague": "UNABLE", "two": "AMBIGUOUS",
        "none": "NO_CONTRACT", "blank": "UNREADABLE", "twice": "UNABLE", "long": "UNABLE", "fees": "UNABLE",
    }
    assert [got[s].n_missing for s in ("complete", "missing", "by_name", "mismatch", "explicit")] == [0, 1, 2, 1, 1]
    assert got["two"].ambiguous == ["second_contract.pdf", "service_agreement.pdf"]
    for s, part in (("twice", "more than once"), ("long", "too long"), ("fees", "No single monthly fee"), ("vague", "No monthly invoice schedule")):
        assert part in got[s].reason
    texts = {r.scope_id: r.report for r in contract.report_texts(folders, expected).collect()}
    assert texts["missing"].endswith("Missing invoices:\n\n- March 2026 — EUR 500")
    assert texts["complete"].endswith("All expected invoices are present.")
    assert "- second_contract.pdf\n- service_agreement.pdf" in texts["two"]


def test_statement_lines_and_twins(spark):
    heights = [10.0, 10.6, 11.2, 11.9, 13.0]
    glyphs = [("s", "f", 1, "f", i, 4.0 * i, 4.0 * i + 4, y) for i, y in enumerate(heights)] + [("s", "f", 1, "f", 9, 60.0, 64.0, 815.0)]
    names = [("f", i, c) for i, c in enumerate("aIbIc")]
    g = spark.createDataFrame(glyphs, "scope_id string, file string, page int, font string, glyph_id int, x0 double, x1 double, y0 double")
    m = spark.createDataFrame(names, "font string, glyph_id int, ch string")
    lines = statement.lines_of_glyphs(g, m)
    assert [r.line for r in lines.orderBy("y0").collect()] == [1, 1, 2, 2, 3]
    assert [r.text for r in statement.words_of_lines(lines).orderBy("line").collect()] == ["al", "bl", "c"]


def test_statement_round_trip_and_broken_balance(spark):
    glyphs, names = catalog._glyphs(spark, SF)
    rows, check = statement.read_statements(glyphs, names)
    assert check.where("problem is not null").count() == 0
    statement.require_balanced(check)
    printed = check.select("scope_id").first().scope_id
    _, broken = statement.read_statements(glyphs.where((F.col("scope_id") != printed) | (F.col("y0") < 100) | (F.col("y0") > 115)), names)
    with pytest.raises(statement.StatementError):
        statement.require_balanced(broken)


def test_statement_profile_and_page_sizes(spark):
    schema = "scope_id string, file string, source_page int, source_row int, posted_date date, direction string, amount decimal(28,8), currency string, description string, merchant_raw string"
    rows = [("s", "f", p, i, date(2026, 9, i), "outgoing" if i % 2 else "incoming", Decimal("1.50"), "EUR", "first\nsecond", None if i == 2 else "Shop") for i, p in ((1, 1), (2, 2), (3, 4), (4, 4))]
    check = spark.createDataFrame([("s", "f", Decimal(1), Decimal(1)), ("s", "empty", Decimal(2), Decimal(2))], "scope_id string, file string, opening decimal(28,8), closing decimal(28,8)")
    pages = spark.createDataFrame([("s", "f", p) for p in (1, 1, 2, 3, 4)], "scope_id string, file string, page int")
    found = {r.file: r for r in statement.statement_profile(spark.createDataFrame(rows, schema), check, pages).collect()}
    assert (found["f"].pages, found["f"].transaction_pages, found["f"].n_outgoing, found["f"].n_incoming) == (4, "1-2, 4", 2, 2)
    assert found["f"].samples.split("\n") == ["1. 2026-09-01 Shop -1.50 EUR", "2. 2026-09-02 first +1.50 EUR", "3. 2026-09-03 Shop -1.50 EUR"]
    assert (found["empty"].transaction_pages, found["empty"].n, found["empty"].samples) == ("none", 0, "")
    sizes = spark.createDataFrame([(595.3, 841.9), (612.0, 842.0), (595.0, 792.0), (None, 842.0)], "w double, h double")
    assert [r.p is None for r in sizes.select(statement.page_problem(F.col("w"), F.col("h")).alias("p")).collect()] == [True, False, False, False]


def test_threshold_and_languages():
    dark = np.full((40, 60), 200, np.uint8)
    dark[10:14, 5:50] = 20
    assert (threshold(dark) == np.where(dark > 100, 255, 0)).all()
    small = np.tile(np.array([30, 32, 220, 222], np.uint8), (4, 1))
    assert (threshold(small) == np.where(small > 100, 255, 0)).all()
    assert threshold(np.zeros((5, 5), np.uint8)).max() == 0
    with pytest.raises(OcrError):
        threshold(np.zeros((2, 2, 3), np.uint8))
    assert ocr_languages({"language": " ENG + lav", "supported_languages": ["eng", "Lav"]}) == "eng+lav"
    for bad in ({"language": "eng+deu", "supported_languages": ["eng"]}, {"language": "english", "supported_languages": ["eng"]}, {"language": "eng", "supported_languages": []}, None):
        with pytest.raises(ConfigError):
            ocr_languages(bad)


def test_page_ranges(spark):
    rows = spark.createDataFrame([("a", p) for p in (1, 2, 3, 5, 5, 9, 10)], "k string, page int")
    assert statement.page_ranges(rows, ["k"]).first().page_ranges == "1-3, 5, 9-10"


def test_scan(spark, tmp_path):
    for name in ("B.pdf", "a.jpg", "nested/A.jpeg", "nested/c.PNG", "notes.txt", "scan.pdf.txt", ".hidden.pdf", "folder.pdf/x.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.touch()
    rows = scan_documents(spark, tmp_path).collect()
    assert [r.rel_path for r in rows] == [".hidden.pdf", "B.pdf", "a.jpg", "nested/A.jpeg", "nested/c.PNG"]
    assert [r.document_type for r in rows] == ["pdf", "pdf", "jpg", "jpeg", "png"]
    with pytest.raises(FileNotFoundError):
        scan_documents(spark, tmp_path / "absent")
    with pytest.raises(NotADirectoryError):
        scan_documents(spark, tmp_path / "B.pdf")


def decoder():
    """Made inside a function, so that executors need no copy of this module."""

    def decode(content, kind):
        if content == b"bad":
            raise ValueError("secret text")
        return content.decode().split("|")

    return decode


def test_text_adapters_and_command(spark, tmp_path, capsys):
    files = spark.createDataFrame([(bytearray(b"Alpha \r\n|  |Invoice 42"), "pdf"), (bytearray(b"bad"), "png")], "content binary, document_type string")
    got = with_text(files, decoder()).orderBy("document_type").collect()
    assert [(r.text, r.extract_error) for r in got] == [("Alpha\n\nInvoice 42", None), ("", "ValueError")]
    assert spark.range(1).select(joined_pages(F.array(F.lit(" a\fb "), F.lit("")))).first()[0] == "a\nb"
    (tmp_path / "service_agreement.pdf").write_text(CONTRACT)
    (tmp_path / "jan.pdf").write_text(invoice(1))
    report = check_folder(spark, str(tmp_path), decoder())
    assert "Invoices expected: 3\nInvoices found: 1" in report and "- February 2026 — EUR 500\n- March 2026 — EUR 500" in report
    assert main(["check-folder", str(tmp_path / "absent")]) == 1


def drawn():
    """A trace of a statement of one row, made inside a function as executors
    have no copy of this module: its PDF holds nothing but its text."""

    def trace(content):
        if content == b"wide":
            raise StatementError("page 1 is not A4")
        words = [(80.0, 218.0, "Sākuma atlikums"), (80.0, 401.0, "EUR+10.00"), (100.0, 62.0, "ref1"), (100.0, 161.0, "10.09.2026"), (100.0, 218.0, "Amazon"), (100.0, 401.0, "-100.00")]
        words += [(740.0, 218.0, "Kopā izskaitīts (1)"), (740.0, 401.0, "EUR-100.00"), (750.0, 218.0, "Kopā ieskaitīts (0)"), (750.0, 401.0, "EUR+0.00")]
        words += [(760.0, 218.0, "Beigu atlikums"), (760.0, 401.0, "EUR-90.00")]
        return [(1, [("f", [(ord(c), x + 4.0 * i, y, x + 4.0 * i + 4.0) for i, c in enumerate(w) if c != " "]) for y, x, w in words])]

    return trace


def test_statement_report_of_a_folder(spark, tmp_path, capsys):
    signs = sorted({*"Sākumatlis EUR+-0123456789.refAmazonKopāizskītsgu()Bd"} - {" "})
    signs = spark.createDataFrame([("f", ord(c), c) for c in signs], "font string, glyph_id int, ch string")
    source = PdfStatements(signs, trace=drawn())
    assert statement_report(spark, str(tmp_path), source, decoder()) is None
    (tmp_path / "invoice.pdf").write_text("Supplier: Amazon\nIssued 10.09.2026\nTotal 100.00 EUR")
    (tmp_path / "copy.pdf").write_text("Supplier: Amazon\nIssued 10.09.2026\nTotal 100.00 EUR")
    assert statement_report(spark, str(tmp_path), source, decoder()) is None
    (tmp_path / "Statement.pdf").write_text("drawn")
    page = statement_report(spark, str(tmp_path), source, decoder()).read_text()
    assert "IDENTIFIED" in page and "2026-09-10" in page and 'href="' in page and "NOT IDENTIFIED" not in page
    with pytest.raises(StatementError):
        PdfStatements().read(spark, str(tmp_path / "Statement.pdf"))
    (tmp_path / "parskats.pdf").write_text("drawn")
    with pytest.raises(StatementError, match="several bank statements found: Statement.pdf, parskats.pdf"):
        statement_report(spark, str(tmp_path), source, decoder())


def test_traces_that_lack_a_font_raise(spark):
    schema = "scope_id string, file string, page int, spans array<struct<font:string,chars:array<struct<glyph_id:int,x0:double,y0:double,x1:double>>>>"
    whole, lacking = ("s", "f", 1, [("a", [(7, 1.0, 2.0, 3.0), (8, 3.0, 2.0, 5.0)])]), ("s", "f", 2, [(None, [])])
    found = statement.glyphs_of_traces(spark.createDataFrame([whole], schema)).collect()
    assert [(r.font, r.glyph_id, r.x0, r.x1, r.y0) for r in found] == [("a", 7, 1.0, 3.0, 2.0), ("a", 8, 3.0, 5.0, 2.0)]
    with pytest.raises(Exception, match="incomplete"):
        statement.glyphs_of_traces(spark.createDataFrame([whole, lacking], schema)).collect()


def test_checks_of_rows(spark):
    good = ("t", date(2026, 9, 10), "outgoing", Decimal("1.00"), " eur ", "CARD", "Shop SIA", "SHOP", "s.pdf", 1, None)
    bad = (" ", None, None, Decimal("0"), "E1R", None, "Shop", "OTHER", "", 0, -1)
    schema = "id string, posted_date date, direction string, amount decimal(28,8), currency string, description string, merchant_raw string, merchant_normalized string, source_file string, source_page int, source_row int"
    rows = checks.checked_transactions(spark.createDataFrame([good, bad], schema)).collect()
    assert rows[0].problems == [] and rows[0].currency == "EUR" and len(rows[1].problems) == 10 and rows[1].id is None
    docs = spark.createDataFrame([("d", "d.pdf", "pdf", None, "", "A" * 64), ("d", "", "doc", Decimal("-1"), "EURO", "xyz")], "id string, filename string, document_type string, amount decimal(28,8), currency string, file_hash string")
    rows = checks.checked_documents(docs).collect()
    assert rows[0].problems == [] and rows[0].currency is None and len(rows[1].problems) == 5


def test_csv_statement_and_stream(spark, tmp_path):
    (tmp_path / "s.csv").write_text("scope_id,posted_date,direction,amount,currency,description,merchant_raw\nx,2026-09-10,outgoing,19.90,EUR,CARD,Shop\n")
    row = CsvStatements().read(spark, str(tmp_path / "s.csv")).first()
    assert len(row.id) == 64 and row.amount == Decimal("19.9") and row.source_file == "s.csv"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("s", "a.pdf", invoice(1))], "scope_id string, filename string, text string").write.parquet(source)
    stream_invoices(spark, source, target, str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(target).first().period == "2026-01"


def test_command_refuses_languages(capsys):
    assert main(["check-folder", ".", "--languages", "eng+deu"]) == 1 and "deu" in capsys.readouterr().err


def test_entry_point_imports():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES and catalog.queries()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_contracts_are_dealt_over_tasks(spark, monkeypatch):
    """However few files hold the contracts; and their texts are read once."""
    seen = []
    monkeypatch.setattr(contract, "cut", lambda df, label: seen.append((label, df.rdd.getNumPartitions())) or cut(df, label))
    rows = spark.createDataFrame([(i, "2024-01 EUR 5\n2024-02 EUR 6") for i in range(40)], "scope_id long, text string").coalesce(1)
    assert contract.required_invoices(rows).where("determined and size(invoices) = 2").count() == 40
    assert seen == [("contracts-read", int(spark.conf.get("spark.sql.shuffle.partitions")))]


def test_lines_with_words_take_one_shuffle_of_glyphs(spark):
    # Two pages whose glyphs alternate, a second word, a twin at a line's start and an unknown glyph.
    text = {(1, 10.0): "ab cI", (1, 10.5): " d", (2, 10.0): "Ix", (2, 30.0): "?b"}
    glyphs = [("s", "f", p, "f", ord(c), 4.0 * i, 4.0 * i + 4, y) for i in range(5) for (p, y), t in text.items() for c in t[i : i + 1] if c != " "]
    g = spark.createDataFrame(glyphs, "scope_id string, file string, page int, font string, glyph_id int, x0 double, x1 double, y0 double").repartition(3)
    m = spark.createDataFrame([("f", ord(c), c) for c in "abcdxI"], "font string, glyph_id int, ch string")
    lines = statement.worded_lines(g, m)
    got = {(r.page, r.line): [w.text for w in r.words] for r in lines.collect()}
    assert got == {(1, 1): ["abd", "cl"], (2, 1): ["Ix"], (2, 2): ["b"]}
    apart = statement.words_of_lines(statement.lines_of_glyphs(g, m)).collect()
    assert sorted((r.page, r.line, r.x0, r.y0, r.text) for r in apart) == sorted((r.page, r.line, w.x0, w.y0, w.text) for r in lines.collect() for w in r.words)
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def _without_broadcasts_by_size(spark, make):
    """The physical plan when no table is known to be small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


GLYPHS = "scope_id string, file string, page int, font string, glyph_id int, x0 double, x1 double, y0 double"


def test_only_packed_pages_are_shuffled(spark, monkeypatch):
    """However many glyphs there are, they do not go to a short map, nor one by one to their page."""
    g = spark.createDataFrame([("s", "f", 1, "f", 97, 4.0, 8.0, 10.0)], GLYPHS)
    m = spark.createDataFrame([("f", 97, "a")], "font string, glyph_id int, ch string")
    plan = _without_broadcasts_by_size(spark, lambda: statement.worded_lines(g, m))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 2 and "SortMergeJoin" not in plan
    unread = _without_broadcasts_by_size(spark, lambda: glyphs.unread_fonts(g, m, statement.FILE))
    assert "SortMergeJoin" not in unread
    monkeypatch.setattr(glyphs, "is_short", lambda names: False)
    assert "SortMergeJoin" in _without_broadcasts_by_size(spark, lambda: glyphs.unread_fonts(g, m, statement.FILE))
    assert glyphs.unread_fonts(g.union(g.withColumn("glyph_id", F.lit(98))), m, statement.FILE).first().unread == "unknown glyph 98 of font f"


def test_packed_pages_hold_all_glyphs():
    chars = ["a", None, "ffi", "a", "", "ž", None]
    table = pa.table({
        "scope_id": ["s", "s", None, "s", "s", "s", "s"], "file": ["f"] * 7, "page": [2, 1, 1, 2, 2, 1, 2], "y0": [1.5, -2.0, 3.0, 0.1, 1e300, 5.0, 6.0],
        "x0": [0.1, None, 3.0, 1 / 3, 5.0, 6.0, 7.0], "x1": [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0], "ch": pa.array(chars), "mark": pa.array([1, 0, 2, 3, 0, 1, 0], pa.int32()),
    })
    parts = pa.Table.from_batches([statement._pack(table.slice(0, 4)), statement._pack(table.slice(4))])
    assert sorted(parts["n"].to_pylist()) == [1, 1, 1, 2, 2]
    back = statement._unpack(parts.append_column("of", pa.array(range(parts.num_rows), pa.int64()))).drop_columns("of")
    rows = lambda t: sorted(((*(("nan" if v != v else v) for v in r.values()),) for r in t.to_pylist()), key=repr)
    filled = table.set_column(4, "x0", table["x0"].fill_null(float("nan"))).set_column(5, "x1", table["x1"].fill_null(float("nan")))
    assert rows(back) == rows(filled.select(back.column_names))
    none = statement._pack(table.set_column(6, "ch", pa.nulls(7, pa.string())))
    assert none.column("chars").flatten().field("ch").null_count == len(none.column("chars").flatten())
    assert statement._unpack(pa.Table.from_batches([none]).append_column("of", pa.array([0] * none.num_rows)))["ch"].null_count == 7


def test_lines_are_numbered_once(spark, monkeypatch):
    """Rows and islands in one pass over written lines; one number of lines a file takes as well as ranges."""
    seen = []
    monkeypatch.setattr(numbering, "cut", lambda df, label: seen.append(label) or cut(df, label))
    kinds = ["more", "opening", "start", "more", "header", "start", "closing", "more", "start"]
    rows = [("s", f, 1 + i // 4, float(i), i, k, f"r{i}" if k != "more" else "", "01.02.2024" if k == "start" else "", f"d{i}", "-1.00" if k == "start" else "") for f in "ab" for i, k in enumerate(kinds)]
    lines = spark.createDataFrame(rows, "scope_id string, file string, page int, y0 double, line int, kind string, reference string, date_text string, details string, amount_text string")
    want = {(f, n, page, text) for f in "ab" for n, page, text in ((1, 1, "r2\nd2\nd3"), (2, 2, "r5\nd5"), (3, 3, "r8\nd8"))}
    for most, labels in ((10**6, ["running-giants"]), (3, ["running-giants", "running-ranges", "running-offsets"])):
        seen.clear()
        found = statement.statement_rows(lines, file_rows=most, written=True)
        assert seen == labels and {(r.file, r.source_row, r.source_page, r.description) for r in found.collect()} == want


def test_letters_at_one_place(spark):
    # In two of three words a twin, which is named I and shown as l, stands where another letter stands.
    placed = [("aIk", (10.0, 14.0, 14.0)), ("bcd", (60.0, 64.0, 68.0)), ("eIm", (90.0, 94.0, 94.0))]
    g = spark.createDataFrame([("s", "f", 1, "f", ord(c), x, x + 4, 50.0) for t, at in placed for c, x in zip(t, at, strict=True)], GLYPHS)
    m = spark.createDataFrame([("f", ord(c), c) for c in "aIkbcdem"], "font string, glyph_id int, ch string")
    assert [w.text for w in statement.worded_lines(g, m).first().words] == ["akl", "bcd", "elm"]
