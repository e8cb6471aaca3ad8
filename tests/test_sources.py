"""Folders, pages and reports as sources and sinks; fonts; matches as JSON."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import contract, glyphs, reports, statement
from tallyloom.plans.statement import StatementError
from tallyloom.scratch import cut, scratch_scope
from tallyloom.sources.files import scan_documents
from tallyloom.sources.ocr_packs import OcrError, find_program, pack_folders, prepared_packs
from tallyloom.sources.pages import page_rows, texts_of_pages
from tallyloom.sources.report_sink import write_reports
from tallyloom.sources.scan import DocumentFolder, FilteringReader
from tallyloom.sources.statements import PdfStatements
from tests.test_documents import CONTRACT, drawn, invoice

ROWS = "scope_id string, transaction_id string, ord int, date string, text string, amount_text string, currency string, status string, files string"


def test_a_folder_is_listed_by_executors(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"s{i % 7}" / f"deep{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.{'PDF' if i % 2 else 'jpg'}").write_bytes(bytes([i]))
    (tmp_path / "top.png").touch()
    (tmp_path / "x.txt").touch()
    spark.dataSource.register(DocumentFolder)
    rows = scan_documents(spark, tmp_path, "scope", content=True).collect()
    want = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".txt")
    assert [r.rel_path for r in rows] == want and {r.scope_id for r in rows} == {"scope"}
    assert all(r.content == (tmp_path / r.rel_path).read_bytes() for r in rows)
    read = spark.read.format("document_folder").option("scopes", "true").load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 7
    scopes = Counter(r.scope_id for r in read.where("document_type = 'pdf'").collect())
    assert sum(scopes.values()) == 30 and set(scopes) == {str(tmp_path / f"s{k}") for k in range(7)}
    assert {r.rel_path for r in read.collect() if r.scope_id.endswith("s1")} == {p.relative_to(tmp_path / "s1").as_posix() for p in (tmp_path / "s1").rglob("*.*")}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert scan_documents(spark, empty).count() == 0


def test_filters_reach_the_listing(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    for name in ("a.pdf", "b.jpg", "c.png"):
        (tmp_path / name).touch()
    reader = FilteringReader({"path": str(tmp_path)}, False)
    other = GreaterThan(("filename",), "a")
    assert list(reader.pushFilters([In(("document_type",), ("pdf", "png")), other, EqualTo(("document_type",), "png")])) == [other]
    assert [r[3] for part in reader.partitions() for r in reader.read(part)] == ["c.png"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r.filename for r in scan_documents(spark, tmp_path).where("document_type = 'jpg'").collect()] == ["b.jpg"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def count(content):
        if content == b"bad":
            raise ValueError("secret text")
        return int(content)

    def read(content, first, end):
        (log / f"{content.decode()}-{first}").touch()
        if content == b"7":
            raise OSError("secret text")
        return [f"page {n}\r\n" if n % 2 else " " for n in range(first, end)]

    files = spark.createDataFrame([("long", b"10000"), ("bad", b"bad"), ("none", b"0"), ("torn", b"7"), ("short", b"3"), ("null", None)], "path string, content binary")
    pages = page_rows(files, ["path"], count, read)
    found = {r.path: (r.text, r.error) for r in texts_of_pages(pages, ["path"]).collect()}
    assert found["long"][0] == "\n\n".join(f"page {n}" for n in range(1, 10001, 2)) and found["short"] == ("page 1\n\npage 3", None)
    assert found["bad"] == ("", "ValueError") and found["torn"] == ("", "OSError") and "none" not in found and found["null"] == ("", "ValueError")
    assert len([p for p in log.iterdir() if p.name.startswith("10000-")]) == 64
    assert page_rows(files.limit(0), ["path"], count, read).count() == 0


def test_reports_of_many_scopes_in_one_job(spark, tmp_path):
    rows = [(f"s/{k}", f"t{i}", i, "2026-01-01", f"<{i}>", "1.00", "EUR", "IDENTIFIED", "a b.pdf") for k in range(1500) for i in range(2)]
    folder = str(tmp_path / "out")
    write_reports(spark.createDataFrame(rows, ROWS), folder)
    assert sorted(os.listdir(folder)) == sorted(f"s%2F{k}" for k in range(1500))
    page = (tmp_path / "out" / "s%2F7" / "report.html").read_text()
    assert page.index("&lt;0&gt;") < page.index("&lt;1&gt;") and page.startswith("<!DOCTYPE") and page.rstrip().endswith("</html>") and "a%20b.pdf" in page
    whole = reports.PAGE.format(rows="\n".join(reports.render_html(spark.createDataFrame(rows[:2], ROWS))))
    assert (tmp_path / "out" / "s%2F0" / "report.html").read_text() == whole


def test_a_failed_job_leaves_old_reports(spark, tmp_path):
    row = ("s", "t", 0, "2026-01-01", "old", "1.00", "EUR", "UNKNOWN", None)
    write_reports(spark.createDataFrame([row], ROWS), str(tmp_path))
    bad = [("s", "t", 0, "2026-01-01", "new", "1.00", "EUR", "UNKNOWN", None), ("z", "t", 0, "2026-01-01", "x", None, "EUR", "UNKNOWN", None)]
    with pytest.raises(Exception, match="."):
        write_reports(spark.createDataFrame(bad, ROWS), str(tmp_path))
    assert os.listdir(tmp_path) == ["s"] and "old" in (tmp_path / "s" / "report.html").read_text()


def test_found_invoices_go_by_path(spark):
    folder = [("contract.pdf", "contract.pdf", CONTRACT), ("z.pdf", "a/z.pdf", invoice(1)), ("b.pdf", "c/b.pdf", invoice(1)), ("i.pdf", "x/i.pdf", invoice(2)), ("i.pdf", "y/i.pdf", invoice(3))]
    files = spark.createDataFrame([("f", *x) for x in folder], "scope_id string, filename string, rel_path string, text string")
    _, expected = contract.check_folders(files)
    assert [r.found for r in expected.orderBy("ord").collect()] == ["z.pdf", "i.pdf", "i.pdf"]
    _, expected = contract.check_folders(files.drop("rel_path"))
    assert [r.found for r in expected.orderBy("ord").collect()] == ["b.pdf", "i.pdf", "i.pdf"]


def test_language_packs_are_found_and_gathered(tmp_path, monkeypatch):
    own, one, two, target = (tmp_path / n for n in ("own", "one", "two", "target"))
    for folder, codes in ((own, ["eng"]), (one, ["lav"]), (two, ["lav", "deu"])):
        folder.mkdir()
        for c in codes:
            (folder / f"{c}.traineddata").write_text(f"{folder.name} {c}")
    assert prepared_packs("eng", [one], own) is None
    assert prepared_packs("lav+deu", [one, two], own) == two
    assert prepared_packs("eng+lav+eng", [own, one, two], own, target) == target
    assert sorted(p.name for p in target.iterdir()) == ["eng.traineddata", "lav.traineddata"] and (target / "lav.traineddata").read_text() == "one lav"
    (one / "lav.traineddata").write_text("newer")
    os.utime(one / "lav.traineddata", (2**31, 2**31))
    assert (prepared_packs("eng+lav", [own, one], own, target) / "lav.traineddata").read_text() == "newer"
    with pytest.raises(OcrError, match="no language pack for fra, ita"):
        prepared_packs("eng+fra+ita", [own, one], None, target)
    program = tmp_path / "tesseract"
    program.touch()
    monkeypatch.setenv("TESSERACT_CMD", str(program))
    monkeypatch.setenv("TESSDATA_PREFIX", str(one))
    assert find_program() == program and pack_folders(program, [two, one])[:3] == [tmp_path / "tessdata", one, two]
    monkeypatch.setenv("TESSERACT_CMD", str(tmp_path / "absent"))
    assert find_program() is None
    monkeypatch.delenv("TESSERACT_CMD")
    assert find_program("no-such-program", places=[tmp_path / "absent", program]) == program


def test_scratch_tables_go_with_their_scope(spark):
    frame = spark.range(5)
    with scratch_scope(spark) as outer:
        kept = cut(frame, "outer")
        with pytest.raises(RuntimeError), scratch_scope(spark) as inner:
            cut(frame, "inner")
            assert os.path.isdir(inner[0])
            raise RuntimeError
        assert not os.path.isdir(inner[0]) and kept.count() == 5 and len(outer) == 1
    assert not os.path.isdir(outer[0])
    left = cut(frame, "left")
    assert left.count() == 5


def measured(pixels):
    """Box and number of dark pixels, the same above the baseline, and those below."""
    box = lambda ps: (min(x for x, _ in ps), min(y for _, y in ps), max(x for x, _ in ps) + 1, max(y for _, y in ps) + 1, len(ps)) if ps else None
    dark = [(x, y) for x, y, level in pixels if level < 180]
    return dark and (box(dark), box([p for p in dark if p[1] < 110]), sum(y >= 110 for _, y in dark))


def test_ink_and_characters_match_plain_python(spark):
    rng = random.Random(4)
    shape = lambda: [(rng.randint(0, 3), rng.choice([107, 108, 109, 110, 111]), rng.choice([0, 179, 180, 255])) for _ in range(rng.randint(0, 3))]
    known = {(b, c): shape() for b in (False, True) for c in "abcdefghIl"}
    known[True, "I"] = known[True, "l"] = [(0, 100, 0), (0, 101, 0)]
    known[False, "a"] = known[False, "b"] = [(7, 100, 0)]
    drawn_glyphs = {(b, g): shape() for b in (False, True) for g in range(150)} | {(True, 200): [(0, 100, 0), (0, 101, 179), (5, 5, 255)], (False, 201): [(7, 100, 9)]}
    rows = lambda of: [(*k, *dict.fromkeys([(x, y)]).popitem()[0], level) for k, ps in of.items() for x, y, level in dict(((x, y), (x, y, v)) for x, y, v in ps).values()]
    clean = lambda of: {k: [r[2:] for r in rows({k: ps})] for k, ps in of.items()}
    reference = glyphs.ink(spark.createDataFrame(rows(known), "bold boolean, ch string, x int, y int, level int"), ["bold", "ch"])
    ink = glyphs.ink(spark.createDataFrame(rows(drawn_glyphs), "bold boolean, g int, x int, y int, level int"), ["bold", "g"])
    known, drawn_glyphs = clean(known), clean(drawn_glyphs)
    want = {}
    for (bold, g), pixels in drawn_glyphs.items():
        if not (own := measured(pixels)):
            continue
        marks = {c: measured(ps) for (b, c), ps in known.items() if b == bold and measured(ps)}
        same = sorted(c for c, m in marks.items() if m[0] == own[0])
        like = [c for c, m in marks.items() if own[1] and m[1] == own[1] and (m[2] > 0) == (own[2] > 0)]
        ch = same[0] if len(same) == 1 else like[0] if not same and len(like) == 1 else None
        want[bold, g] = (ch, same == ["I", "l"], len(same) > 1 and same != ["I", "l"])
    found = {(r.bold, r.g): (r.ch, r.twin, r.problem is not None) for r in glyphs.identify(ink, reference).collect()}
    assert found == want and found[True, 200] == (None, True, False) and {w[2] for w in want.values()} == {True, False}


def font_of(numbers):
    """A stub of a font: its content says which character each glyph draws."""
    return json.dumps(numbers).encode()


def stubs(log, fonts):
    """A trace, fonts and a drawing of statements whose glyph numbers are their own."""
    trace = drawn()

    def of(content):
        name, _, numbers = content.partition(b"|")
        return [("XX+Arial-BoldMT", numbers), ("Helvetica", b"x")]

    def renumbered(content):
        numbers = {c: int(g) for g, c in json.loads(content.partition(b"|")[2]).items()}
        (page, spans), *_ = trace(b"drawn")
        return [(page, 595.8, 842.4, [("XX+Arial-BoldMT", [(numbers[chr(c[0])], *c[1:]) for c in cs]) for _, cs in spans])]

    def draw(content, bold):
        with open(log, "a") as f:
            f.write("drawn\n")
        for g, c in json.loads(content).items():
            code = ord("I" if bold and c == "l" else c)
            for x in range(1 + code % 40):
                for y in range(1 + code // 40):
                    yield int(g), x, 100 - y, 0

    return {"trace": renumbered, "fonts": of, "draw": draw}


def test_statements_with_embedded_fonts(spark, tmp_path):
    letters = sorted({*"Sākumatlis EUR+-0123456789.refAmazonKopāizskītsgu()Bd"} - {" "})
    made = stubs(str(tmp_path / "log"), None)
    pixels = [(b, c, x, y, v) for b in (False, True) for c in letters for _, x, y, v in made["draw"](json.dumps({0: c}).encode(), b)]
    (tmp_path / "log").unlink()
    reference = glyphs.ink(spark.createDataFrame(pixels, "bold boolean, ch string, x int, y int, level int"), ["bold", "ch"])
    folder = tmp_path / "in"
    folder.mkdir()
    numbers = {7 + 3 * i: c for i, c in enumerate(letters)}
    for k in range(4):
        (folder / f"{k}.pdf").write_bytes(b"%d|" % k + font_of(numbers))
    rows = PdfStatements(reference=reference, **made).read(spark, str(folder)).collect()
    assert len(rows) == 4 and {(r.direction, str(r.amount), r.description, r.merchant_raw) for r in rows} == {("outgoing", "100.00000000", "ref1\nAmazon", "Amazon")}
    assert (tmp_path / "log").read_text().count("drawn") == 1  # once for four files
    with pytest.raises(StatementError, match="unknown glyph"):
        PdfStatements(reference=reference.where("ch <> 'z'"), **made).read(spark, str(folder))
    wide = {**made, "trace": lambda content: [(1, 598.0, 842.0, [])]}
    with pytest.raises(StatementError, match="page 1: the page width"):
        PdfStatements(reference=reference, **wide).read(spark, str(folder))
    with pytest.raises(StatementError, match="known"):
        PdfStatements(**made).read(spark, str(folder))


def test_twins_take_the_case_before_them(spark):
    marks = [("Sa", 0), ("Il", 1), ("K", 0), ("Il", 1), ("l", 0), ("Il", 1)]
    placed = spark.createDataFrame([("s", "f", 1, "b", i, 10.0 + 4 * i, 14.0 + 4 * i, 50.0) for i in range(len(marks))], "scope_id string, file string, page int, font string, glyph_id int, x0 double, x1 double, y0 double")
    names = spark.createDataFrame([("b", i, None if twin else c[0], bool(twin)) for i, (c, twin) in enumerate(marks)], "font string, glyph_id int, ch string, twin boolean")
    word = statement.words_of_lines(statement.lines_of_glyphs(placed, names)).first().text
    assert word == "SIKIll"


def test_matches_as_json(spark):
    schema = (
        "transaction_id string, status string, score decimal(9,6), amount_score decimal(9,6), currency_score decimal(9,6), merchant_score decimal(9,6), date_score decimal(9,6), "
        "reference_score decimal(9,6), group_amount_exact boolean, documents array<struct<document_id:string,amount_exact:boolean,merchant_similarity:bigint,date_delta_days:int>>, reason string"
    )
    from decimal import Decimal as D

    rows = [("t", "PROBABLE", D("0.755185"), D(1), D(0), None, D("0.2"), None, False, [("d", None, 740741, 5), ("ē", True, None, None)], "Exact „ē“."), ("u", "MISSING", D(0), None, None, None, None, None, False, [], None)]
    matches = spark.createDataFrame(rows, schema)
    written = matches.select(reports.match_json(matches).alias("j"))
    texts = [json.loads(r.j) for r in written.collect()]
    assert texts[0]["score"] == "0.755185" and texts[0]["currency_score"] == "0.000000" and texts[0]["merchant_score"] is None and texts[0]["documents"][0]["merchant_similarity"] == "0.740741"
    back = written.select(reports.match_of_json(F.col("j")).alias("m")).select("m.*")
    assert back.collect() == matches.collect()
    assert spark.range(1).select(reports.match_of_json(F.lit("no json"))).first()[0] is None
    with pytest.raises(Exception, match="unknown fields of a match: extra"):
        spark.range(1).select(reports.match_of_json(F.lit('{"transaction_id": "t", "extra": 1}'))).collect()
