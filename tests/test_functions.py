"""Functions against given vectors."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import calculator, codecs, formcalc, geometry, jsengine, numbering, validators
from pagemill.operators import detection, objects, pages, search, trees
from pagemill.sources import pdf, writer
from pagemill.streaming import ingest


@pytest.mark.parametrize(("f", "value", "want"), [
    (validators.luhn, "79927398713", True), (validators.luhn, "79927398714", False), (validators.luhn, "4532 0151 1283 0366", True), (validators.luhn, "", False),
    (validators.verhoeff, "1428570", True), (validators.verhoeff, "1428571", False), (validators.verhoeff, "1438570", False),
    (validators.iban, "GB82 WEST 1234 5698 7654 32", True), (validators.iban, "GB82WEST12345698765432", True), (validators.iban, "GB83WEST12345698765432", False),
    (validators.aba, "021000021", True), (validators.aba, "021000022", False), (validators.aba, "12345678", False),
    (validators.npi, "1234567893", True), (validators.npi, "1234567890", False),
    (validators.bic, "DEUTDEFF", True), (validators.bic, "DEUTXXFF", False), (validators.bic, "HDFCINBB0XX", True), (validators.bic, "HOSPITAL", True), (validators.bic, "ABCD12FF", False),
    (validators.itin, "912-70-1234", True), (validators.itin, "912-50-1234", True), (validators.itin, "912-93-1234", False), (validators.itin, "812-70-1234", False),
])
def test_validators(spark, f, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("ok")).first().ok is want


def test_no_finance_in_plain_words(spark):
    d = spark.createDataFrame([(1, "TREATMENT APPROVED BY ONCOLOGY HOSPITAL")], "doc_id long, text string")
    assert detection.findings(d, detection.FINANCIAL).count() == 0


def test_redaction_is_all_or_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, "mail a@b.cc or 123-45-6789"), (2, None)], "doc_id long, text string")
    assert detection.write_redacted(d, detection.GENERAL, f"{tmp_path}/ok") == 1
    assert spark.read.parquet(f"{tmp_path}/ok").where("doc_id = 1").first().text == "mail ██████ or ███████████"
    with pytest.raises(detection.RedactionIncomplete):
        detection.write_redacted(d, [detection.Rule("any", "[a-z]")], f"{tmp_path}/no", mask="x")
    assert not (tmp_path / "no").exists()


SCRIPTS = [
    ('Left("abcdef", 3)', "abc"), ('Right("abcdef", 2)', "ef"), ('Len("hello")', 5.0), ('Substr("abcdef", 2, 3)', "bcd"), ('At("hello world", "world")', 7.0), ("Sum(1,2,3,4)", 10.0), ("Round(3.14159, 2)", 3.14),
    ('Upper("ada") & " " & Upper("lovelace")', "ADA LOVELACE"), ('if (120 > 100) then "premium" else "basic" endif', "premium"), ('"10" == 10.0', True), ('"b" > "a"', True), ("1 / 0", math.inf), ('Avg(3, "x")', 1.5),
    ('Stuff("abcd", 2, 2, "-")', "a-d"), ('Replace("a.a", ".", "|")', "a|a"), ("not 0", True), ('x = 2; x = x + 1; x & "!"', "3!"), ('Concat("a", null, 1.5)', "a1.5"), ("-2 * 3 + 10 / 4", -3.5), ('if 0 then 1 elseif 1 then 2 else 3 endif', 2.0), ('"1,000" + 1', 1001.0), ("Round(-2.5)", -3.0),
]


@pytest.mark.parametrize(("source", "want"), SCRIPTS)
def test_scripts_compiled_and_interpreted(spark, source, want):
    assert formcalc.interpret(source, {})[0] == want
    assert spark.range(1).select(formcalc.compile_script(source, {})[0].column.alias("v")).first().v == want


def test_loops():
    assert formcalc.interpret("t = 0; for i = 1 upto 4 do t = t + i endfor; t", {})[0] == 10
    assert formcalc.interpret("t = 9; while t > 2 do t = t - 3 endwhile; t", {})[0] == 0
    with pytest.raises(formcalc.ScriptError):
        formcalc.interpret("while 1 do x = 1 endwhile", {})
    with pytest.raises(formcalc.ScriptError):
        formcalc.parse("(" * 200 + "1" + ")" * 200)
    with pytest.raises(formcalc.ScriptError):
        formcalc.compile_script("for i = 1 upto 2 do i endfor", {})


@pytest.mark.parametrize(("n", "style", "want"), [(4, "roman", "iv"), (4, "ROMAN", "IV"), (1487, "ROMAN", "MCDLXXXVII"), (1, "ALPHA", "A"), (26, "ALPHA", "Z"), (27, "ALPHA", "AA"), (28, "alpha", "ab"), (0, "ROMAN", "0"), (703, "ALPHA", "AAA")])
def test_numbers(spark, n, style, want):
    assert spark.range(1).select(numbering.STYLES[style](F.lit(n)).alias("v")).first().v == want


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(numbering.label(F.lit(123), width=6)) == "000123" and one(numbering.label(F.lit(12345), width=3)) == "12345"
    assert one(numbering.label(F.lit(1), "BATES-", width=6)) == "BATES-000001" and one(numbering.label(F.lit(123), "A-", "-Z", 6)) == "A-000123-Z" and one(numbering.label(F.lit(4), width=6, style="roman")) == "iv"
    for mode, want in (("number", [1, 2, 3]), ("skip", [None, 2, 3]), ("renumber", [None, 1, 2])):
        assert [r.v for r in spark.range(3).orderBy("id").select(numbering.page_value(F.col("id"), first=mode).alias("v")).collect()] == want


def test_calculator_refuses_what_depends_on_data():
    with pytest.raises(calculator.ProgramError):
        calculator.parse("{ 1 2 add")
    with pytest.raises(calculator.ProgramError):
        calculator.calculator("{ { 1 } { 1 2 } ifelse }", [F.lit(1.0)], [(0, 1)])


def test_path_rules(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (10, 0), (10, 10), (0, 10))])
    r = spark.range(1).select(geometry.path_contains(ring, F.lit(5.0), F.lit(5.0)).alias("a"), geometry.path_contains(ring, F.lit(5.0), F.lit(5.0), even_odd=True).alias("b"), geometry.invert(geometry.matrix(1, 1, 1, 1, 0, 0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (True, False, None)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    for encode, decode in ((codecs.hex_encode, codecs.hex_decode), (codecs.a85_encode, codecs.a85_decode), (codecs.run_length_encode, codecs.run_length_decode), (codecs.lzw_encode, codecs.lzw_decode), (codecs.flate_encode, codecs.flate_decode)):
        assert decode(encode(data)) == data


def test_lzw_grows_and_clears():
    data = random.Random(1).randbytes(20_000) + b"abc" * 9000
    for early in (0, 1):
        assert codecs.lzw_decode(codecs.lzw_encode(data, early), early) == data


def test_codecs_bound_and_keep():
    with pytest.raises(codecs.TooLarge):
        codecs.flate_decode(codecs.flate_encode(b"\0" * 100_000), limit=1000)
    whole = codecs.flate_encode(random.Random(2).randbytes(5000) * 2)
    assert len(codecs.flate_decode(whole[:-2000])) > 1000
    assert codecs.unpredict(bytes([2, 1, 2, 2, 1, 1, 1, 5, 5]), 12, columns=2) == bytes([1, 2, 2, 3, 5, 10])


def test_rc4():
    assert codecs.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**31), 2**31 - 1) | st.binary(max_size=20) | st.builds(pdf.Name, st.text("abcXYZ #/()", max_size=8)), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc", min_size=1, max_size=4), x, max_size=4), max_leaves=12))
@settings(max_examples=150, deadline=None)
def test_objects_round_trip(value):
    assert pdf.Parser(writer.serialize(value)).value() == value


def test_reader_survives_damage(spark):
    good = writer.text_document(["Hello (world)\nline two", "Second"], "Ti\\tle")
    rng = random.Random(3)
    rows = [(0, bytearray(good)), (1, bytearray(b"")), (2, None), (3, bytearray(b"no document"))]
    for k in range(60):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 30)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows.append((10 + k, bad[: rng.randrange(len(bad))] if k % 2 else bad))
    files = spark.createDataFrame(rows, "doc_id long, content binary")
    docs = {r.doc_id: r for r in pdf.relation(files, "documents").collect()}
    assert len(docs) == len(rows) and docs[0].title == "Ti\\tle" and docs[0].page_count == 2 and docs[2].error and docs[0].error is None
    for what in ("xref", "objects", "doc_pages", "fragments"):
        assert pdf.relation(files, what).where("doc_id = 0").count() > 0
    assert [r.text for r in pdf.relation(files, "fragments").where("doc_id = 0").orderBy("page_index", "frag_index").collect()] == ["Hello (world)", "line two", "Second"]


def test_unicode_maps():
    cmap = b"2 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange"
    assert pdf.to_unicode(cmap) == {b"\x01": "A", b"\x02": "😀", b"\x10": "a", b"\x11": "b", b"\x12": "c", b"\x20": "x", b"\x21": "y"}


def test_page_errors(spark):
    p = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_index int")
    with pytest.raises(Exception, match="page range"):
        pages.page_range(p, 1, 2, strict=True).collect()
    with pytest.raises(Exception, match="as long as"):
        pages.reorder(p, spark.createDataFrame([(1, [0])], "doc_id long, order array<int>")).collect()
    assert [r.page_index for r in pages.reorder(p, spark.createDataFrame([(1, [1, 1])], "doc_id long, order array<int>")).orderBy("page_index").collect()] == [0, 1]
    with pytest.raises(ValueError):
        pages.n_up(p, 0, 1, 1, 1)


def test_search_places(spark):
    d = spark.createDataFrame([("aaaa Aa",), ("a.a a",), (None,), ("xaax aa",)], "t string")
    got = lambda *a, **k: [r.p for r in d.select(search.places(F.col("t"), *a, **k).alias("p")).collect()]
    assert got("aa") == [[0, 2], [], [], [1, 5]] and got("aa", ignore_case=True)[0] == [0, 2, 5] and got("a.a") == [[], [0], [], []] and got("aa", whole_word=True) == [[], [], [], [5]]
    r = spark.createDataFrame([("Café ﬁn − x",)], "t string").select(search.folded_places(F.col("t"), F.lit("fin - ")).alias("p")).first().p
    assert [(x.start, x.length) for x in r] == [(6, 5)]


def test_dedup_settles_on_chains(spark):
    rows = [(1, k, "x" if k else "end", [k - 1] if k else []) for k in range(6)] + [(1, 10 + k, "x" if k else "end", [9 + k] if k else []) for k in range(6)]
    out = objects.dedup_objects(spark.createDataFrame(rows, "doc_id long, obj_no int, value string, refs array<int>")).collect()
    assert all(r.keeper == r.obj_no % 10 for r in out)


def test_streaming_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(writer.text_document(["one a@b.cc"]))
    run = lambda: ingest.to_parquet(ingest.relations(spark, f"{tmp_path}/in", "fragments"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    (tmp_path / "in" / "b.pdf").write_bytes(writer.text_document(["two"]))
    run()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one a@b.cc", "two"]
    assert detection.findings(pdf.relation(pdf.read_files(spark, f"{tmp_path}/in"), "fragments").select("doc_id", "text"), detection.GENERAL).count() == 1


@pytest.mark.parametrize(("source", "want"), [
    ("var t = 0; for (var i = 1; i <= 4; i++) { if (i == 3) continue; t += i; } t", 7.0), ("'a' + 1 + 2", "a12"), ("1 + 2 * 3 - 4 / 2", 5.0), ("x > 2 ? 'big' : 'small'", "big"), ("'Hello'.substr(-3, 2)", "ll"), ("'Hello'.substring(4, 1)", "ell"),
    ("'a-b-c'.split('-')", "a"), ("'aXbX'.replace('X', '.')", "a.bX"), ("Math.round(-2.5)", -3.0), ("Math.max(1, x, 3)", 5.0), ("parseInt('12.9') + Number('1')", 13.0), ("isNaN('q')", True), ("null == 0 || 'else'", "else"), ("'abc'.toUpperCase().charAt(1)", "B"),
    ("var n = 0; while (true) { n++; if (n > 9) break; } n", 10.0), ("if (x === '5') { return 1; } return 2;", 2.0), ("name.length", 3.0), ("'abc'[2]", "c"), ("-x % 3", -2.0), ("!0 && 'y'", "y"), ("// note\n'a' /* b */ + 'c'", "ac"), ("1 / 0", math.inf),
])
def test_small_javascript(source, want):
    assert jsengine.run(source, {"x": 5, "name": "abc"})[0] == want


def test_javascript_ends(spark):
    for bad in ("while (1) {}", "f(1)", "(" * 300, "1 = 2", "{"):
        with pytest.raises(formcalc.ScriptError):
            jsengine.run(bad, {})
    d = spark.createDataFrame([(2.0, "b"), (None, "c")], "n double, s string")
    assert [r.v for r in d.select(jsengine.script_udf("s + n * 2", "n", "s").alias("v")).collect()][0] == "b4"


def test_search_in_long_texts(spark):
    """As many places as there are, in time linear in the text; neighbours decide about whole words."""
    text = "the other thethe _the the1 " * 10_000
    d = spark.createDataFrame([(text,), ("the",), ("x the",), ("é the",), ("éthe the",)], "t string")
    plain, whole = ([r.p for r in d.select(search.places(F.col("t"), "the", whole_word=w).alias("p")).collect()] for w in (False, True))
    assert plain[0] == [m.start() for m in re.finditer("the", text)] and plain[1:] == [[0], [2], [2], [1, 5]]
    assert whole[0] == [m.start() for m in re.finditer(r"(?<![^\W_])the(?![^\W_])", text)] and whole[1:] == [[0], [2], [2], [5]]
    dots = spark.createDataFrame([("a.a.. .",)], "t string").select(search.places(F.col("t"), ".", whole_word=True).alias("p")).first().p
    assert dots == [4, 6]


def test_reachable_over_chains(spark):
    """A long chain, a doubly linked one, a hub and a ring, none of which takes a round per object."""
    chain = [(1, k, k + 1) for k in range(1, 40)]
    both = [(2, k, k + 1) for k in range(1, 9)] + [(2, k + 1, k) for k in range(1, 9)]
    hub = [(3, 1, k) for k in range(2, 40)] + [(3, k, 1) for k in range(2, 40)] + [(3, 100, 101), (3, 101, 100), (3, 7, 7)]
    edges = spark.createDataFrame(chain + both + hub, "doc_id long, src int, dst int")
    roots = spark.createDataFrame([(1, 3), (2, 1), (3, 5), (4, 1)], "doc_id long, obj_no int")
    got = {(r.doc_id, r.obj_no) for r in objects.reachable(edges, roots).collect()}
    assert got == {(1, k) for k in range(3, 41)} | {(2, k) for k in range(1, 10)} | {(3, k) for k in range(1, 40)} | {(4, 1)}


def test_outlines_and_pages_by_large_ordinals(spark):
    rows = [(1, k, None, o, f"t{o}", 0) for k, o in enumerate([999_999, 1_000_000, 12_345_678, 2])]
    out = trees.outline(spark.createDataFrame(rows, "doc_id long, node_id int, parent_id int, ordinal long, title string, page_index int"))
    assert [r.title for r in out.orderBy("place").collect()] == ["t2", "t999999", "t1000000", "t12345678"]


def test_what_is_drawn_in_pieces_is_located(spark):
    """A number in runs that touch, with gaps, letter by letter with spaces, or over two lines; the same one once a page."""
    def row(page, k, text, x, y=700.0):
        return (1, page, k, text, x, y, 10.0, 5.0 * len(text))

    rows = [row(0, 0, "call 123-4", 50.0), row(0, 1, "5-6789", 100.0), row(1, 0, "on", 50.0), row(1, 1, "123-45-6789", 70.0), row(2, 0, "1 2 3 - 4 5 - 6 7 8 9", 50.0), row(3, 0, "123-45-", 50.0), row(3, 1, "6789", 50.0, 680.0), row(4, 0, "x123-45-6789", 50.0)]
    frags = spark.createDataFrame(rows, "doc_id long, page_index int, frag_index int, text string, x double, y double, font_size double, width double")
    notes = spark.createDataFrame([(1, 9, "123-45-6789 and 123-45-6789"), (1, 9, None)], "doc_id long, page_index int, contents string")
    got = search.located(frags, [detection.RULES["ssn"]], notes).collect()
    assert sorted((r.page_index, r.source, r.match) for r in got) == [(0, "text", "123-45-6789"), (1, "text", "123-45-6789"), (2, "text", "123-45-6789"), (9, "note", "123-45-6789")]
