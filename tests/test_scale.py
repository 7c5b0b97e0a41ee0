"""That work is spread over tasks and done once, whatever the tables' files, and that nothing of theirs goes through the driver."""

from pyspark.sql import functions as F

from pagemill.functions import formcalc, jsengine
from pagemill.plans import casebook, content, forms
from pagemill.sources import xfa
from tests import oracle


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tasks(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


def test_references_are_not_joined_by_broadcast(spark):
    said = plan(forms.QUERIES["fn_xfa_resolve"](spark, oracle.SF))
    assert "Broadcast" not in said and "Join" not in said
    assert said.count("MapInArrow") == 2  # templates are read once


def test_odd_references(spark):
    nodes = spark.createDataFrame([(1, 0, "subform", "f", "f"), (1, 1, "subform", "a", "f.a"), (1, 2, "field", "x", "f.a.x"), (1, 3, "field", "x", "f.x"), (1, 4, "field", None, ""), (None, 0, "field", "x", "x")], "doc_id long, node_id int, kind string, name string, path string")
    asked = spark.createDataFrame([(1, "x", None, 7), (1, "a.x.rawValue", "f", 8), (1, "b.x", "f", 9), (1, None, "f.a", 1), (1, "no", None, 2), (2, "f", None, 3), (None, "x", None, 4), (1, "$form.f.x", None, 5)], "doc_id long, ref string, context string, more int")
    out = {r.more: (r.doc_id, r.found, r.how) for r in xfa.resolved(asked, nodes).collect()}
    assert out == {7: (1, "f.a.x", "subform"), 8: (1, "f.a.x", "context"), 9: (1, "f.a.x", "leaf"), 1: (1, "f.a", "context"), 2: (1, None, None), 3: (2, None, None), 4: (None, None, None), 5: (1, "f.x", "root")}


def test_pictures_are_dealt_to_tasks(spark):
    assert tasks(forms.QUERIES["src_image_decode"](spark, oracle.SF)) >= 4


def test_image_files_are_made_and_read_once(spark):
    assert plan(forms.QUERIES["sink_image_to_pdf"](spark, oracle.SF)).count("MapInArrow") == 2


def test_pictures_are_compared_by_blocks_of_all_sizes():
    """Edges that are no whole block count as one: the mean over blocks, each by itself."""
    import numpy as np

    from pagemill.functions.images import Frame, alike

    made = np.random.default_rng(3)
    a, b = (made.integers(0, 256, (19, 11, 3)).astype(np.uint8) for _ in range(2))
    each = [alike(Frame(a[i : i + 8, j : j + 8]), Frame(b[i : i + 8, j : j + 8])) for i in (0, 8, 16) for j in (0, 8)]
    assert abs(alike(Frame(a), Frame(b)) - sum(each) / 6) < 1e-12 and alike(Frame(a), Frame(a)) == 1


def test_findings_open_each_file_once(spark):
    for name, steps in (("qa_pdfa", 2), ("sink_pdfa", 3)):
        assert plan(casebook.QUERIES[name](spark, oracle.SF)).count("MapInArrow") == steps


def test_relations_are_those_of_one_each(spark):
    files = content.files(spark, oracle.SF).limit(5).unionByName(spark.createDataFrame([(-1, bytearray(b"none"))], "doc_id long, content binary"))
    from pagemill.sources import pdf

    names = ["doc_pages", "documents", "fragments"]
    rows = pdf.relations(files, names).localCheckpoint()
    for n in names:
        one = pdf.relation(files, n)
        got = rows.where(F.col(n).isNotNull()).select("doc_id", f"{n}.*")
        assert got.columns == one.columns and sorted(map(str, got.collect())) == sorted(map(str, one.collect()))


def test_what_a_file_says_of_its_length_never_fits():
    """The parameters that case files begin with are made up; the number of one was its length by chance."""
    roles = ["user", "assistant"]
    by_chance = [d for d in range(2000, 6000, 2) if len(casebook.case_file(d, roles)) in (d, d + 1)]
    assert by_chance and all(len(casebook.case_file(d, roles)) != d for d in by_chance)


def test_scripts_are_parsed_once():
    """Forms share their scripts; the last sources' statements and errors are kept."""
    import pytest

    for engine in (formcalc, jsengine):
        calls = []
        known = formcalc.remembered(lambda s, p=engine.parse: calls.append(s) or p(s))
        assert known("1 + 1;") is known("1 + 1;") and len(calls) == 1
        for _ in range(2):
            with pytest.raises(formcalc.ScriptError):
                known("x = ((")
        assert len(calls) == 2


def test_templates_are_dealt_to_tasks(spark):
    assert tasks(forms.templates(spark, oracle.SF)) >= 4


def test_trees_read_their_input_once(spark, tmp_path):
    """Each level of the recursion ran the Python that made its input anew."""
    from pagemill.operators import trees

    seen = str(tmp_path / "seen")

    def told(batches):
        for batch in batches:
            with open(seen, "a") as f:
                f.write("x" * len(batch))
            yield batch

    ddl = "doc_id long, field_id int, parent_id int, ordinal int, partial_name string, type string, flags int, max_len int"
    rows = spark.createDataFrame([(1, 0, None, 0, "a", "Tx", 0, None), (1, 1, 0, 0, "b", None, None, None), (1, 2, 1, 0, "c", None, None, None)], ddl)
    assert sorted(r.full_name for r in trees.form_fields(rows.mapInPandas(told, ddl)).collect()) == ["a", "a.b", "a.b.c"]
    assert len(open(seen).read()) == 3


def test_changed_files_are_made_once(spark):
    for name in ("red_doc_scrub", "agg_minify"):
        said = plan(casebook.QUERIES[name](spark, oracle.SF))
        assert said.count("MapInArrow") == 3 and "Join" not in said


def test_files_are_signed_as_they_are_written(spark):
    assert plan(casebook.QUERIES["sig_verify"](spark, oracle.SF)).count("MapInArrow") == 3


def test_pages_are_laid_out_without_data_frames(spark):
    said = plan(content.QUERIES["ord_arrange"](spark, oracle.SF))
    assert "FlatMapGroupsInPandas" not in said


def test_stamps_go_on_pages_in_one_pass(spark):
    from pagemill.plans import layout

    for name in ("set_overlay", "set_flatten_annots"):
        said = plan(layout.QUERIES[name](spark, oracle.SF))
        assert said.count("MapInArrow") == 2 and "Join" not in said


def test_script_runs_take_no_time_by_character():
    """Runs of odd texts, and a long one in a moment."""
    import time

    from pagemill.functions import paths

    assert paths._runs("..a b. бв .") == [{"start": 0, "length": 7, "script": "Latin"}, {"start": 7, "length": 4, "script": "Cyrillic"}]
    assert paths._runs(" ..") == [{"start": 0, "length": 3, "script": "Common"}] and paths._runs(None) == paths._runs("") == []
    began = time.process_time()
    assert len(paths._runs("Ein Wort, und слово. " * 100_000)) == 200_000
    assert time.process_time() - began < 3


def test_codecs_take_rows_one_by_one():
    """A batch's values were all Python's at once."""
    from pyspark.util import PythonEvalType

    from pagemill.functions import codecs

    assert codecs.chain.evalType == codecs.deflate.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert codecs.hex_decode(b"4 1\n4zg2>5") == b"AB" and codecs.hex_decode(b"4") == b"@"
