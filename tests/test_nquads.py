"""N-Quads read and written by column expressions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.functions import terms as T
from quadrille.operators import quads as Q
from quadrille.sources import nquads

TEXT = r"""# a comment with <a> <b> <c> .

<urn:a> <urn:p> <urn:b> <urn:g> .
_:x <urn:p> _:y.z . # after
<urn:a><urn:p>"say \"hi\" \\ \t \u00e9 \U0001F600 \'"@en-GB<urn:g>.
<urn:a> <urn:p> ""^^<http://www.w3.org/2001/XMLSchema#string> _:h .
<urn:a\u00e9> <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .
<urn:a> <urn:p> <urn:b> <urn:g> .
"""


def test_read(spark, tmp_path):
    (tmp_path / "a.nq").write_text(TEXT)
    got = {tuple(r) for r in nquads.read(spark, str(tmp_path), "d").collect()}
    assert got == {
        ("urn:g", "urn:a", "urn:p", "urn:b", 1, 1, None, None, False),
        ("d", "x", "urn:p", "y.z", 2, 2, None, None, False),
        ("urn:g", "urn:a", "urn:p", "say \"hi\" \\ \t é 😀 '", 1, 3, None, "en-GB", False),
        ("_:h", "urn:a", "urn:p", "", 1, 3, None, None, False),
        ("urn:g", "urn:aé", "urn:p", "5", 1, 3, T.XSD + "integer", None, False),
    }


@pytest.mark.parametrize("line", ["<a> <b> .", "<a> b <c> .", '<a> <b> "c .', '"a" <b> <c> .', "<a> <b> <c>", '<a> <b> "c"@ .'])
def test_what_is_no_statement(spark, line):
    rows = spark.createDataFrame([(line,), ("",), ("# fine",)], "value string")
    assert [r.value for r in nquads.faults(rows).collect()] == [line]
    with pytest.raises(Exception, match="no statement"):
        nquads.parse(rows, "d").count()


def test_long_and_no_lines(spark, tmp_path):
    long = 'x\\"' * 300_000
    rows = spark.createDataFrame([(f'<a> <b> "{long}" .',)], "value string")
    assert nquads.parse(rows, "d").first().o == 'x"' * 300_000
    assert nquads.parse(rows.limit(0), "d").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=20, unique=True))
def test_round_trip(spark, texts):
    rows = [("g", "urn:a", "urn:p", t, 1, 3, T.XSD + "token" if n % 2 else None, None, False) for n, t in enumerate(texts)]
    quads = spark.createDataFrame(rows, Q.SCHEMA)
    text = nquads.lines(quads)
    assert all("\n" not in r.value and "\r" not in r.value for r in text.collect())
    assert {tuple(r) for r in nquads.parse(text, "d").collect()} == set(rows)


def test_folder_round_trip_and_stream(spark, tmp_path):
    rows = [("g1", "b", "urn:p", "a\nb\rc", 2, 3, None, "de", False), ("_:g2", "urn:a", "urn:p", "b", 1, 2, None, None, False)]
    quads = spark.createDataFrame(rows, Q.SCHEMA)
    nquads.write(quads, str(tmp_path / "out"))
    assert {tuple(r) for r in nquads.read(spark, str(tmp_path / "out")).collect()} == set(rows)
    stream = nquads.parse(spark.readStream.text(str(tmp_path / "out")), "d")
    q = stream.writeStream.format("memory").queryName("nq").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.table("nq").count() == 2


def test_one_pass_a_line(spark):
    texts = ['<a> <b> "x\ny" <g> . # c\r', "<a> <b> <c> .\n", "# none", " <a><b>_:c.d _:g."]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    quads = nquads.parse(rows, "d")
    assert [tuple(r)[:4] for r in quads.collect()] == [("g", "a", "b", "x\ny"), ("d", "a", "b", "c"), ("_:g", "a", "b", "c.d")]
    plan = quads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract(" not in plan, plan
