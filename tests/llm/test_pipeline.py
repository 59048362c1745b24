import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from quadrille.llm.decontaminate import remove_contaminated
from quadrille.llm.registry import QUERIES, SQL
from quadrille.session import read_table

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = read_table(spark, SF, "documents")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near duplicates", "decontamination", "mixing"]
    by_hand, counts = docs, [docs.count()]
    for _, stage in P.STAGES:
        by_hand = stage(spark, by_hand, SF).cache()
        counts.append(by_hand.count())
        if len(counts) < 6:
            assert by_hand.columns == docs.columns
    assert counts[0] > counts[1] and counts[1] == counts[2] and counts[2] > counts[3] > counts[4]
    run = P.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, by_hand.collect()))


def test_near_duplicate_stage_takes_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(2, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text + " more", "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = P.near_dup_stage(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text) == [("1", text), ("None", text)]
    assert got.count() == 4
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).isEmpty()


def test_no_text_is_lost_for_repeated_ids(spark):
    """Different texts of one id are documents of their own; only copies go, and only once each."""
    a, b, c = ("one two three four five six seven eight", "other words that share nothing with the first text", "a third text of its own with some more words in it")
    rows = [(5, None, "en", "s", 0), (5, a, "en", "s", 1), (5, b, "en", "s", 2), (5, b, "en", "z", 2), (3, a, "en", "s", 1), (7, c, "en", "s", 1), (7, b.upper(), "en", "s", 1), (7, " ", "en", "s", 1), (8, c, "en", "s", 1), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("near_extra", F.create_map(F.lit("k"), F.lit(1)))
    got = sorted(((r.doc_id, r.text) for r in P.near_dup_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(5, None), (3, a), (5, b), (7, " "), (8, c), (9, None)], key=str)
    item = " ".join(f"item{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(5, item, "x"), (5, "clean text", "y"), (None, item, "z"), (6, None, "w")], "doc_id bigint, text string, hit_more string")
    assert sorted(r.hit_more for r in remove_contaminated(docs, bench).collect()) == ["w", "y", "z"]


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)


def test_the_rest_imports_without_this_package(tmp_path):
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules.update({'quadrille.llm': None, 'corpus_pipeline': None}); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
