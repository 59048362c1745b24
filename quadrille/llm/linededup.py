"""Line dedup by distinct-site spread.

A line's spread is the number of sites (``source``) that it stands on, over all documents. HyperLogLog sketches of
the sites, one per line hash, merge by aggregation. Lines whose estimate is clearly over ``min_sites`` are
boilerplate, those clearly under it are not, and those within BAND standard errors get an exact distinct count.
Boilerplate lines are removed wherever they stand, but for their first occurrence (smallest doc_id, then place), so
that no content leaves the corpus altogether. With ``spare_copies`` the first occurrence stays in all whole copies
of the text that has it: for pipelines that drop copies later. Texts meet no shuffle but the one that brings
removals to their documents.

Defined results: lines are split at line feeds and compared without the spaces around them; blank lines are
kept and count for nothing; a null source is no site; null or empty texts stay as they are; a document that
loses all lines keeps its row, with an empty text; a null doc_id is left as it is, but its site counts; repeated rows
are cleaned alike; an empty table gives an empty result; other columns go through, those named like ours are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.tables import checkpointed

MIN_SITES = 6
#: log2 of a sketch's registers; standard errors around the threshold that are counted exactly.
LG_K, BAND = 10, 5
BROADCAST_LINES = 100_000


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, site, the text's hash and the hashes of its lines (null: blank) of every document with a text."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))
    return docs.where("text IS NOT NULL").select("doc_id", F.col("source").cast("string").alias("site"), F.xxhash64("text").alias("t"), lines.alias("lines"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line) hashes on at least ``min_sites`` sites, of ``line_table`` rows."""
    sited = lines.where("site IS NOT NULL").select("site", F.explode(F.array_distinct("lines")).alias("line")).where("line IS NOT NULL")
    spread = sited.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_sites)
    spread = checkpointed(spread.select("line", F.hll_sketch_estimate("sites").alias("sites")))
    margin = BAND * 1.04 / 2 ** (LG_K / 2) * min_sites
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("line")
    sure = spread.where(F.col("sites") > min_sites + margin).select("line")
    # (line, site) pairs are combined before the shuffle, so a line of many documents is no hot group
    pairs = sited.join(_bounded(near), "line", "left_semi").distinct()
    return sure.unionAll(pairs.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line"))


def _bounded(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if there are at most BROADCAST_LINES rows; else joined by shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else rows


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """``docs`` with cleaned ``text``, and ``n_lines``, ``n_removed``."""
    docs = docs.drop("n_lines", "n_removed")
    lines = checkpointed(line_table(docs))
    common = _bounded(checkpointed(boilerplate(lines, min_sites)))
    placed = lines.where("doc_id IS NOT NULL").select("doc_id", "t", F.posexplode("lines").alias("place", "line")).join(common, "line")
    first = checkpointed(placed.groupBy("line").agg(F.min(F.struct("doc_id", "place", "t")).alias("first")))
    stays = (F.col("t") == F.col("first.t")) & (F.col("place") == F.col("first.place"))
    if not spare_copies:
        stays = stays & (F.col("doc_id") == F.col("first.doc_id"))
    gone = placed.join(_bounded(first), "line").where(~stays)
    removals = gone.groupBy("doc_id", F.col("t").alias("removal_of")).agg(F.sort_array(F.collect_set("place")).alias("gone"))
    told = removals.withColumnRenamed("doc_id", "removal_id")
    both = docs.join(told, (F.col("doc_id") == F.col("removal_id")) & (F.xxhash64("text") == F.col("removal_of")), "left")
    # as columns of their own: inside the lambda they would be made again for every run
    both = both.withColumn("removal_lines", F.split(F.col("text"), "\n"))
    both = both.withColumn("removal_ends", F.when(F.col("gone").isNotNull(), F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("removal_lines")))))
    end = lambda k: F.get("removal_ends", k)
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("removal_lines", end(k) + 2, end(k + 1) - end(k) - 1))  # lines between removed places
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("removal_lines")).cast("bigint")
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint")
    return both.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op10_site_spread(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = f"""
WITH common AS (
  SELECT line FROM (SELECT source AS site, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS raw FROM parts),
marked AS (SELECT p.*, c.line, row_number() OVER (PARTITION BY c.line ORDER BY doc_id, place) AS nth FROM placed p LEFT JOIN common c ON trim(p.raw) = c.line)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line IS NOT NULL AND nth > 1) AS n_removed,
    string_agg(raw, chr(10) ORDER BY place) FILTER (line IS NULL OR nth = 1) AS text
  FROM marked GROUP BY doc_id) m USING (doc_id)
"""
