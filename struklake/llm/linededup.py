"""Line deduplication by the spread over distinct sites.

A line that stands on SITES or more distinct sites is cross-site boilerplate and goes, wherever it
stands. Each line's sites are counted by HyperLogLog sketches, which tasks build and the
aggregation merges, so a line on millions of pages is one sketch a task. Sketches decide the clear
cases; lines whose estimate lies within the sketch's error of the threshold get an exact distinct
count.

The site of a document is its source. Lines are compared without surrounding spaces, by 96 bits of
hash. Defined results: empty lines stay; a null source is no site; null texts have no lines and
stay null; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from struklake.llm.common import drop_clashing, materialise

#: Distinct sites from which a line is boilerplate.
SITES = 10
#: log2 of the registers of a sketch, and its relative error.
LG_K, ERROR = 12, 1.04 / 64
#: Errors around the threshold within which lines are counted exactly.
SIGMAS = 4


def line_table(docs: DataFrame, site: str = "source") -> DataFrame:
    """One narrow row per non-empty line: row key, place, line key and site."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("row_id"), F.xxhash64("text").alias("text_key"),
        F.col(site).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"),
    ).withColumn("line", F.trim("line"))
    return lines.filter("line != ''").select(
        "row_id", "text_key", "place", F.xxhash64("line").alias("key"), F.crc32("line").alias("check"), "site"
    )


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(key, check) of the lines on at least `sites` distinct sites."""
    estimated = materialise(
        lines.filter("site is not null").groupBy("key", "check")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
        .filter(F.col("estimate") >= sites * (1 - SIGMAS * ERROR) - 1)
    )
    high = sites * (1 + SIGMAS * ERROR) + 1
    sure = estimated.filter(F.col("estimate") > high).select("key", "check")
    near = estimated.filter(F.col("estimate") <= high).select("key", "check")
    exact = (
        lines.join(near, ["key", "check"], "left_semi").groupBy("key", "check")
        .agg(F.count_distinct("site").alias("n")).filter(F.col("n") >= sites).select("key", "check")
    )
    return sure.unionByName(exact)


def without_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """`docs` with the boilerplate lines taken out of `text`, and n_lines and n_removed, which replace
    columns of these names."""
    docs = drop_clashing(docs, "n_lines", "n_removed")
    lines = materialise(line_table(docs, site))
    marked = (
        lines.join(materialise(spread_lines(lines, sites)), ["key", "check"], "left_semi")
        .groupBy("row_id", "text_key").agg(F.collect_set("place").alias("__places"))
        .withColumnsRenamed({"row_id": "__row", "text_key": "__key"})
    )
    keyed = docs.withColumns({
        "__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__text_key": F.xxhash64("text"),
    })
    all_lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__places"))
    # the lines are bound once, so that a text of many lines takes no more than one step for each
    kept = F.transform(F.array(all_lines), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))[0]
    text = F.when(F.col("__places").isNull(), F.col("text")).otherwise(kept)
    return keyed.join(
        marked, (F.col("__row_id") == F.col("__row")) & (F.col("__text_key") == F.col("__key")), "left"
    ).select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("n_removed"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: lines, removed lines and the SHA-256 of the text that stays."""
    return without_boilerplate(docs.select("doc_id", "text", "source")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH l AS (
    SELECT r, doc_id, source, absent, i, lines[i] AS line, trim(lines[i]) AS bare
    FROM (SELECT row_number() OVER () AS r, doc_id, source, text IS NULL AS absent, string_split(coalesce(text, ''), chr(10)) AS lines,
                 unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
b AS (SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {SITES})
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (NOT absent) AS n_lines, count(b.bare) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.bare IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b USING (bare) GROUP BY r"""
