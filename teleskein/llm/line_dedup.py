"""Line dedup by spread over sites: a line found on many sites is boilerplate.

Every line (trimmed of white space) gets a 128-bit key. One aggregation per key builds a
HyperLogLog sketch of its distinct sites; sketches are partial per task and merged, so a line
that fills a third of the corpus is one sketch a task. Lines clearly below ``MIN_SITES`` are
done; the occurrences of all others are found in a second pass over the text. Lines clearly above
are boilerplate, and only those within the sketch's error of the threshold get an exact distinct
count, from the occurrences. Of each boilerplate line the occurrence with the
smallest (doc_id, position) stays; all others are removed, so nothing is lost from the corpus.

DataFrame operations only. The text is shuffled once, to meet the positions to drop.

Defined cases: a null or empty text has no lines and stays as it is; blank lines are never
boilerplate; a null site counts as one site of its own, a null doc_id comes after all others;
rows equal in doc_id and text are one document that is listed twice and come out alike; an
empty table gives an empty result; all columns of the caller are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleskein.llm.common import join_small, let, row_key, stored, wrapped

MIN_SITES = 10
LG_K = 12
# Bounds the sketch's relative error (1.04 / sqrt(2^LG_K)) with five deviations.
BAND = 5 * 1.04 / 2 ** (LG_K / 2)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(inner: DataFrame) -> DataFrame:
    """site, doc, at (row key), position and line key of every line that is not blank."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("")).alias("site")
    lines = inner.select(site, "doc", "at", "text").select("site", "doc", "at", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))
    return lines.withColumn("line", trimmed).filter("line <> ''").select("site", "doc", "at", "pos", row_key(F.col("line")).alias("key"))


def candidates(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key and sure of the lines that may have ``min_sites`` sites; where sure, they have."""
    sketched = rows.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    band = max(1.0, BAND * min_sites)
    return sketched.filter(F.col("estimate") >= min_sites - band).select("key", (F.col("estimate") > min_sites + band).alias("sure"))


def boilerplate(maybe: DataFrame, hits: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys of ``maybe`` with at least ``min_sites`` sites, by exact counts over their
    ``hits`` where the sketch leaves it open."""
    exact = (
        hits.filter("not sure")
        .groupBy("key", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count("*").alias("n_sites"))
        .filter(F.col("n_sites") >= min_sites)
    )
    return maybe.filter("sure").select("key").unionByName(exact.select("key"))


def dropped_lines(inner: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc, at and drop (the positions to remove) of every document that loses a line."""
    rows = line_rows(inner)
    maybe = stored(candidates(rows, min_sites), "line-sketch")
    hits = stored(join_small(rows, maybe, "key"), "line-hits")
    common = stored(boilerplate(maybe, hits, min_sites), "boilerplate")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "pos")
    firsts = stored(join_small(hits, common, "key").groupBy("key").agg(F.min(place).alias("first")), "line-firsts")
    later = join_small(hits, firsts, "key").filter(place > F.col("first"))
    return later.groupBy("doc", "at").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without boilerplate; text is replaced, all other columns stay."""
    return cleaned(docs, site, min_sites).select("row.*")


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``row`` with the text replaced, and beside it ``n_lines`` and ``n_removed``."""
    inner = wrapped(docs, doc="doc_id", text="text", site=site)
    inner = inner.withColumn("at", row_key(F.col("doc"), F.col("text")))
    drops = dropped_lines(inner, min_sites).withColumnRenamed("doc", "drop_doc").withColumnRenamed("at", "drop_at")
    met = inner.join(drops, (F.col("at") == F.col("drop_at")) & F.col("doc").eqNullSafe(F.col("drop_doc")), "left")
    lines = split_lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    # split once for the whole document, not once for each line that stays
    kept = F.array_join(let(lines, lambda own: F.transform(stay, lambda i: F.get(own, i))), "\n")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept)
    return met.select(
        F.col("row").withField("text", text).alias("row"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"),
    )
