"""Parcel and plot search with ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastre.functions.canonical import clean_search_text


def with_queries(table: DataFrame, queries: list[str]) -> DataFrame:
    """A literal list of query texts (bounded by its length in the program) exploded beside each row."""
    texts = F.array(*[F.lit(q) for q in queries])
    return table.withColumn("query", F.explode(texts)).withColumn("q", F.lower(F.trim("query"))).withColumn("clean_q", clean_search_text(F.col("query")))


def search_parcels(parcels: DataFrame, projects: DataFrame, queries: list[str], limit: int = 8, include_demo: bool = True) -> DataFrame:
    """Ranked matches per query with the total and whether more exist.

    Nine substring predicates; an exact parcel number first, then an exact survey number, then real
    projects before demo ones. ``parcels``: parcel_id, project_id, status, source, survey_no,
    features_text, comments, reviewer. The scan is one pass for all queries and ranks are cut to the
    limit before the shuffle; totals come from a separate partial aggregate.
    """
    proj = projects.select("project_id", F.lower("name").alias("p_name"), F.lower("location").alias("p_location"), F.lower("project_type").alias("p_type"), "is_demo")
    live = parcels.where(F.col("status").isNull() | (F.col("status") != "Deleted"))
    rows = with_queries(live.join(proj, "project_id", "left"), queries)
    pid = F.lower(F.col("parcel_id").cast("string"))
    bare = F.regexp_replace(F.regexp_replace(pid, "^pm-?", ""), "^plot-?", "")
    q = F.col("q")
    hit = bare.contains(F.col("clean_q"))
    for text in (pid, F.lower("status"), F.col("p_name"), F.col("p_location"), F.col("p_type"), F.lower("features_text"), F.lower("comments"), F.lower("reviewer")):
        hit = hit | F.coalesce(text, F.lit("")).contains(q)
    demo = F.coalesce("is_demo", F.lit(False))
    found = rows.where((q != "") & hit & (F.lit(include_demo) | ~demo)).withColumn("is_demo", demo)
    found = found.withColumn("exact_number", pid == F.col("clean_q")).withColumn("exact_survey", F.lower(F.coalesce("survey_no", F.lit(""))) == F.col("clean_q"))
    totals = found.groupBy("query").agg(F.count("*").alias("total"))
    order = [F.desc("exact_number"), F.desc("exact_survey"), F.asc("is_demo"), F.asc("parcel_id")]
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= limit)
    return top.join(totals, "query").withColumn("has_more", F.col("total") > limit)


def search_plots(plots: DataFrame, queries: list[str], limit: int = 12) -> DataFrame:
    """Plots by number, survey number (with and without slash), owner or village."""
    rows = with_queries(plots, queries)
    c, q = F.col("clean_q"), F.col("q")
    no, survey = F.lower(F.col("plot_no").cast("string")), F.lower("survey_no")
    hit = no.contains(c) | survey.contains(c) | F.regexp_replace(survey, "/", "").contains(c) | F.lower("owner").contains(q) | F.lower("village").contains(q)
    found = rows.where((q != "") & hit)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("plot_id"))).where(F.col("rank") <= limit)


def clean_plot_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "^plot-?", ""), "^parcel-?", ""))


def plot_by_id(plots: DataFrame, ids: DataFrame) -> DataFrame:
    """Plots by plot number, whatever prefix the request used."""
    wanted = ids.select("request_id", clean_plot_key(F.col("request")).alias("key"))
    return wanted.join(plots.withColumn("key", F.lower(F.col("plot_no").cast("string"))), "key")
