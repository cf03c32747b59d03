"""Catalogue operators: merging, deduplication, unique-name joins, listings, records, link maps.

Keys are aggregated before they are joined, and every ordered list is sorted inside its row, so results
do not depend on partitioning. Catalogues are joined as they are: the engine broadcasts the small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import text as T


def merge_subjects(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the first row's values, mentions united in order, blank year and term filled by later rows."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "name", "kind", "ects", "year", "term", "mentions")))
    filled = lambda f: F.coalesce(F.get(F.filter(F.transform("r", lambda x: x[f]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0)), F.lit(""))
    first = lambda f: F.element_at("r", 1)[f].alias(f)
    mentions = F.array_distinct(F.flatten(F.transform("r", lambda x: x["mentions"]))).alias("mentions")
    return rows.groupBy(*keys).agg(ordered.alias("r")).select(*keys, first("name"), first("kind"), first("ects"), filled("year").alias("year"), filled("term").alias("term"), mentions)


def dedup_units(rows: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Equal keys as one unit with its members in order; hashed first, so long texts are shuffled once."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(identity)).alias("members"))


def assemble_text(fallback: Column, general: Column, summary: Column, contents: Column) -> Column:
    """The general body of a fallback guide, else summary and contents, empty parts left out."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.when(fallback, F.coalesce(general, F.lit(""))).otherwise(F.concat_ws("\n\n", blank(summary), blank(contents)))


def attach_by_unique_name(left: DataFrame, right: DataFrame, name: str = "name", key: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(attached, ambiguous): rows of ``left`` with the one unit of ``right`` of that name.

    Names are compared normalised; a trailing acronym in parentheses is dropped only where nothing matched.
    """
    names = right.select(T.normalize(F.col(name)).alias("_n"), F.col(key)).groupBy("_n").agg(F.count_distinct(key).alias("_c"), F.min(key).alias(key))
    lone = left.withColumn("_n", T.normalize(F.col(name)))
    first = lone.join(names, "_n", "left")
    hit, miss = first.where("_c is not null"), first.where("_c is null").drop("_c", key)
    bare = miss.withColumn("_n", T.normalize(F.regexp_replace(F.col(name), "[ \\t]*\\([A-Z]{2,8}\\)[ \\t]*$", "")))
    again = bare.join(names, "_n")
    both = hit.unionByName(again)
    return both.where("_c = 1").drop("_n", "_c"), both.where("_c > 1").drop("_n", "_c", key)


def split_by_plan(members: DataFrame, records: DataFrame, keys: list[str], unit: str, degree: str) -> DataFrame:
    """The degrees of each unit, apart by what their records say; degrees without a record are one group."""
    facts = ["kind", "ects", "year", "term"]
    both = members.join(records.select(*keys, *facts), keys, "left")
    return both.groupBy(unit, *facts).agg(F.array_sort(F.collect_set(degree)).alias("degrees"))


def ordered_degrees(rows: DataFrame, unit: str, degree: str, code: str, double: str) -> DataFrame:
    """Parallel arrays of degrees and codes, double degrees last; an absent code is empty."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(double).alias("d"), F.col(degree).alias("g"), F.coalesce(F.col(code).cast("string"), F.lit("")).alias("c"))))
    return rows.groupBy(unit).agg(pairs.alias("p")).select(unit, F.transform("p", lambda x: x["g"]).alias("degrees"), F.transform("p", lambda x: x["c"]).alias("codes"))


def plan_listing(subjects: DataFrame) -> DataFrame:
    """Per degree, group and year: count and names in order."""
    group = F.when(F.upper("kind") == "OP", "optativas").otherwise("obligatorias")
    return subjects.withColumn("grp", group).groupBy("degree", "grp", "year").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"))


def degree_records(degrees: DataFrame, subjects: DataFrame) -> DataFrame:
    """Totals, duration and mentions of every degree; one without subjects gets a notice."""
    sums = subjects.groupBy("degree").agg(
        F.count("*").alias("total"), F.count_if(F.upper("kind") != "OP").alias("obligatory"), F.count_if(F.upper("kind") == "OP").alias("elective"),
        F.max(T.highest_year(F.col("year"))).alias("duration"), F.count_distinct("mention").alias("mentions"),
    )
    out = degrees.select("degree").join(sums, "degree", "left")
    return out.select("degree", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "obligatory", "elective", "duration", "mentions")], F.when(F.col("total").isNull(), "sin asignaturas publicadas").alias("notice"))


def distinctive_words(catalogue: DataFrame, name: str = "name") -> DataFrame:
    """Words of four letters or more in fewer than half of the names."""
    n = catalogue.agg(F.count("*").alias("_n"))
    words = catalogue.select(F.explode(T.tokens(F.col(name))).alias("word")).groupBy("word").agg(F.count("*").alias("names"))
    return words.crossJoin(F.broadcast(n)).where((F.col("names") < F.col("_n") / 2) & (F.char_length("word") >= 4)).drop("_n")  # one row


def unambiguous_links(links: DataFrame, keys: list[str], url: str) -> DataFrame:
    """Keys with one url only."""
    return links.groupBy(*keys).agg(F.count_distinct(url).alias("_c"), F.min(url).alias(url)).where("_c = 1").drop("_c")


def first_seen(rows: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in a group."""
    w = Window.partitionBy(group, *keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    left = a.select(*keys).distinct()
    right = b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("missing")).union(right.join(left, keys, "left_anti").withColumn("side", F.lit("extra")))
