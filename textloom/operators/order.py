"""Order-dependent operators: positions, neighbours, progress, gaps, numbering. One window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, part: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Rows strictly before, in the partition: ties share a position (rank, not row number)."""
    return df.withColumn(name, (F.rank().over(Window.partitionBy(*part).orderBy(*order)) - 1).cast("long"))


def neighbours(df: DataFrame, part: list[str], order: list[Column], value: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumns({f"prev_{value}": F.lag(value).over(w), f"next_{value}": F.lead(value).over(w)})


def adjacent(df: DataFrame, part: list[str], order: list[Column], value: str) -> DataFrame:
    """Previous then next, without the missing ones."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("adjacent", F.array_compact(F.array(F.lag(value).over(w), F.lead(value).over(w))))


def progress(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    from textloom.functions.scalars import percent

    total = F.count(F.lit(1)).over(Window.partitionBy(*part))
    return positions(df, part, order).withColumn("percent", percent(F.col("position"), total))


def carry_forward(df: DataFrame, part: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gaps(df: DataFrame, part: list[str], number: str) -> DataFrame:
    """One row for each number missing between consecutive distinct ones."""
    w = Window.partitionBy(*part).orderBy(number)
    rows = df.select(*part, number).distinct().withColumn("_before", F.lag(number).over(w)).where(F.col(number) > F.col("_before") + 1)
    return rows.select(*part, F.explode(F.sequence(F.col("_before") + 1, F.col(number) - 1)).alias("missing"))


def dense_violations(df: DataFrame, part: list[str], order: list[Column], ordinal: str) -> DataFrame:
    expected = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn("expected", expected).where(F.col(ordinal) != F.col("expected"))


def occurrence_suffix(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """occurrence, suffix ('' for the first, b for the second), and whether it exceeds the alphabet."""
    n = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    df = df.withColumn("occurrence", n)
    suffix = F.when(F.col("occurrence") == 1, "").when(F.col("occurrence") <= 26, F.char(F.col("occurrence") + 96))
    return df.withColumn("suffix", suffix).withColumn("failed", F.col("occurrence") > 26)


def running_offsets(df: DataFrame, part: list[str], order: list[Column], size: str) -> DataFrame:
    """Half-open [first, last) of each row in the concatenation of its partition."""
    last = F.sum(size).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("last", last).withColumn("first", F.col("last") - F.col(size))


def first_rows(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where("_n = 1").drop("_n")


def most_recent(df: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Distinct keys by latest use, newest first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias(at)).orderBy(F.col(at).desc(), key).limit(most)


def renumbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 1 without gaps within their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def ids_or_null(rows: DataFrame, group: list[str], id_col: str, name: str = "ids") -> DataFrame:
    """Sorted ids of a group that are not null; null, not an empty list, where there is none."""
    ids = F.array_sort(F.collect_set(id_col))
    return rows.groupBy(*group).agg(F.when(F.size(ids) > 0, ids).alias(name))


def ordered_union(a: Column, b: Column) -> Column:
    """Members of a, then those of b that are not in a; nulls count as empty lists."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def without(listed: Column, one: Column) -> Column:
    """The list without any member equal to ``one``, order kept."""
    return F.filter(listed, lambda x: ~x.eqNullSafe(one))


def printed_key(col: Column) -> Column:
    """Sort key of a printed number with a letter ("12", "12b"): numbers, then letters; what can't be read comes last."""
    number = F.regexp_extract(col, r"^\s*(\d+)\s*([a-z]?)\s*$", 1).try_cast("long")
    return F.struct(number.isNull().alias("unread"), number.alias("number"), F.regexp_extract(col, r"^\s*(\d+)\s*([a-z]?)\s*$", 2).alias("letter"), col.alias("text"))


def union_of_lists(rows: DataFrame, group: list[str], listed: str, name: str) -> DataFrame:
    """The distinct members of all lists of a group, sorted; an empty list where there is none."""
    return rows.groupBy(*group).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(listed)))).alias(name))


def repeated(rows: DataFrame, key: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """The keys that several rows share, with their number ``n`` and ``first`` id; and the rows (key, id) that share them. Members
    stay rows, so a key that most rows have is no group of its own."""
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")).where("n > 1")
    return groups, rows.select(*key, id_col).join(groups.select(*key), key, "left_semi")
