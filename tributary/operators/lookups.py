"""Lookups as joins: aliases, likest names, terms of a dictionary in texts, most frequent and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.dims import SKILL
from tributary.functions.similarity import indel_ratio, reachable, sorted_tokens

#: A dictionary of at most so many entries is broadcast; a larger one is shuffled.
MOST_BROADCAST = 100_000


def dictionary(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    """(alias, name, pos) of an alias table, in its order."""
    return spark.createDataFrame([(a, n, i) for i, (a, n) in enumerate(table.items())], "alias string, name string, pos int")


def small(dim: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The dimension with a broadcast hint if it has few enough rows, which is counted."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def by_alias(df: DataFrame, key: Column, dim: DataFrame) -> DataFrame:
    """df with ``name``: that of its key's alias, null without one."""
    found = small(dim).select(F.col("alias").alias("_alias"), "name")
    return df.withColumn("_key", F.lower(F.trim(key))).join(found, F.col("_key") == F.col("_alias"), "left").drop("_key", "_alias")


def grams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters; of a single character it alone."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))


def like_pairs(names: DataFrame, cutoff: float) -> DataFrame:
    """(left_name, right_name, ratio) of distinct names (a column name) whose ratio is the cutoff or more, each pair once, the lesser name first. Pairs meet by the character pairs they share, as in likest()."""
    if cutoff <= 200 / 3:
        raise ValueError("below 66.7 like strings need not share two neighbouring characters")
    own = names.select("name").distinct().withColumn("s", sorted_tokens(F.lower("name"))).withColumn("gram", F.explode(grams(F.col("s"))))
    x, y = own.select("gram", F.col("name").alias("left_name"), F.col("s").alias("a")), own.select("gram", F.col("name").alias("right_name"), F.col("s").alias("b"))
    pairs = x.join(y, "gram").where((F.col("left_name") < F.col("right_name")) & reachable(F.col("a"), F.col("b"), cutoff)).select("left_name", "right_name", "a", "b").distinct()
    return pairs.select("left_name", "right_name", indel_ratio(F.col("a"), F.col("b")).alias("ratio")).where(F.col("ratio") >= cutoff)


def likest(names: DataFrame, dim: DataFrame, cutoff: float = SKILL) -> DataFrame:
    """(key, name, score) of each distinct key without an exact alias: the likest alias from the cutoff on, the first of equals.

    Keys are made distinct first, so each is compared once however many rows
    have it. Candidates share a pair of neighbouring characters of their sorted
    tokens: at a ratio over 2/3 strings of two characters or more must, so the
    join is by equality and its size is that of the pairs that could be alike.
    """
    if cutoff <= 200 / 3:
        raise ValueError("below 66.7 like strings need not share two neighbouring characters")
    keys = names.select(F.lower(F.trim("key")).alias("key")).distinct().join(small(dim).select(F.col("alias").alias("key")), "key", "left_anti")
    a = keys.withColumn("ka", sorted_tokens(F.col("key"))).withColumn("gram", F.explode(grams(F.col("ka"))))
    b = dim.withColumn("kb", sorted_tokens(F.col("alias"))).withColumn("gram", F.explode(grams(F.col("kb"))))
    pairs = a.join(b, "gram").where(reachable(F.col("ka"), F.col("kb"), cutoff)).select("key", "ka", "kb", "name", "pos").distinct()
    rated = pairs.withColumn("score", indel_ratio(F.col("ka"), F.col("kb"))).where(F.col("score") >= cutoff)
    best = rated.groupBy("key").agg(F.max(F.struct("score", (-F.col("pos")).alias("rank"), "name")).alias("best"))
    return best.select("key", "best.name", "best.score")


#: Pieces between word boundaries: runs of word characters and runs of others.
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def terms_by_join(texts: DataFrame, dim: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term) of dictionary terms that stand in texts between word boundaries, whatever characters they hold and however long they are.

    Texts and terms are cut at word boundaries. Every piece of a text, with those
    after it, meets the terms that begin with it by equality, so cost follows the
    text and not text times dictionary.
    """
    pieces = lambda c: F.regexp_extract_all(F.lower(c), F.lit(PIECES), F.lit(0))
    terms = small(dim.select(F.lower("alias").alias("term"), pieces(F.col("alias")).alias("own")).distinct().select("term", F.get("own", F.lit(0)).alias("head"), F.size("own").alias("n")).where("n > 0"))
    longest = terms.agg(F.max("n")).first()[0] or 0
    # All pieces, and beside them those k further on: a slice per piece would copy the text each time.
    ahead = [F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - F.lit(k), F.lit(0))).alias(f"w{k}") for k in range(max(1, longest))]
    rows = texts.select(F.col(id_col).alias("id"), pieces(F.col(text_col)).alias("w")).select("id", *ahead)
    each = rows.select("id", F.explode(F.arrays_zip(*(f"w{k}" for k in range(max(1, longest))))).alias("at")).select("id", "at.*")
    met = each.join(terms, F.col("w0") == F.col("head"))
    run = F.concat_ws("", *(F.when(F.col("n") > k, F.col(f"w{k}")) for k in range(longest)))
    return met.where(run == F.col("term")).select("id", "term").distinct()


def first_of_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") == 1).drop("_rank")


def top_rows(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
