"""From checked rows to nodes and edges: what loaders of transfers, token transfers, trades and addresses write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Kinds of activity and the edges that they become (fixed values).
EDGE_OF = {"send": "SENT", "receive": "RECEIVED", "mint": "MINTED", "burn": "BURNED", "swap": "SWAPPED", "approve": "APPROVED", "call": "CALLED"}


def endpoints(t: DataFrame, *columns: str, label: str = "Address") -> DataFrame:
    """(id, label): each value of the columns once; nulls are no nodes."""
    return t.select(F.explode(F.array(*columns)).alias("id")).filter("id is not null").distinct().withColumn("label", F.lit(label))


def edges(t: DataFrame, kind: str, src: str, dst: str, key: str, value: str) -> DataFrame:
    """(kind, src, dst, key, value): one edge for each key, the one of largest value where a key comes again; ends may not be null."""
    rows = t.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    once = rows.groupBy(key).agg(F.max(F.struct(F.col(value).alias("v"), F.col(src).alias("s"), F.col(dst).alias("d"))).alias("x"))
    return once.select(F.lit(kind).alias("kind"), F.col("x.s").alias("src"), F.col("x.d").alias("dst"), F.col(key).alias("key"), F.col("x.v").alias("value"))


def relations(t: DataFrame, kind: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(kind, src, dst): the distinct pairs of several pairs of columns, without nulls."""
    both = F.explode(F.array(*[F.struct(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst")) for a, b in pairs])).alias("p")
    return t.select(both).select(F.lit(kind).alias("kind"), "p.src", "p.dst").filter("src is not null and dst is not null").distinct()


def routed(t: DataFrame, kind: str) -> DataFrame:
    """t with edge: what an activity becomes, CALLED for any other; one pass over the rows."""
    found = F.lit("CALLED")
    for name, edge in EDGE_OF.items():
        found = F.when(F.lower(F.col(kind)) == name, edge).otherwise(found)
    return t.withColumn("edge", found)


def with_properties(t: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, properties): a map of the columns that aren't null, as texts; of rows with one id the later name wins by value."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]), lambda e: e["value"].isNotNull())
    return t.select(F.col(id_col).alias("id"), F.map_from_entries(pairs).alias("properties"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new in place of all of old's rows of its keys (documents that are chunked anew)."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def node_texts(nodes: DataFrame, id_col: str, label_col: str, columns: list[str]) -> DataFrame:
    """(id, text): a node as a line of its label, id and properties that aren't null, in order of name."""
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in sorted(columns)]))
    return nodes.select(F.col(id_col).alias("id"), F.concat(F.col(label_col), F.lit(" "), F.col(id_col), F.lit(" ("), F.array_join(parts, ", "), F.lit(")")).alias("text"))


def first_few(df: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """(key, text): the n smallest distinct values of a key, then how many more there are.

    Values are ranked by counting, with a window over distinct pairs, so that only n of each key are gathered.
    """
    from pyspark.sql import Window

    pairs = df.select(key, value).distinct()
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    g = ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col(value)))), lambda x: x.cast("string")), ", ").alias("_few"), F.count("*").alias("_n"))
    more = F.when(F.col("_n") > n, F.concat(F.lit(" and "), (F.col("_n") - n).cast("string"), F.lit(" more"))).otherwise("")
    return g.select(key, F.concat("_few", more).alias("text"))


def top_entries(df: DataFrame, key: str, entry: str, amount: str, n: int = 10) -> DataFrame:
    """(key, entries): the n entries of largest amount as entry=amount, ties to the smaller entry."""
    from pyspark.sql import Window

    sums = df.groupBy(key, entry).agg(F.sum(amount).alias("_a"))
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_a"), entry))).filter(F.col("_r") <= n)
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", entry))), lambda x: x[entry]), ",").alias("entries"))
