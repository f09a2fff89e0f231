"""Retrieval: nearest vectors by cosine, keyword search, reranking, chunks of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Vectors of a block.
BLOCK = 5_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(items: DataFrame, query: DataFrame, k: int, least: float, tag: str | None = None, blocks: int | None = None) -> DataFrame:
    """(qid, rank, id, similarity): rows of items (id, v, optionally a tag) nearest to each query (qid, qv) by cosine: the k best, and of those the ones over least.

    A stated set of queries meets all items in blocks: both are dealt to blocks by a hash, each pair of blocks of one tag is a
    group, and a group hands on the k best of each of its queries. Nothing is broadcast, and no task holds more than two blocks. blocks:
    how many for each tag; without, as many as its items need for BLOCK in one.
    Vectors that are null, of no length or of another length than the query's have no similarity. Ties go to the smaller id.
    """
    import numpy as np
    import pyarrow as pa

    n = F.col("_n")
    part = lambda c: F.pmod(F.xxhash64(c), n).cast("int")
    tag_of = lambda c: F.col(c) if c else F.lit(0)
    cuts = items.filter("v IS NOT NULL").groupBy(tag_of(tag).alias("_t")).agg((F.ceil(F.count("*") / BLOCK) if blocks is None else F.lit(blocks)).cast("int").alias("_n"))
    at = lambda df, c: df.join(cuts, tag_of(c) == F.col("_t"))
    x = at(items.filter("v IS NOT NULL"), tag).select(tag_of(tag).alias("tag"), part("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), F.lit(0).alias("role"), F.col("id").cast("long").alias("id"), F.transform("v", lambda e: e.cast("double")).alias("v"))
    q = at(query.filter("qv IS NOT NULL"), f"q{tag}" if tag else None).select(tag_of(f"q{tag}" if tag else None).alias("tag"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), part("qid").alias("j"), F.lit(1).alias("role"), F.col("qid").cast("long").alias("id"), F.transform("qv", lambda e: e.cast("double")).alias("v"))

    def best(group: pa.Table) -> pa.Table:
        role = group.column("role").to_numpy()
        out: list[tuple[int, int, float]] = []
        sides = [group.filter(pa.array(role == r)) for r in (0, 1)]
        by_size: list[dict[int, list[tuple[int, list]]]] = [{}, {}]
        for side, found in zip(sides, by_size, strict=True):
            for i, v in zip(side.column("id").to_pylist(), side.column("v").to_pylist(), strict=True):
                if v and None not in v:
                    found.setdefault(len(v), []).append((i, v))
        for size, asked in by_size[1].items():
            own = by_size[0].get(size, [])
            if not own:
                continue
            ids = np.array([i for i, _ in own])
            m = np.array([v for _, v in own])
            lengths = np.sqrt((m * m).sum(axis=1))
            for qid, v in asked:
                w = np.array(v)
                with np.errstate(all="ignore"):
                    sim = np.round((m @ w) / (lengths * np.sqrt(w @ w)), 6)
                good = np.flatnonzero(np.isfinite(sim))
                top = good[np.lexsort((ids[good], -sim[good]))[:k]]
                out += [(qid, int(ids[t]), float(sim[t])) for t in top]
        return pa.table({"qid": pa.array([o[0] for o in out], pa.int64()), "id": pa.array([o[1] for o in out], pa.int64()), "similarity": pa.array([o[2] for o in out], pa.float64())})

    s = x.unionByName(q).groupBy("tag", "i", "j").applyInArrow(best, "qid long, id long, similarity double")
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return s.withColumn("rank", r).filter((F.col("rank") <= k) & (F.col("similarity") >= least)).select("qid", "rank", "id", "similarity")


def terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0))


def keyword_search(docs: DataFrame, query: str, id_col: str, text_col: str, k: int) -> DataFrame:
    """.9 where the text contains the query, else .5 and .4 of the share of its words that the text has; the best k."""
    words = terms(F.lit(query))
    overlap = F.size(F.array_intersect(words, terms(F.col(text_col))))
    score = F.when(F.contains(F.lower(text_col), F.lit(query.lower())), 0.9).when(overlap > 0, 0.5 + 0.4 * overlap / F.size(words))
    return docs.select(id_col, F.round(score, 6).alias("score")).filter("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def rerank_recent(found: DataFrame, factor: float = 0.3) -> DataFrame:
    """similarity and recency (0 to 1 over the result) mixed; found has similarity and t."""
    w = found.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    r = (F.col("t") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return found.crossJoin(F.broadcast(w)).withColumn("score", F.round((1 - factor) * F.col("similarity") + factor * r, 6)).drop("lo", "hi")


def expanded(queries: DataFrame, synonyms: DataFrame, most: int = 20) -> DataFrame:
    """(qid, expansion): a query's words and their synonyms (word, synonym), each once, in order of the word and then the synonym, joined by OR; at most so many."""
    words = queries.select("qid", F.posexplode(terms(F.col("query"))).alias("place", "word"))
    also = words.join(synonyms, "word").select("qid", "place", "synonym")
    every = words.select("qid", "place", F.lit(0).alias("kind"), F.col("word").alias("term")).unionByName(also.select("qid", "place", F.lit(1).alias("kind"), F.col("synonym").alias("term")))
    first = every.groupBy("qid", "term").agg(F.min(F.struct("place", "kind")).alias("at"))
    g = first.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "term"))), 1, most).alias("all"))
    return g.select("qid", F.array_join(F.transform("all", lambda x: x["term"]), " OR ").alias("expansion"))


def rerank_by_words(found: DataFrame, query: str, text_col: str, title_col: str) -> DataFrame:
    """found with score: .6 of similarity, .3 of the share of the query's words in the text and .1 of that in the title."""
    q = terms(F.lit(query))
    share = lambda c: F.coalesce(F.try_divide(F.size(F.array_intersect(q, terms(F.coalesce(c, F.lit(""))))), F.size(q)), F.lit(0.0))
    return found.withColumn("score", F.round(0.6 * F.col("similarity") + 0.3 * share(F.col(text_col)) + 0.1 * share(F.col(title_col)), 6))


def rerank_hybrid(found: DataFrame, factor: float = 0.3) -> DataFrame:
    """similarity, times 1.2 for subgraphs and 1.1 for paths, at most 1, mixed with the share of the query's words (overlap)."""
    boost = F.when(F.col("kind") == "subgraph", 1.2).when(F.col("kind") == "path", 1.1).otherwise(1.0)
    return found.withColumn("score", F.round(F.least(F.lit(1.0), ((1 - factor) * F.col("similarity") + factor * F.col("overlap")) * boost), 6))


def with_fallback(first: DataFrame, second: DataFrame, key: str, least: int) -> DataFrame:
    """first, and of keys with fewer than least rows there the rows of second, without those that first has; found_by tells which."""
    n = first.groupBy(key).agg(F.count("*").alias("_n"))
    short = second.join(n, key, "left").filter(F.coalesce("_n", F.lit(0)) < least).drop("_n")
    fresh = short.join(first.select(key, "id"), [key, "id"], "left_anti")
    return first.withColumn("found_by", F.lit("vector")).unionByName(fresh.select(*first.columns).withColumn("found_by", F.lit("keyword")))


def page(found: DataFrame, key: str, order: list, offset: int, limit: int) -> DataFrame:
    """The rows of each key from offset on, so many, in an order."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.withColumn("_r", r).filter((F.col("_r") > offset) & (F.col("_r") <= offset + limit)).drop("_r")


def context(parts: DataFrame, key: str, topic: str, text: str) -> DataFrame:
    """(key, address, transaction, other): texts by what their topic starts with, joined line by line in order."""
    route = F.when(F.startswith(topic, F.lit("address:")), "address").when(F.startswith(topic, F.lit("transaction:")), "transaction").otherwise("other")
    lines = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(route == r, F.struct(topic, text)))), lambda x: x[text]), "\n").alias(r)
    return parts.groupBy(key).agg(*map(lines, ("address", "transaction", "other")))
