"""URL filter: allow and block rules by host and path, then a weighted vocabulary found with Aho-Corasick.

A term counts only where neither neighbour in the URL is an ASCII letter or digit. One strict term, or
`soft_limit` distinct soft terms, reject a URL that no rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.llm.base import table

#: Fixed values: (verdict, host, path prefix).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The default vocabulary.
STRICT = ("casino", "escort", "hentai", "malware", "phishing", "porn", "viagra", "warez", "xxx")
SOFT = ("adult", "bet", "click", "crack", "dating", "free", "keygen", "loan", "pills", "poker", "promo", "sex", "torrent", "win")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """Terms are lower-cased; a term in both lists is strict."""
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term.lower(), (term.lower(), False))
    for term in strict:
        found.add_word(term.lower(), (term.lower(), True))
    found.make_automaton()
    return found


def hits(machine: ahocorasick.Automaton, url: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms of a lower-cased URL that stand between boundaries."""
    strict, soft, last = set(), set(), len(url) - 1
    for end, (term, is_strict) in machine.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in ALNUM) and (end == last or url[end + 1] not in ALNUM):
            (strict if is_strict else soft).add(term)
    return strict, soft


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_limit: int = 2,
) -> DataFrame:
    """One row for each input row: id_col, host, path, rule, verdict, strict_hits, soft_hits.

    host and path are empty for a null URL or one without "://"; no rule fits those. The rule with the longest
    host and path decides (of equally long ones, block before allow, then the smaller text). Vocabularies are
    parameters of a few thousand terms at most, sent with the task. Other columns of the input are not read, so
    clashing names do no harm; repeated rows are judged one by one.
    """
    ascii_lower = F.translate(F.col("_url"), UPPER, LOWER)
    scanned = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url")).select(
        "_id",
        F.translate(F.regexp_extract("_url", r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
        ascii_lower.alias("_url"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(strict, soft)
        for batch in batches:
            pairs = [hits(machine, url) for url in batch.column(batch.schema.get_field_index("_url")).to_pylist()]
            terms = [pa.array([sorted(p[k]) for p in pairs], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *terms], names=["_id", "host", "path", "strict_hits", "soft_hits"])

    id_type = pages.schema[id_col].dataType.simpleString()
    scanned = scanned.mapInArrow(scan, f"_id {id_type}, host string, path string, strict_hits array<string>, soft_hits array<string>")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p)) for _, h, p in order]
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(fit, h + p) for fit, (_, h, p) in zip(fits, order, strict=True)], none)
    ruled = F.coalesce(*[F.when(fit, v) for fit, (v, _, _) in zip(fits, order, strict=True)], none)
    own = F.when((F.size("strict_hits") >= 1) | (F.size("soft_hits") >= soft_limit), "block").otherwise("allow")
    return scanned.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "strict_hits", "soft_hits")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"))
    return judged.select(
        "page_id", "host", "path", "rule", "verdict", F.size("strict_hits").cast("long").alias("n_strict"), F.size("soft_hits").cast("long").alias("n_soft")
    )


def _sql() -> str:
    def found(terms: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)

    def fit(h: str, p: str) -> str:
        return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"

    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in order)
    verdict = " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for v, h, p in order)
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, translate(url, '{UPPER}', '{LOWER}') AS u FROM a),
c AS (SELECT *, {found(STRICT)} AS n_strict, {found(SOFT)} AS n_soft FROM b)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM c"""


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": _sql()}
