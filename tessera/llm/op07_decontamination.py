"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Texts and benchmark items are split into lower-case runs of letters and digits.  A seed is a fixed mask over a few
consecutive tokens that ignores some of them; the hash of the others is joined between the benchmark and every position
of every text.  A hit fixes a diagonal (text position minus item position), on which the tokens around it are compared
one by one, so substituted words do not hide a leak: a diagonal counts if some `window` consecutive positions (or the
whole of a shorter item) hold at least `share` equal tokens.  With the default window and share the masks of `COVER`
have a hit in every such window, whichever tokens are substituted.  Items shorter than the window are seeded by runs of
tokens so short that one of them must be free of substitutions.

Plan: one algorithm at every size.  Positions and hashes of the texts are joined with those of the benchmark; the hits,
distinct by row, item and diagonal, are cut off as a shared table and joined back to the texts of their rows, which only
then are compared.  Rows and items are known by a hash of id and text, so that null and repeated ids stay apart.  Up to
`max_seeds` seeds (counted first) are broadcast, which makes the first join one narrow, generated stage; more are
shuffled, where Spark splits a seed that very many positions have.

Defined cases: null and empty texts and items have no tokens and no leaks; rows that repeat a doc_id (a null one too) are
searched each and reported once for each item; items that repeat an item_id likewise; a text of any length is searched
whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import stored

#: Token offsets that each mask reads: together they have a hit in any 12 tokens of which 9 are equal.
COVER = ((0, 1, 3, 6, 7), (0, 2, 3, 5, 8), (0, 1, 2, 4, 5), (0, 1, 5, 7, 8), (0, 1, 3, 4, 5))
WINDOW = 12
SHARE = 0.75
MAX_SEEDS = 1_000_000
_TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_TOKEN), F.lit(0))


def run_length(n: int, share: float) -> int:
    """The longest run that any n tokens, at least `share` of them equal, must have at a multiple of its length."""
    return n // (n - math.ceil(share * n) + 1)


def _seeds(frame: DataFrame, masks: tuple[tuple[int, ...], ...], wanted: list[Column] | None = None) -> DataFrame:
    """Rows of frame (with an array t) for every position and mask that fits (and is wanted there): adds pos and seed."""
    least = min(m[-1] for m in masks)
    placed = frame.where(F.size("t") > least).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("t") - F.lit(1 + least))))
    at = lambda k: F.get("t", F.col("pos") + k)
    fits = [(F.col("pos") + m[-1] < F.size("t")) & w for m, w in zip(masks, wanted or [F.lit(True)] * len(masks), strict=True)]
    keyed = F.array(*[F.when(fit, F.xxhash64(F.lit(i), *[at(k) for k in m])) for i, (m, fit) in enumerate(zip(masks, fits, strict=True))])
    return placed.withColumn("seed", F.explode(keyed)).where(F.col("seed").isNotNull())


def _verified(candidates: DataFrame, window: int, share: float) -> DataFrame:
    """candidates: doc_id, item_id, diagonal, item (its tokens) and part (text tokens from max(0, diagonal) on)."""
    begin = F.greatest(-F.col("diagonal"), F.lit(0))
    n = F.least(F.size("part"), F.size("item") - begin)
    compared = candidates.select(
        "doc_id", "item_id", F.size("item").alias("n_item"),
        F.zip_with(F.slice("part", F.lit(1), n), F.slice("item", begin + 1, n), lambda a, b: F.when(a == b, 1).otherwise(0)).alias("equal"),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    width = F.least(F.lit(window), F.col("n_item"))
    found = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("equal") - width + 1, F.lit(1))),
        lambda i: total(F.slice("equal", i, width)) >= F.ceil(F.lit(share) * width),
    )
    return (
        compared.where((F.size("equal") >= width) & found)
        .groupBy("doc_id", "item_id").agg(F.max(total(F.col("equal"))).cast("long").alias("n_equal"), F.max("n_item").cast("long").alias("n_item"))
    )


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = COVER, window: int = WINDOW, share: float = SHARE, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """doc_id, item_id, n_equal (equal tokens on the best diagonal) and n_item (tokens of the item) of every leak found."""
    items = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("of_item"), tokens(F.col("text")).alias("t")).dropDuplicates(["of_item"])
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("of_row"), F.col("text"))
    # Items shorter than the window, by size (fewer sizes than the window has tokens): one run must be equal as a whole.
    sizes = [r.n for r in items.select(F.size("t").alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()]
    runs = sorted({run_length(n, share) for n in sizes})
    wanted = [F.lit(True)] * len(masks) + [F.size("t").isin([n for n in sizes if run_length(n, share) == k]) for k in runs]
    masks = (*masks, *(tuple(range(k)) for k in runs))
    seeds = _seeds(items, masks, wanted).select("seed", "of_item", F.col("pos").alias("item_pos"), F.size("t").alias("n_item"))
    if seeds.limit(max_seeds + 1).count() <= max_seeds:
        seeds = F.broadcast(seeds)
    placed = _seeds(texts.select("of_row", tokens(F.col("text")).alias("t")), masks).select("of_row", "pos", "seed")
    hits, _ = stored(placed.join(seeds, "seed").select("of_row", "of_item", "n_item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "leak-hits")
    held = texts.join(hits.select("of_row").distinct(), "of_row", "left_semi").select("doc_id", "of_row", tokens(F.col("text")).alias("t"))
    part = F.slice("t", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.col("n_item"))
    parts = hits.join(held, "of_row").select("doc_id", "of_item", "diagonal", part.alias("part"))
    return _verified(parts.join(items.select("item_id", "of_item", F.col("t").alias("item")), "of_item"), window, share)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All diagonals with enough equal tokens, without seeds.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS t FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS t FROM benchmark),
dt AS (SELECT r, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM d),
bt AS (SELECT k, len(t) AS n_item, unnest(t) AS token, generate_subscripts(t, 1) AS q FROM b),
c AS (SELECT r, k, p - q AS diagonal FROM dt JOIN bt USING (token) GROUP BY ALL HAVING count(*) >= ceil({SHARE} * least({WINDOW}, max(n_item)))),
e AS (SELECT doc_id, item_id, len(b.t) AS n_item,
  list_transform(range(greatest(-diagonal, 0), least(len(b.t), len(d.t) - diagonal)), lambda i: CASE WHEN d.t[i + diagonal + 1] = b.t[i + 1] THEN 1 ELSE 0 END) AS equal
  FROM c JOIN d USING (r) JOIN b USING (k)),
v AS (SELECT *, least({WINDOW}, n_item) AS width FROM e)
SELECT doc_id, item_id, CAST(max(list_sum(equal)) AS BIGINT) AS n_equal, CAST(max(n_item) AS BIGINT) AS n_item
FROM v WHERE len(equal) >= width
  AND len(list_filter(range(1, len(equal) - width + 2), lambda i: list_sum(equal[i:i + width - 1]) >= ceil({SHARE} * width))) > 0
GROUP BY doc_id, item_id
"""
