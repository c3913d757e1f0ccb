"""Deterministic sampling and splitting.

Randomness is a hash: rows are ordered by ``md5('<seed>:<id>')`` (ties by id), so a
sample is the same on every engine, partitioning, and rerun, and lost tasks
recompute identical rows.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.operators.filters import live, stories
from threadlens.operators.threads import assemble_threads
from threadlens.session import materialize

#: A sample of at most this many rows is an ordered limit (the rows meet in one task); a larger one is cut at its last key.
SMALL_SAMPLE = 10_000
#: Hexadecimal digits of the key that one round of :func:`key_cuts` looks at (65,536 counts for each group).
DIGITS = 4
KEY_DIGITS = 32


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_bucket(id_col: str, seed: int, buckets: int = 100) -> Column:
    """A number in ``[0, buckets)`` from the first 32 bits of the md5 key."""
    return F.pmod(F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("bigint"),
                  F.lit(buckets))


def key_cuts(df: DataFrame, sizes: DataFrame, groups: Sequence[str] = (), seed: int = 42, id_col: str = "id",
             small: int = SMALL_SAMPLE) -> DataFrame:
    """``(*groups, key, last)``: the key and id of the ``n``-th row of each group in (hash key, id) order.

    ``sizes`` is ``(*groups, n)`` with ``n`` from 1 to the group's rows. The place is found without sorting the rows: counts of
    key prefixes tell which prefix the n-th row has, and only that prefix is looked at again, four digits deeper, until the rows
    it leaves are few (or the key ends). Each round is one grouped count; only those few rows of each group are ever ranked.
    """
    groups = list(groups)
    keyed = df.select(*groups, F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_key")).where("_key IS NOT NULL")
    if not groups:
        keyed, sizes = keyed.withColumn("_all", F.lit(0)), sizes.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    at = sizes.select(*by, F.col("n").cast("bigint").alias("_left"), F.lit("").alias("_prefix"), F.lit(None).cast("bigint").alias("_rows"))
    for digits in range(DIGITS, KEY_DIGITS + 1, DIGITS):
        rows = keyed.withColumn("_prefix", F.substring("_key", 1, digits - DIGITS))
        rows = rows.join(at, same(rows, at, [*by, "_prefix"])).select(*[rows[c] for c in by], "_left", "_key")
        counts = rows.groupBy(*by, "_left", F.substring("_key", 1, digits).alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
        upto = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_prefix"))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_rows") < F.col("_left")))
        at = materialize(found.select(*by, (F.col("_left") - F.col("_upto") + F.col("_rows")).alias("_left"), "_prefix", "_rows"), "cuts")
        if not at.where(F.col("_rows") > small).count():
            break
    rows = keyed.withColumn("_prefix", F.substring("_key", 1, digits))
    rows = rows.join(at, same(rows, at, [*by, "_prefix"])).select(*[rows[c] for c in by], "_left", "_key", "_id")
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "_id"))).where("_at = _left")
    return materialize(ranked.select(*groups, F.col("_key").alias("key"), F.col("_id").alias("last")), "cuts")


def marked_upto(df: DataFrame, cuts: DataFrame, groups: Sequence[str], seed: int, id_col: str, name: str) -> DataFrame:
    """Add ``name``: true for the rows up to their group's cut (false without one). One row a group is joined."""
    own = cuts.select(*[F.col(c).alias(f"_g_{c}") for c in groups], F.col("key").alias("_cut"), F.col("last").alias("_last"))
    on = [df[c].eqNullSafe(own[f"_g_{c}"]) for c in groups]
    joined = df.join(own, on, "left") if groups else df.join(F.broadcast(own), how="left")     # the one cut of the whole table
    key = hash_key(id_col, seed)
    upto = (key < F.col("_cut")) | ((key == F.col("_cut")) & (F.col(id_col) <= F.col("_last")))
    return joined.withColumn(name, F.coalesce(upto, F.lit(False))).drop("_cut", "_last", *[f"_g_{c}" for c in groups])


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id", small: int = SMALL_SAMPLE) -> DataFrame:
    """D3: exactly ``min(n, rows)`` rows without replacement, returned in id order.

    Beyond ``small`` rows the sample is a filter on the key of its last row, so no task holds ``n`` rows. (Ids are
    taken to be distinct there: rows that repeat the last row's id all come with it. Rows without id are not drawn.)
    """
    if n > small:
        rows = df.where(F.col(id_col).isNotNull()).count()
        if n >= rows:
            return df.where(F.col(id_col).isNotNull()).orderBy(id_col)
        cuts = key_cuts(df, df.sparkSession.range(1).select(F.lit(n).alias("n")), (), seed, id_col, small)
        return marked_upto(df, cuts, (), seed, id_col, "_in").where("_in").drop("_in").orderBy(id_col)
    picked = df.where(F.col(id_col).isNotNull()).withColumn("_h", hash_key(id_col, seed)) \
               .orderBy(F.col("_h"), F.col(id_col)).limit(n).drop("_h")
    return picked.orderBy(id_col)


def sample_stories(spark: SparkSession, items: DataFrame, n: int, seed: int = 42,
                   live_mode: str = "exists") -> DataFrame:
    """Draw ``n`` ids from the id space ``[0, max id]``, keep live titled stories, assemble them.

    Draws that hit a comment or a missing id are lost, as with the reference, so
    the number of threads is at most ``n``.
    """
    top = items.agg(F.max("id")).first()[0]
    space = spark.range(0, (top or 0) + 1)
    drawn = sample_n(space, n, seed, "id")
    roots = stories(live(items, live_mode))
    roots = roots.join(drawn.select(F.col("id").alias("_d")), roots["id"] == F.col("_d"), "left_semi")
    return assemble_threads(items, roots=roots, prune=True, live_mode=live_mode)


def balanced_sample(df: DataFrame, cat_col: str, n: int | None = None, seed: int = 42, id_col: str = "id",
                    allow_short: bool = False) -> DataFrame:
    """``n`` rows from every category (``n=None``: the size of the smallest category).

    Raises when a category has fewer than ``n`` rows unless ``allow_short`` (ten of them
    are named). The sample is a windowed ``row_number`` with a group limit, so a huge
    class ships at most ``n`` rows per map task; for an ``n`` that one task should not
    hold there is :func:`split_exact` by category.
    """
    if n is None:
        # one number reaches the driver; a literal limit keeps the pre-shuffle group limit
        n = df.groupBy(cat_col).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    elif not allow_short:
        sizes = df.groupBy(cat_col).agg(F.count(F.lit(1)).alias("n"))
        short = sizes.where(F.col("n") < n).limit(10).collect()
        if short:
            raise ValueError(f"categories smaller than n={n}: "
                             + ", ".join(f"{r[cat_col]}={r['n']}" for r in short))
    w = Window.partitionBy(cat_col).orderBy(hash_key(id_col, seed), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def split(df: DataFrame, train: float = 0.7, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Adds ``part`` = 'train' / 'test' from a hash bucket of the id (stable, no shuffle).

    Sizes are approximate (the share holds in expectation), parts are disjoint and total.
    """
    cut = int(round(train * 100))
    return df.withColumn("part", F.when(hash_bucket(id_col, seed) < cut, F.lit("train"))
                                  .otherwise(F.lit("test")))


def split_exact(df: DataFrame, train: float = 0.7, seed: int = 42, id_col: str = "id", by: Sequence[str] = (),
                small: int = SMALL_SAMPLE) -> DataFrame:
    """D6, exact sizes: ``part`` = 'train' for ``round(train * rows)`` rows (of each group of ``by``), 'test' for the others.

    The rows that come first in hash order are for training. Halves round up, as in SQL. Rows without id are for testing.
    """
    by = list(by)
    sizes = df.where(F.col(id_col).isNotNull()).groupBy(*by).agg(
        F.round(F.count(F.lit(1)) * F.lit(Decimal(str(train)))).cast("bigint").alias("n"))
    cuts = key_cuts(df, materialize(sizes.where("n > 0"), "sizes"), by, seed, id_col, small)
    marked = marked_upto(df, cuts, by, seed, id_col, "part")
    return marked.withColumn("part", F.when(F.col("part"), F.lit("train")).otherwise(F.lit("test")))


def train_test(df: DataFrame, train: float = 0.7, seed: int = 42, id_col: str = "id"):
    parts = split(df, train, seed, id_col)
    return (parts.where(F.col("part") == "train").drop("part"),
            parts.where(F.col("part") == "test").drop("part"))


def fixed_samples(df: DataFrame, positions: Iterable[int], order_col: str = "id") -> DataFrame:
    """Rows at fixed 0-based positions of the ``order_col`` order.

    Only ``max(positions) + 1`` rows survive the ordered limit, so the numbering
    window runs over a bounded set.
    """
    positions = sorted(set(int(p) for p in positions))
    head = df.orderBy(order_col).limit(positions[-1] + 1)
    w = Window.orderBy(order_col)
    return (head.withColumn("position", F.row_number().over(w) - 1)
                .where(F.col("position").isin(positions)))
