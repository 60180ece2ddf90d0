"""Sorting and sampling by hash: deterministic, distributed counterparts of seeded draws."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions.hashing import order_key, u01
from loomspan.operators import scan
from loomspan.operators.scan import ranged
from loomspan.operators.tables import written

#: Deviations that the margin of a hash sample allows for.
MARGIN = 6.0


def shuffled_take(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """SRT-06: top n by hash; Spark keeps n rows a task."""
    return df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def per_group(df: DataFrame, by: list[str], seed: str, key: str, n: Column | int, most: int | None = None) -> DataFrame:
    """SRT-08, SRT-09, AGG-05: up to n rows of each group by hash; n may be a column that is one number a group, `most` at most.

    Hashes are uniform, so the n smallest of a group of N lie below n / N and a margin with all but certainty. Only rows below
    that leave their task: about n a group, whatever its size. Where fewer than n are found, the group's rows are taken
    whole; so the result never rests on the margin. Places among the rows taken come from a window where a range holds n rows,
    else from ranges of the hash. A null key stands first.
    """
    most = n if isinstance(n, int) else most
    wanted = n if isinstance(n, Column) else F.lit(n)
    u = F.coalesce(u01(F.concat(F.lit(seed), F.col(key).cast("string"))), F.lit(-1.0))
    rows = df.withColumns({"_pg_wanted": wanted.cast("long"), "_pg_u": u})
    sizes = rows.groupBy(*[F.col(c).alias(f"_pgs{c}") for c in by]).agg(F.count("*").alias("_pg_all"), F.max("_pg_wanted").alias("_pg_k"))
    k, size = F.col("_pg_k").cast("double"), F.col("_pg_all")
    sizes = sizes.withColumn("_pg_below", (k + MARGIN * F.sqrt(F.greatest(k, F.lit(0.0))) + MARGIN * MARGIN) / size)
    sizes = written(sizes)  # three steps read them
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_pgs{c}")) for c in by], F.lit(True))
    taken = rows.join(sizes, same)
    found = taken.groupBy(*[F.col(f"_pgs{c}") for c in by]).agg(F.count_if(F.col("_pg_u") <= F.col("_pg_below")).alias("_pg_found"), F.first("_pg_all").alias("_pg_all"), F.first("_pg_k").alias("_pg_k"))
    # Groups whose margin was too small; as a rule there are none.
    short = found.where(F.col("_pg_found") < F.least("_pg_k", "_pg_all")).select(*[F.col(f"_pgs{c}").alias(f"_pgf{c}") for c in by], F.lit(True).alias("_pg_whole"))
    missed = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_pgf{c}")) for c in by], F.lit(True))
    taken = taken.join(short, missed, "left").where((F.col("_pg_u") <= F.col("_pg_below")) | F.col("_pg_whole")).withColumn("_pg_order", order_key(seed, F.col(key)))
    if most is not None and most <= scan.ROWS:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_pg_order", key))
        return taken.withColumn("_pg_r", place).where(F.col("_pg_r") <= F.col("_pg_wanted")).select(*df.columns)
    placed = ranged(taken.select(*df.columns, "_pg_u", "_pg_order", "_pg_wanted"), by, F.col("_pg_u"), ["_pg_u", "_pg_order", key])
    return placed.running(_pg_r=("count", None)).rows().where(F.col("_pg_r") <= F.col("_pg_wanted")).select(*df.columns)


def strided(df: DataFrame, order: str, stride: int, need: int) -> DataFrame:
    """SRT-04: every stride-th row in order, `need` of them. Meant for lists of files, which are small."""
    w = Window.orderBy(order)
    return df.withColumn("_r", F.row_number().over(w) - 1).where((F.col("_r") % stride == 0) & (F.col("_r") < stride * need)).drop("_r")


def stride_for(shards: int, want: int, rows_per_shard: int = 5000, survive: float = 0.8) -> tuple[int, int]:
    """SRT-04: (stride, shards needed)."""
    need = int(want / (rows_per_shard * survive)) + 2
    return max(1, shards // need), need


def chunks(df: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """SRT-12: df with the number of each row's chunk of `size` sorted rows."""
    return ordinals(df, by, [], order, "_at").withColumn("chunk", F.floor((F.col("_at") - 1) / F.lit(float(size))).cast("bigint")).drop("_at")


def split_rank(path: Column) -> Column:
    """SRT-02: train, val, test, others."""
    return F.when(path.contains("train"), 0).when(path.contains("val"), 1).when(path.contains("test"), 2).otherwise(3)


def weighted_source(draws: DataFrame, probabilities: DataFrame, seed: str) -> DataFrame:
    """SRT-13: each draw (draw, bucket) takes a source by P(source | bucket): an equi-join on the bucket, then the range."""
    w = Window.partitionBy("bucket").orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("p_s_given_b").over(w)
    cdf = probabilities.select("bucket", "source", upto.alias("upto"), (upto - F.col("p_s_given_b")).alias("above"))
    u = draws.withColumn("u", u01(F.concat(F.lit(seed), F.col("draw").cast("string"))))
    return u.join(F.broadcast(cdf), "bucket").where("u >= above and u < upto").drop("above", "upto")


def mismatched(df: DataFrame, key: str, value: str, seed: str) -> DataFrame:
    """SRT-16: another row's value: shuffled by hash, and where a row would get its own value, the next one's.

    The order is one scan over ranges of the hash: no window holds the table.
    """
    d = df.withColumns({"_u": u01(F.concat(F.lit(seed), F.col(key).cast("string"))), "_order": order_key(seed, F.col(key))})
    first = d.agg(F.min_by(value, F.struct("_order", key)).alias("_first"))
    r = ranged(d, [], F.col("_u"), ["_order", key]).shifted("_next", value, -1).shifted("_after", value, -2)
    other = F.coalesce(F.when(F.col("_next") != F.col(value), F.col("_next")).otherwise(F.col("_after")), F.col("_first"))
    return r.rows().crossJoin(F.broadcast(first)).withColumn("other", other).drop("_u", "_order", "_next", "_after", "_first")


#: Ranges of an ordering key that a group is dealt to.
RANGES = 4096


def ordinals(df: DataFrame, by: list[str], lead: list[str], key: str, name: str) -> DataFrame:
    """df with each row's place, from 1, in its group `by`, in the order of the columns `lead`, then of the number `key`.

    The values of `key` under each (by, lead) are dealt to ranges; a row's place is the number of rows in the ranges before,
    from one row a range, and its place in its own range. So no window holds a group. Nulls of by and lead are values;
    rows with a null key stand first.
    """
    keys = [*by, *lead]
    ends = df.groupBy(*[F.col(c).alias(f"_e{c}") for c in keys]).agg(F.min(key).cast("double").alias("_lo"), F.max(key).cast("double").alias("_hi"))
    same = lambda of, sign: functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{sign}{c}")) for c in of])
    d = df.join(ends, same(keys, "e"))
    at = F.floor((F.col(key).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES)
    at = F.when(F.col("_hi") > F.col("_lo"), at).otherwise(F.lit(0))
    d = d.select(*df.columns, F.when(F.col(key).isNull(), -1).otherwise(at).cast("int").alias("_b"))
    sizes = d.groupBy(*[F.col(c).alias(f"_s{c}") for c in [*keys, "_b"]]).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*[f"_s{c}" for c in by]).orderBy(*[f"_s{c}" for c in [*lead, "_b"]]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    out = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(key)))
    return out.join(sizes, same([*keys, "_b"], "s")).select(*df.columns, (F.col("_before") + F.col("_r")).alias(name))
