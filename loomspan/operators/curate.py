"""Curation: aspect buckets, row assembly, caption joins, hold-out, merge and append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import text as S
from loomspan.functions.hashing import u01

# Buckets as width / height, in order of declaration (ties go to the first).
BUCKETS = {"1_1": (256, 256), "4_3": (288, 224), "3_4": (224, 288), "3_2": (320, 208), "2_3": (208, 320)}
# Aspect range, square share rules, hold-out size.
ASPECT = (0.5, 2.0)
SQUARE_CROP, SQUARE_REAL, SQUARE_SYNTHETIC = 0.30, 0.5, 0.45
HOLD_OUT = 1000


def crop_fraction(aspect: Column, bucket: str) -> Column:
    """PRJ-05: share of an image that a bucket's crop loses."""
    a = F.lit(BUCKETS[bucket][0] / BUCKETS[bucket][1])
    return F.lit(1.0) - F.least(aspect, a) / F.greatest(aspect, a)


def in_range(aspect: Column) -> Column:
    """FLT-01: bounds count as inside."""
    return aspect.between(F.lit(ASPECT[0]), F.lit(ASPECT[1]))


def bucket(aspect: Column, real: bool, key: Column) -> Column:
    """PRJ-06: struct (bucket, crop), null outside the range. The coin is drawn from the key, so reruns agree."""
    names = list(BUCKETS)
    near = F.array_min(F.array(*[F.struct(crop_fraction(aspect, b).alias("crop"), F.lit(i).alias("i"), F.lit(b).alias("bucket")) for i, b in enumerate(names)]))
    if real:
        square = (crop_fraction(aspect, "1_1") <= SQUARE_CROP) & (u01(key) < SQUARE_REAL)
        chosen = F.when(square, F.lit("1_1")).otherwise(near["bucket"])
    else:
        others = F.array(*[F.lit(b) for b in names[1:]])
        chosen = F.when(u01(key) < SQUARE_SYNTHETIC, F.lit("1_1")).otherwise(F.get(others, F.floor(u01(F.concat(key, F.lit("/b"))) * 4).cast("int")))
    crop = F.lit(None).cast("double")
    for b in names:
        crop = F.when(chosen == b, crop_fraction(aspect, b)).otherwise(crop)
    return F.when(in_range(aspect), F.struct(chosen.alias("bucket"), crop.alias("crop")))


def assemble(long: Column, short: Column) -> Column:
    """PRJ-01: struct (long, short) of trimmed captions, each falling back on the other; null where both are empty."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), S.strip), lambda x: x.isNotNull() & (x != ""))

    def fall_back(c: Column) -> Column:
        ll, ss = c["long"], c["short"]
        first = F.when(F.size(ll) > 0, F.array(S.first_sentence(F.get(ll, 0)))).otherwise(ss)
        found = F.struct(F.when(F.size(ll) > 0, ll).otherwise(ss).alias("long"), F.when(F.size(ss) > 0, ss).otherwise(first).alias("short"))
        return F.when((F.size(ll) > 0) | (F.size(ss) > 0), found)

    return S.let(F.struct(clean(long).alias("long"), clean(short).alias("short")), fall_back)


def route_captions(entity: Column, composition: Column, detail: Column, crop: Column, most: float = 0.20) -> Column:
    """PRJ-07: struct (short, long); a heavily cropped image gets the short caption for both."""
    short = F.coalesce(S.blank_to_null(entity), S.blank_to_null(composition), S.blank_to_null(S.first_sentence(detail)))
    return F.struct(short.alias("short"), F.when(crop > most, short).otherwise(detail).alias("long"))


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """PRJ-04: fails at once, naming the columns that are missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """PRJ-03: all columns but `keep` get a prefix."""
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def grouped_captions(captions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """AGG-01: captions of a key as a list in order."""
    lists = captions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda x: x[value]).alias("captions"))


def last_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """JOI-03, WIN-06: one row a key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overwritten(main: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JOI-07, SNK-09: matched rows take the side's columns, nulls too; others keep theirs."""
    s = side.select(F.col(key).alias("_k"), F.lit(True).alias("_m"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = main.join(s, F.col(key) == F.col("_k"), "left")
    return out.select(*[(F.when(F.col("_m"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in main.columns])


def held_out(df: DataFrame, source: str, order: list[str], n: int = HOLD_OUT) -> DataFrame:
    """WIN-01: flag `val` for the first n rows of each ingest source. The order must be total.

    Spark keeps n rows a source and task to find where each source's hold-out ends; the rows themselves stay in place and
    compare with that one row.
    """
    w = Window.partitionBy(source).orderBy(*order)
    first = df.select(source, *order).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    ends = first.groupBy(F.col(source).alias("_source")).agg(F.max(F.struct(*order)).alias("_end"))
    out = df.join(F.broadcast(ends), F.col(source).eqNullSafe(F.col("_source")), "left")
    return out.withColumn("val", F.struct(*order) <= F.col("_end")).drop("_source", "_end")


def merged(parts: list[DataFrame]) -> DataFrame:
    """SNK-04, SET-01: union by name; order is carried by columns, not by files."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-08: rows of new replace those of old with an equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def channel_stats(df: DataFrame, vector: str, floor: float = 1e-8) -> DataFrame:
    """AGG-04: one-pass mean and population deviation of each channel."""
    x = df.select(F.posexplode(vector).alias("channel", "x")).select("channel", F.col("x").cast("double").alias("x"))
    sums = x.groupBy("channel").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    mean = F.col("s") / F.col("n")
    return sums.select("channel", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(floor))).alias("std"))


def mixture(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """AGG-32: counts (source, bucket, n) and weights (source, weight) -> p_b and p_s_given_b.

    Weights are renormalised over the sources that are present.
    """
    per_source, per_bucket = Window.partitionBy("source"), Window.partitionBy("bucket")
    c = counts.where("n > 0").join(F.broadcast(weights), "source")
    total = c.select("source", "weight").distinct().agg(F.sum("weight").alias("all_w"))
    c = c.crossJoin(F.broadcast(total)).withColumn("joint", F.col("weight") / F.col("all_w") * F.col("n") / F.sum("n").over(per_source))
    p_b = F.sum("joint").over(per_bucket)
    return c.select("source", "bucket", "n", p_b.alias("p_b"), (F.col("joint") / p_b).alias("p_s_given_b"))
