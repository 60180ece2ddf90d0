"""Command line (CLI-01, CLI-02): thin calls of the same functions.

python -m loomspan.cli ingest ROOT --source S --input PATH [--kind parquet|tar] [--id C] [--picture C] [--long C,...] [--short C,...]
    [--synthetic] [--limit N] [--target N] [--batch N] [--encoder module:function]
python -m loomspan.cli merge|append|check ROOT [--source S] [--exclude S,...] [--force]
python -m loomspan.cli tree|schema|sample PATH [--suffix .parquet] [--rows N] [--seed S] [--columns a,b]
"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomspan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["ingest", "merge", "append", "check", "tree", "schema", "sample"])
    p.add_argument("path")
    p.add_argument("--source")
    p.add_argument("--exclude", default="")
    p.add_argument("--force", action="store_true")
    p.add_argument("--suffix", default=".parquet")
    p.add_argument("--rows", type=int, default=5)
    p.add_argument("--seed", default="0")
    p.add_argument("--columns")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--input")
    p.add_argument("--kind", choices=["parquet", "tar"], default="parquet")
    p.add_argument("--id", default="id")
    p.add_argument("--picture", default="picture")
    p.add_argument("--long", default="long")
    p.add_argument("--short", default="")
    p.add_argument("--synthetic", action="store_true")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--target", type=int, default=0)
    p.add_argument("--batch", type=int, default=64)
    p.add_argument("--encoder")
    a = p.parse_args(argv)
    from loomspan.sources import archives, files

    if a.command == "tree":
        print("\n".join(archives.listed(a.path, tuple(a.suffix.split(",")))))
        return 0
    from loomspan import session
    from loomspan.operators.store import Store

    spark = session.build(a.master)
    if a.command == "ingest":
        if not a.source or not a.input:
            p.error("ingest needs --source and --input")
        print(ingest(spark, a))
    elif a.command == "merge":
        print(Store(spark, a.path).merge(tuple(x for x in a.exclude.split(",") if x)))
    elif a.command == "append":
        if not a.source:
            p.error("append needs --source")
        print(Store(spark, a.path).append(a.source, a.force))
    elif a.command == "check":
        Store(spark, a.path).check().show(truncate=False)
    elif a.command == "schema":
        files.parquet_peek(spark, a.path).show(truncate=False)
        spark.read.parquet(a.path).printSchema()
    else:
        files.register(spark)
        reader = spark.read.format("loomspan_row_group").option("path", a.path).option("seed", a.seed)
        (reader.option("columns", a.columns) if a.columns else reader).load().limit(a.rows).show(truncate=200)
    return 0


def ingest(spark, a) -> dict[str, int]:
    """Rows of Parquet files, or complete pairs of tars, into the store; captions are columns, or fields of the pairs' JSON."""
    from importlib import import_module

    from pyspark.sql import functions as F

    from loomspan.operators import ingest as I
    from loomspan.operators.store import Store
    from loomspan.sources import archives

    if a.kind == "tar":
        archives.register(spark)
        rows = spark.read.format("loomspan_tar_pairs").option("path", a.input).load()
        key, picture, field = F.col("key"), F.col("picture"), lambda c: F.get_json_object("text", f"$.{c}")
    else:
        rows = spark.read.parquet(a.input)
        key, picture, field = F.col(a.id), F.col(a.picture), lambda c: F.col(c).cast("string")
    captions = lambda names: F.array(*[field(c) for c in names.split(",") if c]).cast("array<string>")
    encode = I.mean_grid
    if a.encoder:
        module, _, name = a.encoder.partition(":")
        encode = getattr(import_module(module), name)
    rows = rows.select(key.cast("string").alias("id"), picture.alias("picture"), captions(a.long).alias("long"), captions(a.short).alias("short"))
    return I.pictures(rows, Store(spark, a.path), a.source, encode, not a.synthetic, a.batch, a.limit, target=a.target)


if __name__ == "__main__":
    raise SystemExit(main())
