"""Pictures are dealt to tasks whatever their files are, and each is made, encoded and decoded once."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from loomspan.functions import images
from loomspan.operators import ingest
from loomspan.operators.store import Store
from loomspan.operators.tables import spread
from loomspan.plans import catalog, media


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_file_are_many_tasks(spark):
    one = spark.range(40_000).coalesce(1)
    parts = spread(one, "id", rows=5_000)
    sizes = [r.n for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert parts.rdd.getNumPartitions() == 8 and len(sizes) == 8 and max(sizes) < 6_000 and sum(sizes) == 40_000


def test_pixel_stats_deals_the_customers_before_it_makes_pictures(spark, sf_dir):
    text = plan(catalog.queries()["mth15_pixel_stats"](spark, sf_dir))
    assert "hashpartitioning(c_custkey" in text and text.index("ArrowEvalPython") < text.index("Exchange")
    assert media.pictures(spark.range(20_000).selectExpr("id c_custkey", "0 c_nationkey", "'' c_name", "'' c_mktsegment", "0e0 c_acctbal").coalesce(1)).rdd.getNumPartitions() == 4


def test_perturbations_share_one_decoding(spark, sf_dir):
    """Each of the four had a branch with its own pictures; and none of the work may be pushed below the dealing."""
    text = plan(catalog.queries()["udf11_perturb"](spark, sf_dir))
    assert "Union\n" not in text and text.count("ArrowEvalPython") == 2 and text.rindex("ArrowEvalPython") < text.index("Exchange")
    rng = np.random.default_rng(3)
    rows = [(i, bytearray(images.to_png(rng.integers(0, 256, (5 + i, 9, 3))))) for i in range(4)] + [(8, bytearray(b"none")), (9, None)]
    d = spark.createDataFrame(rows, "i long, p binary")
    all_ = {r.i: {x.name: x.picture for x in r.x} for r in d.select("i", images.all_perturbed()("p").alias("x")).collect()}
    for name in images.PERTURBATIONS:
        assert {r.i: r.x for r in d.select("i", images.perturbed(name)("p").alias("x")).collect()} == {i: x[name] for i, x in all_.items()}


def test_blur_is_the_mean_of_the_square():
    x = np.random.default_rng(5).integers(0, 256, (7, 11, 3)).astype(np.uint8)
    padded = np.pad(x.astype(float), ((2, 2), (2, 2), (0, 0)), mode="edge")
    want = np.rint([[padded[i : i + 5, j : j + 5].sum(axis=(0, 1)) / 25 for j in range(11)] for i in range(7)])
    assert (images.blur(x, 2) == want).all()


def test_every_picture_is_encoded_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def encode(pictures):
        (seen / f"{uuid.uuid4().hex}-{len(pictures)}").touch()
        return ingest.mean_grid(pictures)

    png = bytearray(images.to_png(np.full((10, 12, 3), 9, np.uint8)))
    rows = spark.range(300).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit(bytes(png)).alias("picture"), F.array(F.lit("a")).alias("long"), F.array().cast("array<string>").alias("short"))
    s = Store(spark, f"file://{tmp_path}/store")
    assert ingest.pictures(rows, s, "s", encode=encode)["ok"] == 300
    assert sum(int(f.name.split("-")[1]) for f in seen.iterdir()) == 300
    assert s.staged().select("seq").distinct().count() == 300
