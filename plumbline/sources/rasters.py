"""Rasters ``(img, ix, iy, v)``, 1 for paper and 0 for ink: formulas, grids counted from tables, colour planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rounds import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    """(ix, iy) of every pixel."""
    return spark.range(w * h).select((F.col("id") % w).cast("int").alias("ix"), F.floor(F.col("id") / w).cast("int").alias("iy"))


def tone(kind: str) -> Column:
    """Tone of a pixel (ix, iy) of a picture ``w`` by ``h``: a ``ramp`` from black on the left to white on the right, a ``radial``
    one from black in the middle to white in the corners, fading ``rings`` about the middle, or a lit ``sphere``."""
    ix, iy, w, h = (F.col(c) for c in ("ix", "iy", "w", "h"))
    if kind == "ramp":
        return ix / (w - 1).cast("double")
    if kind == "radial":
        dx, dy = ix - (w - 1) / 2, iy - (h - 1) / 2
        return F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy) / F.sqrt((w - 1) / 2 * ((w - 1) / 2) + (h - 1) / 2 * ((h - 1) / 2)))
    x, y = ix / (w - 1) * 2 - 1, iy / (h - 1) * 2 - 1
    r = F.sqrt(x * x + y * y)
    if kind == "rings":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.45 * F.cos(r * 18) * F.exp(-r * 0.8)))
    # The ball's radius, the direction of light, and the tones.
    ball, light = 0.72, (-0.45, -0.55, 0.7)
    z = F.sqrt(F.greatest(F.lit(0.0), ball * ball - r * r))
    size = F.sqrt(x * x + y * y + z * z)
    facing = F.greatest(F.lit(0.0), (light[0] * x + light[1] * y + light[2] * z) / size)
    shade = F.exp(-12 * (r - ball) * (r - ball))
    v = F.when(r < ball, F.greatest(F.lit(0.02), F.least(F.lit(1.0), 0.12 + 0.95 * facing))).otherwise(0.55 + 0.4 * (iy / (h - 1)) - 0.12 * shade)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def painted(sizes: DataFrame, kind: str) -> DataFrame:
    """(img, ix, iy, v): a picture of that kind for each of ``sizes`` (img, w, h; two pixels and more to a side)."""
    cells = sizes.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)))
    at = cells.select("img", "w", "h", (F.col("c") % F.col("w")).cast("int").alias("ix"), F.floor(F.col("c") / F.col("w")).cast("int").alias("iy"))
    return at.select("img", "ix", "iy", tone(kind).cast("float").alias("v"))


def formula(spark: SparkSession, kind: str, w: int, h: int) -> DataFrame:
    """One picture of that kind."""
    at = grid(spark, w, h).withColumn("w", F.lit(w)).withColumn("h", F.lit(h))
    return at.select(F.lit(kind).alias("img"), "ix", "iy", tone(kind).cast("float").alias("v"))


def ramp(spark: SparkSession, w: int, h: int) -> DataFrame:
    """Black on the left to white on the right."""
    return formula(spark, "ramp", w, h)


def radial(spark: SparkSession, w: int, h: int) -> DataFrame:
    """Black in the middle to white in the corners."""
    return formula(spark, "radial", w, h)


def counted(rows: DataFrame, w: int, h: int, images: int | None = None) -> DataFrame:
    """Raster of each image of ``rows`` (img, ix, iy): the more rows a pixel has, the darker it is; the fullest is black.

    Counts are taken before the shuffle, and an image's full pixels come together as one row, which is filled up with the
    empty ones there: a whole grid never goes through a shuffle, and whatever is grouped by image next needs none. An image
    without a name stays white. Where the number of ``images`` is given, tasks grow in number with their pixels.
    """
    cell = (F.col("iy") * w + F.col("ix")).cast("int")
    counts = rows.groupBy("img", "ix", "iy").agg(F.count("*").alias("n")).select("img", cell.alias("c"), "n")
    counts = counts.withColumn("n", F.when(F.col("img").isNull(), 0).otherwise(F.col("n")))
    if images is not None:
        counts = spread(counts, images * w * h, "img")
    full = counts.groupBy("img").agg(F.greatest(F.lit(1), F.max("n")).alias("most"), F.array_sort(F.collect_list(F.struct("c", "n"))).alias("s"))
    none = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("n")))
    full = full.select("img", "most", F.when(F.col("s")[0]["c"] > 0, F.concat(none, "s")).otherwise(F.col("s")).alias("s"))
    # Each full pixel with the empty ones up to the next.
    next_ = lambda i: F.coalesce(F.get("s", i + 1)["c"], F.lit(w * h))
    zero = F.lit(0).cast("long")
    fill = F.flatten(F.transform("s", lambda e, i: F.concat(F.array(e["n"]), F.array_repeat(zero, next_(i) - e["c"] - 1))))
    cells = full.select("img", "most", F.posexplode(fill).alias("c", "n"))
    return cells.select("img", (F.col("c") % w).cast("int").alias("ix"), F.floor(F.col("c") / w).cast("int").alias("iy"), (1 - F.col("n") / F.col("most")).cast("double").alias("v"))


LI_W, LI_H, EV_W, EV_H = 50, 11, 24, 30


def lineitem_cells(spark: SparkSession, sf_dir: str, img: Column | None = None) -> DataFrame:
    """(img, ix, iy): each line item's pixel, quantity (rounded, halves to even) by discount; an image for each return flag."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") if img is None else img).alias("img"), (F.rint("l_quantity").cast("int") - 1).alias("ix"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("iy")
    )
    return rows.where(f"ix between 0 and {LI_W - 1} and iy between 0 and {LI_H - 1}")


def lineitem_raster(spark: SparkSession, sf_dir: str, img: Column | None = None) -> DataFrame:
    """Quantity by discount, an image for each return flag."""
    return counted(lineitem_cells(spark, sf_dir, img), LI_W, LI_H)


def whole_lineitem_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by discount, all line items in one image."""
    return lineitem_raster(spark, sf_dir, F.lit("all"))


def supplier_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by discount, an image for each supplier: there are more with more data."""
    images = table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_suppkey")).first()[0]
    return counted(lineitem_cells(spark, sf_dir, F.col("l_suppkey")), LI_W, LI_H, images)


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour by day, an image for each type of event."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("img"), F.hour("ts").alias("ix"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("iy")
    )
    return counted(rows.where(f"iy between 0 and {EV_H - 1}"), EV_W, EV_H)


def embedding_points(spark: SparkSession, sf_dir: str, w: int = LI_W, h: int = LI_H) -> DataFrame:
    """(pid, x, y): the first two components of each vector, scaled to the raster's pixel box from 1 on."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pid"),
        (1 + (F.tanh(F.col("embedding")[0].cast("double")) + 1) / 2 * (w - 1)).alias("x"),
        (1 + (F.tanh(F.col("embedding")[1].cast("double")) + 1) / 2 * (h - 1)).alias("y"),
    )


def user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, seq, x, y): each user's events in order, hours since the first of 2024 against their value;
    those without a time come last."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    # Whole seconds go down, also before 1970.
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path_id"), (F.row_number().over(order) - 1).alias("seq"), (seconds / 3600.0).alias("x"), F.col("value").alias("y")
    )


def colour(rgb: DataFrame) -> DataFrame:
    """Coverage of cyan, magenta, yellow and black from 8-bit colour, the grey they share moved to black; one row each."""
    c, m, y = (1 - F.col(p) / 255.0 for p in ("r", "g", "b"))
    k = F.least(c, m, y)
    planes = F.array(*[F.struct(F.lit(n).alias("channel"), v.alias("cover")) for n, v in (("c", c - k), ("m", m - k), ("y", y - k), ("k", k))])
    return rgb.select("img", "ix", "iy", F.explode(planes).alias("p")).select("img", "ix", "iy", "p.channel", (1 - F.col("p.cover")).cast("float").alias("v"))


def grey(rgb: DataFrame) -> DataFrame:
    """Luminance of 8-bit colour."""
    v = (0.2989 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 255.0
    return rgb.select("img", "ix", "iy", v.cast("float").alias("v"))


def inverted(raster: DataFrame) -> DataFrame:
    return raster.withColumn("v", 1 - F.col("v"))
