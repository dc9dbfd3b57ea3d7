"""Motion model, template and tracker queries, and the streaming ones over the events table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import tracking as K
from ..sources.rasters import scratch
from .roles import r6, sql6, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _moved(spark, sf, kind: str, dt: float = 2.0):
    """One particle for each line item, moved once without noise; the surface is 0.1 x + 0.2 y."""

    def run(batches):
        for b in batches:
            p = b[["x", "y", "z", "vx", "vy", "vz"]].to_numpy(float).copy()
            params = {"ax": 0.5, "ay": -0.25, "az": 0.1, "ar": 0.5, "ath": 0.125}
            model = K.MODELS[kind](params, lambda x, y: 0.1 * x + 0.2 * y)
            model.evolve(p, dt, np.random.default_rng(0))
            out = pd.DataFrame(p, columns=["x", "y", "z", "vx", "vy", "vz"])
            out.insert(0, "ok", b["ok"].to_numpy())
            out.insert(1, "ln", b["ln"].to_numpy())
            yield out

    c = F.col
    rows = table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("ok"), c("l_linenumber").cast("long").alias("ln"), (c("l_extendedprice") / 1000).alias("x"), c("l_quantity").alias("y"), (c("l_discount") * 100).alias("z"), (c("l_tax") * 50 + 1).alias("vx"), (c("l_quantity") / 10).alias("vy"), F.lit(0.5).alias("vz")
    )
    moved = rows.mapInPandas(run, "ok long, ln long, x double, y double, z double, vx double, vy double, vz double")
    return moved.select("ok", "ln", *[r6(c(n), 5).alias(n) for n in ("x", "y", "z", "vx", "vy", "vz")])


_P = "p AS (SELECT l_orderkey AS ok, l_linenumber::BIGINT AS ln, l_extendedprice / 1000 AS x, l_quantity AS y, l_discount * 100 AS z, l_tax * 50 + 1 AS vx, l_quantity / 10 AS vy, 0.5::DOUBLE AS vz FROM lineitem)"


def _sql(ax: str, ay: str, az: str = "0.1::DOUBLE", tangent: bool = False, still: bool = False) -> str:
    nx, ny = f"x + 2 * vx + 2 * ({ax})", f"y + 2 * vy + 2 * ({ay})"
    nz = f"z - (0.1::DOUBLE * x + 0.2::DOUBLE * y) + 0.1::DOUBLE * ({nx}) + 0.2::DOUBLE * ({ny})" if tangent else f"z + 2 * vz + 2 * ({az})"
    vz = "vz" if tangent else f"vz + 2 * ({az})"
    cols = [(nx, "x"), (ny, "y"), (nz, "z"), (f"vx + 2 * ({ax})", "vx"), (f"vy + 2 * ({ay})", "vy"), (vz, "vz")]
    return f"WITH {_P} SELECT ok, ln, " + ", ".join(f"{sql6(e, 5)} AS {n}" for e, n in cols) + " FROM p"


_AR = ("0.5::DOUBLE * vx / sqrt(vx * vx + vy * vy) - vy * 0.125", "0.5::DOUBLE * vy / sqrt(vx * vx + vy * vy) + vx * 0.125")


@query(_sql("0.0", "0.0", "0.0"))
def motion_base(spark, sf):
    return _moved(spark, sf, "base")


@query(_sql("0.5", "-0.25"))
def motion_cartesian(spark, sf):
    return _moved(spark, sf, "cartesian")


@query(_sql(*_AR))
def motion_cylindrical(spark, sf):
    return _moved(spark, sf, "cylindrical")


@query(_sql("0.5", "-0.25", tangent=True))
def motion_tangent_cartesian(spark, sf):
    return _moved(spark, sf, "tangent_cartesian")


@query(_sql(*_AR, tangent=True))
def motion_tangent_cylindrical(spark, sf):
    return _moved(spark, sf, "tangent_cylindrical")


@query("SELECT p_partkey AS pk, " + sql6("2 + 3 * c - 0.5 * r + 0.01 * c * c * c - 0.02 * r * r * c") + " AS z FROM (SELECT p_partkey, (p_retailprice - 900) / 10.0::DOUBLE AS c, p_size / 6.0::DOUBLE AS r FROM part)")
def tile_sample(spark, sf):
    """A bicubic spline gives a cubic surface exactly, inside the tile of 12 x 11 cells."""

    @F.pandas_udf("double")
    def run(r: pd.Series, c: pd.Series) -> pd.Series:
        i, j = np.mgrid[0:12, 0:11]
        tile = 2 + 3 * j - 0.5 * i + 0.01 * j**3 - 0.02 * i * i * j
        return pd.Series(K.spline_sample(tile.astype(float), r.to_numpy(float), c.to_numpy(float)))

    return table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), r6(run(F.col("p_size") / 6.0, (F.col("p_retailprice") - 900) / 10.0)).alias("z"))


@query("SELECT i::INT AS i, j::INT AS j, " + sql6("2 + 3 * (j + 0.25) - 0.5 * (i - 0.4::DOUBLE) + 0.01 * pow(j + 0.25, 3)") + " AS z FROM range(0, 12) a(i), range(0, 11) b(j)")
def tile_shift(spark, sf):
    i, j = np.mgrid[0:12, 0:11]
    z = K.spline_shift((2 + 3 * j - 0.5 * i + 0.01 * j**3).astype(float), -0.4, 0.25)
    rows = [(int(a), int(b), round(float(z[a, b]), 6) + 0.0) for a in range(12) for b in range(11)]
    return spark.createDataFrame(rows, "i int, j int, z double")


# ---- a synthetic scene: a texture that moves 1.5 units a frame to the right and 0.5 down; one unit is a pixel


def _texture(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 100 + 30 * np.sin(x / 3.1) * np.cos(y / 2.7) + 20 * np.sin(x / 1.9 + y / 4.3) + 10 * np.cos(x * y / 97.0) + 8 * np.sin(x / 7.7 - y / 1.3)


_NX, _NY, _FRAMES = 160, 160, 6


def image_rows(spark):
    """Rows of pixels of every frame: step, t, row, values."""

    def run(batches):
        for b in batches:
            for s, r in zip(b["step"], b["row"]):
                x = np.arange(_NX) + 0.5
                yield pd.DataFrame({"step": [int(s)], "t": [float(s)], "row": [int(r)], "values": [_texture(x - 1.5 * s, r + 0.5 - 0.5 * s)]})

    rows = spark.range(_FRAMES * _NY).select((F.col("id") / _NY).cast("int").alias("step"), (F.col("id") % _NY).cast("int").alias("row"))
    return rows.mapInPandas(run, "step int, t double, row int, values array<double>")


def _pixels(points: np.ndarray) -> np.ndarray:
    return points[:, :2]


def _models(spark, sf):
    """A track for each nation, starting on a lattice, with a guess of the velocity that is off by half a pixel."""
    k = F.col("n_nationkey")
    params = F.create_map(*[x for n, v in {"x": 50.0 + (k % 5) * 15.0, "y": 50.0 + F.floor(k / 5) * 10.0, "vx": F.lit(1.0), "vy": F.lit(0.0), "svx": F.lit(0.8), "svy": F.lit(0.8), "sax": F.lit(0.05), "say": F.lit(0.05)}.items() for x in (F.lit(n), v.cast("double"))])
    return table(spark, sf, "nation").select(k.cast("long").alias("track"), (50.0 + (k % 5) * 15.0).alias("u"), (50.0 + F.floor(k / 5) * 10.0).cast("double").alias("v"), F.lit("cartesian").alias("kind"), (k + 1).cast("long").alias("seed"), params.alias("params"))


def _tracked(spark, sf, method="systematic"):
    models = _models(spark, sf)
    frames = K.patches(models, image_rows(spark), 45).join(models.select("track", "kind", "seed", "params"), "track")
    return K.track(frames, _pixels, particles=400, tile=15, sigma=0.1, method=method)


@query()
def tracker_track(spark, sf):
    t = _tracked(spark, sf)
    return t.select("track", "step", *[r6(F.col(c), 3).alias(c) for c in ("x", "y", "vx", "vy", "sx", "sy")], "error")


@query("SELECT n_nationkey::BIGINT AS track, true AS found, true AS clean FROM nation")
def tracker_velocity(spark, sf):
    """The velocity of the texture, found to a fifth of a pixel a frame."""
    ends = _tracked(spark, sf).groupBy("track").agg(F.max_by("x", "step").alias("x1"), F.min_by("x", "step").alias("x0"), F.max_by("y", "step").alias("y1"), F.min_by("y", "step").alias("y0"), F.bool_and(F.col("error").isNull()).alias("clean"))
    n = _FRAMES - 1
    ok = (F.abs((F.col("x1") - F.col("x0")) / n - 1.5) < 0.2) & (F.abs((F.col("y1") - F.col("y0")) / n - 0.5) < 0.2)
    return ends.select("track", ok.alias("found"), "clean")


@query()
def resample_particles(spark, sf):
    """The same scene under each of the other resampling methods: end points."""
    out = None
    for method in ("stratified", "residual", "choice"):
        e = _tracked(spark, sf, method).groupBy("track").agg(r6(F.max_by("x", "step"), 2).alias("x")).withColumn("method", F.lit(method))
        out = e if out is None else out.unionByName(e)
    return out


@query()
def tracker_template(spark, sf):
    """The prepared template of each track: mean and spread of its pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        image = np.stack([np.asarray(r, float) for r in f["pixels"]])
        c = int(f["u"]) - int(f["col0"])
        r = int(f["v"]) - int(f["row0"])
        tile, _ = K.prepare(image[r - 7 : r + 8, c - 7 : c + 8])
        return pd.DataFrame({"track": [f["track"]], "mean": [round(float(tile.mean()), 6) + 0.0], "spread": [round(float(tile.std()), 6)]})

    models = _models(spark, sf)
    first = K.patches(models, image_rows(spark).where("step = 0"), 45).join(models.select("track", "u", "v"), "track")
    return first.groupBy("track").applyInPandas(run, "track long, mean double, spread double")


@query("SELECT n_nationkey::BIGINT AS track, 0::INT AS drow, 0::INT AS dcol FROM nation")
def tracker_likelihood(spark, sf):
    """Where the template of the first frame fits best in the first frame: at its own place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        image = np.stack([np.asarray(r, float) for r in f["pixels"]])
        c, r = int(f["u"]) - int(f["col0"]), int(f["v"]) - int(f["row0"])
        sse = K.squared_difference(image[r - 17 : r + 18, c - 17 : c + 18], image[r - 7 : r + 8, c - 7 : c + 8])
        i, j = np.unravel_index(int(sse.argmin()), sse.shape)
        return pd.DataFrame({"track": [f["track"]], "drow": [int(i) - 10], "dcol": [int(j) - 10]})

    models = _models(spark, sf)
    first = K.patches(models, image_rows(spark).where("step = 0"), 45).join(models.select("track", "u", "v"), "track")
    return first.groupBy("track").applyInPandas(run, "track long, drow int, dcol int")


@query("SELECT s::INT AS step, r::INT AS row, 20 AS n FROM range(0, 6) a(s), range(10, 30) b(r)")
def scan_image_read(spark, sf):
    """A box of every frame: rows by filter, columns by slice."""
    return image_rows(spark).where("row >= 10 AND row < 30").select("step", "row", F.size(F.slice("values", 41, 20)).alias("n"))


def _streamed(spark, sf, made, mode: str):
    """A query over the events as a stream, run to its end over all files, as a table.

    Results are written by the executors: of each batch in append mode, of the last one, which holds all, in complete mode."""
    path = scratch(spark, "streamed")
    # A file source wants a folder or a pattern; the table may be either a file or a folder.
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    out = made(source)
    done = []

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    run = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    batches = [f"{path}/{n}" for n in done]
    return spark.read.schema(out.schema).parquet(*(batches[-1:] if mode == "complete" else batches)) if batches else spark.createDataFrame([], out.schema)


@query(
    "SELECT time_bucket(INTERVAL '1 day', ts) AS start, user_id AS track, "
    + sql6("sum(value / (s * s)) / sum(1 / (s * s))")
    + " AS mean, count(*) AS n FROM (SELECT *, 1.0::DOUBLE + event_id % 7 AS s FROM events) GROUP BY ALL"
)
def stream_windowed(spark, sf):
    from ..streaming.tracks import windowed

    def made(source):
        rows = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("track"), F.col("value").alias("x"), (1.0 + F.col("event_id") % 7).alias("s"))
        return windowed(rows, "1 day", "1 hour")

    out = _streamed(spark, sf, made, "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "track", r6(F.col("mean")).alias("mean"), "n")


@query("SELECT track, " + sql6("t", 3) + " AS t, x FROM (SELECT user_id AS track, epoch_us(ts) / 1e6 AS t, value AS x FROM events)")
def stream_latest(spark, sf):
    from ..streaming.tracks import latest

    def made(source):
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return latest(source.select(F.col("user_id").alias("track"), (us / 1e6).alias("t"), F.col("value").alias("x")))

    return _streamed(spark, sf, made, "append").select("track", r6(F.col("t"), 3).alias("t"), "x")
