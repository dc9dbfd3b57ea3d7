"""Time, statistics, particle and track queries.  Events are images (or track points) of an observer, their user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..operators import temporal as T
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


EV = "ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us, 1.0::DOUBLE + event_id % 7 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
HOUR = 3_600_000_000


def events(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", T.micros(F.col("ts")).alias("us"), (1.0 + F.col("event_id") % 7).alias("s"))
    return T.numbered(e, "user_id", ["us", "event_id"])


def _targets(spark, sf, every=6 * HOUR):
    e = events(spark, sf).agg(F.min("us").alias("a"), F.max("us").alias("b"))
    t = e.select(F.explode(T.snap_targets(F.col("a"), F.col("b"), every / 1e6)).alias("target"))
    return events(spark, sf).select("user_id").distinct().crossJoin(t)


_TG = f"tg AS (SELECT user_id, t AS target FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(range((min(us) + {6 * HOUR} - 1) // {6 * HOUR} * {6 * HOUR}, max(us) + 1, {6 * HOUR})) AS t FROM ev))"


@query(
    f"""WITH {EV}, {_TG}, c AS (SELECT tg.user_id, target, event_id, abs(us - target) AS gap, row_number() OVER (PARTITION BY tg.user_id, target ORDER BY abs(us - target), us, event_id DESC) AS r FROM tg JOIN ev USING (user_id))
SELECT user_id, target, CASE WHEN gap <= {2 * HOUR} THEN event_id END AS event_id, CASE WHEN gap <= {2 * HOUR} THEN gap END AS gap FROM c WHERE r = 1"""
)
def match_datetimes(spark, sf):
    return T.nearest(_targets(spark, sf), events(spark, sf), "user_id", "event_id", 7200)


@query(f"WITH {EV} SELECT user_id, arg_min(event_id, (abs(us - 1705320000000000), us)) AS event_id, min(abs(us - 1705320000000000)) AS gap FROM ev GROUP BY 1 HAVING gap <= {12 * HOUR}")
def observer_index(spark, sf):
    """Each observer's image nearest to one instant, within 12 hours."""
    t = events(spark, sf).select("user_id").distinct().withColumn("target", F.lit(1705320000000000))
    return T.nearest(t, events(spark, sf), "user_id", "event_id", 43200).where("event_id IS NOT NULL").drop("target")


@query("SELECT o_orderkey AS k, arg_min(n_nationkey, (abs(n_nationkey * 20000.0::DOUBLE - o_totalprice), n_nationkey)) AS nearest FROM orders, nation GROUP BY 1")
def sorted_nearest(spark, sf):
    """Nearest of 25 sorted values, the left one of two: each order searches them."""
    v = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct((F.col("n_nationkey") * 20000.0).alias("value"), F.col("n_nationkey").cast("long").alias("id")))).alias("values"))
    return table(spark, sf, "orders").crossJoin(v).select(F.col("o_orderkey").alias("k"), T.nearest_sorted(F.col("values"), F.col("o_totalprice")).alias("nearest"))


@query(f"WITH {EV}, {_TG} SELECT user_id, target, max(us) FILTER (us <= target) AS before, min(us) FILTER (us >= target) AS after FROM tg JOIN ev USING (user_id) GROUP BY ALL")
def interp_nearest(spark, sf):
    """The rasters before and after each instant."""
    left = _targets(spark, sf).select("user_id", F.col("target").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("us"))
    right = events(spark, sf).select("user_id", F.col("us").alias("at"), F.lit(0).alias("side"), "us")
    upto = Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    back_to = Window.partitionBy("user_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns({"before": F.last("us", True).over(upto), "after": F.last("us", True).over(back_to)})
    return both.where("side = 1").select("user_id", F.col("at").alias("target"), "before", "after")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(us - 1705320000000000), us) AS r FROM ev) SELECT user_id, event_id, r::INT AS r FROM r WHERE r <= 2")
def nearest_two_rasters(spark, sf):
    near = F.row_number().over(Window.partitionBy("user_id").orderBy(F.abs(F.col("us") - 1705320000000000), "us"))
    return events(spark, sf).withColumn("r", near).where("r <= 2").select("user_id", "event_id", "r")


@query(f"WITH {EV}, {_TG} SELECT user_id, count(*) AS n FROM tg WHERE EXISTS (SELECT 1 FROM ev WHERE ev.user_id = tg.user_id AND abs(us - target) <= {2 * HOUR}) GROUP BY 1")
def parse_datetimes(spark, sf):
    """Targets that some image matches, counted for each observer."""
    return T.nearest(_targets(spark, sf), events(spark, sf), "user_id", "event_id", 7200).where("event_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT a.user_id, a.event_id AS i, b.event_id AS j FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.n < b.n AND b.us - a.us <= {2 * HOUR}")
def match_pairs(spark, sf):
    return T.pairs_within(events(spark, sf), "user_id", "event_id", 7200).select("user_id", "i", "j")


@query(f"WITH {EV} SELECT DISTINCT a.user_id, a.n::INT AS ni, b.n::INT AS nj FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.n < b.n AND (b.us - a.us <= {2 * HOUR} OR b.n - a.n IN (1, 5))")
def pairs_union(spark, sf):
    e = events(spark, sf)
    near = T.pairs_within(e, "user_id", "event_id", 7200).select("user_id", F.col("ni").cast("int").alias("ni"), F.col("nj").cast("int").alias("nj"))
    last = F.max("n").over(Window.partitionBy("user_id"))
    lags = e.withColumn("m", last).select("user_id", F.col("n").alias("ni"), F.explode(F.array(F.col("n") + 1, F.col("n") + 5)).alias("nj"), "m").where("nj <= m")
    return near.unionByName(lags.select("user_id", "ni", "nj")).distinct()


@query(f"WITH {EV} SELECT a.user_id, a.event_id AS i, b.event_id AS j FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.n < b.n AND b.us - a.us <= {2 * HOUR} WHERE a.event_type = 'error' OR b.event_type = 'error'")
def pairs_intersect_imgs(spark, sf):
    """Pairs that touch a wanted image."""
    e = events(spark, sf)
    wanted = e.where("event_type = 'error'").select(F.col("event_id").alias("w"))
    p = T.pairs_within(e, "user_id", "event_id", 7200).select("user_id", "i", "j")
    first = p.join(wanted, F.col("i") == F.col("w"), "left_semi")
    return first.unionByName(p.join(wanted, F.col("j") == F.col("w"), "left_semi")).distinct()


@query(
    f"""WITH {EV}, ends AS (SELECT user_id, min(us) - {6 * HOUR} AS a, max(us) + {6 * HOUR} AS b FROM ev GROUP BY 1), tg AS (SELECT user_id, unnest(range((a + {6 * HOUR} - 1) // {6 * HOUR} * {6 * HOUR}, b + 1, {6 * HOUR})) AS target FROM ends),
c AS (SELECT tg.user_id, event_id, abs(us - target) AS gap, row_number() OVER (PARTITION BY tg.user_id, target ORDER BY abs(us - target), us, event_id DESC) AS r FROM tg JOIN ev USING (user_id))
SELECT DISTINCT user_id, event_id FROM c WHERE r = 1 AND gap <= {HOUR * 3 // 2}"""
)
def select_datetimes(spark, sf):
    return T.select_snapped(events(spark, sf), "user_id", "event_id", 6 * 3600, 5400)


@query("SELECT n_nationkey AS k, i::INT AS i, TIMESTAMP '2024-01-01' + INTERVAL (n_nationkey) HOUR + i * INTERVAL '90 minutes' AS t FROM nation, range(0, 17) r(i)")
def datetime_range(spark, sf):
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, n_nationkey, 0, 0)")
    t = F.posexplode(F.sequence(start, start + F.expr("interval 1 day"), F.expr("interval 90 minutes"))).alias("i", "t")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), t)


@query(f"WITH {EV} SELECT user_id, event_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY n) AS step FROM ev")
def time_diff(spark, sf):
    return events(spark, sf).select("user_id", "event_id", (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("n"))).alias("step"))


@query(f"WITH {EV} SELECT DISTINCT us FROM ev")
def observer_datetimes_union(spark, sf):
    return events(spark, sf).select("us").distinct()


@query("SELECT DISTINCT p_size AS lag FROM part")
def sort_unique(spark, sf):
    return table(spark, sf, "part").select(F.col("p_size").alias("lag")).distinct().orderBy("lag")


@query(f"WITH {EV}, d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY n) AS dv, us - lag(us) OVER (PARTITION BY user_id ORDER BY n) AS du FROM ev) SELECT user_id, bool_and(coalesce(du > 0, true)) AS strict, bool_and(coalesce(du >= 0, true)) OR bool_and(coalesce(du <= 0, true)) AS monotonic FROM d GROUP BY 1")
def monotonic_check(spark, sf):
    return T.strictly_increasing(events(spark, sf), "user_id", "n", "us")


@query(f"WITH {EV} SELECT user_id, event_id FROM ev WHERE us >= 1704844800000000 AND us < 1705708800000000")
def observer_subset(spark, sf):
    return events(spark, sf).where("us >= 1704844800000000 AND us < 1705708800000000").select("user_id", "event_id")


@query(
    f"""WITH {EV}, m AS (SELECT *, min(us) OVER (PARTITION BY user_id) AS a, max(us) OVER (PARTITION BY user_id) AS b FROM ev), d AS (SELECT *, least(floor((us - a) * 4 / (b - a)::DOUBLE), 3)::INT AS span FROM m),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, span ORDER BY us DESC, event_id DESC) AS r FROM d)
SELECT user_id, event_id, span, false AS repeated FROM l UNION ALL SELECT user_id, event_id, span + 1, true FROM l WHERE r <= 2 AND span < 3"""
)
def observer_split(spark, sf):
    return T.split_spans(events(spark, sf), "user_id", ["us", "event_id"], 4, 2).select("user_id", "event_id", "span", "repeated")


@query("SELECT a.s_suppkey AS a, n_nationkey AS b, abs(a.s_suppkey * 3600.0::DOUBLE - n_nationkey * 86400.0::DOUBLE) AS seconds FROM supplier a, nation")
def pairwise_distance_datetimes(spark, sf):
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (start + F.expr("make_dt_interval(0, cast(s_suppkey as int), 0, 0)")).alias("ta"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"), (start + F.expr("make_dt_interval(n_nationkey, 0, 0, 0)")).alias("tb"))
    return a.crossJoin(b).select("a", "b", F.abs(T.seconds(F.col("ta")) - T.seconds(F.col("tb"))).alias("seconds"))


# ---- statistics


@query(f"WITH {EV} SELECT user_id, event_type, {sql6('sum(value / (s * s)) / sum(1 / (s * s))')} AS mean, {sql6('1 / sqrt(sum(1 / (s * s)))')} AS sigma FROM ev GROUP BY ALL")
def tracks_merge(spark, sf):
    m, s = S.sum_normals(F.col("value"), F.col("s"), 1.0 / (F.col("s") * F.col("s")))
    return events(spark, sf).groupBy("user_id", "event_type").agg(r6(m).alias("mean"), r6(s).alias("sigma"))


@query(f"WITH {EV} SELECT user_id, {sql6('sum(value / (s * s)) / sum(1 / (s * s))')} AS mean, {sql6('sum(1 / s) / sum(1 / (s * s))')} AS sigma FROM ev GROUP BY ALL")
def tracks_average(spark, sf):
    m, s = S.sum_normals(F.col("value"), F.col("s"), 1.0 / (F.col("s") * F.col("s")), rho=1.0)
    return events(spark, sf).groupBy("user_id").agg(r6(m).alias("mean"), r6(s).alias("sigma"))


@query(f"WITH {EV} SELECT event_type, {sql6('sum(w * value) / sum(w)')} AS mean, {sql6('sqrt(0.7 * sum(w * w * s * s) + 0.3 * pow(sum(w * s), 2)) / sum(w)')} AS sigma FROM (SELECT *, 1 + event_id % 3 AS w FROM ev) GROUP BY ALL")
def sum_normals(spark, sf):
    m, s = S.sum_normals(F.col("value"), F.col("s"), 1.0 + F.col("event_id") % 3, rho=0.3)
    return events(spark, sf).groupBy("event_type").agg(r6(m).alias("mean"), r6(s).alias("sigma"))


_PART = "pa AS (SELECT l_suppkey AS track, l_orderkey * 8 + l_linenumber AS pid, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_extendedprice / 1000 AS w FROM lineitem), mo AS (SELECT track, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM pa GROUP BY 1)"


def particles(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("track"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_extendedprice") / 1000).alias("w")
    )


def _moments(spark, sf):
    return S.weighted_moments(particles(spark, sf), ["track"], ["x", "y", "z"], "w")


@query(f"WITH {_PART} SELECT track, {sql6('mx')} AS x, {sql6('my')} AS y, {sql6('mz')} AS z FROM mo")
def particle_mean(spark, sf):
    return _moments(spark, sf).select("track", *[r6(F.col(f"mean_{c}")).alias(c) for c in "xyz"])


@query(f"WITH {_PART} SELECT track, " + ", ".join(f"{sql6(f'sqrt(sum(w * pow({c} - m{c}, 2)) / sum(w))')} AS {c}" for c in "xyz") + " FROM pa JOIN mo USING (track) GROUP BY 1")
def particle_sigma(spark, sf):
    return _moments(spark, sf).select("track", *[r6(F.col(f"sigma_{c}")).alias(c) for c in "xyz"])


@query(f"WITH {_PART} SELECT track, " + ", ".join(f"{sql6(f'sum(w * ({a} - m{a}) * ({b} - m{b})) / sum(w)')} AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM pa JOIN mo USING (track) GROUP BY 1")
def particle_covariance(spark, sf):
    return _moments(spark, sf).select("track", *[r6(F.col(f"cov_{a}_{b}")).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])


@query(f"WITH {EV} SELECT event_id, {sql6('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS z FROM ev WINDOW w AS (PARTITION BY event_type)")
def normalize(spark, sf):
    e = events(spark, sf)
    m = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return e.join(m, "event_type").select("event_id", r6((F.col("value") - F.col("m")) / F.col("d")).alias("z"))


@query(f"WITH {EV} SELECT DISTINCT event_type, value, {sql6('cume_dist() OVER (PARTITION BY event_type ORDER BY value)', 9)} AS q FROM ev")
def compute_cdf(spark, sf):
    return S.distribution(events(spark, sf), ["event_type"], "value", F.floor(F.col("value") / 8)).withColumn("q", r6(F.col("q"), 9))


@query(
    f"""WITH {EV}, a AS (SELECT DISTINCT value, cume_dist() OVER (ORDER BY value) AS q FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT value AS v, cume_dist() OVER (ORDER BY value) AS q FROM ev WHERE event_type = 'view'),
st AS (SELECT v, q, lead(v) OVER (ORDER BY q) AS v1, lead(q) OVER (ORDER BY q) AS q1 FROM b), lo AS (SELECT min(q) AS q, min(v) AS v FROM b)
SELECT value, {sql6('CASE WHEN a.q < lo.q THEN lo.v WHEN st.q1 IS NULL THEN st.v ELSE st.v + (a.q - st.q) / (st.q1 - st.q) * (st.v1 - st.v) END')} AS matched FROM a CROSS JOIN lo LEFT JOIN st ON st.q <= a.q AND (a.q < st.q1 OR st.q1 IS NULL)"""
)
def match_cdf(spark, sf):
    e = events(spark, sf).withColumn("part", F.lit(0))
    a, b = (S.distribution(e.where(F.col("event_type") == t), ["part"], "value", F.floor(F.col("value") / 8)) for t in ("click", "view"))
    return S.match_distribution(e, "value", a, b).select("value", r6(F.col("matched")).alias("matched"))


@query(f"WITH {EV} SELECT event_id, {sql6('s * count(*) OVER () / sum(s) OVER ()', 9)} AS w FROM ev")
def weights_normalize(spark, sf):
    e = events(spark, sf)
    return e.crossJoin(e.agg((F.count("*") / F.sum("s")).alias("f"))).select("event_id", r6(F.col("s") * F.col("f"), 9).alias("w"))


_CUMW = f"{EV}, cw AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS c, sum(value) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS m FROM ev)"


@query(f"WITH {_CUMW}, d AS (SELECT user_id, unnest(range(0, m)) AS draw, t, m FROM (SELECT DISTINCT user_id, t, m FROM cw)) SELECT d.user_id, draw, event_id FROM d JOIN cw ON cw.user_id = d.user_id AND (c - value) / cw.t < (draw + 0.37) / d.m AND (draw + 0.37) / d.m <= c / cw.t")
def resample_systematic(spark, sf):
    bucket = F.floor(F.col("event_id") / 4096)
    return S.resample_systematic(events(spark, sf).where("user_id IS NOT NULL"), ["user_id"], "event_id", "value", 0.37, bucket)


_DRAWS = "d AS (SELECT user_id, n AS draw, (n + ((event_id * 7919) % 1000) / 1000.0::DOUBLE) / count(*) OVER (PARTITION BY user_id) AS position, event_id AS own FROM ev)"


def _draws(spark, sf, stratified=True):
    e = events(spark, sf)
    u = ((F.col("event_id") * 7919) % 1000) / 1000.0
    where = (F.col("n") + u) / F.count("*").over(Window.partitionBy("user_id")) if stratified else u + 0.0005
    return e.select("user_id", F.col("n").alias("draw"), where.alias("position"))


@query(f"WITH {_CUMW}, {_DRAWS} SELECT d.user_id, draw::BIGINT AS draw, min(event_id) AS event_id FROM d JOIN cw ON cw.user_id = d.user_id AND c / t >= position GROUP BY ALL")
def resample_stratified(spark, sf):
    return S.resample_at(events(spark, sf), _draws(spark, sf), ["user_id"], "event_id", "value")


@query(f"WITH {_CUMW} SELECT d.user_id, d.n::BIGINT AS draw, min(cw.event_id) AS event_id FROM ev d JOIN cw ON cw.user_id = d.user_id AND c / t >= ((d.event_id * 7919) % 1000) / 1000.0::DOUBLE + 0.0005 GROUP BY ALL")
def resample_choice(spark, sf):
    return S.resample_at(events(spark, sf), _draws(spark, sf, stratified=False), ["user_id"], "event_id", "value")


@query(f"WITH {_CUMW} SELECT user_id, event_id, floor(value * m / t)::INT AS copies, {sql6('value * m / t - floor(value * m / t)', 9)} AS left_over FROM cw")
def resample_residual(spark, sf):
    rest = S.resample_residual(events(spark, sf), ["user_id"], "event_id", "value")
    return rest.select("user_id", "event_id", "copies", r6(F.col("value"), 9).alias("left_over"))


@query("SELECT l_suppkey AS track, l_partkey AS pid, " + sql6("exp(-sum(l_discount * l_quantity / 50)) + 1e-300", 9) + " AS w FROM lineitem GROUP BY ALL")
def tracker_update_weights(spark, sf):
    """Weights from the negative log-likelihoods of all observers."""
    nll = F.col("l_discount") * F.col("l_quantity") / 50
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("track"), F.col("l_partkey").alias("pid")).agg(r6(F.exp(-F.sum(nll)) + 1e-300, 9).alias("w"))


# ---- tracks: a user's events are the steps of a track; errors leave no value


_TR = f"{EV}, tr AS (SELECT user_id AS track, n AS step, CASE WHEN event_type <> 'error' THEN value END AS x, s FROM ev)"


def tracks(spark, sf):
    return events(spark, sf).select(F.col("user_id").alias("track"), F.col("n").alias("step"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"), "s", "event_type")


@query(f"WITH {_TR} SELECT track, min(step) FILTER (x IS NOT NULL)::INT AS first, max(step) FILTER (x IS NOT NULL)::INT AS last FROM tr GROUP BY 1")
def tracks_endpoints(spark, sf):
    step = F.when(F.col("x").isNotNull(), F.col("step"))
    return tracks(spark, sf).groupBy("track").agg(F.min(step).alias("first"), F.max(step).alias("last"))


@query(f"WITH {_TR} SELECT track, bool_and(x IS NOT NULL) AS success FROM tr GROUP BY 1")
def tracks_success(spark, sf):
    return tracks(spark, sf).groupBy("track").agg(F.bool_and(F.col("x").isNotNull()).alias("success"))


@query(f"WITH {_TR} SELECT track, (max(step) OVER (PARTITION BY track) - step)::INT AS step, x, s FROM tr")
def tracks_reverse(spark, sf):
    back = F.max("step").over(Window.partitionBy("track")) - F.col("step")
    return tracks(spark, sf).select("track", back.alias("step"), "x", "s")


@query(f"WITH {_PART} SELECT track, " + ", ".join(f"{sql6(f'sqrt(sum(w * pow({c} - m{c}, 2)) / sum(w))')} AS s{c}" for c in "xyz") + f", {sql6('any_value(mx)')} AS x FROM pa JOIN mo USING (track) GROUP BY 1")
def tracks_accessors(spark, sf):
    """Means, and sigmas as the root of the covariance's diagonal."""
    return _moments(spark, sf).select("track", *[r6(F.sqrt(F.col(f"cov_{c}_{c}"))).alias(f"s{c}") for c in "xyz"], r6(F.col("mean_x")).alias("x"))


@query(f"WITH {_TR} SELECT step::INT AS step, count(*) AS n FROM tr WHERE x IS NOT NULL AND step IN (SELECT DISTINCT p_size FROM part) GROUP BY 1")
def frames_intersect(spark, sf):
    """Steps with a solution that also have an image."""
    images = table(spark, sf, "part").select(F.col("p_size").alias("step")).distinct()
    return tracks(spark, sf).where("x IS NOT NULL").join(images, "step", "left_semi").groupBy("step").agg(F.count("*").alias("n"))
