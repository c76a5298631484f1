"""Queries of scans, projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from pepspark.operators import relational as R
from pepspark.operators import sampling as P
from pepspark.operators import spectra as S
from pepspark.operators import windows as W
from pepspark.plans import analogs as A
from pepspark.plans.analogs import table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- projections and filters


@query("prj01_select_exclude", "SELECT * EXCLUDE (p_name, p_type) FROM part")
def _(spark, d):
    return table(spark, d, "part").drop("p_name", "p_type")


@query("prj02_derived_rename", "SELECT o_orderkey AS id, round(o_totalprice / 1000.0, 6) AS thousands, year(o_orderdate)::int AS year FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000.0, 6).alias("thousands"), F.year("o_orderdate").alias("year")).withColumnsRenamed({"o_orderkey": "id"})


@query("prj05_dense_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id FROM orders")
def _(spark, d):
    return R.dense_id(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], "id").select("o_orderkey", F.col("id").cast("long").alias("id"))


@query("prj05b_wide_dense_id", "SELECT o_orderkey, o_orderpriority, o_totalprice, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id FROM orders")
def _(spark, d):
    return R.dense_id(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "id").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey", "id")


@query("prj06_when_chain", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax FROM lineitem")
def _(spark, d):
    band = W.when_column([(F.col("l_quantity") < 10, "low"), (F.col("l_quantity") < 30, "mid")], "high")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", band.alias("band"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).otherwise(F.lit(None).cast("double")).alias("tax"))


@query("flt02_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def _(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("flt03_charge_bounds", "SELECT p_partkey, z FROM part, (SELECT unnest([1, 2, 3, 4]) AS z) WHERE p_retailprice BETWEEN 1000.0 - 3.5 / z AND 1400.0 + 1.25 / z")
def _(spark, d):
    charged = table(spark, d, "part").select("p_partkey", "p_retailprice", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("z"))
    return charged.where(F.col("p_retailprice").between(1000.0 - 3.5 / F.col("z"), 1400.0 + 1.25 / F.col("z"))).select("p_partkey", "z")


@query("flt04_null_keys", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").dropna(subset=["quality", "toxic"])


@query("flt06_disjunction", "SELECT o_orderkey FROM orders WHERE o_totalprice <= 50000 OR o_orderstatus = 'F'")
def _(spark, d):
    return table(spark, d, "orders").where((F.col("o_totalprice") <= 50000) | (F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("flt07_score_threshold", f"WITH {A.MATCHES} SELECT pmsm_index, score FROM pmsm WHERE score > 50000")
def _(spark, d):
    return A.matches(spark, d).where("score > 50000").select("pmsm_index", "score")


# --- joins


@query(
    "jn01_star_join",
    """SELECT l_orderkey, l_linenumber, p_brand, s_name, n_name, r_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.star_join(facts, (part, "l_partkey"), (supplier, "l_suppkey"), (nation, "s_nationkey"), (region, "n_regionkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name", "r_name")


@query(
    "jn03_composite_left_join",
    f"WITH {A.MATCHES}, best AS (SELECT run_index, precursor_index, max(score) AS best FROM pmsm WHERE NOT is_decoy GROUP BY ALL) SELECT pmsm_index, best FROM pmsm LEFT JOIN best USING (run_index, precursor_index)",
)
def _(spark, d):
    m = A.matches(spark, d)
    best = m.where("not is_decoy").groupBy("run_index", "precursor_index").agg(F.max("score").alias("best"))
    return m.join(best, ["run_index", "precursor_index"], "left").select("pmsm_index", "best")


@query("jn04_composite_inner_join", f"WITH {A.MATCHES}, c AS (SELECT run_index, precursor_index, count(*) AS n FROM pmsm GROUP BY ALL HAVING count(*) > 2) SELECT pmsm_index, n FROM pmsm JOIN c USING (run_index, precursor_index)")
def _(spark, d):
    m = A.matches(spark, d)
    many = m.groupBy("run_index", "precursor_index").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return m.join(many, ["run_index", "precursor_index"]).select("pmsm_index", "n")


@query("jn05_semi_join", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "n_chars")


_BEST = "best AS (SELECT run_index, precursor_index, arg_max(observed_rt, (score, -pmsm_index)) AS rt FROM pmsm GROUP BY ALL)"


@query("jn07_run_pairs", f"WITH {A.MATCHES}, {_BEST} SELECT a.precursor_index, a.run_index AS run_a, b.run_index AS run_b, a.rt AS rt_a, b.rt AS rt_b FROM best a JOIN best b ON a.precursor_index = b.precursor_index AND a.run_index < b.run_index")
def _(spark, d):
    best = R.best_row(A.matches(spark, d), ["run_index", "precursor_index"], "score", ["pmsm_index"]).select("run_index", "precursor_index", "observed_rt")
    a = best.select("precursor_index", F.col("run_index").alias("run_a"), F.col("observed_rt").alias("rt_a"))
    b = best.select("precursor_index", F.col("run_index").alias("run_b"), F.col("observed_rt").alias("rt_b"))
    return a.join(b, "precursor_index").where("run_a < run_b")


_PPM = "mz BETWEEN theo_mz - theo_mz * 5000.0 * 1e-6 AND theo_mz + theo_mz * 5000.0 * 1e-6"


@query("jn08_ppm_join", f"WITH {A.PEAKS}, {A.THEORETICAL} SELECT theo_mz, event_id, mz FROM theo JOIN peaks ON {_PPM}")
def _(spark, d):
    return R.ppm_join(A.theoretical(spark, d), A.peaks(spark, d), "theo_mz", "mz", 5000.0).select("theo_mz", "event_id", "mz")


_BOUNDS = "b AS (SELECT min(time) AS t0, max(time) AS t1 FROM peaks)"


@query(
    "jn09_mz_time_join",
    f"WITH {A.PEAKS}, {A.THEORETICAL}, {_BOUNDS} SELECT theo_mz, event_id FROM theo JOIN peaks ON {_PPM}, b WHERE time BETWEEN t0 + (theo_mz / 500.0 - 0.3) * (t1 - t0) AND t0 + (theo_mz / 500.0 + 0.3) * (t1 - t0)",
)
def _(spark, d):
    peaks = A.peaks(spark, d)
    span = peaks.agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    library = A.theoretical(spark, d).crossJoin(F.broadcast(span)).select("theo_mz", (F.col("t0") + (F.col("theo_mz") / 500.0 - 0.3) * (F.col("t1") - F.col("t0"))).alias("rt_low"), (F.col("t0") + (F.col("theo_mz") / 500.0 + 0.3) * (F.col("t1") - F.col("t0"))).alias("rt_high"))
    return S.match_fragments(library, peaks, 5000.0, "rt_low", "rt_high", "time").select("theo_mz", "event_id")


_WINDOWS = "w AS (SELECT i AS window_id, i * 50.0 AS low, i * 50.0 + 52.0 AS high FROM range(0, 10) t(i))"


@query("jn10_isolation_windows", f"WITH {A.PEAKS}, {_WINDOWS} SELECT window_id, event_id FROM w JOIN peaks ON mz BETWEEN low - 3.5 / 2 AND high + 1.25 / 2")
def _(spark, d):
    windows = spark.range(10).select(F.col("id").alias("window_id"), (F.col("id") * 50.0).alias("low"), (F.col("id") * 50.0 + 52.0).alias("high"))
    return S.in_windows(A.peaks(spark, d).withColumn("z", F.lit(2)), windows, "mz", "low", "high", "z", width=25.0).select("window_id", "event_id")


@query("jn10b_strict_windows", f"WITH {A.PEAKS}, {_WINDOWS} SELECT window_id, event_id FROM w JOIN peaks ON mz > low - 3.5 / 2 AND mz < high + 1.25 / 2")
def _(spark, d):
    windows = spark.range(10).select(F.col("id").alias("window_id"), (F.col("id") * 50.0).alias("low"), (F.col("id") * 50.0 + 52.0).alias("high"))
    return S.in_windows(A.peaks(spark, d).withColumn("z", F.lit(2)), windows, "mz", "low", "high", "z", width=25.0, strict=True).select("window_id", "event_id")


@query(
    "jn11_nearest_frame",
    f"""WITH {A.PEAKS}, a AS (SELECT * FROM peaks WHERE run <> 'view'), b AS (SELECT min(event_id) AS event_id, time FROM peaks WHERE run = 'view' GROUP BY time),
    lo AS (SELECT a.event_id AS id, a.time AS t, b.event_id AS bid, b.time AS bt FROM a ASOF LEFT JOIN b ON a.time >= b.time),
    hi AS (SELECT a.event_id AS id, b.event_id AS aid, b.time AS ta FROM a ASOF LEFT JOIN b ON a.time <= b.time)
    SELECT id AS event_id, CASE WHEN ta IS NULL OR t - bt <= ta - t THEN bid ELSE aid END AS nearest FROM lo JOIN hi USING (id)""",
)
def _(spark, d):
    peaks = A.peaks(spark, d)
    first = peaks.where("run = 'view'").groupBy("time").agg(F.min("event_id").alias("right_id")).withColumnRenamed("time", "right_time")
    return R.nearest_join(peaks.where("run <> 'view'").select("event_id", "time"), first, "time", "right_time", "right_id").select("event_id", "nearest")


_BINS = """ce AS (SELECT event_id AS centre_id, time AS centre FROM peaks WHERE run = 'purchase'), fr AS (SELECT min(event_id) AS frame, time FROM peaks WHERE run = 'view' GROUP BY time),
  bn AS (SELECT centre_id, b::int AS bin, centre + b * 900.0 AS mid FROM ce, range(-4, 5) t(b)),
  asg AS (SELECT centre_id, bin, frame FROM bn JOIN fr ON time BETWEEN mid - 450.0 AND mid + 450.0 QUALIFY row_number() OVER (PARTITION BY centre_id, bin ORDER BY abs(time - mid), frame) = 1)"""


def _binned(spark, d):
    p = A.peaks(spark, d)
    centres = p.where("run = 'purchase'").select(F.col("event_id").alias("centre_id"), F.col("time").alias("centre"))
    frames = p.where("run = 'view'").groupBy("time").agg(F.min("event_id").alias("frame"))
    return S.time_bins(centres, frames, [], "centre", "time", "frame", 900.0)


@query("jn12_time_bins", f"WITH {A.PEAKS}, {_BINS} SELECT centre_id, bin, frame FROM asg")
def _(spark, d):
    return _binned(spark, d).select("centre_id", "bin", "frame")


@query("jn13_time_steps", f"WITH {A.PEAKS}, {_BINS} SELECT event_id, centre_id, bin FROM peaks JOIN asg ON event_id = frame")
def _(spark, d):
    peaks = A.peaks(spark, d).select("event_id", F.col("event_id").alias("frame"))
    return S.time_steps(peaks, _binned(spark, d).select("frame", "centre_id", "bin"), ["frame"]).select("event_id", "centre_id", "bin")


@query("jn15_charge_states", "SELECT p_partkey, z::int AS z, round(p_retailprice / z + 1.0072764667710, 6) AS mz FROM part, range(1, 5) t(z)")
def _(spark, d):
    from pepspark.functions.columns import precursor_mz

    return table(spark, d, "part").withColumn("z", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("p_partkey", "z", F.round(precursor_mz("p_retailprice", "z"), 6).alias("mz"))


@query("jn17_bin_lookup", f"WITH {A.PEAKS} SELECT event_id, CAST(ceil(ln(mz / 0.001) / ln(1 + 0.05)) AS BIGINT) AS bin FROM peaks")
def _(spark, d):
    from pepspark.functions.columns import ppm_bin

    return A.peaks(spark, d).select("event_id", ppm_bin("mz", 50_000.0, 0.001).cast("long").alias("bin"))


# --- aggregates


@query("agg01_best_match", f"WITH {A.MATCHES} SELECT run_index, cluster, pmsm_index, score FROM pmsm QUALIFY row_number() OVER (PARTITION BY run_index, cluster ORDER BY score DESC, pmsm_index) = 1")
def _(spark, d):
    return R.best_row(A.matches(spark, d), ["run_index", "cluster"], "score", ["pmsm_index"]).select("run_index", "cluster", "pmsm_index", "score")


@query("agg02_nearest_to_median", f"WITH {A.MATCHES}, m AS (SELECT precursor_index, median(observed_rt) AS mid FROM pmsm GROUP BY ALL) SELECT precursor_index, pmsm_index FROM pmsm JOIN m USING (precursor_index) QUALIFY row_number() OVER (PARTITION BY precursor_index ORDER BY abs(observed_rt - mid), pmsm_index) = 1")
def _(spark, d):
    m = A.matches(spark, d)
    mid = m.groupBy("precursor_index").agg(F.median("observed_rt").alias("mid"))
    return R.best_row(m.join(mid, "precursor_index"), ["precursor_index"], F.abs(F.col("observed_rt") - F.col("mid")), ["pmsm_index"], ascending=True).select("precursor_index", "pmsm_index")


@query("agg03_keep_last", f"WITH {A.MATCHES} SELECT precursor_index, pmsm_index, observed_rt FROM pmsm QUALIFY row_number() OVER (PARTITION BY precursor_index ORDER BY score DESC, pmsm_index DESC) = 1")
def _(spark, d):
    return R.best_row(A.matches(spark, d), ["precursor_index"], "score", [-F.col("pmsm_index")]).select("precursor_index", "pmsm_index", "observed_rt")


@query("agg04_keep_first", "SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def _(spark, d):
    return R.keep_one(table(spark, d, "customer"), ["c_nationkey"], F.desc("c_acctbal"), F.asc("c_custkey")).select("c_nationkey", "c_custkey", "c_name")


@query("agg05_ordered_list", "SELECT l_partkey, array_to_string(list_sort(list(l_suppkey)), ';') AS suppliers FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    from pepspark.functions.columns import list_text

    return table(spark, d, "lineitem").groupBy("l_partkey").agg(list_text(F.array_sort(F.collect_list("l_suppkey"))).alias("suppliers"))


@query("agg06_min_max_count", f"WITH {A.PEAKS} SELECT run, min(mz) AS low, max(mz) AS high, count(*) AS n, round(sum(ab), 4) AS total FROM peaks GROUP BY run")
def _(spark, d):
    return A.peaks(spark, d).groupBy("run").agg(F.min("mz").alias("low"), F.max("mz").alias("high"), F.count(F.lit(1)).alias("n"), F.round(F.sum("ab"), 4).alias("total"))


@query("agg08_median", "SELECT l_suppkey, median(l_quantity) AS mid FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("mid"))


@query("agg10_cycle_time", f"WITH {A.PEAKS}, s AS (SELECT run, time - lag(time) OVER (PARTITION BY run ORDER BY time, event_id) AS step FROM peaks), m AS (SELECT run, avg(step) AS mean FROM s GROUP BY run) SELECT round(avg(mean), 4) AS cycle FROM m")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("time", "event_id")
    steps = A.peaks(spark, d).withColumn("step", F.col("time") - F.lag("time").over(w))
    return steps.groupBy("run").agg(F.avg("step").alias("mean")).agg(F.round(F.avg("mean"), 4).alias("cycle"))


@query("agg11_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("agg11b_distinct_with_null", "WITH t AS (SELECT l_suppkey, CASE WHEN l_quantity > 10 THEN l_partkey END AS x FROM lineitem) SELECT l_suppkey, count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS n FROM t GROUP BY l_suppkey")
def _(spark, d):
    values = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("x"))
    return values.groupBy("l_suppkey").agg(R.distinct_with_null("x").alias("n"))


@query("agg13_all_true", "SELECT l_orderkey, bool_and(l_quantity > 5) AS every FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("every"))


@query("agg14_quantiles", f"WITH {A.PEAKS} SELECT frame_num, round(quantile_cont(mz, 0.25), 6) AS q1, round(quantile_cont(mz, 0.5), 6) AS q2, round(quantile_cont(mz, 0.75), 6) AS q3 FROM peaks GROUP BY frame_num")
def _(spark, d):
    q = F.percentile("mz", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return A.peaks(spark, d).groupBy("frame_num").agg(q.alias("q")).select("frame_num", *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)))


@query("agg16_batch_counts", f"WITH {A.MATCHES} SELECT run_index, CAST(ceil(count(*) / 512.0) AS BIGINT) AS batches FROM pmsm GROUP BY run_index")
def _(spark, d):
    return A.matches(spark, d).groupBy("run_index").agg(F.ceil(F.count(F.lit(1)) / 512.0).cast("long").alias("batches"))


@query("agg17_grouping_sets", f"WITH {A.MATCHES} SELECT run_index, count(DISTINCT CASE WHEN score <= 30000 THEN precursor_index END) AS precursors, count(DISTINCT CASE WHEN score <= 30000 THEN peptidoform_index END) AS peptides FROM pmsm GROUP BY GROUPING SETS ((), (run_index))")
def _(spark, d):
    m = A.matches(spark, d)
    return m.groupingSets([[F.col("run_index")], []], F.col("run_index")).agg(F.count_distinct(F.when(F.col("score") <= 30000, F.col("precursor_index"))).alias("precursors"), F.count_distinct(F.when(F.col("score") <= 30000, F.col("peptidoform_index"))).alias("peptides"))


@query("agg18_log_mad", f"WITH {A.MATCHES} SELECT run_index, round(mad(ln(score)), 6) AS mad FROM pmsm WHERE score > 0 GROUP BY run_index")
def _(spark, d):
    from pepspark.operators.quantify import median_deviation

    return median_deviation(A.matches(spark, d), ["run_index"], "score").select("run_index", F.round("mad", 6).alias("mad"))


@query("agg19_weighted_mean", f"WITH {A.MATCHES} SELECT precursor_index, round(sum(observed_rt * score) / sum(score), 4) AS mean FROM pmsm GROUP BY precursor_index")
def _(spark, d):
    return A.matches(spark, d).groupBy("precursor_index").agg(F.round(F.sum(F.col("observed_rt") * F.col("score")) / F.sum("score"), 4).alias("mean"))


@query(
    "agg19b_weighted_median",
    f"WITH {A.MATCHES}, s AS (SELECT precursor_index, observed_rt, sum(ab) AS w FROM pmsm GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY precursor_index ORDER BY observed_rt) AS c, sum(w) OVER (PARTITION BY precursor_index) / 2 AS half FROM s) SELECT precursor_index, min(observed_rt) FILTER (c >= half) AS mid FROM c GROUP BY precursor_index",
)
def _(spark, d):
    return W.weighted_median(A.matches(spark, d), ["precursor_index"], "observed_rt", "ab", "mid")


@query("agg20_filtered_median", "SELECT l_orderkey, coalesce(median(CASE WHEN l_linenumber BETWEEN 3 AND 5 AND l_quantity > 0 THEN l_quantity END), 0.0) AS apex_median_intensity FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    from pepspark.operators.quantify import apex_median

    return apex_median(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")


@query("agg21_having", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) >= 10")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n")).where("n >= 10")


@query(
    "agg22_training_statistics",
    """WITH t AS (SELECT l_linenumber AS len, CAST(l_tax * 100 AS INT) AS charge, l_discount AS energy FROM lineitem)
    SELECT 'total' AS kind, CAST(NULL AS DOUBLE) AS value, count(*) AS n FROM t UNION ALL SELECT 'len', len::double, count(*) FROM t GROUP BY len
    UNION ALL SELECT 'charge', charge::double, count(*) FROM t GROUP BY charge UNION ALL SELECT 'energy', energy::double, count(*) FROM t GROUP BY energy""",
)
def _(spark, d):
    from pepspark.sources.sinks import training_statistics

    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("len"), F.round(F.col("l_tax") * 100).cast("int").alias("charge"), F.col("l_discount").alias("energy"))
    return training_statistics(rows, "len", "charge", "energy")


# --- windows


@query("win04_offsets", "WITH o AS (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY ALL) SELECT l_orderkey, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS stop FROM o WINDOW w AS (PARTITION BY s ORDER BY l_orderkey)")
def _(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("s"))
    return W.running_offsets(sizes, ["s"], ["l_orderkey"], "n").select("l_orderkey", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("win05_lag_interval", f"WITH {A.PEAKS} SELECT run, round(median(step), 4) AS step FROM (SELECT run, time - lag(time) OVER (PARTITION BY run ORDER BY time, event_id) AS step FROM peaks) GROUP BY run")
def _(spark, d):
    w = Window.partitionBy("run").orderBy("time", "event_id")
    return A.peaks(spark, d).withColumn("step", F.col("time") - F.lag("time").over(w)).groupBy("run").agg(F.round(F.median("step"), 4).alias("step"))


@query("win07_lead_offsets", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS following FROM orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1)).alias("following"))


@query("win08_normalised", f"WITH {A.MATCHES} SELECT pmsm_index, round(score / sum(score) OVER (PARTITION BY run_index, precursor_index), 6) AS share FROM pmsm")
def _(spark, d):
    return R.normalised(A.matches(spark, d), ["run_index", "precursor_index"], "score", "share").select("pmsm_index", F.round("share", 6).alias("share"))


@query("win09_max_normalised", "SELECT p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand), 6) AS share FROM part")
def _(spark, d):
    return R.normalised(table(spark, d, "part"), ["p_brand"], "p_retailprice", "share", "max").select("p_partkey", F.round("share", 6).alias("share"))


@query("win10_rank_in_list", "SELECT vec_id, k::int AS k, rank() OVER (PARTITION BY vec_id ORDER BY x DESC)::int AS rank FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS k FROM embeddings)")
def _(spark, d):
    each = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return each.select("vec_id", "k", F.rank().over(Window.partitionBy("vec_id").orderBy(F.desc("x"))).alias("rank"))


_CELLS = f"{A.PEAKS}, c0 AS (SELECT run, frame_num, CAST(count(*) AS BIGINT) AS v FROM peaks GROUP BY ALL)"
_AXIS = f"{_CELLS}, ax AS (SELECT run, unnest(range(min(frame_num), max(frame_num) + 1)) AS frame_num FROM c0 GROUP BY run), c AS (SELECT ax.run, ax.frame_num, coalesce(v, 0) AS v FROM ax LEFT JOIN c0 USING (run, frame_num))"


def _cells(spark, d):
    counts = A.peaks(spark, d).groupBy("run", "frame_num").agg(F.count(F.lit(1)).alias("v"))
    return W.dense_axis(counts, ["run"], "frame_num", "v")


@query("win11_sliding_sum", f"WITH {_AXIS} SELECT run, frame_num, CAST(sum(v) OVER (PARTITION BY run ORDER BY frame_num RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS BIGINT) AS s FROM c")
def _(spark, d):
    return W.sliding_sum(_cells(spark, d), ["run"], "frame_num", "v", 4, "s").select("run", "frame_num", "s")


@query("win12_smoothed", f"WITH {_AXIS} SELECT run, frame_num, v / 2 + (coalesce(lag(v) OVER w, 0) + coalesce(lead(v) OVER w, 0)) / 4 AS s FROM c WINDOW w AS (PARTITION BY run ORDER BY frame_num)")
def _(spark, d):
    return W.smoothed(_cells(spark, d), ["run"], "frame_num", "v", "s").select("run", "frame_num", "s")


_MAXIMA = f"""{_AXIS}, i AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY run ORDER BY frame_num)),
 j AS (SELECT *, sum(ch) OVER (PARTITION BY run ORDER BY frame_num) AS isl FROM i), f AS (SELECT run, isl, min(frame_num) AS a, max(frame_num) AS b, max(v) AS v FROM j GROUP BY run, isl),
 g AS (SELECT *, lag(v) OVER w AS vb, lead(v) OVER w AS va FROM f WINDOW w AS (PARTITION BY run ORDER BY isl)),
 mx AS (SELECT run, CAST(floor((a + b) / 2) AS BIGINT) AS frame_num, v FROM g WHERE v > vb AND v > va)"""


@query("win13_local_maxima", f"WITH {_MAXIMA} SELECT run, frame_num, v FROM mx")
def _(spark, d):
    return W.local_maxima(_cells(spark, d), ["run"], "frame_num", "v")


@query(
    "win14_gap_clusters",
    f"""WITH {_MAXIMA}, k AS (SELECT *, CASE WHEN frame_num - lag(frame_num) OVER w <= 2 THEN 0 ELSE 1 END AS far FROM mx WINDOW w AS (PARTITION BY run ORDER BY frame_num)),
    l AS (SELECT *, sum(far) OVER (PARTITION BY run ORDER BY frame_num) AS cl FROM k) SELECT run, CAST(cl AS BIGINT) AS cluster, frame_num, v FROM l QUALIFY row_number() OVER (PARTITION BY run, cl ORDER BY v DESC, frame_num) = 1""",
)
def _(spark, d):
    return W.cluster_peaks(W.local_maxima(_cells(spark, d), ["run"], "frame_num", "v"), ["run"], "frame_num", "v", 2).select("run", "cluster", "frame_num", "v")


@query("win15_cluster_medians", f"WITH {A.PEAKS}, u AS (SELECT DISTINCT run, frame_num FROM peaks), k AS (SELECT *, CASE WHEN frame_num - lag(frame_num) OVER w <= 1 THEN 0 ELSE 1 END AS far FROM u WINDOW w AS (PARTITION BY run ORDER BY frame_num)), l AS (SELECT *, sum(far) OVER (PARTITION BY run ORDER BY frame_num) AS cl FROM k) SELECT run, CAST(cl AS BIGINT) AS cluster, median(frame_num) AS mid, count(*) AS n FROM l GROUP BY run, cl HAVING count(*) >= 2")
def _(spark, d):
    u = A.peaks(spark, d).select("run", "frame_num").distinct()
    return W.gap_clusters(u, ["run"], "frame_num", 1).groupBy("run", "cluster").agg(F.median("frame_num").alias("mid"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("win16_clipped_positions", "SELECT DISTINCT l_suppkey, greatest(10, least(40, l_quantity)) AS l_quantity FROM lineitem")
def _(spark, d):
    return W.clip_positions(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 10, 40)


@query(
    "win17_monotone_bases",
    f"""WITH {_AXIS}, ap AS (SELECT run, frame_num AS apex FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY v DESC, frame_num) = 1),
    n AS (SELECT c.run, apex, frame_num AS f, v, lead(v) OVER w AS after, lag(v) OVER w AS before FROM c JOIN ap USING (run) WINDOW w AS (PARTITION BY c.run ORDER BY frame_num))
    SELECT run, apex, coalesce(max(CASE WHEN f < apex AND v > after THEN f + 1 END), min(f)) AS left, coalesce(min(CASE WHEN f > apex AND v > before THEN f - 1 END), max(f)) AS right FROM n GROUP BY run, apex""",
)
def _(spark, d):
    cells = _cells(spark, d)
    apex = R.best_row(cells, ["run"], "v", ["frame_num"]).select("run", F.col("frame_num").alias("apex"))
    return W.monotone_bases(cells.join(apex, "run"), ["run"], "frame_num", "v", "apex")


@query("mth26_signal_to_noise", f"WITH {A.MATCHES}, r AS (SELECT precursor_index, score, row_number() OVER (PARTITION BY precursor_index ORDER BY score) AS r, count(*) OVER (PARTITION BY precursor_index) AS n FROM pmsm) SELECT precursor_index, round(max(score) / (avg(score) FILTER (r <= floor(n * 0.2)) + 1e-9), 6) AS snr FROM r GROUP BY precursor_index")
def _(spark, d):
    return W.signal_to_noise(A.matches(spark, d), ["precursor_index"], "score").select("precursor_index", F.round("snr", 6).alias("snr"))


# --- sorts, limits and samples


@query("srt02_flag_order", f"WITH {A.MATCHES} SELECT pmsm_index, row_number() OVER (ORDER BY NOT is_decoy, score DESC, pmsm_index) - 1 AS place FROM pmsm")
def _(spark, d):
    return R.dense_id(A.matches(spark, d).withColumn("_target", ~F.col("is_decoy")), ["_target", F.col("score").desc(), "pmsm_index"], "place").select("pmsm_index", "place")


@query("srt03_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000)


@query("srt04_top_k_per_group", f"WITH {A.MATCHES} SELECT precursor_index, pmsm_index FROM pmsm QUALIFY row_number() OVER (PARTITION BY precursor_index ORDER BY score DESC, pmsm_index) <= 10")
def _(spark, d):
    return R.top_k(A.matches(spark, d), ["precursor_index"], 10, F.desc("score"), F.asc("pmsm_index")).select("precursor_index", "pmsm_index")


@query("srt07_equal_slices", "SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) / greatest(1, ceil(count(*) OVER () / 128.0))) AS BIGINT) AS isolation_group FROM supplier")
def _(spark, d):
    return S.isolation_groups(table(spark, d, "supplier"), 128, "s_acctbal", "s_suppkey").select("s_suppkey", "isolation_group")


@query("srt08_batches", "SELECT l_orderkey, l_linenumber, CAST(floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) / 512) AS BIGINT) AS batch FROM lineitem")
def _(spark, d):
    return R.batches(table(spark, d, "lineitem"), ["l_suppkey"], 512, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "batch")


def _md5(seed: int, ident: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {ident})), 1, 8) AS BIGINT)"


@query("smp01_split_decoys", f"WITH {A.MATCHES}, t AS (SELECT pmsm_index, is_decoy, {_md5(928, 'peptidoform_index')} % 100 < 50 AS a FROM pmsm) SELECT pmsm_index, 'train' AS part FROM t WHERE NOT is_decoy OR a UNION ALL SELECT pmsm_index, 'test' FROM t WHERE NOT is_decoy OR NOT a")
def _(spark, d):
    train, test = P.split_decoys(A.matches(spark, d), "peptidoform_index", "is_decoy")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select("pmsm_index", "part")


@query("smp02_hash_sample", f"SELECT p_partkey FROM part ORDER BY {_md5(928, 'p_partkey')}, p_partkey LIMIT 100")
def _(spark, d):
    return P.down_sample(table(spark, d, "part"), "p_partkey", 100, seed=928).select("p_partkey")


@query("smp03_epoch_samples", " UNION ALL ".join(f"SELECT {e} AS epoch, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY {_md5(e, 'o_orderkey')}, o_orderkey LIMIT 500)" for e in range(3)))
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return reduce(lambda a, b: a.unionByName(b), (P.down_sample(orders, "o_orderkey", 500, e).select(F.lit(e).alias("epoch"), "o_orderkey") for e in range(3)))


@query("smp04_seeded_until_enough", f"WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), u AS (SELECT l_orderkey, n, sum(n) OVER (ORDER BY {_md5(1226, 'l_orderkey')}, l_orderkey ROWS UNBOUNDED PRECEDING) - n AS before FROM t) SELECT l_orderkey, n FROM u WHERE before <= 5000")
def _(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return P.until_enough(sizes, "l_orderkey", "n", 5000)


# --- sets


@query("set01_union_all", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("set02_union_distinct", "SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).union(table(spark, d, "part").select("p_partkey")).distinct()


@query("set03_jaccard", "WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS a, list(DISTINCT l_partkey % 100) AS b FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard FROM s")
def _(spark, d):
    from pepspark.functions.columns import jaccard

    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 100).alias("b"))
    return sets.select("l_orderkey", F.round(jaccard("a", "b"), 6).alias("jaccard"))
