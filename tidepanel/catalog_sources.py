"""Queries of the ingestion path, of sinks read again, of series and of checks across tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _ID, _MODEL, HEADLINE, MONITORED, _population, _simulated, features, labels, later, mapped, query, table
from .functions import scalars as S
from .operators import metrics, panel, ranking
from .operators.panel import KEY, MONTH
from .sources import delimited
from .sources.workspace import scratch

# --- a headerless file made from lineitem: wide rows now and then, a number that isn't one, a sentinel ---------------

_LAYOUT = [
    {"position": 1, "title": "Order  Key", "type": "Alpha", "length": "12"},
    {"position": 2, "title": "Line", "type": "Numeric", "length": "2"},
    {"position": 3, "title": "Quantity", "type": "Numeric", "length": "12,2"},
    {"position": 4, "title": "Ship Month", "type": "Date", "length": "6", "format": "YYYYMM"},
    {"position": 5, "title": "Return Flag", "type": "Alpha", "length": "1"},
]
_NAMES = {"Order Key": "order_key", "Line": "line", "Quantity": "quantity", "Ship Month": "ship_month", "Return Flag": "return_flag"}


def _file(spark, d) -> tuple[DataFrame, list[delimited.Field]]:
    li = table(spark, d, "lineitem")
    quantity = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string"))
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), quantity, F.date_format("l_shipdate", "yyyyMM"), F.when(F.col("l_returnflag") == "N", " 9 ").otherwise(F.col("l_returnflag")))
    line = F.when(F.col("l_orderkey") % 100 == 0, F.concat(line, F.lit("|extra"))).otherwise(line)
    path = scratch(spark, "delimited")
    for year in (1995, 1996):
        li.where((F.year("l_shipdate") > 1995) == (year > 1995)).select(line.alias("value")).write.text(f"{path}/sample_orig_{year}")
    fields = delimited.layout(_LAYOUT, _NAMES)
    return delimited.read_text(spark, delimited.resolve(spark, path + "/sample_orig_{vintage}", [1995, 1996]), fields), fields


def _ingested(spark, d) -> DataFrame:
    text, fields = _file(spark, d)
    return delimited.cast(delimited.clean(text, fields, {"return_flag": ["9"]}), fields).withColumn("vintage", delimited.file_vintage())


_RAW = "(SELECT *, CASE WHEN year(l_shipdate)>1995 THEN 1996 ELSE 1995 END AS vintage, CASE WHEN l_linenumber<>7 THEN floor(l_quantity) END AS q, CASE WHEN l_returnflag<>'N' THEN l_returnflag END AS flag, CAST(date_trunc('month',l_shipdate) AS DATE) AS m FROM lineitem)"


@query(f"SELECT vintage, m AS ship_month, flag AS return_flag, count(*) AS n, CAST(sum(q) AS DOUBLE) AS quantity, count(DISTINCT l_orderkey) AS orders FROM {_RAW} GROUP BY 1,2,3")
def ingest_typed(spark, d):
    return _ingested(spark, d).groupBy("vintage", "ship_month", "return_flag").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.countDistinct("order_key").alias("orders"))


@query("SELECT count(*) AS n_rows, CAST(sum(CASE WHEN l_orderkey%100=0 THEN 1 ELSE 0 END) AS BIGINT) AS n_corrupt, CAST(0 AS BIGINT) AS failed_line, CAST(sum(CASE WHEN l_linenumber=7 THEN 1 ELSE 0 END) AS BIGINT) AS failed_quantity, CAST(0 AS BIGINT) AS failed_ship_month, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def ingest_profile(spark, d):
    text, fields = _file(spark, d)
    return delimited.profile(text, fields, orders=F.countDistinct("order_key"))


@query(f"SELECT vintage, s_nationkey, count(*) AS n, CAST(sum(CASE WHEN s_nationkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched FROM {_RAW} r LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k, c_nationkey AS s_nationkey FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderpriority<>'5-LOW') ON k=CAST(l_orderkey AS VARCHAR) GROUP BY 1,2")
def ingest_retain_join(spark, d):
    static = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    static = static.select(F.col("o_orderkey").cast("string").alias("order_key"), F.col("c_nationkey").alias("s_nationkey"))
    kept = delimited.retain(_ingested(spark, d), static, "order_key", ["order_key", "line", "vintage"], ["s_nationkey"])
    return kept.groupBy("vintage", "s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_nationkey").isNull()).alias("n_unmatched"))


@query("+SELECT CAST(month_idx//12 AS INT) AS year, count(*) AS n, count(DISTINCT loan_sequence_number) AS n_loans, CAST(sum(upb_cents) AS BIGINT) AS upb_cents FROM mapped WHERE month_idx//12 BETWEEN 1997 AND 1999 GROUP BY 1")
def partitioned_panel_scan(spark, d):
    """The panel written by year and read again with a filter that only opens the folders asked for."""
    path = scratch(spark, "panel")
    delimited.write_partitioned(mapped(spark, d).withColumn("year", F.floor(F.col(MONTH) / 12).cast("int")), path, "year", [KEY, MONTH])
    return spark.read.parquet(path).where("year BETWEEN 1997 AND 1999").groupBy("year").agg(F.count("*").alias("n"), F.countDistinct(KEY).alias("n_loans"), F.sum("upb_cents").alias("upb_cents"))


_STORED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _STORED))
def stored_row_counts(spark, d):
    """Counts that need no column, so only the files' footers are read."""
    out = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _STORED]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


@query("SELECT split, n, printf('%.5f', rate) AS rate FROM (SELECT l_returnflag AS split, CAST(count(*) AS VARCHAR) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/count(*) AS rate FROM lineitem GROUP BY 1)")
def result_table_round_trip(spark, d):
    path = scratch(spark, "result")
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("split")).agg(F.count("*").alias("n"), (F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count("*")).alias("rate"))
    delimited.write_table(t, path)
    return spark.read.option("header", True).csv(path)


@query("SELECT coalesce(a.period,b.period) AS period, a.value AS urgent, b.value AS low FROM (SELECT CAST(date_trunc('month',o_orderdate) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1 HAVING month(period)<>3) a FULL JOIN (SELECT CAST(date_trunc('month',o_orderdate) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderpriority='5-LOW' GROUP BY 1 HAVING year(period)<2001) b ON a.period=b.period")
def series_concat(spark, d):
    """Two series from files, a dot for a missing value, side by side on their months."""
    out = None
    for name, priority, gone in (("urgent", "1-URGENT", "month(period) = 3"), ("low", "5-LOW", "year(period) >= 2001")):
        path = scratch(spark, "series")
        s = table(spark, d, "orders").where(F.col("o_orderpriority") == priority).groupBy(F.trunc("o_orderdate", "MM").alias("period")).agg(F.count("*").cast("string").alias("v"))
        s.select(F.col("period").cast("string").alias("observation_date"), F.when(F.expr(gone), ".").otherwise(F.col("v")).alias("value")).write.option("header", True).csv(path)
        s = delimited.read_series(spark, path).where("value IS NOT NULL").withColumnRenamed("value", name)
        out = s if out is None else out.join(s, "period", "full")
    return out


# --- panel checks and label checks -----------------------------------------------------------------------------------


@query("+SELECT loan_sequence_number, max(dq_bucket) AS max_bucket FROM mapped GROUP BY 1 HAVING max(dq_bucket)>0")
def ever_delinquent_loans(spark, d):
    return panel.ever_delinquent(mapped(spark, d))


@query("+SELECT loan_sequence_number FROM mapped GROUP BY 1 HAVING max(dq_bucket)=0 OR max(dq_bucket) IS NULL")
def never_delinquent_loans(spark, d):
    m = mapped(spark, d)
    return m.select(KEY).distinct().exceptAll(panel.ever_delinquent(m).select(KEY))


@query("+SELECT label_reason, n, row_number() OVER (ORDER BY n DESC, label_reason) AS place FROM (SELECT label_reason, count(*) AS n FROM lab GROUP BY 1)")
def label_reasons_by_count(spark, d):
    return panel.by_count(panel.labelled(mapped(spark, d)), "label_reason")


@query("+SELECT m.loan_sequence_number, m.month_idx, m.dq_bucket, t.month_idx AS t FROM mapped m JOIN (SELECT loan_sequence_number, month_idx FROM mapped ORDER BY md5(concat_ws(':','0',loan_sequence_number,CAST(month_idx AS VARCHAR))) LIMIT 12) t ON t.loan_sequence_number=m.loan_sequence_number AND m.month_idx BETWEEN t.month_idx-3 AND t.month_idx+3")
def label_trace(spark, d):
    return panel.trace(mapped(spark, d), 12).select(*_ID, "dq_bucket", "t")


@query("+SELECT s.split, count(*) AS n, CAST(sum(CASE WHEN d.month_idx IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM spl s LEFT JOIN dis d ON d.loan_sequence_number=s.loan_sequence_number AND d.month_idx=s.month_idx GROUP BY 1")
def split_containment(spark, d):
    pop = _population(spark, d)
    return panel.contained(pop, panel.disjoint(labels(spark, d)), _ID, ["split"])


@query("+SELECT split, count(*) AS n, round(avg(upb_cents),4) AS mean_upb, CAST(sum(label) AS BIGINT) AS n_label FROM dis GROUP BY 1")
def features_with_labels(spark, d):
    """Features and labels made apart and joined row to row; a key that either side has twice is an error."""
    lab = panel.disjoint(panel.labelled(mapped(spark, d))).select(*_ID, "split", "label")
    return panel.join_one_to_one(features(spark, d).select(*_ID, "upb_cents"), lab, _ID).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("upb_cents"), 4).alias("mean_upb"), F.sum("label").cast("long").alias("n_label"))


_FLAGS = {"ever_owned": "CAST(is_reo AS INT)", "ever_serious": "CAST(dq_bucket >= 3 AS INT)", "ever_ended": "CAST(zero_balance_code IS NOT NULL AS INT)", "ever_code_03": "CAST(zero_balance_code = '03' AS INT)"}


@query("+SELECT loan_sequence_number, month_idx, " + ", ".join(f"max({e}) OVER past AS {n}" for n, e in _FLAGS.items()) + " FROM mapped WINDOW past AS (PARTITION BY loan_sequence_number ORDER BY month_idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def traj_ever_flags(spark, d):
    return panel.trajectories(mapped(spark, d), "upb_cents", panel.flag_features(_FLAGS)).select(*_ID, *_FLAGS)


@query("+SELECT month_idx, min(first_so) AS first_so, count(*) AS n, count(DISTINCT loan_sequence_number) AS n_loans, round(avg(CASE WHEN coalesce(times_entered_delinquency_before_t,0)=0 THEN 1.0 ELSE 0.0 END),6) AS first_episode_share FROM spl GROUP BY 1")
def first_episode_share(spark, d):
    first = S.lookup(F.col("first_split"), {n: k for k, n in enumerate(panel.SPLITS)})
    share = F.avg((F.coalesce("times_entered_delinquency_before_t", F.lit(0)) == 0).cast("double"))
    return _population(spark, d).groupBy(MONTH).agg(F.min(first).alias("first_so"), F.count("*").alias("n"), F.countDistinct(KEY).alias("n_loans"), F.round(share, 6).alias("first_episode_share"))


@query("+SELECT d.split, d.month_idx, count(*) AS n, round(max(value),4) AS level FROM dis d LEFT JOIN (SELECT month_idx+2 AS month_idx, avg(cents) AS value FROM ser GROUP BY 1) m USING (month_idx) GROUP BY 1,2")
def national_macro_join(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(S.month_index(F.col("o_orderdate")).cast("int").alias(MONTH), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    level = panel.published(panel.monthly(o, extend=0), 2, [], True)  # a row a month: small whatever the data
    return panel.disjoint(labels(spark, d)).join(F.broadcast(level), MONTH, "left").groupBy("split", MONTH).agg(F.count("*").alias("n"), F.round(F.max("level"), 4).alias("level"))


# --- feature audit, policy checks ------------------------------------------------------------------------------------

_AUDITED = [*dict.fromkeys([*_MODEL, *MONITORED])]
_AUDIT_SQL = (
    "+SELECT feature, null_rate, auc, row_number() OVER (ORDER BY auc DESC NULLS LAST, feature) AS auc_rank FROM (SELECT feature, round(CASE WHEN sum(c1)*(sum(c)-sum(c1))<>0 THEN sum(c1*(2*below+c-c1))/(2*sum(c1)*(sum(c)-sum(c1))) END,6) AS auc FROM "
    "(SELECT *, coalesce(sum(c-c1) OVER (PARTITION BY feature ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM (SELECT feature, r, count(*) AS c, sum(label) AS c1 FROM asc1 WHERE split='test' GROUP BY 1,2)) GROUP BY 1) "
    "JOIN (SELECT feature, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END),6) AS null_rate FROM along GROUP BY 1) USING (feature)"
)


@query(_AUDIT_SQL)
def feature_audit(spark, d):
    r = panel.disjoint(labels(spark, d))
    return metrics.feature_audit(r.where("split = 'train'"), r.where("split = 'test'"), r, _AUDITED)


@query("+SELECT capacity, policy, round(sum(captured)/sum(at_risk),6) AS capture FROM (SELECT r.month_idx, policy, seed, capacity, sum(CASE WHEN rank<=floor(capacity*n+1e-9) THEN money ELSE 0 END) AS captured, any_value(at_risk) AS at_risk FROM rankall r JOIN sized USING (month_idx), (SELECT unnest([0.1,0.15,0.2,0.25,0.3,0.75,1.0])::DOUBLE AS capacity) GROUP BY 1,2,3,4) GROUP BY 1,2")
def policy_capture_grid(spark, d):
    """The curve on an even grid with one point more and full capacity."""
    from .catalog import _SEEDS, _ranked_on

    return ranking.curve(ranking.simulate(_ranked_on(spark, d), S.capacity_grid(0.1, 0.3, 0.05, [0.75]), seeds=_SEEDS))


_CHECKS_SQL = """+SELECT unnest(['random_near_capacity','never_over_oracle','informed_below_oracle','informed_over_random','complete_and_never_falling','balance_tracks_share']) AS "check",
  unnest([bool_and(policy<>'random' OR abs(capture-capacity)<=0.25), bool_and(capture<=best+1e-6), bool_and(policy IN ('random','oracle') OR capacity>=1 OR capture<best), bool_and(policy IN ('random','oracle') OR capture>=floor_-0.25),
  bool_and((b IS NULL OR capture>=b-1e-6) AND (capacity<1 OR abs(capture-1)<1e-6)), bool_and(policy<>'by_balance' OR capacity<>0.2 OR abs(capture-share)<=0.25)]) AS passed
FROM (SELECT p.*, o.capture AS best, f.capture AS floor_, lag(p.capture) OVER (PARTITION BY p.policy ORDER BY p.capacity) AS b, (SELECT sum(CASE WHEN t THEN exposure END)/sum(exposure) FROM (SELECT exposure, row_number() OVER (PARTITION BY month_idx ORDER BY exposure DESC, loan_sequence_number)<=floor(0.2*count(*) OVER (PARTITION BY month_idx)+1e-9) AS t FROM late)) AS share
  FROM points p JOIN points o ON o.policy='oracle' AND o.capacity=p.capacity JOIN points f ON f.policy='random' AND f.capacity=p.capacity)"""


@query(_CHECKS_SQL)
def policy_structure_checks(spark, d):
    share = ranking.largest_share(later(spark, d), HEADLINE).select("balance_share")
    return ranking.structure_checks(ranking.curve(_simulated(spark, d)), share, HEADLINE, 0.25)
