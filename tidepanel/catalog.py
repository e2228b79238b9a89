"""All queries of the panel engine, over a proxy panel derived from `lineitem`, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import drift, metrics, panel, ranking, scoring
from .operators.panel import KEY, MONTH
from .plans.frames import audit
from .sources.workspace import stored

CAPACITIES = [0.05, 0.1, 0.2, 0.3, 0.5, 1.0]
HEADLINE = 0.2
MONITORED = ["upb_cents", "months_delinquent_last_3", "max_bucket_last_6", "bucket_lag_1"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql if sql.lstrip().upper().startswith("SELECT") else _with(sql)
        return f

    return keep


# --- the proxy panel and what is built on it, in Spark and in SQL ---------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def proxy(spark: SparkSession, d: str) -> DataFrame:
    """Loan-month rows: 18-month cohorts of suppliers, status from returns, terminations in the last month."""
    li = table(spark, d, "lineitem").withColumn(MONTH, S.month_index(F.col("l_shipdate")).cast("int"))
    loan = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 3).cast("string"), F.lit("-"), F.floor((F.col(MONTH) + F.col("l_suppkey") % 18) / 18).cast("int").cast("string"))
    e = li.groupBy(loan.alias(KEY), MONTH).agg(
        F.min(F.trunc("l_shipdate", "MM")).alias("reporting_period"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("r"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("upb_cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
    )
    from pyspark.sql.window import Window

    last = F.max(MONTH).over(Window.partitionBy(KEY))
    code = F.element_at(F.create_map(*(F.lit(x) for p in ((0, "01"), (1, "03"), (2, "09"), (3, "16")) for x in p)), (F.col("q") % 8).cast("int"))
    status = F.when(F.col("q") % 97 == 0, "XX").when((F.col("r") >= 4) & (F.col("q") % 2 == 0), "RA").otherwise(F.lpad(F.col("r").cast("string"), 2, "0"))
    return e.withColumn("zero_balance_code", F.when(F.col(MONTH) == last, F.when(F.col("q") % 8 < 4, code))).select(
        KEY, "reporting_period", MONTH, "upb_cents", status.alias("delinquency_status"), "zero_balance_code"
    )


def mapped(spark, d) -> DataFrame:
    return panel.mapped(proxy(spark, d))


def features(spark, d) -> DataFrame:
    return panel.trajectories(mapped(spark, d), "upb_cents")


def labels(spark, d) -> DataFrame:
    return panel.labelled(features(spark, d))


def rows(spark, d) -> DataFrame:
    """Labelled rows of disjoint splits with the smoothed training rate of their buckets as score p."""
    all_rows = panel.disjoint(labels(spark, d)).withColumn("exposure", F.col("upb_cents"))
    train = all_rows.where("split = 'train'")
    by = ["dq_bucket", "max_bucket_last_3"]
    prior = train.agg(F.round(F.sum(F.col("label").cast("long")) / F.count("label"), 6).alias("rate"))
    return metrics.encoded(all_rows, metrics.target_rates(train, by), by, prior).withColumns({"y": F.col("label"), "p_raw": F.col("dq_bucket") / 4})


def later(spark, d) -> DataFrame:
    return rows(spark, d).where("split IN ('validation', 'test')")


_PARTS = {
    "panel": """SELECT loan_sequence_number, reporting_period, month_idx, upb_cents,
  CASE WHEN q%97=0 THEN 'XX' WHEN r>=4 AND q%2=0 THEN 'RA' ELSE lpad(CAST(r AS VARCHAR),2,'0') END AS delinquency_status,
  CASE WHEN month_idx=max(month_idx) OVER (PARTITION BY loan_sequence_number) THEN CASE q%8 WHEN 0 THEN '01' WHEN 1 THEN '03' WHEN 2 THEN '09' WHEN 3 THEN '16' END END AS zero_balance_code
FROM (SELECT concat('S',CAST(l_suppkey AS VARCHAR),'-',CAST(l_linenumber%3 AS VARCHAR),'-',CAST(CAST(floor((month_idx+l_suppkey%18)/18) AS INT) AS VARCHAR)) AS loan_sequence_number, month_idx,
  min(CAST(date_trunc('month',l_shipdate) AS DATE)) AS reporting_period, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS INT) AS r,
  CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS upb_cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
  FROM (SELECT *, CAST(year(l_shipdate)*12+month(l_shipdate)-1 AS INT) AS month_idx FROM lineitem) GROUP BY 1,2)""",
    "mapped": """SELECT *, TRY_CAST(delinquency_status AS INT) AS dq_months, CASE WHEN delinquency_status='RA' THEN 4 ELSE least(TRY_CAST(delinquency_status AS INT),4) END AS dq_bucket,
  delinquency_status='RA' AS is_reo FROM panel WHERE delinquency_status<>'XX'""",
    "ev0": """SELECT *, CASE WHEN lag(month_idx) OVER o = month_idx-1 THEN lag(dq_bucket) OVER o END AS prev_bucket FROM mapped WINDOW o AS (PARTITION BY loan_sequence_number ORDER BY month_idx)""",
    "ev1": """SELECT *, CASE WHEN coalesce(prev_bucket,0)=0 AND dq_bucket>0 THEN 1 ELSE 0 END AS entry_event, CAST(prev_bucket>0 AND dq_bucket=0 AS INT) AS cure_event, CAST(dq_bucket>prev_bucket AS INT) AS roll_event FROM ev0""",
    "ev": """SELECT *, CASE WHEN dq_bucket>0 THEN month_idx - max(CASE WHEN entry_event=1 THEN month_idx END) OVER (PARTITION BY loan_sequence_number ORDER BY month_idx ROWS UNBOUNDED PRECEDING) + 1 END AS run_len FROM ev1""",
    "feat": """SELECT *, """
    + ", ".join(
        f"CAST(sum(CASE WHEN dq_bucket>0 THEN 1 ELSE 0 END) OVER w{n} AS BIGINT) AS months_delinquent_last_{n}, max(dq_bucket) OVER w{n} AS max_bucket_last_{n}, avg(dq_bucket) OVER w{n} AS mean_bucket_last_{n}"
        for n in (3, 6, 12)
    )
    + """, count(*) OVER w12 AS months_observed_last_12, """
    + ", ".join(f"CAST(sum({e}_event) OVER w{n} AS BIGINT) AS n_{e}_events_last_{n}" for n in (6, 12) for e in ("cure", "roll"))
    + ", "
    + ", ".join(f"max(dq_bucket) OVER p{k} AS bucket_lag_{k}" for k in (1, 2, 3))
    + """, month_idx - max(CASE WHEN dq_bucket=0 THEN month_idx END) OVER past AS months_since_last_current, month_idx - min(CASE WHEN dq_bucket>0 THEN month_idx END) OVER past AS months_since_first_delinquency,
  max(run_len) OVER past AS longest_delinquent_run_before_t, CAST(sum(entry_event) OVER past AS BIGINT) AS times_entered_delinquency_before_t, max(dq_bucket) OVER past AS max_bucket_before_t,
  dq_bucket - max(dq_bucket) OVER p3 AS delinquency_velocity_3m, run_len AS current_run_length, """
    + ", ".join(f"CASE WHEN max(upb_cents) OVER p{n} > 0 THEN (upb_cents / max(upb_cents) OVER p{n} - 1) * 100 END AS upb_change_pct_{n}" for n in (3, 6, 12))
    + """ FROM ev WINDOW """
    + ", ".join([f"w{n} AS (PARTITION BY loan_sequence_number ORDER BY month_idx RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 6, 12)] + [f"p{n} AS (PARTITION BY loan_sequence_number ORDER BY month_idx RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)" for n in (1, 2, 3, 6, 12)])
    + """, past AS (PARTITION BY loan_sequence_number ORDER BY month_idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "ahead": """SELECT *, max(dq_bucket) OVER f AS a_bucket, count(*) OVER f AS a_months, max(CASE WHEN zero_balance_code IN ('02','03','09','15') THEN 1 ELSE 0 END) OVER f AS a_roll,
  max(CASE WHEN zero_balance_code='01' THEN 1 ELSE 0 END) OVER f AS a_cure, max(CASE WHEN zero_balance_code IN ('16','96') THEN 1 ELSE 0 END) OVER f AS a_exclude, (SELECT max(month_idx) FROM mapped)-3 AS last_month
  FROM feat WINDOW f AS (PARTITION BY loan_sequence_number ORDER BY month_idx RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
    "lab": """SELECT *, CASE WHEN label_reason IN ('deeper_bucket','roll_zero_balance') THEN 1 WHEN label_reason IN ('cure_zero_balance','no_roll_full_window') THEN 0 END AS label FROM (
  SELECT *, CASE WHEN month_idx>last_month THEN 'end_of_data' WHEN a_bucket>dq_bucket THEN 'deeper_bucket' WHEN a_roll=1 THEN 'roll_zero_balance' WHEN a_exclude=1 THEN 'excluded_zero_balance'
  WHEN a_cure=1 THEN 'cure_zero_balance' WHEN a_months=3 THEN 'no_roll_full_window' ELSE 'incomplete_window' END AS label_reason
  FROM ahead WHERE dq_bucket IN (1,2,3) AND NOT is_reo AND zero_balance_code IS NULL)""",
    "spl": """SELECT *, min(so) OVER (PARTITION BY loan_sequence_number) AS first_so, list_extract(['train','validation','test','drift_study'], so+1) AS split FROM (
  SELECT *, CASE WHEN month_idx BETWEEN 23940 AND 23987 THEN 0 WHEN month_idx BETWEEN 23988 AND 23999 THEN 1 WHEN month_idx BETWEEN 24000 AND 24011 THEN 2 WHEN month_idx BETWEEN 24012 AND 24023 THEN 3 END AS so FROM lab WHERE label IS NOT NULL) WHERE so IS NOT NULL""",
    "dis": "SELECT * FROM spl WHERE so=first_so",
    "prior": "SELECT sum(label) AS s0, count(label) AS n0, round(sum(label)/count(label),6) AS rate FROM dis WHERE split='train'",
    "rates": "SELECT d.dq_bucket AS rb, d.max_bucket_last_3 AS rm, round((sum(label)+100*any_value(p.s0)/any_value(p.n0))/(count(label)+100),6) AS rate FROM dis d, prior p WHERE split='train' GROUP BY 1,2",
    "sc": """SELECT d.*, upb_cents AS exposure, label AS y, coalesce(r.rate,p.rate) AS p, dq_bucket/4 AS p_raw FROM dis d CROSS JOIN prior p LEFT JOIN rates r ON d.dq_bucket IS NOT DISTINCT FROM r.rb AND d.max_bucket_last_3 IS NOT DISTINCT FROM r.rm""",
    "late": "SELECT * FROM sc WHERE split IN ('validation','test')",
    "money": "SELECT month_idx, loan_sequence_number, CASE WHEN label=1 THEN exposure ELSE 0 END AS money, dq_bucket, exposure, p, p_raw FROM late",
    "prio": """SELECT month_idx, loan_sequence_number, money, unnest(['random','by_dpd','by_balance','by_prob','by_expected_value','by_expected_value_raw']) AS policy,
  unnest([CAST(0 AS DOUBLE), CAST(dq_bucket AS DOUBLE), CAST(exposure AS DOUBLE), p, p*exposure, p_raw*exposure]) AS priority FROM money""",
    "seeds": "SELECT unnest([0,1,2]) AS seed",
    "rank0": """SELECT month_idx, loan_sequence_number, money, policy, seed, row_number() OVER (PARTITION BY month_idx, policy, seed ORDER BY priority DESC, md5(concat_ws(':',CAST(seed AS VARCHAR),loan_sequence_number,CAST(month_idx AS VARCHAR))), loan_sequence_number) AS rank FROM prio, seeds""",
    "rankall": """SELECT * FROM rank0 UNION ALL SELECT month_idx, loan_sequence_number, money, 'oracle', seed, row_number() OVER (PARTITION BY month_idx, seed ORDER BY money DESC, loan_sequence_number) FROM money, seeds""",
    "sized": "SELECT month_idx, count(*) AS n, sum(money) AS at_risk FROM money GROUP BY 1",
    "caps": "SELECT unnest([0.05,0.1,0.2,0.3,0.5,1.0])::DOUBLE AS capacity",
    "sim": """SELECT r.month_idx, policy, seed, capacity, CAST(sum(CASE WHEN rank<=floor(capacity*n+1e-9) THEN money ELSE 0 END) AS BIGINT) AS captured, CAST(any_value(at_risk) AS BIGINT) AS at_risk FROM rankall r JOIN sized USING (month_idx), caps GROUP BY 1,2,3,4""",
    "points": "SELECT capacity, policy, round(sum(captured)/sum(at_risk),6) AS capture FROM sim GROUP BY 1,2",
    "months": "SELECT month_idx, policy, round(CASE WHEN sum(at_risk)<>0 THEN sum(captured)/sum(at_risk) END,6) AS capture FROM sim WHERE capacity=0.2 GROUP BY 1,2",
    "binned10": "SELECT *, CAST((SELECT count(*) FROM range(1,10) t(k) WHERE k*0.1::DOUBLE <= p) AS INT) AS bin FROM late",
    "longf": "SELECT loan_sequence_number, month_idx, split, unnest(['upb_cents','months_delinquent_last_3','max_bucket_last_6','bucket_lag_1']) AS feature, unnest([upb_cents::DOUBLE, months_delinquent_last_3::DOUBLE, max_bucket_last_6::DOUBLE, bucket_lag_1::DOUBLE]) AS x FROM spl",
    "ref": "SELECT * FROM longf WHERE split='train'",
    "cuts": "SELECT feature, list_sort(list_distinct(quantile_cont(x,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS edges FROM ref GROUP BY 1",
    "lb": "SELECT l.*, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e<=x)) END AS bin FROM longf l JOIN cuts USING (feature)",
    "halves": "SELECT *, CASE WHEN (strpos('0123456789abcdef', substr(md5(concat_ws(':','0',loan_sequence_number,CAST(month_idx AS VARCHAR))),1,1))-1)%2=0 THEN 0 ELSE 1 END AS half FROM lb WHERE split='train'",
    "acols": "SELECT feature, list_sort(list_distinct(quantile_cont(x,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS edges FROM along WHERE split='train' GROUP BY 1",
    "along": "SELECT split, label, unnest(['dq_bucket','bucket_lag_1','months_delinquent_last_6','max_bucket_last_6','upb_change_pct_3','upb_cents','months_delinquent_last_3']) AS feature, unnest([dq_bucket::DOUBLE,bucket_lag_1::DOUBLE,months_delinquent_last_6::DOUBLE,max_bucket_last_6::DOUBLE,upb_change_pct_3::DOUBLE,upb_cents::DOUBLE,months_delinquent_last_3::DOUBLE]) AS x FROM dis",
    "abin": "SELECT l.*, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e<=x)) END AS bin FROM along l JOIN acols USING (feature)",
    "aprior": "SELECT feature, sum(label)/count(*) AS prior FROM abin WHERE split='train' GROUP BY 1",
    "arate": "SELECT b.feature, b.bin, round((sum(label)+100*any_value(prior))/(count(*)+100),6) AS rate FROM abin b JOIN aprior USING (feature) WHERE split='train' GROUP BY 1,2",
    "asc1": "SELECT b.feature, b.split, b.label, coalesce(rate, round(prior,6)) AS r FROM abin b JOIN aprior USING (feature) LEFT JOIN arate a ON a.feature=b.feature AND a.bin=b.bin",
    "wcuts": "SELECT list_distinct(quantile_cont(max_bucket_last_6::DOUBLE,[k/20.0 FOR k IN range(1,20)])) AS edges FROM dis WHERE split='train'",
    "wbin": "SELECT CASE WHEN max_bucket_last_6 IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e<=max_bucket_last_6)) END AS bin, label FROM dis, wcuts WHERE split='train'",
    "cat": "SELECT feature, unnest(range(-1, len(edges)+1)) AS bin FROM cuts",
    "ex": "SELECT c.feature, c.bin, coalesce(n,0)/sum(coalesce(n,0)) OVER (PARTITION BY c.feature) AS e FROM cat c LEFT JOIN (SELECT feature, bin, count(*) AS n FROM lb WHERE split='train' GROUP BY 1,2) USING (feature, bin)",
    "psi": """SELECT month_idx, feature, round(sum((greatest(a,1e-4)-greatest(e,1e-4))*ln(greatest(a,1e-4)/greatest(e,1e-4))),6) AS psi FROM (
  SELECT t.month_idx, t.feature, ex.e, coalesce(c.n,0)/t.t AS a FROM (SELECT month_idx, feature, count(*) AS t FROM lb GROUP BY 1,2) t JOIN ex USING (feature)
  LEFT JOIN (SELECT month_idx, feature, bin, count(*) AS n FROM lb GROUP BY 1,2,3) c ON c.month_idx=t.month_idx AND c.feature=t.feature AND c.bin=ex.bin) GROUP BY 1,2""",
    "mm0": "SELECT month_idx, count(*) AS n, round(avg(y),6) AS roll_rate, round(avg(p),6) AS mean_pred, round(avg(p)-avg(y),6) AS gap, round(avg(p_raw)-avg(y),6) AS gap_raw FROM sc GROUP BY 1",
    "mb": "SELECT *, (SELECT count(*) FROM range(1,10) t(k) WHERE k*0.1::DOUBLE <= p) AS bin FROM sc",
    "ece": "SELECT month_idx, round(sum(g)/sum(n),6) AS ece FROM (SELECT month_idx, bin, count(*) AS n, abs(sum(p)-sum(y)) AS g FROM mb GROUP BY 1,2) GROUP BY 1",
    "auc": """SELECT month_idx, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c1) AS BIGINT) AS n_pos, round(CASE WHEN sum(c1)*(sum(c)-sum(c1))<>0 THEN sum(c1*(2*below+c-c1))/(2*sum(c1)*(sum(c)-sum(c1))) END,6) AS auc FROM (
  SELECT *, coalesce(sum(c-c1) OVER (PARTITION BY month_idx ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM (SELECT month_idx, p, count(*) AS c, sum(y) AS c1 FROM sc GROUP BY 1,2)) GROUP BY 1""",
    "base": "SELECT round(avg(mean_pred)-2*stddev_samp(mean_pred),6) AS low, round(avg(mean_pred)+2*stddev_samp(mean_pred),6) AS high FROM mm0 WHERE month_idx<23988",
    "ser": "SELECT n_nationkey, CAST(year(o_orderdate)*12+month(o_orderdate)-1 AS INT) AS month_idx, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey",
    "smean": "SELECT n_nationkey, month_idx, avg(cents) AS mean FROM ser GROUP BY 1,2",
    "spine": "SELECT n_nationkey, CAST(unnest(range(min(month_idx),max(month_idx)+3)) AS INT) AS month_idx FROM smean GROUP BY 1",
    "filled": "SELECT s.n_nationkey, s.month_idx, last_value(mean IGNORE NULLS) OVER (PARTITION BY s.n_nationkey ORDER BY s.month_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value FROM spine s LEFT JOIN smean USING (n_nationkey, month_idx)",
    "macro": """SELECT n_nationkey, month_idx+2 AS month_idx, value AS level, CASE WHEN max(value) OVER p3>0 THEN (value/max(value) OVER p3-1)*100 END AS c3, value-max(value) OVER p12 AS c12 FROM filled
  WINDOW p3 AS (PARTITION BY n_nationkey ORDER BY month_idx RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING), p12 AS (PARTITION BY n_nationkey ORDER BY month_idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING)""",
}


def _with(select: str) -> str:
    """`select` after the views it needs, directly or not."""
    import re

    need: list[str] = []
    seen: set[str] = set()

    def add(text: str) -> None:
        for name in _PARTS:
            if name not in seen and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                seen.add(name)
                add(_PARTS[name])
                need.append(name)

    body = select.lstrip().removeprefix("+").lstrip()
    add(body)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in need) + "\n" + body


# --- queries ---------------------------------------------------------------------------------------------------------

_ID = [KEY, MONTH]


@query("+SELECT count(*) AS n_rows, count(DISTINCT loan_sequence_number) AS n_loans, CAST(sum(CASE WHEN delinquency_status='XX' THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown, CAST(sum(CASE WHEN delinquency_status='RA' THEN 1 ELSE 0 END) AS BIGINT) AS n_owned, max(month_idx) AS last_month, CAST(sum(CASE WHEN delinquency_status IS NOT NULL AND TRY_CAST(delinquency_status AS INT) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed_status FROM panel")
def panel_profile(spark, d):
    s = F.col("delinquency_status")
    return proxy(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct(KEY).alias("n_loans"), F.count_if(s == "XX").alias("n_unknown"), F.count_if(s == "RA").alias("n_owned"), F.max(MONTH).alias("last_month"), S.cast_failures(s, "int").alias("failed_status"))


@query("+SELECT loan_sequence_number, month_idx, upb_cents, dq_months, dq_bucket, is_reo, zero_balance_code FROM mapped")
def panel_status_map(spark, d):
    return mapped(spark, d).select(*_ID, "upb_cents", "dq_months", "dq_bucket", "is_reo", "zero_balance_code")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1")
def panel_duplicates(spark, d):
    return panel.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("+SELECT count(*) AS n_loans, CAST(sum(CASE WHEN span<>n THEN 1 ELSE 0 END) AS BIGINT) AS n_with_gaps FROM (SELECT loan_sequence_number, count(*) AS n, max(month_idx)-min(month_idx)+1 AS span FROM mapped GROUP BY 1)")
def panel_gap_summary(spark, d):
    return panel.gap_summary(mapped(spark, d))


@query("+SELECT dq_bucket, is_reo, count(*) AS n, round(count(*)/(SELECT count(*) FROM mapped),6) AS share FROM mapped GROUP BY 1,2")
def panel_bucket_distribution(spark, d):
    return panel.shares(mapped(spark, d), "dq_bucket", "is_reo")


@query("+SELECT loan_sequence_number, month_idx, a_bucket, a_months, a_roll, a_cure, a_exclude FROM ahead")
def label_future_window(spark, d):
    o = ("bucket", "months", "roll", "cure", "exclude")
    return panel.with_outcomes(mapped(spark, d)).select(*_ID, *(F.col(f"outcome.{c}").alias(f"a_{c}") for c in o))


@query("+SELECT loan_sequence_number, month_idx, dq_bucket, label_reason, label FROM lab")
def label_reasons(spark, d):
    return panel.labelled(mapped(spark, d)).select(*_ID, "dq_bucket", "label_reason", "label")


@query("+SELECT label_reason, count(*) AS n, round(count(*)/(SELECT count(*) FROM lab),6) AS share FROM lab GROUP BY 1")
def label_reason_counts(spark, d):
    return panel.shares(panel.labelled(mapped(spark, d)), "label_reason")


@query("+SELECT loan_sequence_number, month_idx, split, label FROM dis")
def split_disjoint(spark, d):
    return panel.disjoint(panel.labelled(mapped(spark, d))).select(*_ID, "split", "label")


@query("+SELECT split, count(*) AS n, count(DISTINCT loan_sequence_number) AS n_loans, round(avg(label),6) AS base_rate, min(month_idx) AS first_month, max(month_idx) AS last_month FROM dis GROUP BY 1")
def split_summary(spark, d):
    return panel.disjoint(panel.labelled(mapped(spark, d))).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct(KEY).alias("n_loans"), F.round(F.avg("label"), 6).alias("base_rate"), F.min(MONTH).alias("first_month"), F.max(MONTH).alias("last_month"))


@query("+SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.loan_sequence_number) AS n_loans FROM spl a JOIN spl b ON a.loan_sequence_number=b.loan_sequence_number AND a.so<b.so GROUP BY 1,2")
def split_overlaps(spark, d):
    return panel.overlaps(panel.with_splits(panel.labelled(mapped(spark, d))), list(panel.SPLITS)).where("n_loans > 0")


@query("+SELECT split, round(avg(CASE WHEN dq_bucket=1 THEN label END),6) AS bucket_1, round(avg(CASE WHEN dq_bucket=2 THEN label END),6) AS bucket_2, round(avg(CASE WHEN dq_bucket=3 THEN label END),6) AS bucket_3 FROM dis GROUP BY 1")
def base_rate_by_bucket(spark, d):
    p = panel.disjoint(panel.labelled(mapped(spark, d))).groupBy("split").pivot("dq_bucket", [1, 2, 3]).agg(F.round(F.avg("label"), 6))
    return p.select("split", *(F.col(str(k)).alias(f"bucket_{k}") for k in (1, 2, 3)))


def _feature_query(names: list[str], rounded: tuple[str, ...] = ()):
    def run(spark, d):
        audit([f for f in panel.trajectory_features("upb_cents") if f.name in names])
        return features(spark, d).select(*_ID, *(F.round(n, 6).alias(n) if n in rounded else F.col(n) for n in names))

    return run, "+SELECT loan_sequence_number, month_idx, " + ", ".join(f"round({n},6) AS {n}" if n in rounded else n for n in names) + " FROM feat"


for _name, _args in {
    "traj_windows_3_6_12": (["months_observed_last_12", *(f"{a}_last_{n}" for a in ("months_delinquent", "max_bucket", "mean_bucket") for n in (3, 6, 12))], tuple(f"mean_bucket_last_{n}" for n in (3, 6, 12))),
    "traj_events": ([f"n_{e}_events_last_{n}" for e in ("cure", "roll") for n in (6, 12)],),
    "traj_lags_exact": (["bucket_lag_1", "bucket_lag_2", "bucket_lag_3"],),
    "traj_lifetime": (["months_since_last_current", "months_since_first_delinquency", "times_entered_delinquency_before_t", "max_bucket_before_t"],),
    "traj_runs": (["longest_delinquent_run_before_t", "current_run_length"],),
    "traj_velocity_upb_change": (["delinquency_velocity_3m", "upb_change_pct_3", "upb_change_pct_6", "upb_change_pct_12"], ("upb_change_pct_3", "upb_change_pct_6", "upb_change_pct_12")),
}.items():
    _f, _s = _feature_query(*_args)
    _f.__name__ = _name
    query(_s)(_f)


@query("+SELECT loan_sequence_number, month_idx, round(CASE WHEN o>0 THEN upb_cents/o END,6) AS upb_to_orig_upb, upb_cents%1000-o%1000 AS rate_change_since_orig FROM (SELECT *, first_value(upb_cents) OVER (PARTITION BY loan_sequence_number ORDER BY month_idx) AS o FROM mapped)")
def current_state_ratios(spark, d):
    from pyspark.sql.window import Window

    m = mapped(spark, d).withColumn("orig_upb", F.first("upb_cents").over(Window.partitionBy(KEY).orderBy(MONTH))).withColumnRenamed("upb_cents", "current_upb")
    m = m.withColumns({"current_interest_rate": F.col("current_upb") % 1000, "orig_interest_rate": F.col("orig_upb") % 1000})
    return panel.current_state(m).select(*_ID, F.round("upb_to_orig_upb", 6).alias("upb_to_orig_upb"), "rate_change_since_orig")


def _series(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    s = o.select("n_nationkey", S.month_index(F.col("o_orderdate")).cast("int").alias(MONTH), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    return panel.monthly(s, ["n_nationkey"])


@query("+SELECT n_nationkey, month_idx, round(value,4) AS value FROM filled")
def macro_monthly_ffill(spark, d):
    return _series(spark, d).select("n_nationkey", MONTH, F.round("value", 4).alias("value"))


def _macro(spark, d) -> DataFrame:
    s = _series(spark, d)
    a = panel.published(s, 2, [3], True, ["n_nationkey"]).withColumnRenamed("level_chg_3m", "c3")
    return a.join(panel.published(s, 2, [12], False, ["n_nationkey"]).select("n_nationkey", MONTH, F.col("level_chg_12m").alias("c12")), ["n_nationkey", MONTH])


@query("+SELECT n_nationkey, month_idx, round(level,4) AS level, round(c3,4) AS c3, round(c12,4) AS c12 FROM macro")
def macro_lagged_changes(spark, d):
    return _macro(spark, d).select("n_nationkey", MONTH, *(F.round(c, 4).alias(c) for c in ("level", "c3", "c12")))


@query("+SELECT d.loan_sequence_number, d.month_idx, split, label, bucket_lag_1, round(level,4) AS level, round(c3,4) AS c3 FROM dis d JOIN supplier ON s_suppkey=CAST(substr(split_part(loan_sequence_number,'-',1),2) AS BIGINT) LEFT JOIN macro m ON m.n_nationkey=s_nationkey AND m.month_idx=d.month_idx")
def feature_join(spark, d):
    r = panel.disjoint(labels(spark, d)).withColumn("s_suppkey", F.substring(F.split_part(F.col(KEY), F.lit("-"), F.lit(1)), 2, 20).cast("long"))
    r = r.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), "s_suppkey").join(_macro(spark, d), ["n_nationkey", MONTH], "left")
    return r.select(*_ID, "split", "label", "bucket_lag_1", F.round("level", 4).alias("level"), F.round("c3", 4).alias("c3"))


_NULLED = ["bucket_lag_1", "bucket_lag_3", "months_since_last_current", "upb_change_pct_12"]


@query("+SELECT unnest([" + ",".join(f"'{c}'" for c in _NULLED) + "]) AS feature, unnest([" + ",".join(f"round((count(*)-count({c}))/count(*),6)" for c in _NULLED) + "]) AS null_rate FROM feat")
def feature_null_rates(spark, d):
    return metrics.null_rates(features(spark, d), _NULLED)


@query("+SELECT loan_sequence_number, month_idx, p FROM sc")
def target_encoding(spark, d):
    return rows(spark, d).select(*_ID, "p")


@query("+SELECT round(CASE WHEN sum(c1)*(sum(c)-sum(c1))<>0 THEN sum(c1*(2*below+c-c1))/(2*sum(c1)*(sum(c)-sum(c1))) END,6) AS auc, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c1) AS BIGINT) AS n_pos FROM (SELECT *, coalesce(sum(c-c1) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM (SELECT p, count(*) AS c, sum(y) AS c1 FROM late GROUP BY 1))")
def single_feature_auc_categorical(spark, d):
    return metrics.auc(later(spark, d), [])


@query("+SELECT * FROM auc")
def auc_by_group(spark, d):
    return metrics.auc(rows(spark, d), [MONTH])


@query("+SELECT split, round(sum(c1*tp/n)/sum(c1),6) AS average_precision FROM (SELECT *, sum(c) OVER w AS n, sum(c1) OVER w AS tp FROM (SELECT split, p, count(*) AS c, sum(y) AS c1 FROM sc GROUP BY 1,2) WINDOW w AS (PARTITION BY split ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1")
def average_precision_by_group(spark, d):
    return metrics.average_precision(rows(spark, d), ["split"])


@query("+SELECT split, round(avg((p-y)*(p-y)),6) AS brier FROM sc GROUP BY 1")
def brier_by_group(spark, d):
    return metrics.brier(rows(spark, d), ["split"])


@query("+SELECT k AS bin, coalesce(n,0) AS n, mean_pred, actual FROM (SELECT CAST(unnest(range(0,10)) AS INT) AS k) LEFT JOIN (SELECT bin, count(*) AS n, round(avg(p),6) AS mean_pred, round(avg(y),6) AS actual FROM binned10 GROUP BY 1) ON k=bin")
def reliability_table(spark, d):
    return metrics.reliability(later(spark, d))


@query("+SELECT * FROM ece")
def ece_by_month(spark, d):
    return metrics.calibration_error(rows(spark, d), [MONTH])


@query("+SELECT split, decile, count(*) AS n, round(avg(p),6) AS mean_pred, round(avg(y),6) AS actual FROM (SELECT *, CAST((row_number() OVER (PARTITION BY split ORDER BY p DESC, loan_sequence_number, month_idx)*10+count(*) OVER (PARTITION BY split)-1)//count(*) OVER (PARTITION BY split) AS INT) AS decile FROM late) GROUP BY 1,2")
def decile_table(spark, d):
    return metrics.deciles(later(spark, d), ["split"])


@query("+SELECT a.dq_bucket, a.n, base_rate, auc, average_precision FROM (SELECT dq_bucket, CAST(sum(c) AS BIGINT) AS n, round(sum(c1)/sum(c),6) AS base_rate, round(CASE WHEN sum(c1)*(sum(c)-sum(c1))<>0 THEN sum(c1*(2*below+c-c1))/(2*sum(c1)*(sum(c)-sum(c1))) END,6) AS auc FROM (SELECT *, coalesce(sum(c-c1) OVER (PARTITION BY dq_bucket ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM (SELECT dq_bucket, p, count(*) AS c, sum(y) AS c1 FROM late GROUP BY 1,2)) GROUP BY 1) a JOIN (SELECT dq_bucket, round(sum(c1*tp/n)/sum(c1),6) AS average_precision FROM (SELECT *, sum(c) OVER w AS n, sum(c1) OVER w AS tp FROM (SELECT dq_bucket, p, count(*) AS c, sum(y) AS c1 FROM late GROUP BY 1,2) WINDOW w AS (PARTITION BY dq_bucket ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1) USING (dq_bucket)")
def metrics_per_bucket(spark, d):
    return metrics.per_group(later(spark, d), ["dq_bucket"])


_SEEDS = (0, 1, 2)


def _simulated(spark, d) -> DataFrame:
    return ranking.simulate(_ranked_on(spark, d), CAPACITIES, seeds=_SEEDS)


def _ranked_on(spark, d) -> DataFrame:
    return later(spark, d).select(*_ID, "dq_bucket", "exposure", "p", "p_raw", "label")


@query("+SELECT month_idx, loan_sequence_number, policy, seed, rank FROM rank0")
def policy_rank(spark, d):
    return ranking.ranked(_ranked_on(spark, d).drop("label"), seeds=_SEEDS)


@query("+SELECT * FROM points")
def policy_capture_curve(spark, d):
    return ranking.curve(_simulated(spark, d))


@query("+SELECT * FROM months")
def policy_monthly_capture(spark, d):
    return ranking.monthly_capture(_simulated(spark, d), HEADLINE)


@query("+SELECT m.policy, count(m.capture) AS months, round(avg(m.capture),8) AS mean, round(stddev_samp(m.capture),8) AS sd, min(m.capture) AS low, max(m.capture) AS high, CAST(sum(CASE WHEN m.capture>f.capture THEN 1 ELSE 0 END) AS BIGINT) AS above_by_dpd, CAST(sum(CASE WHEN m.capture>g.capture THEN 1 ELSE 0 END) AS BIGINT) AS above_by_balance FROM months m JOIN months f ON f.policy='by_dpd' AND f.month_idx=m.month_idx JOIN months g ON g.policy='by_balance' AND g.month_idx=m.month_idx GROUP BY 1")
def policy_stability(spark, d):
    return ranking.stability(ranking.monthly_capture(_simulated(spark, d), HEADLINE))


@query("+SELECT p.capacity, p.policy, round(CASE WHEN o.capture<>f.capture THEN (p.capture-f.capture)/(o.capture-f.capture) END,4) AS gap_closed FROM points p JOIN points f ON f.policy='random' AND f.capacity=p.capacity JOIN points o ON o.policy='oracle' AND o.capacity=p.capacity")
def policy_gap_closed(spark, d):
    return ranking.gap_closed(ranking.curve(_simulated(spark, d)))


@query("+SELECT round(sum(CASE WHEN t THEN exposure END)/sum(exposure),6) AS balance_share, round(avg(CASE WHEN t THEN label END),6) AS rate_largest, round(avg(CASE WHEN NOT t THEN label END),6) AS rate_rest FROM (SELECT *, row_number() OVER (PARTITION BY month_idx ORDER BY exposure DESC, loan_sequence_number)<=floor(0.2*count(*) OVER (PARTITION BY month_idx)+1e-9) AS t FROM late)")
def policy_balance_share(spark, d):
    return ranking.largest_share(later(spark, d), HEADLINE)


@query("+SELECT unnest(['all_at_full_capacity','never_over_oracle','never_falling','random_near_capacity']) AS \"check\", unnest([bool_and(capacity<1 OR abs(capture-1)<1e-6), bool_and(capture<=best+1e-6), bool_and(b IS NULL OR capture>=b-1e-6), bool_and(policy<>'random' OR abs(capture-capacity)<0.25)]) AS passed FROM (SELECT p.*, o.capture AS best, lag(p.capture) OVER (PARTITION BY p.policy ORDER BY p.capacity) AS b FROM points p JOIN points o ON o.policy='oracle' AND o.capacity=p.capacity)")
def policy_validity_checks(spark, d):
    return ranking.validity(ranking.curve(_simulated(spark, d)))


def _population(spark, d) -> DataFrame:
    return panel.with_splits(labels(spark, d))


def _psi(spark, d) -> DataFrame:
    pop = _population(spark, d)
    return drift.psi_by_period(pop.where("split = 'train'"), pop, MONTH, MONITORED)


@query("+SELECT feature, round(edge,4) AS edge FROM (SELECT feature, unnest(edges) AS edge FROM cuts)")
def psi_bins(spark, d):
    return drift.edges(_population(spark, d).where("split = 'train'"), MONITORED).select("feature", F.explode("edges").alias("edge")).withColumn("edge", F.round("edge", 4))


@query("+SELECT * FROM psi")
def psi_by_month(spark, d):
    return _psi(spark, d)


@query("+SELECT t.feature, round(sum((greatest(coalesce(b.n,0)/t.n1,1e-4)-greatest(coalesce(a.n,0)/t.n0,1e-4))*ln(greatest(coalesce(b.n,0)/t.n1,1e-4)/greatest(coalesce(a.n,0)/t.n0,1e-4))),6) AS psi FROM (SELECT feature, sum(CASE WHEN half=0 THEN 1 ELSE 0 END) AS n0, sum(half) AS n1 FROM halves GROUP BY 1) t JOIN cat USING (feature) LEFT JOIN (SELECT feature, bin, count(*) AS n FROM halves WHERE half=0 GROUP BY 1,2) a ON a.feature=t.feature AND a.bin=cat.bin LEFT JOIN (SELECT feature, bin, count(*) AS n FROM halves WHERE half=1 GROUP BY 1,2) b ON b.feature=t.feature AND b.bin=cat.bin GROUP BY 1")
def psi_split_half(spark, d):
    return drift.split_half(_population(spark, d).where("split = 'train'"), _ID, MONITORED)


@query("+SELECT month_idx, round(median(psi),7) AS median_psi, CAST(sum(CASE WHEN psi>0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_warn, CAST(sum(CASE WHEN psi>0.25 THEN 1 ELSE 0 END) AS BIGINT) AS n_alarm FROM psi GROUP BY 1")
def psi_monthly_summary(spark, d):
    return drift.monthly_summary(_psi(spark, d), MONTH)


@query("+SELECT m.*, ece, auc FROM mm0 m JOIN ece USING (month_idx) JOIN auc USING (month_idx)")
def drift_monthly_metrics(spark, d):
    return drift.monthly(rows(spark, d), MONTH)


def _mean_pred(spark, d) -> DataFrame:
    return rows(spark, d).groupBy(MONTH).agg(metrics.exact_mean("p").alias("mean_pred"))


@query("+SELECT * FROM base")
def drift_baseline_band(spark, d):
    return drift.band(_mean_pred(spark, d).where(F.col(MONTH) < 23988), "mean_pred")


@query("+SELECT min(CASE WHEN h=2 THEN month_idx END) AS first_departure FROM (SELECT month_idx, sum(CASE WHEN mean_pred>high THEN 1 ELSE 0 END) OVER (ORDER BY month_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS h FROM mm0, base)")
def drift_first_departure(spark, d):
    s = _mean_pred(spark, d)
    return drift.first_departure(s, drift.band(s.where(F.col(MONTH) < 23988), "mean_pred"), MONTH, "mean_pred")


@query("+SELECT feature, round(avg(CASE WHEN month_idx>=24000 THEN psi END)-avg(CASE WHEN month_idx<24000 THEN psi END),6) AS excess, max(psi) AS peak, arg_max(month_idx, psi*1000000-month_idx/1000000) AS peak_period FROM psi GROUP BY 1")
def drift_top_features(spark, d):
    return drift.movers(_psi(spark, d), MONTH, 24000)


@query("+SELECT split, list_extract(['train','validation','test','drift_study'], first_so+1) AS first_split, count(*) AS n FROM spl GROUP BY 1,2")
def monitoring_population(spark, d):
    return _population(spark, d).groupBy("split", "first_split").agg(F.count("*").alias("n"))


@query("+SELECT split, coalesce(k, CASE WHEN zero_status IS NULL THEN 'null' ELSE 'other' END) AS bin, count(*) AS n FROM (SELECT split, CASE WHEN bucket_lag_1 IS NOT NULL THEN concat('b', CAST(bucket_lag_1 AS VARCHAR)) END AS zero_status FROM spl) LEFT JOIN (SELECT DISTINCT concat('b', CAST(bucket_lag_1 AS VARCHAR)) AS k FROM spl WHERE split='validation' AND bucket_lag_1 IS NOT NULL AND bucket_lag_1<4) ON k=zero_status GROUP BY 1,2")
def drift_level_bins(spark, d):
    pop = _population(spark, d).withColumn("lvl", F.when(F.col("bucket_lag_1").isNotNull(), F.concat(F.lit("b"), F.col("bucket_lag_1").cast("string"))))
    return drift.level_bins(pop, pop.where("split = 'validation' AND bucket_lag_1 < 4"), "lvl", ["split"])


@query()
def calibration_transfer(spark, d):
    r = stored(rows(spark, d).where("split <> 'drift_study'").select(MONTH, F.col("p").alias("raw"), "y"))
    return scoring.transfer_check(r, MONTH)[1]


_MODEL = ["dq_bucket", "bucket_lag_1", "months_delinquent_last_6", "max_bucket_last_6", "upb_change_pct_3"]


@query()
def model_comparison(spark, d):
    """Bucket rate, WOE logistic, boosted trees over all rows and per bucket: raw and calibrated on the validation split."""
    r = stored(rows(spark, d).select("split", "y", "p", "label", *_MODEL))
    train, check, test = (r.where(F.col("split") == s) for s in ("train", "validation", "test"))
    pooled = scoring.boosted(train, _MODEL, check=check)
    own = scoring.segmented(train, _MODEL, "dq_bucket", [1, 2, 3])
    models = {
        "bucket_rate": lambda df: df.withColumn("raw", F.col("p")),
        "woe_logistic": scoring.woe_logistic(train, _MODEL),
        "boosted_pooled": lambda df: scoring.scored(pooled, df, _MODEL),
        "boosted_segmented": lambda df: scoring.scored_by_segment(own, df, _MODEL, "dq_bucket"),
    }
    return scoring.compared(models, check, test)


@query()
def feature_importance(spark, d):
    r = stored(rows(spark, d).select("split", "label", *_MODEL))
    return scoring.importance(scoring.boosted(r.where("split = 'train'"), _MODEL, check=r.where("split = 'validation'")), _MODEL, spark)


@query("+SELECT 'max_bucket_last_6' AS feature, bin, round(ln(((n1+0.5)/sum(n1) OVER ())/((n0+0.5)/sum(n0) OVER ())),6) AS woe FROM (SELECT bin, sum(label) AS n1, sum(1-label) AS n0 FROM wbin GROUP BY 1)")
def woe_bins(spark, d):
    return scoring.woe_table(rows(spark, d).where("split = 'train'"), "max_bucket_last_6").drop("edges").withColumn("woe", F.round("woe", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_sources  # noqa: F401  adds its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_sources  # noqa: F401  adds its queries

    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_monthly_capture(spark, sf_dir)
