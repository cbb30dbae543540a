"""The jobs as queries: each runs twice into a new folder under spark.checkpoint.dir and gives its output read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import monthly_field, text_recurrence
from jobs.common import config


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share. A local session without the setting (as in tests) gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="isohyet-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_monthly_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job1")
    for _ in range(2):
        monthly_field.run(spark, f"{sf_dir}/lineitem.parquet", out, config(monthly_field.DEFAULT))
    return monthly_field.read_back(spark, out)


def job2_text_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "job2")
    for _ in range(2):
        text_recurrence.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint", config(text_recurrence.DEFAULT))
    return text_recurrence.read_back(spark, out)


QUERIES = {"job1_monthly_field": job1_monthly_field, "job2_text_recurrence": job2_text_recurrence}

RUNS = """
c AS (SELECT {keys}, 'diag' AS kind, j - i AS line, i AS place FROM rec UNION ALL SELECT {keys}, 'vert', j, i FROM rec),
g AS (SELECT *, place - row_number() OVER (PARTITION BY {keys}, kind, line ORDER BY place) AS g FROM c),
runs AS (SELECT {keys}, kind, count(*) AS len FROM g GROUP BY {keys}, kind, line, g),"""

JOB1_SQL = f"""
WITH b AS (SELECT CAST(l_shipdate AS DATE) AS time, l_partkey % 100 AS cell, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
lim AS (SELECT CAST(date_trunc('month', min(time)) AS DATE) AS lo, CAST(date_trunc('month', max(time)) AS DATE) - 1 AS hi FROM b),
days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS time FROM lim),
cube AS (SELECT d.time, CAST(c.range AS BIGINT) AS cell, coalesce(b.value, 0) AS value FROM days d CROSS JOIN range(100) c LEFT JOIN b ON b.time = d.time AND b.cell = c.range),
normals AS (SELECT cell, month(time) AS m, avg(value) AS mean, stddev_pop(value) AS sd FROM cube WHERE year(time) BETWEEN 1993 AND 1995 GROUP BY 1, 2),
daily AS (SELECT time, cube.cell, value, (value - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM cube JOIN normals n ON n.cell = cube.cell AND n.m = month(time)),
wins AS (SELECT unnest(generate_series(0, (date_diff('day', lo, hi) + 1 - 122) // 61)) AS win FROM lim),
own AS (SELECT win, d.time, date_diff('day', lo, d.time) - win * 61 AS i FROM wins, days d, lim WHERE date_diff('day', lo, d.time) BETWEEN win * 61 AND win * 61 + 121),
x AS (SELECT time, list(z + 1e-6 ORDER BY cell) AS e FROM daily GROUP BY 1),
u AS (SELECT time, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda w: w * w)))) AS u FROM x),
st AS (SELECT win, i, u FROM own JOIN u USING (time)),
pairs AS (SELECT a.win, a.i, b.i AS j, round(least(greatest(1 - list_dot_product(a.u, b.u), 0), 2), 9) AS d FROM st a JOIN st b ON a.win = b.win WHERE abs(a.i - b.i) > 2),
eps AS (SELECT win, quantile_cont(d, 0.1) AS eps FROM pairs GROUP BY 1),
rec AS (SELECT p.win, p.i, p.j FROM pairs p JOIN eps USING (win) WHERE d <= eps),{RUNS.format(keys="win")}
h AS (SELECT win, kind, len, count(*) AS n FROM runs GROUP BY ALL),
p AS (SELECT *, n * 1.0 / sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n END) OVER (PARTITION BY win) AS p FROM h),
m AS (SELECT win,
 coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n * len END), 0) / (coalesce(sum(CASE WHEN kind = 'diag' THEN n * len END), 0) + 1e-8) AS det,
 coalesce(sum(CASE WHEN kind = 'vert' AND len >= 2 THEN n * len END), 0) / (coalesce(sum(CASE WHEN kind = 'vert' THEN n * len END), 0) + 1e-8) AS lam,
 coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN -p * ln(p + 1e-8) END), 0) / ln(121) AS entr,
 coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n * len END) / sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n END), 0) AS lmean FROM p GROUP BY 1),
dd AS (SELECT time, avg(value) AS mean, avg(CAST(value <= 0 AS DOUBLE)) AS nodes, CAST(bool_and(value <= 0) AS DOUBLE) AS dry FROM daily GROUP BY 1),
r AS (SELECT win, min(time) AS first, max(time) AS last, quantile_cont(mean, 0.5) AS rain, avg(dry) AS dry_fraction, avg(nodes) AS dry_node_fraction FROM own JOIN dd USING (time) GROUP BY 1)
SELECT 'daily' AS part, strftime(time, '%Y-%m') AS month, cell AS item, CAST(time AS VARCHAR) AS first, round(value, 6) AS value, round(z, 6) + 0.0 AS anomaly,
 CAST(NULL AS DOUBLE) AS det, CAST(NULL AS DOUBLE) AS lam, CAST(NULL AS DOUBLE) AS entr, CAST(NULL AS DOUBLE) AS lmean, CAST(NULL AS DOUBLE) AS rain, CAST(NULL AS DOUBLE) AS dry_fraction, CAST(NULL AS DOUBLE) AS dry_node_fraction, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd FROM daily
UNION ALL
SELECT 'window', strftime(last, '%Y-%m'), win, CAST(first AS VARCHAR), NULL, NULL, round(det, 6), round(lam, 6), round(entr, 6), round(lmean, 6), round(rain, 6), round(dry_fraction, 6), round(dry_node_fraction, 6), NULL, NULL FROM r LEFT JOIN m USING (win)
UNION ALL
SELECT 'normal', lpad(CAST(m AS VARCHAR), 2, '0'), cell, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(mean, 6), round(sd, 6) FROM normals
UNION ALL
SELECT 'mark', strftime(hi, '%Y-%m'), NULL, CAST(lo AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lim
"""

SUMS = "CAST(sum(words) AS BIGINT) AS words, CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(points) AS BIGINT) AS points, CAST(sum(diagonal_long) AS BIGINT) AS diagonal_long, CAST(sum(diagonal_runs) AS BIGINT) AS diagonal_runs, CAST(sum(vertical_long) AS BIGINT) AS vertical_long"
SHARES = "round(coalesce(diagonal_long / nullif(points, 0), 0), 6) AS det, round(coalesce(vertical_long / nullif(points, 0), 0), 6) AS lam, round(coalesce(diagonal_long / nullif(diagonal_runs, 0), 0), 6) AS lmean"
COUNTS = "words, windows, points, diagonal_long, diagonal_runs, vertical_long"

JOB2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS source, coalesce(nullif(lang, ''), 'und') AS language,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT k, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
v AS (SELECT k, word, pos // 64 AS win, pos % 64 AS i FROM w),
rec AS (SELECT a.k, a.win, a.i, b.i AS j FROM v a JOIN v b ON a.k = b.k AND a.win = b.win AND a.word = b.word WHERE a.i <> b.i),{RUNS.format(keys="k, win")}
h AS (SELECT k, kind, len, count(*) AS n FROM runs GROUP BY ALL),
s AS (SELECT k, CAST(sum(CASE WHEN kind = 'diag' THEN n * len END) AS BIGINT) AS points, CAST(coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n * len END), 0) AS BIGINT) AS diagonal_long,
  CAST(coalesce(sum(CASE WHEN kind = 'diag' AND len >= 2 THEN n END), 0) AS BIGINT) AS diagonal_runs, CAST(coalesce(sum(CASE WHEN kind = 'vert' AND len >= 2 THEN n * len END), 0) AS BIGINT) AS vertical_long FROM h GROUP BY 1),
q AS (SELECT k, n * 1.0 / sum(n) OVER (PARTITION BY k) AS p FROM h WHERE kind = 'diag' AND len >= 2),
e AS (SELECT k, sum(-p * ln(p)) AS entr FROM q GROUP BY 1),
t AS (SELECT language, source, doc_id, CAST(len(ws) AS BIGINT) AS words, CAST((len(ws) + 63) // 64 AS BIGINT) AS windows, coalesce(points, 0) AS points, coalesce(diagonal_long, 0) AS diagonal_long,
  coalesce(diagonal_runs, 0) AS diagonal_runs, coalesce(vertical_long, 0) AS vertical_long, coalesce(entr, 0) AS entr FROM d LEFT JOIN s USING (k) LEFT JOIN e USING (k)),
o AS (SELECT language, source, count(*) AS texts, {SUMS} FROM t GROUP BY 1, 2)
SELECT 'text' AS part, language, source, doc_id, {COUNTS}, {SHARES}, round(entr, 6) + 0.0 AS entr, CAST(NULL AS BIGINT) AS texts FROM t
UNION ALL
SELECT 'source', language, source, NULL, {COUNTS}, {SHARES}, NULL, texts FROM o
"""

ORACLE_SQL = {"job1_monthly_field": JOB1_SQL, "job2_text_recurrence": JOB2_SQL}
