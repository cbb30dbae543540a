"""Jobs over growing input, in copies: two runs give what one run over all of it gives."""

import datetime
import os
import subprocess
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isohyet.functions import kernels
from jobs import monthly_field, text_recurrence
from jobs import queries as jobs
from jobs.common import config, read_if_there

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FIELD = dict(time="day", cell="cell", value="v", cells=4, baseline=[2000, 2000], window_days=60, step_days=30, quantile=0.1, theiler=1, dry=0.0)
TEXT = config(text_recurrence.DEFAULT) | {"window_words": 8}


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    first = datetime.datetime(2000, 1, 5)
    rows = [(first + datetime.timedelta(int(k)), int(c), float(rng.gamma(1.0))) for k in range(560) for c in rng.choice(5, 3)]
    rows += [(None, 1, 5.0), (first, None, 5.0), (first, 2, None), (first, 99, 1.0), *rows[:4]]
    path = str(tmp_path_factory.mktemp("field"))
    df = spark.createDataFrame(rows, "day timestamp_ntz, cell long, v double").repartition(3)
    for k, stop in enumerate(["2000-06-10", "2001-02-03", "2009-01-01"]):
        df.where(F.coalesce(F.col("day") < F.lit(stop).cast("timestamp_ntz"), F.lit(True))).write.parquet(f"{path}/{k}")
    return path


def test_field_grows(spark, field, tmp_path):
    once, steps = f"{tmp_path}/once", f"{tmp_path}/steps"
    all_ = monthly_field.run(spark, f"{field}/2", once, FIELD)
    assert all_["windows"] == (datetime.date(2001, 6, 30) - datetime.date(2000, 1, 1)).days // 30 - 1
    assert monthly_field.run(spark, f"{field}/0", steps, FIELD) == {"days": 0, "windows": 0}  # no whole baseline yet
    one = monthly_field.run(spark, f"{field}/1", steps, FIELD)
    two = monthly_field.run(spark, f"{field}/2", steps, FIELD)
    assert one["days"] == 397 and one["days"] + two["days"] == all_["days"] and one["windows"] + two["windows"] == all_["windows"] and two["windows"] > 0
    want = rows_of(monthly_field.read_back(spark, once).where("part <> 'mark'"))
    assert rows_of(monthly_field.read_back(spark, steps).where("part <> 'mark'")) == want
    # Nothing new: nothing changes. From a month on anew, or after a loss of the mark: the same again.
    assert monthly_field.run(spark, f"{field}/2", steps, FIELD)["days"] == 0
    assert monthly_field.run(spark, f"{field}/2", steps, FIELD, since="2001-04")["days"] == 91
    assert rows_of(monthly_field.read_back(spark, steps).where("part <> 'mark'")) == want
    spark.createDataFrame([], monthly_field.MARK).write.mode("overwrite").parquet(f"{steps}/mark")
    assert monthly_field.run(spark, f"{field}/2", steps, FIELD) == all_
    assert rows_of(monthly_field.read_back(spark, steps).where("part <> 'mark'")) == want


def test_field_values(spark, field, tmp_path):
    out = str(tmp_path)
    monthly_field.run(spark, f"{field}/2", out, FIELD)
    t = spark.read.parquet(f"{field}/2").toPandas().dropna(subset=["day", "cell"])
    got = spark.read.parquet(f"{out}/daily").toPandas()
    day, cell = datetime.date(2000, 3, 7), 2
    mine = got[(got.time == day) & (got.cell == cell)].iloc[0]
    assert mine.value == pytest.approx(t[(t.day == "2000-03-07") & (t.cell == cell)].v.sum())
    base = got[(got.cell == cell) & got.time.map(lambda d: d.year == 2000 and d.month == 3)].value
    assert mine.anomaly == pytest.approx((mine.value - base.mean()) / base.std(ddof=0))
    w = spark.read.parquet(f"{out}/windows").where("win = 4").first()
    days = [w["first"] + datetime.timedelta(k) for k in range(60)]
    x = got.pivot(index="time", columns="cell", values="anomaly").loc[days].to_numpy()
    want = kernels.line_metrics(kernels.recurrence(x, 0.1, 1))
    assert w["first"] == datetime.date(2000, 4, 30) and all(w[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def counts(text, size=8):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    out = [len(words), -(-len(words) // size), 0, 0, 0, 0]
    for a in range(0, len(words), size):
        w = words[a : a + size]
        r = np.array([[x == y and i != j for j, y in enumerate(w)] for i, x in enumerate(w)])
        d, v = kernels.line_lengths(r), kernels.line_lengths(r, False)
        out[2] += int(r.sum())
        for at, n in ((3, sum(k for k in d if k >= 2)), (4, sum(1 for k in d if k >= 2)), (5, sum(k for k in v if k >= 2))):
            out[at] += int(n)
    return tuple(out)


def test_counts_come_from_places_and_not_from_matrices(monkeypatch):
    """Texts of a batch are counted together, however their pairs are dealt out."""
    rng = np.random.default_rng(7)
    said = [None, "", " \t", "x " * 300, "a b " * 50, *(" ".join(rng.choice(list("aAbBcé"), rng.integers(0, 60))) for _ in range(40))]
    want = [counts(t) for t in said]
    monkeypatch.setattr(kernels, "line_lengths", None)
    for most in (5, 100, 1 << 20):
        monkeypatch.setattr(text_recurrence, "PAIRS", most)
        got, entropy = text_recurrence.counted(pa.array(said, pa.string()), 8, 2)
        assert [tuple(map(int, c)) for c in zip(*got)] == want
        lines = np.array([37 + 1, 37 + 1, 37, 37, 37, 37])  # of 2 to 7 places: 37 windows of 8 words and one of 4
        assert entropy[3] == pytest.approx(-(lines / lines.sum() * np.log(lines / lines.sum())).sum()) and not entropy[:3].any()


FIRST = [(1, "a b a b a b", "en", "s1", 1), (2, None, None, None, 1), (3, "A a a a", "", "s1", 1), (4, "the rain in spain " * 40, "en", "s2", 1), (None, "x x", "en", "s1", 1), (1, "a b a b a b", "en", "s1", 1)]
SECOND = [(7, "one two three", "de", "s1", 1), (8, "b a b a", "en", "s1", 1)]


def test_texts_grow(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    texts(spark, FIRST).write.parquet(source)
    assert text_recurrence.run(spark, source, out, mark, TEXT) == {"rows": 6, "sources": 4}
    assert text_recurrence.run(spark, source, out, mark, TEXT) == {"rows": 0, "sources": 4}
    texts(spark, SECOND).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert text_recurrence.run(spark, source, out, mark, TEXT) == {"rows": 2, "sources": 5}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    got = text_recurrence.read_back(spark, out)
    mine = sorted(((r.doc_id or -1, *[r[c] for c in text_recurrence.COUNTS]) for r in got.where("part = 'text'").collect()))
    assert mine == sorted((i or -1, *counts(t)) for i, t, *_ in FIRST + SECOND)
    whole = f"{tmp_path}/whole"
    text_recurrence.run(spark, source, whole, f"{tmp_path}/mark2", TEXT)
    assert rows_of(text_recurrence.read_back(spark, whole)) == rows_of(got)
    one = got.where("part = 'source' AND language = 'en' AND source = 's1'").first()
    assert one.texts == 4 and one.det == round(one.diagonal_long / one.points, 6)


def test_missing_tables_are_empty(spark, tmp_path):
    assert read_if_there(spark, f"{tmp_path}/none", "a long").count() == 0


def test_command_lines(spark, field, tmp_path):
    texts(spark, FIRST).write.parquet(f"{tmp_path}/in")
    (tmp_path / "field.json").write_text(__import__("json").dumps(FIELD))
    for args in (["jobs.text_recurrence", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"], ["jobs.monthly_field", "--input", f"{field}/2", "--output", f"{tmp_path}/field", "--config", f"{tmp_path}/field.json"]):
        done = subprocess.run([sys.executable, "-m", *args], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "isohyet.jobs" in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/out/texts").count() == 6 and spark.read.parquet(f"{tmp_path}/field/windows").count() == 17


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_twin(name, spark):
    c = duckdb.connect()
    for t in ("lineitem", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    b = c.sql(jobs.ORACLE_SQL[name]).df()
    a = jobs.QUERIES[name](spark, DATA).toPandas()[list(b.columns)]
    assert len(a) == len(b) > 0
    numbers = [k for k in b.columns if b[k].dtype != object]
    keys = [k for k in b.columns if b[k].dtype == object] + [k for k in ("item", "doc_id") if k in numbers]
    a, b = (x.astype({k: float for k in numbers}).fillna({k: "" for k in b.columns if k not in numbers}).sort_values(keys + numbers).reset_index(drop=True) for x in (a, b))
    for k in b.columns:
        assert np.allclose(a[k], b[k], atol=2e-6, equal_nan=True) if k in numbers else (a[k] == b[k]).all(), k
