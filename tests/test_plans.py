"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os
from urllib.parse import quote

import duckdb
import pytest

from quarry.plans import numbers, retrieval, texts

PLANS = {k: (m.QUERIES[k], m.ORACLE.get(k)) for m in (retrieval, texts, numbers) for k in m.QUERIES}


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, (int, bool)) else str(v)

    return [names[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", [k for k, (_, sql) in PLANS.items() if sql])
def test_same_as_sql(spark, small, duck, name):
    query, sql = PLANS[name]
    duck.execute(f"CREATE OR REPLACE VIEW wanted AS {sql}")
    got, want = query(spark, small), duck.execute("SELECT * FROM wanted")
    names = [d[0] for d in want.description]
    assert canonical(got.columns, got.collect()) == canonical(names, want.fetchall())


@pytest.mark.parametrize("name", [k for k, (_, sql) in PLANS.items() if not sql])
def test_runs(spark, small, name):
    assert PLANS[name][0](spark, small).count() > 0


def test_deep_links_cover_all_documents_and_whole_texts(spark, tmp_path):
    texts = ["Größe, «été»\u00a0año: 50 % & more/less ~ a*b + c_d-e.f rest", "one\ttwo\n\x1cthree", "", " 中文 ", "a b c d e f g h i", "😀?", *(f"a{c}b" for c in map(chr, range(0x3100)) if c.isspace())]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.url for r in PLANS["lnk_deep_url"][0](spark, str(tmp_path)).collect()}
    want = {i: "https://files.example.org/x#:~:text=" + quote(" ".join(t.split()[:8])) for i, t in enumerate(texts)}
    assert got == want | {99: None}


def test_cleaned_pages_have_the_entities_of_the_sql(spark, tmp_path):
    html = ["<p>a&amp b&amp</p>", "<p>&amp;&amp;&amp</p>", "<p>&amp;lt; &lt;b&gt; &#39;x&#39; &#x27; &euro; &copy &nbsp;&middot;</p>", "<p>&nbsp x &AMP; &ltc</p>", "a&amp;b", "", None]
    spark.createDataFrame([*enumerate(html)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = PLANS["txt_clean_pages"]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = query(spark, str(tmp_path)), c.execute(sql)
    assert canonical(got.columns, got.collect()) == canonical([d[0] for d in want.description], want.fetchall())


def test_idf_has_every_term(spark, tmp_path):
    texts = ["alpha beta beta", "alpha gamma", "", None, "alpha x-ray 10k"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: (r.df, r.idf) for r in PLANS["ir_idf"][0](spark, str(tmp_path)).collect()}
    df = {"alpha": 3, "beta": 1, "gamma": 1, "x-ray": 1, "10k": 1}
    assert got == {t: (k, round(math.log((5 - k + 0.5) / (k + 0.5) + 1), 6)) for t, k in df.items()}


def test_every_answer_has_a_verdict(spark, tmp_path):
    said = "The quarterly revenue grew strongly across european markets."
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "user", said), (2, 1, "assistant", "Yes. Of course!"), (3, 0, "assistant", said), (4, 0, "user", None), (4, 1, "assistant", said)]
    turns += [(5, 0, "user", said), (5, 1, "assistant", "The dog chased seventeen purple balloons yesterday."), (6, 0, "user", said), (6, 1, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.passed, r.ratio, r.level) for r in PLANS["aud_verdict"][0](spark, str(tmp_path)).collect()}
    assert got == {1: (True, 1.0, "high"), 2: (True, 1.0, "high"), 3: (False, 0.0, "low"), 4: (False, 0.0, "low"), 5: (False, 0.0, "low"), 6: (True, 1.0, "high")}
    assert {r.conv_id for r in PLANS["aud_support"][0](spark, str(tmp_path)).collect()} == {1, 5}


def test_control_regression_matches_least_squares(spark):
    import numpy as np

    from quarry.operators.returns import ols

    r = np.random.default_rng(3)
    x, z = r.normal(size=200), r.normal(size=200)
    y = 0.3 + 0.5 * x - 0.2 * z + r.normal(scale=0.1, size=200)
    rows = [(5, float(a), float(b), float(c)) for a, b, c in zip(x, z, y)] + [(5, float("nan"), 0.0, 0.0), (20, 1.0, 1.0, 1.0)]
    got = {g["window"]: g for g in ols(spark.createDataFrame(rows, "window int, signal double, mkt double, ret double"), ["window"], control="mkt").collect()}
    a = np.column_stack([np.ones(200), x, z])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    res = y - a @ beta
    se = math.sqrt(res @ res / 197 * np.linalg.inv(a.T @ a)[1, 1])
    assert got[5]["n"] == 200 and abs(got[5]["coef"] - beta[1]) < 1e-9 and abs(got[5]["t_stat"] - beta[1] / se) < 1e-6
    assert got[20]["n"] == 1 and math.isnan(got[20]["coef"])
