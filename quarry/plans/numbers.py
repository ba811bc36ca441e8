"""Statements, differences, returns, evaluation and cache queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import diffing as D
from quarry.operators import fundamentals as N
from quarry.operators import returns as R
from quarry.operators import stores as S
from quarry.operators.storage import written
from quarry.plans.bind import LETTERS_SQL, calendared, table

#: Statement lines of a nation's customers by year, as sums over lineitem; the same text is run by both engines.
_LINES = {
    "revenue": "sum(l_extendedprice * (1 - l_discount))",
    "cost_of_revenue": "sum(l_extendedprice * 0.55 * (1 + l_tax))",
    "operating_income": "sum(l_extendedprice * (0.2 - l_discount))",
    "net_income": "sum(l_extendedprice * (0.15 - l_discount))",
    "total_assets": "sum(l_quantity * 1500)",
    "total_equity": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.1 * l_extendedprice END)",
    "total_debt": "sum(l_tax * l_extendedprice * 15)",
    "cash": "sum(l_discount * l_extendedprice)",
    "current_assets": "sum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END)",
    "current_liabilities": "sum(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END)",
    "operating_cash_flow": "sum(l_extendedprice * (0.1 - l_tax))",
    "capex": "-sum(l_extendedprice * 0.04)",
    "interest_expense": "sum(CASE WHEN l_tax > 0.02 THEN l_extendedprice * 0.05 END)",
}


def statements(spark, d):
    """(entity, period, the 13 lines): joins on the order and customer keys, map-side sums."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("period"))
    rows = orders.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("entity", "period").agg(*[F.expr(e).alias(k) for k, e in _LINES.items()])


_ST = f"""st AS (SELECT c_nationkey AS entity, year(o_orderdate) AS period, {', '.join(f'{e} AS {k}' for k, e in _LINES.items())}
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
_RATIO = {
    "gross_margin": "(revenue - cost_of_revenue) / nullif(revenue, 0)", "operating_margin": "operating_income / nullif(revenue, 0)", "net_margin": "net_income / nullif(revenue, 0)",
    "current_ratio": "current_assets / nullif(current_liabilities, 0)", "debt_to_equity": "total_debt / nullif(total_equity, 0)", "roe": "net_income / nullif(total_equity, 0)", "roa": "net_income / nullif(total_assets, 0)",
    "asset_turnover": "revenue / nullif(total_assets, 0)", "fcf": "operating_cash_flow - abs(capex)", "fcf_margin": "(operating_cash_flow - abs(capex)) / nullif(revenue, 0)", "interest_coverage": "operating_income / nullif(interest_expense, 0)",
}
_RT = f"{_ST}, rt AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _RATIO.items())} FROM st)"
_GR = f"{_RT}, gr AS (SELECT *, " + ", ".join(f"CASE WHEN lag({f}) OVER w > 0 THEN {f} / lag({f}) OVER w - 1 END AS {f}_growth" for f in N.GROWTH) + " FROM rt WINDOW w AS (PARTITION BY entity ORDER BY period))"


def _ratios(spark, d):
    return N.ratios(statements(spark, d)).select("entity", F.col("period").cast("long").alias("period"), *[F.round(r, 6).alias(r) for r in N.RATIOS])


def _growth(spark, d):
    return N.growth(statements(spark, d)).select("entity", F.col("period").cast("long").alias("period"), *[F.round(f"{g}_growth", 6).alias(g) for g in N.GROWTH])


def _flags(spark, d):
    return N.flags(statements(spark, d))


def _verdict(spark, d):
    return N.verdict(N.flags(statements(spark, d))).select("entity", F.col("reds").cast("long").alias("reds"), "verdict")


def _trend(spark, d):
    return N.trend(N.long_ratios(statements(spark, d)))


def _growth_trend(spark, d):
    g = N.growth(statements(spark, d)).unpivot(["entity", "period"], [f"{x}_growth" for x in N.GROWTH], "metric", "value")
    return N.trend(g, tolerance=0.01, short="stable")


def _matrix(spark, d):
    """Ratios by period, a column for each period that occurs."""
    rows = N.long_ratios(statements(spark, d)).withColumn("period", F.concat(F.lit("y"), F.col("period").cast("string")))
    return N.pivoted(rows, ["entity", "metric"], "period", F.round(F.first("value"), 6))


def _formatted(spark, d):
    return N.long_ratios(statements(spark, d)).select("entity", F.col("period").cast("long").alias("period"), "metric", N.formatted(F.col("metric"), F.col("value")).alias("shown"))


def facts(spark, d):
    """Facts made of orders: a restatement is a later order of the same customer's nation, year and tag."""
    tags = [t for ts in N.TAGS.values() for t in ts]
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tag = F.element_at(F.array(*map(F.lit, tags)), (F.col("o_orderkey") % len(tags) + 1).cast("int"))
    return rows.select(
        F.col("c_nationkey").alias("entity"), tag.alias("tag"), F.year("o_orderdate").alias("fy"), F.when(F.col("o_orderkey") % 11 == 0, "Q1").otherwise("FY").alias("fp"),
        F.when(F.col("o_orderkey") % 7 == 0, "10-Q").otherwise("10-K").alias("form"), F.col("o_totalprice").alias("val"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("pos"),
    )


def _latest_filed(spark, d):
    return N.latest_filed(facts(spark, d))


def _tag_priority(spark, d):
    annual = facts(spark, d).where("form = '10-K' and fp = 'FY'")
    out = annual.groupBy("entity").agg(*[F.coalesce(*[F.max(F.when(F.col("tag") == t, t)) for t in ts]).alias(f) for f, ts in N.TAGS.items()])
    return out


def prices(spark, d):
    """Daily mean value of each event type as its closing price."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("close"))


def market(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("close"))


def study(spark, d):
    """One event for each user, type and day, its signal the user's mean value that day."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "user_id").agg(F.avg("value").alias("signal"))
    form = F.element_at(F.array(*map(F.lit, ("10-K", "10-q", "Transcript", "8-K"))), (F.col("user_id") % 4 + 1).cast("int"))
    return e.withColumn("form", form)


_MK = """px AS (SELECT event_type AS ticker, ts::DATE AS date, avg(value) AS close FROM events GROUP BY ALL),
 mk AS (SELECT ts::DATE AS date, avg(value) AS close FROM events GROUP BY ALL),
 fw AS (SELECT *, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 20) OVER w / close - 1 AS r20 FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 fm AS (SELECT *, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 20) OVER w / close - 1 AS r20 FROM mk WINDOW w AS (ORDER BY date)),
 ev AS (SELECT event_type AS ticker, ts::DATE AS date, user_id, avg(value) AS signal, (['10-K', '10-q', 'Transcript', '8-K'])[user_id % 4 + 1] AS form FROM events GROUP BY ALL),
 j5 AS (SELECT ev.*, fw.r5, fw.r20 FROM ev ASOF JOIN fw ON ev.ticker = fw.ticker AND ev.date < fw.date),
 jm AS (SELECT j5.*, fm.r5 AS m5, fm.r20 AS m20 FROM j5 ASOF LEFT JOIN fm ON j5.date < fm.date),
 en AS (SELECT ticker, date, user_id, signal, form, 5 AS "window", r5 AS ret, m5 AS mkt FROM jm WHERE r5 IS NOT NULL UNION ALL SELECT ticker, date, user_id, signal, form, 20, r20, m20 FROM jm WHERE r20 IS NOT NULL)"""
_GROUP = "CASE WHEN upper(form) IN ('10-K', '10-Q') THEN 'periodic' WHEN upper(form) = 'TRANSCRIPT' THEN 'transcripts' ELSE 'other' END"


def _enriched(spark, d):
    return R.enrich(study(spark, d), prices(spark, d), market(spark, d))


def _forward(spark, d):
    f = R.forward(study(spark, d), prices(spark, d))
    return f.select("ticker", F.col("date").cast("string").alias("date"), "user_id", "window", F.round("ret", 6).alias("ret"))


def _calendar(spark, d):
    """The same from the stored calendar."""
    f = calendared(spark, d, prices(spark, d)).forward(study(spark, d))
    return f.select("ticker", F.col("date").cast("string").alias("date"), "user_id", "window", F.round("ret", 6).alias("ret"))


def _enrich(spark, d):
    return _enriched(spark, d).select("ticker", F.col("date").cast("string").alias("date"), "user_id", "window", F.round("ret", 6).alias("ret"), F.round("mkt", 6).alias("mkt"))


def _result(df, by):
    return df.select(*by, F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("coef", "intercept", "t_stat", "r2", "rmse", "mae")])


def _pooled(spark, d):
    return _result(R.ols(_enriched(spark, d), ["window"]), ["window"])


def _control(spark, d):
    return _result(R.ols(_enriched(spark, d), ["window"], control="mkt"), ["window"])


def _grouped(spark, d):
    rows = _enriched(spark, d).withColumn("group", R.group_of(F.col("form")))
    return _result(R.ols(rows, ["group", "window"]), ["group", "window"])


def _studied(spark, d):
    """Study rows of the documents: ticker is the source, the date moves with the id, the signal is the sentiment, changes those against the version before."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    form = F.element_at(F.array(*map(F.lit, ("10-K", "10-Q", "TRANSCRIPT", "8-K"))), (F.col("doc_id") % 4 + 1).cast("int"))
    named = docs.select("doc_id", F.col("source").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 25).cast("int")).alias("date"), form.alias("form"), "text")
    signals = named.select("doc_id", X.lexicon_score(F.col("text"), ("the", "on", "la", "der", "en"), ("of", "and", "de", "die", "el")).alias("sentiment_score"))
    changes = D.change_count(D.diff(_pairs(spark, d), units(spark, d)), docs)
    return R.study_rows(named, signals, changes)


def _ret_rows(spark, d):
    return _studied(spark, d).select("doc_id", "ticker", F.col("date").cast("string").alias("date"), "form", F.round("signal", 6).alias("signal"), "disclosure_change")


def _returns_cache(spark, d):
    """Both studies of each ticker, the one of disclosure changes only from five usable documents on, as one row a ticker: `studies` in short, `fits` with their regressions as JSON."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.dayofyear("date") % 28)
    calendar = prices(spark, d).groupBy(day.alias("date")).agg(F.avg("close").alias("close"))
    rows = written(_studied(spark, d), "study")  # read by the calendar's range and by both studies
    met = R.forward(rows.withColumn("_all", F.lit("all")), calendar.withColumn("_all", F.lit("all")), (1, 2), "_all").drop("_all")
    one = R.study(met, ["ticker"]).withColumn("study", F.lit("sentiment"))
    two = R.study(met, ["ticker"], "disclosure_change", 5).withColumn("study", F.lit("disclosure"))
    cached = S.returns_cache(one.unionByName(two))
    shown = F.transform("studies", lambda s: F.concat_ws(":", s["study"], s["group"], s["window"].cast("string"), s["n"].cast("string")))
    names = ("coef", "intercept", "t_stat", "r2", "rmse", "mae")
    fits = F.transform("studies", lambda s: F.struct(*[s[c].alias(c) for c in ("study", "group", "window", "n")], *[F.round(s[c], 6).alias(c) for c in names]))
    return cached.select("ticker", F.array_join(shown, ",").alias("studies"), F.to_json(fits).alias("fits"))


def _ret_verdict(spark, d):
    rows = R.ols(_enriched(spark, d).withColumn("group", R.group_of(F.col("form"))), ["group", "window"])
    return rows.select("group", "window", R.verdict(F.col("t_stat"), F.col("coef")).alias("verdict"), R.summary(F.col("window"), F.col("n"), F.col("coef"), F.col("t_stat"), F.col("r2")).alias("summary"))


def _group_counts(spark, d):
    return study(spark, d).groupBy(R.group_of(F.col("form")).alias("group")).agg(F.count("*").alias("n"))


def _pairs(spark, d):
    return D.pairs(table(spark, d, "documents"), ["source", "lang"], "doc_id")


def _prev(spark, d):
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", F.lag("doc_id").over(w).alias("prev_id"))


def units(spark, d):
    """Lines of more than 40 characters as the units that are compared."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(X.paragraphs(F.col("text"), 40, "\n")).alias("pos", "text"))
    return rows


def _best(spark, d):
    m = D.best_matches(_pairs(spark, d), units(spark, d))
    return m.select("old_id", "new_id", F.col("new_pos").cast("long").alias("new_pos"), F.col("old_pos").cast("long").alias("old_pos"), F.round("score", 6).alias("score"))


def _classify(spark, d):
    kinds = D.best_matches(_pairs(spark, d), units(spark, d)).withColumn("kind", F.coalesce(D.classify(F.col("score")), F.lit("same")))
    return kinds.groupBy("old_id", "new_id", "kind").agg(F.count("*").alias("n"))


def _removed(spark, d):
    p, u = _pairs(spark, d), units(spark, d)
    return D.removed(D.best_matches(p, u), p, u).select("old_id", "new_id", F.col("old_pos").cast("long").alias("old_pos"))


def _top40(spark, d):
    rows = D.diff(_pairs(spark, d), units(spark, d))
    return rows.select("old_id", "new_id", F.col("place").cast("long").alias("place"), "kind", F.col("old_pos").cast("long").alias("old_pos"), F.col("new_pos").cast("long").alias("new_pos"), "similarity")


def _changes(spark, d):
    docs = table(spark, d, "documents")
    return D.change_count(D.diff(_pairs(spark, d), units(spark, d)), docs)


def _turn_pairs(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("series", F.col("doc_id") % 7)
    return D.pairs(c, ["series"], "doc_id")


def _turn_sections(spark, d):
    """Conversations as documents: a turn is a section, its role the item, its lines paragraphs."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("item"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


def _document(spark, d):
    rows = D.by_section(_turn_pairs(spark, d), _turn_sections(spark, d))
    return rows.select("old_id", "new_id", F.col("place").cast("long").alias("place"), "kind", "item", "similarity", F.md5("old_text").alias("old_md5"), F.md5("new_text").alias("new_md5"))


def _by_vectors(spark, d):
    """The same with paragraphs matched by vectors (of letters, so no model is needed)."""
    rows = D.by_section(_turn_pairs(spark, d), _turn_sections(spark, d), embed=X.letter_vector)
    return rows.select("old_id", "new_id", F.col("place").cast("long").alias("place"), "kind", "item", "similarity", F.md5("old_text").alias("old_md5"), F.md5("new_text").alias("new_md5"))


def _suppress(spark, d):
    return D.suppressed(D.by_section(_turn_pairs(spark, d), _turn_sections(spark, d)))


def _diff_cache(spark, d):
    cached = S.diff_cache(D.by_section(_turn_pairs(spark, d), _turn_sections(spark, d)))
    return cached.select("key", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["kind"], i["item"], F.format_string("%.3f", i["similarity"]))), ",").alias("items"))


def _diff_cached(spark, d):
    """Read-through by old|new: pairs whose old document is even are taken as cached, the others are computed (here, how many new sections have an old one)."""
    pairs_ = _turn_pairs(spark, d).withColumn("key", F.concat_ws("|", "old_id", "new_id"))
    turns = table(spark, d, "conversations").select("conv_id", "role")

    def compute(p):
        news = p.join(turns.select(F.col("conv_id").alias("new_id"), "role"), "new_id")
        olds = turns.select(F.col("conv_id").alias("old_id"), "role").distinct()
        return news.join(olds, ["old_id", "role"]).groupBy("key").agg(F.count("*").alias("n")).withColumn("cached", F.lit(False))

    have = compute(pairs_.where("old_id % 2 = 0")).withColumn("cached", F.lit(True))
    return S.read_through(pairs_, have, compute, ["key"])


def _from_statements(spark, d):
    """Statement lines with vendors' labels: some only under the second label, some NaN."""
    st = statements(spark, d).select("entity", "period", *N.LABELS)
    label = F.coalesce(*[F.when((F.col("field") == f) & (F.col("entity") % len(ls) == i), ls[i]) for f, ls in N.LABELS.items() for i in range(len(ls))])
    lines = st.unpivot(["entity", "period"], list(N.LABELS), "field", "value").select("entity", label.alias("label"), F.make_date(F.col("period"), F.lit(12), F.lit(31)).alias("date"), F.when((F.col("field") == "cash") & (F.col("period") % 2 == 0), F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    rows = N.from_statements(lines)
    return rows.select("entity", "period", *[F.round(f, 6).alias(f) for f in N.LABELS])


_PAIR = "pr AS (SELECT doc_id AS old_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS new_id FROM documents QUALIFY new_id IS NOT NULL)"
_MATCH = rf"""{_PAIR}, un AS (SELECT doc_id, i - 1 AS pos, u[i] AS text FROM (SELECT doc_id, u, unnest(generate_series(1, len(u))) AS i FROM (SELECT doc_id, [x FOR x IN [regexp_replace(v, '^\s+|\s+$', '', 'g') FOR v IN string_split(text, chr(10))] IF length(x) > 40] AS u FROM documents))),
 ws AS (SELECT doc_id, pos, list_distinct([w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> '']) AS w FROM un),
 tm AS (SELECT doc_id, pos, len(w) AS n, unnest(w) AS term FROM ws),
 bo AS (SELECT old_id, new_id, o.pos AS old_pos, n.pos AS new_pos, count(*) / (any_value(o.n) + any_value(n.n) - count(*)) AS score FROM pr JOIN tm o ON o.doc_id = old_id JOIN tm n ON n.doc_id = new_id AND n.term = o.term GROUP BY ALL),
 be AS (SELECT old_id, new_id, new_pos, old_pos, score FROM bo QUALIFY row_number() OVER (PARTITION BY old_id, new_id, new_pos ORDER BY score DESC, old_pos) = 1),
 ma AS (SELECT pr.old_id, pr.new_id, un.pos AS new_pos, coalesce(be.old_pos, -1) AS old_pos, coalesce(be.score, 0) AS score FROM pr JOIN un ON un.doc_id = pr.new_id LEFT JOIN be ON be.old_id = pr.old_id AND be.new_id = pr.new_id AND be.new_pos = un.pos),
 ki AS (SELECT *, CASE WHEN score >= 0.9 THEN 'same' WHEN score < 0.3 THEN 'new' WHEN score < 0.65 THEN 'substantive' ELSE 'minor' END AS kind FROM ma),
 rm AS (SELECT pr.old_id, pr.new_id, un.pos AS old_pos FROM pr JOIN un ON un.doc_id = pr.old_id AND length(un.text) > 80 ANTI JOIN ma ON ma.old_id = pr.old_id AND ma.new_id = pr.new_id AND ma.old_pos = un.pos),
 df AS (SELECT old_id, new_id, kind, old_pos, new_pos, round(score, 3) AS similarity FROM ki WHERE kind <> 'same' UNION ALL SELECT old_id, new_id, 'removed', old_pos, -1, 0.0 FROM rm),
 top AS (SELECT *, row_number() OVER (PARTITION BY old_id, new_id ORDER BY CASE kind WHEN 'new' THEN 0 WHEN 'substantive' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, new_pos, old_pos) AS place FROM df QUALIFY place <= 40)"""


#: Conversations as documents of sections, compared section by section.
_SECTIONS = r"""cs AS (SELECT conv_id AS doc_id, turn AS pos, role AS item, replace(text, chr(10), chr(10) || chr(10)) AS text FROM conversations),
 spr AS (SELECT doc_id AS old_id, lead(doc_id) OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS new_id FROM (SELECT DISTINCT doc_id FROM cs) QUALIFY new_id IS NOT NULL),
 para AS (SELECT doc_id, pos, item, i - 1 AS k, p[i] AS text FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, pos, item, [x FOR x IN [regexp_replace(u, '^\s+|\s+$', '', 'g') FOR u IN regexp_split_to_array(text, '\n\s*\n')] IF length(x) > 80] AS p FROM cs))),
 lst AS (SELECT doc_id, item, max(pos) AS pos FROM cs GROUP BY ALL),
 met AS (SELECT old_id, new_id, n.item, n.pos AS new_sec, l.pos AS old_sec FROM spr JOIN cs n ON n.doc_id = new_id JOIN lst l ON l.doc_id = old_id AND l.item = n.item),
 wd AS (SELECT *, list_distinct([w FOR w IN regexp_split_to_array(lower(text), '\s+') IF w <> '']) AS w FROM para),
 sco AS (SELECT m.old_id, m.new_id, m.item, m.new_sec, n.k AS new_k, o.k AS old_k, len(list_intersect(o.w, n.w)) / greatest(len(o.w) + len(n.w) - len(list_intersect(o.w, n.w)), 1) AS score FROM met m JOIN wd n ON n.doc_id = new_id AND n.pos = new_sec JOIN wd o ON o.doc_id = old_id AND o.pos = old_sec),
 bst AS (SELECT * FROM sco WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY old_id, new_id, new_sec, new_k ORDER BY score DESC, old_k) = 1),
 mt AS (SELECT m.*, n.k AS new_k, n.text AS new_text, b.old_k, coalesce(b.score, 0) AS score FROM met m JOIN para n ON n.doc_id = m.new_id AND n.pos = m.new_sec LEFT JOIN bst b ON b.old_id = m.old_id AND b.new_id = m.new_id AND b.new_sec = m.new_sec AND b.new_k = n.k),
 sdr AS (SELECT old_id, new_id, 'removed' AS kind, o.item, 0.0::DOUBLE AS similarity, substr(o.text, 1, 600) AS old_text, '' AS new_text, 0 AS s0, o.pos AS s1, 0 AS s2, o.k AS s3 FROM spr JOIN para o ON o.doc_id = old_id WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.doc_id = new_id AND cs.item = o.item)
  UNION ALL SELECT old_id, new_id, 'new', n.item, 0.0, '', substr(n.text, 1, 600), 1, n.pos, 0, 0 FROM spr JOIN cs n ON n.doc_id = new_id WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.doc_id = old_id AND cs.item = n.item)
  UNION ALL SELECT mt.old_id, mt.new_id, CASE WHEN score < 0.3 THEN 'new' WHEN score < 0.65 THEN 'substantive' ELSE 'minor' END, mt.item, round(score, 3), coalesce(substr(o.text, 1, 600), ''), substr(new_text, 1, 600), 1, new_sec, 0, new_k FROM mt LEFT JOIN para o ON o.doc_id = mt.old_id AND o.pos = mt.old_sec AND o.k = mt.old_k WHERE score < 0.9
  UNION ALL SELECT m.old_id, m.new_id, 'removed', m.item, 0.0, substr(o.text, 1, 600), '', 1, m.new_sec, 1, o.k FROM met m JOIN para o ON o.doc_id = m.old_id AND o.pos = m.old_sec
   WHERE EXISTS (SELECT 1 FROM para n WHERE n.doc_id = m.new_id AND n.pos = m.new_sec) AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.old_id = m.old_id AND mt.new_id = m.new_id AND mt.new_sec = m.new_sec AND mt.old_k = o.k)),
 sdf AS (SELECT *, row_number() OVER (PARTITION BY old_id, new_id ORDER BY CASE kind WHEN 'new' THEN 0 WHEN 'substantive' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END, s0, s1, s2, s3) AS place FROM sdr QUALIFY place <= 40)"""
#: The same by vectors: an old section without paragraphs has an empty one, every paragraph has a best one, and few common words make it new.
_BY_VECTORS = (
    _SECTIONS.replace(" lst AS (", " opara AS (SELECT * FROM para UNION ALL SELECT doc_id, pos, item, 0, '' FROM cs WHERE NOT EXISTS (SELECT 1 FROM para p WHERE p.doc_id = cs.doc_id AND p.pos = cs.pos)),\n lst AS (")
    .replace("AS w FROM para)", f"AS w, {LETTERS_SQL.format('text')} AS v FROM opara)")
    .replace("AS score FROM met m JOIN wd n ON n.doc_id = new_id AND n.pos = new_sec JOIN", "AS overlap, round(list_dot_product(o.v, n.v), 9) AS score FROM met m JOIN wd n ON n.doc_id = new_id AND n.pos = new_sec AND n.text <> '' JOIN")
    .replace("FROM sco WHERE score > 0 QUALIFY", "FROM sco QUALIFY")
    .replace("b.old_k, coalesce(b.score, 0) AS score", "b.old_k, b.overlap, coalesce(b.score, 0) AS score")
    .replace("WHEN score < 0.3 THEN 'new' WHEN score < 0.65 THEN", "WHEN score < 0.45 OR overlap < 0.15 THEN 'new' WHEN score < 0.8 THEN")
    .replace("WHERE score < 0.9\n", "WHERE score < 0.97\n")
)
#: Sentiment of every document by two short word lists.
_SENT = r"""sent AS (SELECT doc_id, source, (len([w FOR w IN words IF w IN ('the', 'on', 'la', 'der', 'en')]) - len([w FOR w IN words IF w IN ('of', 'and', 'de', 'die', 'el')])) / greatest(len([w FOR w IN words IF w IN ('the', 'on', 'la', 'der', 'en', 'of', 'and', 'de', 'die', 'el')]), 1) AS score
 FROM (SELECT doc_id, source, regexp_extract_all(lower(array_to_string([s FOR s IN [regexp_replace(u, '^\s+|\s+$', '', 'g') FOR u IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))] IF length(s) > 20][:200], ' ')), '[a-z]+') AS words FROM documents))"""


def _accuracy(spark, d):
    """Accuracy of a length rule against the quality labels, by language and overall."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("right", ((F.length("text") > 200).cast("int") == F.col("quality")).cast("int"))
    out = rows.rollup("lang").agg(F.round(F.avg("right"), 6).alias("accuracy"), F.count("*").alias("n"))
    return out.select(F.coalesce("lang", F.lit("overall")).alias("signal"), "accuracy", "n", (F.col("accuracy") >= 0.85).alias("reached"))


def _risk_tol(spark, d):
    a, t = F.col("o_orderkey") % 13, F.col("o_custkey") % 17
    ok = F.abs(a - t) <= F.greatest(F.lit(1), F.bround(0.2 * t))
    return table(spark, d, "orders").select("o_orderkey", ok.alias("within"))


def _contains_all(spark, d):
    want = F.array("o_orderstatus", F.substring("o_orderpriority", 1, 3), F.lit("1"))
    have = F.concat_ws(" ", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.forall(want, lambda w: F.contains(have, w)).alias("all_found"))


def _sign(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.signum("c_acctbal") == F.signum((F.col("c_custkey") % 3 - 1).cast("double"))).alias("same_sign"))


def _upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("version"), F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("payload"), F.col("o_orderkey").alias("seq"))
    old, new = o.where("seq % 2 = 0"), o.where("seq % 2 = 1")
    return S.upsert(S.latest(old, ["id", "version"], ["seq"]), S.latest(new, ["id", "version"], ["seq"]), ["id", "version"])


def _difference(spark, d):
    have = table(spark, d, "labels").select("doc_id")
    return S.missing(table(spark, d, "documents").select("doc_id"), have, ["doc_id"])


def _histogram(spark, d):
    docs = table(spark, d, "documents")
    by = lambda c: docs.groupBy(F.lit(c).alias("by"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return by("lang").unionByName(by("source"))


def _cik(spark, d):
    """Case-insensitive lookup of names, as tickers are looked up."""
    want = table(spark, d, "customer").select("c_custkey", F.lower(F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"))).alias("ticker"))
    have = table(spark, d, "nation").select(F.upper(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"))).alias("name"), F.col("n_nationkey").alias("cik"))
    return want.join(have, F.upper("ticker") == F.col("name")).select("c_custkey", "cik")


QUERIES = {
    "fun_ratios": _ratios, "fun_growth": _growth, "fun_flags": _flags, "fun_verdict": _verdict, "fun_trend": _trend, "fun_growth_trend": _growth_trend, "fun_ratio_matrix": _matrix, "fun_format": _formatted,
    "xbr_latest_filed": _latest_filed, "xbr_tag_priority": _tag_priority, "ret_forward": _forward, "ret_calendar": _calendar, "ret_enrich": _enrich, "ret_pooled": _pooled, "ret_ols_control": _control, "ret_grouped": _grouped,
    "ret_verdict": _ret_verdict, "ret_group_counts": _group_counts, "dif_pairs": _pairs, "dif_prev": _prev, "dif_best_match": _best, "dif_classify": _classify, "dif_removed": _removed, "dif_top40": _top40,
    "dif_change_count": _changes, "evl_accuracy": _accuracy, "evl_risk_tol": _risk_tol, "evl_contains_all": _contains_all, "evl_sign": _sign, "sink_upsert_latest": _upsert, "sink_set_difference": _difference,
    "src_histogram": _histogram, "src_cik": _cik, "dif_document": _document, "dif_by_vectors": _by_vectors, "dif_suppress": _suppress, "sink_diff_cache": _diff_cache, "dif_cached": _diff_cached, "ret_rows": _ret_rows,
    "sink_returns_cache": _returns_cache, "src_statements": _from_statements,
}

_LONG = "lo AS (UNPIVOT (SELECT entity, period, " + ", ".join(N.RATIOS) + " FROM rt) ON " + ", ".join(N.RATIOS) + " INTO NAME metric VALUE value)"
# years of the tables: a view of DuckDB has its columns fixed
_YEARS = range(1995, 2002)
_LONG_NULLS = "lo AS (" + " UNION ALL ".join(f"SELECT entity, period, '{r}' AS metric, {r} AS value FROM rt" for r in N.RATIOS) + ")"
_GLONG = "lo AS (UNPIVOT (SELECT entity, period, " + ", ".join(f"{g}_growth" for g in N.GROWTH) + " FROM gr) ON " + ", ".join(f"{g}_growth" for g in N.GROWTH) + " INTO NAME metric VALUE value)"


def _trend_sql(short: str, tolerance: float) -> str:
    move = "arg_max(value, period) - arg_min(value, period)"
    return f"SELECT entity, metric, CASE WHEN count(*) < 2 THEN '{short}' WHEN {move} > {tolerance} THEN 'improving' WHEN {move} < -{tolerance} THEN 'declining' ELSE 'stable' END AS trend FROM lo GROUP BY ALL"


_FLAGS = f"""{_GR}, la AS (SELECT *, lag(revenue_growth) OVER w AS g1, lag(operating_margin) OVER w AS m1, lag(operating_margin, 2) OVER w AS m2 FROM gr WINDOW w AS (PARTITION BY entity ORDER BY period) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) = 1),
 fl AS (SELECT entity, CASE WHEN current_ratio < 1 THEN 'red' WHEN current_ratio < 1.2 THEN 'amber' ELSE 'green' END AS severity, 'current_ratio' AS metric, CASE WHEN current_ratio < 1 THEN 'current_ratio < 1.0' WHEN current_ratio < 1.2 THEN '1.0 <= current_ratio < 1.2' ELSE 'current_ratio >= 1.2' END AS rule FROM la WHERE current_ratio IS NOT NULL
 UNION ALL SELECT entity, CASE WHEN debt_to_equity > 2 THEN 'red' WHEN debt_to_equity > 1 THEN 'amber' ELSE 'green' END, 'debt_to_equity', CASE WHEN debt_to_equity > 2 THEN 'debt_to_equity > 2.0' WHEN debt_to_equity > 1 THEN '1.0 < debt_to_equity <= 2.0' ELSE 'debt_to_equity <= 1.0' END FROM la WHERE debt_to_equity IS NOT NULL
 UNION ALL SELECT entity, CASE WHEN interest_coverage < 1.5 THEN 'red' ELSE 'amber' END, 'interest_coverage', 'interest_coverage < 3.0' FROM la WHERE interest_coverage < 3
 UNION ALL SELECT entity, CASE WHEN fcf < 0 THEN 'red' ELSE 'green' END, 'fcf', CASE WHEN fcf < 0 THEN 'fcf < 0' ELSE 'fcf >= 0' END FROM la WHERE fcf IS NOT NULL
 UNION ALL SELECT entity, 'amber', 'earnings_quality', 'ocf < 0.5 * net_income while net_income > 0' FROM la WHERE net_income > 0 AND operating_cash_flow < 0.5 * net_income
 UNION ALL SELECT entity, 'red', 'revenue_trend', 'revenue YoY < 0 twice in a row' FROM la WHERE revenue_growth < 0 AND g1 < 0
 UNION ALL SELECT entity, 'amber', 'margin_trend', 'operating_margin strictly decreasing over 3 periods' FROM la WHERE m2 > m1 AND m1 > operating_margin)"""
_TAGLIST = [t for ts in N.TAGS.values() for t in ts]
_FACTS = f"""fa AS (SELECT c_nationkey AS entity, ([{', '.join(f"'{t}'" for t in _TAGLIST)}])[o_orderkey % {len(_TAGLIST)} + 1] AS tag, year(o_orderdate) AS fy, o_totalprice AS val, o_orderdate::DATE AS filed, o_orderkey AS pos
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0)"""
_FIELDS = "fi(tag, field, priority) AS (VALUES " + ", ".join(f"('{t}', '{f}', {i})" for f, ts in N.TAGS.items() for i, t in enumerate(ts)) + ")"


def _ols_sql(by: str, rows: str) -> str:
    return f"""m AS (SELECT {by}, regr_slope(ret, signal) AS coef, regr_intercept(ret, signal) AS intercept, regr_r2(ret, signal) AS r2, count(*) AS n, regr_sxx(ret, signal) AS xx, regr_syy(ret, signal) AS yy, regr_sxy(ret, signal) AS xy FROM {rows} GROUP BY ALL),
 e AS (SELECT {', '.join('r.' + b.strip() for b in by.split(','))}, avg(abs(ret - intercept - coef * signal)) AS mae FROM {rows} r JOIN m USING ({by}) GROUP BY ALL)
 SELECT {by}, n, round(coef, 6) AS coef, round(intercept, 6) AS intercept, round(coef / sqrt((yy - coef * xy) / greatest(n - 2, 1) / xx), 6) AS t_stat, round(r2, 6) AS r2, round(sqrt((yy - coef * xy) / n), 6) AS rmse, round(mae, 6) AS mae FROM m JOIN e USING ({by})"""


ORACLE = {
    "fun_ratios": f"WITH {_RT} SELECT entity, period, " + ", ".join(f"round({r}, 6) AS {r}" for r in N.RATIOS) + " FROM rt",
    "fun_growth": f"WITH {_GR} SELECT entity, period, " + ", ".join(f"round({g}_growth, 6) AS {g}" for g in N.GROWTH) + " FROM gr",
    "fun_flags": f"WITH {_FLAGS} SELECT * FROM fl",
    "fun_verdict": f"WITH {_FLAGS} SELECT entity, count(*) FILTER (severity = 'red') AS reds, CASE WHEN count(*) FILTER (severity = 'red') >= 2 THEN 'weak' WHEN count(*) FILTER (severity = 'red') = 1 THEN 'moderate' ELSE 'strong' END AS verdict FROM fl GROUP BY entity",
    "fun_trend": f"WITH {_RT}, {_LONG} {_trend_sql('—', 0.0)}",
    "fun_growth_trend": f"WITH {_GR}, {_GLONG} {_trend_sql('stable', 0.01)}",
    "fun_ratio_matrix": f"WITH {_RT}, {_LONG} SELECT entity, metric, " + ", ".join(f"round(max(value) FILTER (period = {y}), 6) AS y{y}" for y in _YEARS) + " FROM lo GROUP BY entity, metric",
    "fun_format": f"WITH {_RT}, {_LONG_NULLS} SELECT entity, period, metric, CASE WHEN value IS NULL THEN '—' WHEN regexp_matches(metric, 'margin$|^ro[ea]$') THEN printf('%.1f%%', value * 100) WHEN metric = 'fcf' THEN format('{{:,}}', round_even(value, 0)::BIGINT) ELSE printf('%.2f', value) END AS shown FROM lo",
    "src_statements": f"WITH {_ST} SELECT entity, period::VARCHAR AS period, " + ", ".join(f"round({f if f != 'cash' else 'CASE WHEN period % 2 = 1 THEN cash END'}, 6) AS {f}" for f in N.LABELS) + " FROM st QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) <= 4",
    "ret_ols_control": f"""WITH {_MK}, g AS (SELECT *, avg(signal) OVER w AS mx, avg(ret) OVER w AS my, avg(mkt) OVER w AS mz FROM en WHERE mkt IS NOT NULL WINDOW w AS (PARTITION BY "window")),
 s AS (SELECT "window", count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum((signal - mx) ** 2) AS xx, sum((signal - mx) * (ret - my)) AS xy, sum((ret - my) ** 2) AS yy, sum((mkt - mz) ** 2) AS zz, sum((signal - mx) * (mkt - mz)) AS xz, sum((mkt - mz) * (ret - my)) AS zy FROM g GROUP BY "window"),
 b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS coef, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS gamma FROM s),
 c AS (SELECT *, my - coef * mx - gamma * mz AS intercept, yy - coef * xy - gamma * zy AS ssr FROM b),
 e AS (SELECT g."window", avg(abs(ret - intercept - coef * signal - gamma * mkt)) AS mae FROM g JOIN c ON c."window" = g."window" GROUP BY ALL)
 SELECT c."window", n, round(coef, 6) AS coef, round(intercept, 6) AS intercept, round(coef / sqrt(ssr / (n - 3) * zz / (xx * zz - xz * xz)), 6) AS t_stat, round(1 - ssr / yy, 6) AS r2, round(sqrt(ssr / n), 6) AS rmse, round(mae, 6) AS mae FROM c JOIN e ON e."window" = c."window\"""",
    "ret_verdict": f"""WITH {_MK}, eg AS (SELECT *, {_GROUP} AS "group" FROM en), q AS (SELECT "group", "window", regr_slope(ret, signal) AS coef, regr_r2(ret, signal) AS r2, count(*) AS n, regr_sxx(ret, signal) AS xx, regr_syy(ret, signal) AS yy, regr_sxy(ret, signal) AS xy FROM eg GROUP BY ALL),
 t AS (SELECT *, coef / sqrt((yy - coef * xy) / greatest(n - 2, 1) / xx) AS t FROM q)
 SELECT "group", "window", CASE WHEN abs(t) >= 2 THEN CASE WHEN coef > 0 THEN 'positive' ELSE 'negative' END ELSE 'inconclusive' END AS verdict, printf('%dd: n=%d coef=%.4f t=%.2f R2=%.3f', "window", n, coef, t, r2) AS summary FROM t""",
    "ret_rows": f"""WITH {_MATCH}, {_SENT}, c AS (SELECT new_id, count(*) FILTER (kind <> 'minor') AS changes FROM top GROUP BY new_id)
 SELECT doc_id, source AS ticker, (DATE '2024-01-01' + (doc_id % 25)::INT)::VARCHAR AS date, (['10-K', '10-Q', 'TRANSCRIPT', '8-K'])[doc_id % 4 + 1] AS form, round(score, 6) AS signal, CASE WHEN doc_id % 4 <> 2 THEN changes END AS disclosure_change FROM sent LEFT JOIN c ON c.new_id = doc_id""",
    "dif_document": f"WITH {_SECTIONS} SELECT old_id, new_id, place, kind, item, similarity, md5(old_text) AS old_md5, md5(new_text) AS new_md5 FROM sdf",
    "dif_by_vectors": f"WITH {_BY_VECTORS} SELECT old_id, new_id, place, kind, item, similarity, md5(old_text) AS old_md5, md5(new_text) AS new_md5 FROM sdf",
    "dif_suppress": f"WITH {_SECTIONS} SELECT old_id, new_id, count(*) FILTER (kind <> 'minor') AS shown, count(*) FILTER (kind = 'minor') AS suppressed FROM sdf GROUP BY ALL",
    "sink_diff_cache": f"WITH {_SECTIONS} SELECT old_id || '|' || new_id AS key, string_agg(kind || ':' || item || ':' || printf('%.3f', similarity), ',' ORDER BY place) AS items FROM sdf GROUP BY old_id, new_id",
    "dif_cached": f"WITH {_SECTIONS} SELECT old_id || '|' || new_id AS key, count(*) AS n, old_id % 2 = 0 AS cached FROM met GROUP BY old_id, new_id",
    "xbr_latest_filed": f"""WITH {_FACTS}, {_FIELDS}, ch AS (SELECT * FROM (SELECT *, min(priority) OVER (PARTITION BY entity, field) AS least FROM fa JOIN fi USING (tag)) WHERE priority = least),
 nw AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY entity, field, fy ORDER BY filed DESC, pos) = 1),
 wi AS (SELECT entity, fy, {', '.join(f"max(val) FILTER (field = '{f}') AS {f}" for f in N.TAGS)} FROM nw GROUP BY ALL)
 SELECT entity, 'FY' || fy AS period, {', '.join(N.TAGS)} FROM wi QUALIFY row_number() OVER (PARTITION BY entity ORDER BY fy DESC) <= 4""",
    "xbr_tag_priority": f"WITH {_FACTS} SELECT entity, " + ", ".join("coalesce(" + ", ".join(f"max(tag) FILTER (tag = '{t}')" for t in ts) + f") AS {f}" for f, ts in N.TAGS.items()) + " FROM fa GROUP BY entity",
    "ret_forward": f'WITH {_MK} SELECT ticker, date::VARCHAR AS date, user_id, "window", round(ret, 6) AS ret FROM en',
    "ret_calendar": """WITH px AS (SELECT event_type AS ticker, ts::DATE AS date, avg(value) AS close FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL HAVING avg(value) IS NOT NULL),
 fw AS (SELECT *, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 20) OVER w / close - 1 AS r20 FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)),
 ev AS (SELECT DISTINCT event_type AS ticker, ts::DATE AS date, user_id FROM events),
 met AS (SELECT ev.*, r5, r20 FROM ev ASOF JOIN fw ON ev.ticker = fw.ticker AND ev.date < fw.date)
SELECT ticker, date::VARCHAR AS date, user_id, 5 AS "window", round(r5, 6) AS ret FROM met WHERE r5 IS NOT NULL UNION ALL SELECT ticker, date::VARCHAR, user_id, 20, round(r20, 6) FROM met WHERE r20 IS NOT NULL""",
    "ret_enrich": f'WITH {_MK} SELECT ticker, date::VARCHAR AS date, user_id, "window", round(ret, 6) AS ret, round(mkt, 6) AS mkt FROM en',
    "ret_pooled": f'WITH {_MK}, {_ols_sql(chr(34) + "window" + chr(34), "en")}',
    "ret_grouped": f'WITH {_MK}, eg AS (SELECT *, {_GROUP} AS "group" FROM en), ' + _ols_sql('"group", "window"', "eg"),
    "ret_group_counts": f'WITH {_MK} SELECT {_GROUP} AS "group", count(*) AS n FROM ev GROUP BY ALL',
    "dif_pairs": f"WITH {_PAIR} SELECT * FROM pr",
    "dif_prev": "SELECT doc_id, lag(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS prev_id FROM documents",
    "dif_best_match": f"WITH {_MATCH} SELECT old_id, new_id, new_pos, old_pos, round(score, 6) AS score FROM ma",
    "dif_classify": f"WITH {_MATCH} SELECT old_id, new_id, kind, count(*) AS n FROM ki GROUP BY ALL",
    "dif_removed": f"WITH {_MATCH} SELECT * FROM rm",
    "dif_top40": f"WITH {_MATCH} SELECT old_id, new_id, place, kind, old_pos, new_pos, similarity FROM top",
    "dif_change_count": f"WITH {_MATCH} SELECT d.doc_id, c.changes FROM documents d LEFT JOIN (SELECT new_id, count(*) FILTER (kind <> 'minor') AS changes FROM top GROUP BY new_id) c ON c.new_id = d.doc_id",
    "evl_accuracy": "SELECT coalesce(lang, 'overall') AS signal, round(avg(((length(text) > 200)::INT = quality)::INT), 6) AS accuracy, count(*) AS n, accuracy >= 0.85 AS reached FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)",
    "evl_risk_tol": "SELECT o_orderkey, abs(o_orderkey % 13 - o_custkey % 17) <= greatest(1, round_even(0.2 * (o_custkey % 17), 0)) AS within FROM orders",
    "evl_contains_all": "SELECT o_orderkey, contains(h, o_orderstatus) AND contains(h, substr(o_orderpriority, 1, 3)) AND contains(h, '1') AS all_found FROM (SELECT *, o_orderstatus || ' ' || o_orderpriority || ' ' || o_orderkey AS h FROM orders)",
    "evl_sign": "SELECT c_custkey, sign(c_acctbal) = sign(c_custkey % 3 - 1) AS same_sign FROM customer",
    "sink_upsert_latest": """WITH o AS (SELECT o_custkey AS id, o_orderkey % 3 AS version, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload, o_orderkey AS seq FROM orders)
 SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY seq % 2 DESC, seq DESC) = 1""",
    "sink_set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "src_histogram": "SELECT 'lang' AS by, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source",
    "src_cik": "SELECT c_custkey, n_nationkey AS cik FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
