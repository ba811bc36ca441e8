"""Retrieval queries over documents, benchmark passages and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as X
from quarry.operators import answering as A
from quarry.operators import retrieval as R
from quarry.plans.bind import indexed, table, vector_indexed

_TOK = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-]+')"


def _tokenize(spark, d):
    words = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def _idf(spark, d):
    docs = table(spark, d, "documents")
    return R.idf_table(R.postings(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def _ranks(df, key="doc_id", query="item_id"):
    return df.select(query, key, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _bm25(spark, d):
    return _ranks(indexed(spark, d).lexical.bm25(table(spark, d, "benchmark"), 5))


def _bm25_filtered(spark, d):
    return _ranks(indexed(spark, d).lexical.bm25(table(spark, d, "benchmark"), 5, keep=F.col("lang") == "en"))


def _tfidf(spark, d):
    return _ranks(indexed(spark, d).tfidf.cosine(table(spark, d, "benchmark"), 5))


def _rrf(spark, d):
    return _ranks(indexed(spark, d).search(table(spark, d, "benchmark"), 5))


def _hit(spark, d):
    """Whether one of the five best documents holds the passage: only those documents' texts are read back, by id."""
    docs, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    top = indexed(spark, d).lexical.bm25(queries, 5).select("item_id", "doc_id").join(queries, "item_id")
    passages = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    top = F.broadcast(top) if 5 * passages <= R.SENT_BYTES else top
    hits = docs.select("doc_id", F.col("text").alias("doc")).join(top, "doc_id").groupBy("item_id").agg(F.max(F.contains(F.col("doc"), F.col("text"))).alias("hit"))
    return queries.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def _answer(spark, d):
    """Extractive answers to the benchmark's passages as questions."""
    index = indexed(spark, d)
    got = A.answer(index, table(spark, d, "benchmark"))
    sources = F.array_join(F.transform("sources", lambda s: s["key"].cast("string")), ",")
    return got.select("item_id", F.md5("answer").alias("answer_md5"), sources.alias("sources"), "backend", F.lit(index.name).alias("index_name"))


def _rerank(spark, d):
    """A scorer's logits (here of the passage's length) as probabilities; ties keep the order."""
    docs, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = indexed(spark, d).lexical.bm25(queries, 10).join(docs.select("doc_id", "text"), "doc_id").join(queries.select("item_id", F.col("text").alias("question")), "item_id")
    best = A.rerank(hits, lambda question, text: (F.length(text) % 7 - 3).cast("double"))
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _lookup(spark, d):
    docs = table(spark, d, "documents")
    hits = indexed(spark, d).lexical.bm25(table(spark, d, "benchmark"), 5).select("item_id", "doc_id", "rank")
    return A.lookup(hits, docs.select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"))).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), "lang", "source", "n_chars")


def _linkify(spark, d):
    c = table(spark, d, "conversations")
    said = F.concat(F.lit("See [1], ["), (F.col("turn") % 4).cast("string"), F.lit("] and [9]."))
    return c.select("conv_id", "turn", X.linkify(said, F.array(F.lit("https://a.example/1"), F.lit("https://a.example/2"))).alias("linked"))


def _dense(spark, d):
    v = table(spark, d, "embeddings")
    return _ranks(R.dense(v, v.where("vec_id % 100 = 0"), 5), "vec_id", "query_id")


def _ann(spark, d):
    """The same by the approximate index; tests hold its recall against the exact search."""
    return _ranks(vector_indexed(spark, d).search(table(spark, d, "embeddings").where("vec_id % 100 = 0"), 5), "vec_id", "query_id")


def _dense_label(spark, d):
    v = table(spark, d, "embeddings")
    return _ranks(R.dense(v, v.where("vec_id % 100 = 0"), 5, same="label"), "vec_id", "query_id")


def _jaccard(spark, d):
    """Each document against the next of its source and language: only ids go through the window, word sets meet by id."""
    docs = table(spark, d, "documents")
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    pairs = docs.select("doc_id", F.lead("doc_id").over(w).alias("next_id")).where("next_id is not null")
    words = docs.select("doc_id", X.token_set(F.col("text")).alias("words"))
    pairs = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("next_id"), F.col("words").alias("next_words")), "next_id")
    return pairs.select("doc_id", "next_id", F.round(X.jaccard(F.col("words"), F.col("next_words")), 6).alias("jaccard"))


def _dedupe(spark, d):
    """Greedy near-duplicate removal in the ranked pool of each passage."""
    docs = table(spark, d, "documents")
    pool = indexed(spark, d).lexical.bm25(table(spark, d, "benchmark"), 25)
    pool = pool.join(docs.select("doc_id", X.token_set(F.col("text")).alias("words")), "doc_id")
    hits = pool.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").alias("key"), "words"))).alias("hits"))
    ordered = F.transform("hits", lambda h: F.struct(h["key"].alias("key"), h["words"].alias("words")))
    kept = hits.select("item_id", F.size("hits").cast("long").alias("pool"), R.dedupe(ordered).alias("kept"))
    return kept.select("item_id", "pool", F.size("kept").cast("long").alias("n_kept"), F.array_join(F.transform("kept", lambda x: x["key"].cast("string")), ",").alias("kept"))


def _snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def _context(spark, d):
    """Numbered context block of each conversation's turns."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    block = F.transform("t", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), x["role"], F.lit(")\n"), x["text"]))
    return turns.select("conv_id", F.md5(F.array_join(block, "\n\n")).alias("context_md5"), F.size("t").cast("long").alias("n"))


def _prune(spark, d):
    """Citations renumbered in an answer made from each conversation."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    answer = F.concat(F.lit("One [3, 1]. Two ["), (F.col("conv_id") % 7).cast("string"), F.lit("] and [99]."))
    text, kept = X.prune_citations(answer, F.transform("t", lambda x: x["turn"].cast("string")))
    return c.select("conv_id", text.alias("answer"), F.array_join(kept, ",").alias("sources"))


QUERIES = {
    "ir_tokenize_counts": _tokenize, "ir_idf": _idf, "ir_bm25_top5": _bm25, "ir_bm25_filtered": _bm25_filtered, "ir_tfidf_top5": _tfidf, "ir_rrf_top5": _rrf,
    "ir_hit_at_5": _hit, "ir_dense_top5": _dense, "ir_ann_top5": _ann, "ir_dense_label_filter": _dense_label, "ir_jaccard_pairs": _jaccard, "ir_dedupe_pools": _dedupe,
    "ir_snippet": _snippet, "txt_context": _context, "ir_prune_cites": _prune, "ir_answer": _answer, "ir_rerank": _rerank, "ir_lookup": _lookup, "ui_linkify": _linkify,
}


def _bm25_sql(k: int, keep: str = "true", name: str = "bm25") -> str:
    return f"""
 {name}_p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL),
 {name}_l AS (SELECT doc_id, len({_TOK}) AS len, {keep} AS keep FROM documents),
 {name}_a AS (SELECT count(*) AS n, avg(len) AS avg_len FROM {name}_l),
 {name}_i AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM {name}_p, {name}_a GROUP BY term),
 {name}_q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
 {name}_s AS (SELECT item_id, doc_id, sum(q * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg_len))) AS score
   FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_i USING (term) JOIN {name}_l USING (doc_id), {name}_a WHERE keep GROUP BY ALL),
 {name} AS (SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


_STOPS = ", ".join(f"'{w}'" for w in R.STOP)


def _grams_sql(table_: str, key: str) -> str:
    return f"""SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) AS term FROM (
      SELECT {key}, [x FOR x IN regexp_extract_all(lower(text), '{R.GRAM_WORD}') IF x NOT IN ({_STOPS})] AS w FROM {table_})) GROUP BY ALL"""


def _tfidf_sql(k: int) -> str:
    return f"""
 tp AS ({_grams_sql("documents", "doc_id")}),
 tw AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tp GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {R.FEATURES}),
 td AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tp JOIN tw USING (term)),
 tn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM td GROUP BY 1),
 tq AS (SELECT item_id, term, (1 + ln(tf)) * idf AS qw FROM ({_grams_sql("benchmark", "item_id")}) JOIN tw USING (term)),
 tm AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM tq GROUP BY 1),
 tz AS (SELECT item_id, doc_id, dot / (norm * qnorm) AS score FROM (SELECT item_id, doc_id, sum(qw * w) AS dot FROM tq JOIN td USING (term) GROUP BY ALL) JOIN tn USING (doc_id) JOIN tm USING (item_id)),
 ts AS (SELECT item_id, doc_id, coalesce(tz.score, 0) AS score FROM (SELECT item_id, doc_id FROM (SELECT item_id FROM benchmark), (SELECT doc_id FROM documents)) LEFT JOIN tz USING (item_id, doc_id)),
 tfidf AS (SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ts) WHERE rank <= {k})"""


def _dense_sql(also: str) -> str:
    return f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id {also} WHERE q.vec_id % 100 = 0)) WHERE rank <= 5"""


def _rrf_sql(k: int) -> str:
    pool = max(2 * k, 10)
    return f"""{_bm25_sql(pool)}, {_tfidf_sql(pool)},
 rf AS (SELECT item_id, doc_id, coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + t.rank), 0) AS score, b.rank AS r1, t.rank AS r2 FROM bm25 b FULL JOIN tfidf t USING (item_id, doc_id)),
 rrf AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS rank FROM rf QUALIFY rank <= {k})"""


def _greedy_sql(pool: str, k: int) -> str:
    """kept: of each question's ranked pool the ranks that are unlike all kept before, k at most."""
    jaccard = "len(list_intersect(a.w, b.w)) / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1)"
    return f"""
 pw AS (SELECT item_id, doc_id, rank, {_SET} AS w FROM {pool} JOIN documents USING (doc_id)),
 nr AS (SELECT b.item_id, b.rank, coalesce(list(a.rank) FILTER (CASE WHEN len(a.w) > 0 AND least(len(a.w), len(b.w)) > 0.85 * greatest(len(a.w), len(b.w)) THEN {jaccard} > 0.85 ELSE false END), []) AS near FROM pw b LEFT JOIN pw a ON a.item_id = b.item_id AND a.rank < b.rank GROUP BY ALL),
 gr AS (SELECT item_id, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM (SELECT DISTINCT item_id FROM pw)
   UNION ALL SELECT gr.item_id, nr.rank, CASE WHEN len(kept) >= {k} OR list_has_any(kept, near) THEN kept ELSE kept || [nr.rank] END FROM gr JOIN nr ON nr.item_id = gr.item_id AND nr.rank = gr.rank + 1),
 kept AS (SELECT item_id, max(rank) AS pool, arg_max(kept, rank) AS kept FROM gr GROUP BY item_id)"""


_SET = "list_distinct([w FOR w IN regexp_split_to_array(lower(text), '\\s+') IF w <> ''])"
ORACLE = {
    "ir_tokenize_counts": f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, len(list_distinct({_TOK}))::BIGINT AS n_distinct FROM documents",
    "ir_idf": f"WITH {_bm25_sql(5).split('bm25_l AS')[0].rstrip().rstrip(',')} SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM bm25_p GROUP BY term",
    "ir_bm25_top5": f"WITH {_bm25_sql(5)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM bm25",
    "ir_bm25_filtered": f"""WITH {_bm25_sql(5, "lang = 'en'")} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM bm25""",
    "ir_tfidf_top5": f"WITH {_tfidf_sql(5)} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM tfidf",
    "ir_rrf_top5": f"""WITH {_bm25_sql(10)}, {_tfidf_sql(10)},
 f AS (SELECT item_id, doc_id, coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + t.rank), 0) AS score, b.rank AS r1, t.rank AS r2 FROM bm25 b FULL JOIN tfidf t USING (item_id, doc_id))
 SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 5""",
    "ir_hit_at_5": f"""WITH {_bm25_sql(5)} SELECT b.item_id, coalesce(bool_or(contains(d.text, b.text)), false) AS hit
 FROM benchmark b LEFT JOIN bm25 USING (item_id) LEFT JOIN documents d USING (doc_id) GROUP BY b.item_id""",
    "ir_dense_top5": _dense_sql(""),
    "ir_dense_label_filter": _dense_sql("AND q.label = v.label"),
    "ir_jaccard_pairs": f"""SELECT doc_id, next_id, round(CASE WHEN len(w) > 0 AND len(n) > 0 THEN len(list_intersect(w, n)) / (len(w) + len(n) - len(list_intersect(w, n))) ELSE 0 END, 6) AS jaccard
 FROM (SELECT doc_id, lead(doc_id) OVER g AS next_id, w, lead(w) OVER g AS n FROM (SELECT doc_id, source, lang, {_SET} AS w FROM documents) WINDOW g AS (PARTITION BY source, lang ORDER BY doc_id)) WHERE next_id IS NOT NULL""",
    "ir_snippet": "SELECT doc_id, regexp_replace(substr(text, 1, 350), ' [^ ]*$', '') || '…' AS snippet FROM documents",
    "ir_dedupe_pools": f"""WITH RECURSIVE {_bm25_sql(25)}, {_greedy_sql("bm25", 1 << 30)}
 SELECT item_id, pool, len(kept) AS n_kept, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM pw WHERE pw.item_id = kept.item_id AND list_contains(kept.kept, pw.rank)) AS kept FROM kept""",
    "ir_answer": f"""WITH RECURSIVE {_rrf_sql(25)}, {_greedy_sql("rrf", 5)},
 us AS (SELECT kept.item_id, list_position(kept, rank) AS i, doc_id, regexp_replace(substr(text, 1, 350), ' [^ ]*$', '') || '…' AS snippet FROM kept JOIN pw ON pw.item_id = kept.item_id AND list_contains(kept, rank) JOIN documents USING (doc_id)),
 an AS (SELECT item_id, string_agg('[' || i || '] ' || snippet, chr(10) || chr(10) ORDER BY i) AS body, string_agg(doc_id::VARCHAR, ',' ORDER BY i) AS sources FROM us GROUP BY item_id)
 SELECT item_id, md5(CASE WHEN body IS NULL THEN '{A.NOTHING}' ELSE '{A.EXTRACTIVE.strip()}' || chr(10) || chr(10) || chr(10) || body END) AS answer_md5, coalesce(sources, '') AS sources,
   CASE WHEN body IS NULL THEN 'none' ELSE 'extractive' END AS backend, 'tfidf' AS index_name FROM benchmark LEFT JOIN an USING (item_id)""",
    "ir_rerank": f"""WITH {_bm25_sql(10)}, lo AS (SELECT item_id, doc_id, rank, 1 / (1 + exp(-(length(text) % 7 - 3)::DOUBLE)) AS p FROM bm25 JOIN documents USING (doc_id))
 SELECT item_id, doc_id, round(p, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, rank) AS rank FROM lo""",
    "ir_lookup": f"WITH {_bm25_sql(5)} SELECT item_id, doc_id, rank, lang, source, length(text) AS n_chars FROM bm25 JOIN documents USING (doc_id)",
    "ui_linkify": """SELECT conv_id, turn, 'See [[1]](https://a.example/1), ' || CASE turn % 4 WHEN 1 THEN '[[1]](https://a.example/1)' WHEN 2 THEN '[[2]](https://a.example/2)' ELSE '[' || turn % 4 || ']' END || ' and [9].' AS linked FROM conversations""",
    "ir_prune_cites": """WITH c AS (SELECT conv_id, count(*) AS n, list(turn ORDER BY turn, role) AS t, conv_id % 7 AS g FROM conversations GROUP BY conv_id),
 v AS (SELECT *, list_sort(list_distinct([x FOR x IN [3, 1, g, 99] IF x BETWEEN 1 AND n])) AS cited FROM c),
 m AS (SELECT *, [list_position(cited, x)::VARCHAR FOR x IN [3, 1] IF list_contains(cited, x)] AS one FROM v)
 SELECT conv_id, 'One [' || array_to_string(one, ', ') || ']. Two [' || CASE WHEN list_contains(cited, g) THEN list_position(cited, g) ELSE g END || '] and [99].' AS answer,
   array_to_string([t[x]::VARCHAR FOR x IN cited], ',') AS sources FROM m""",
    "txt_context": """SELECT conv_id, md5(string_agg('[' || n || '] (' || role || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text)) AS context_md5, count(*) AS n
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id""",
}
