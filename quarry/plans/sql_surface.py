"""The library from SQL: scalar and table functions with SQL bodies, and views of what needs whole documents.

`register` makes the functions known to a session, no Python runs for them. `publish` adds views over a table of documents: its sections, turns
and chunks, which are planned like any other view, so a query's filters and columns reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import segment as S


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + pattern.replace("'", "''") + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Name -> (parameters, result, body).
SCALAR = {
    "doc_tokens": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {_quoted(X.TOKEN)}, 0)"),
    "doc_token_set": ("t STRING", "ARRAY<STRING>", "array_distinct(filter(split(lower(t), r'\\s+'), w -> w <> ''))"),
    "token_jaccard": (
        "a STRING, b STRING",
        "DOUBLE",
        "coalesce(size(array_intersect(doc_token_set(a), doc_token_set(b))) / nullif(size(array_union(doc_token_set(a), doc_token_set(b))), 0), 0.0)",
    ),
    "doc_sentences": ("t STRING", "ARRAY<STRING>", f"split(t, {_quoted(X.SENTENCE_BREAK)})"),
    "doc_snippet": ("t STRING", "STRING", "regexp_replace(substring(t, 1, 350), ' [^ ]*$', '') || '…'"),
    "revenue_guidance": ("t STRING", "ARRAY<STRING>", f"slice(array_distinct(transform(regexp_extract_all(t, {_quoted(X.REVENUE_GUIDANCE)}, 1), g -> regexp_replace(g, r'^\\s+|\\s+$', ''))), 1, 5)"),
}
#: Name -> (parameters, columns, body).
TABLES = {
    "doc_paragraphs": ("t STRING, least INT", "pos INT, text STRING", "SELECT pos, text FROM (SELECT posexplode(filter(transform(split(t, r'\\n\\s*\\n'), p -> regexp_replace(p, r'^\\s+|\\s+$', '')), p -> length(p) > least)) AS (pos, text))"),
    "doc_terms": ("t STRING", "term STRING, tf BIGINT", f"SELECT term, count(*) FROM (SELECT explode(regexp_extract_all(lower(t), {_quoted(X.TOKEN)}, 0)) AS term) GROUP BY term"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name, (parameters, result, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return [*SCALAR, *TABLES]


def publish(docs: DataFrame, prefix: str = "") -> list[str]:
    """Views `sections`, `turns` and `chunks` of documents (doc_id, form, text); transcripts have the form TRANSCRIPT. Their names."""
    transcript = F.upper(F.coalesce("form", F.lit(""))) == "TRANSCRIPT"
    parts = {"sections": S.sections(docs.where(~transcript)), "turns": S.turns(docs.where(transcript).select("doc_id", "text"))}
    parts["chunks"] = S.chunks(parts["sections"].unionByName(parts["turns"]))
    for name, df in parts.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in parts]
