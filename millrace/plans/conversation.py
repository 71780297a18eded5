"""Queries on retrieval-augmented conversation.

A thread of documents is a conversation (order and role by document number); a question of quora_queries belongs to the
thread of its best document; its context are its five best documents in search_results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import whole_number
from millrace.operators import rag
from millrace.operators.ranking import top_k
from millrace.plans import sqltext as sq
from millrace.session import table


def messages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("thread_id IS NOT NULL")
    role = F.when(F.col("doc_id") % 2 == 0, "user").otherwise("ASSISTANT")
    return t.select(F.col("thread_id").alias("conversation_id"), F.col("doc_id").alias("turn"), role.alias("role"), "text", F.col("created_at").alias("ts"))


def context(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    h = table(spark, d, "search_results").select("query_id", whole_number("doc_id").alias("doc_id"), F.col("similarity_score").alias("score"))
    h = h.filter("doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"), "thread_id")
    return top_k(h, k).join(docs, "doc_id", "left").select("query_id", "rank", "doc_id", "document", "thread_id", F.col("score").alias("similarity_score"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quora_queries").groupBy("query_id").agg(F.min("text").alias("text"))
    first = context(spark, d, 1).select("query_id", F.col("thread_id").alias("conversation_id"))
    return q.join(first, "query_id", "left")


def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    return rag.prompts(questions(spark, d), messages(spark, d), context(spark, d), "quora")


def rag_template(spark: SparkSession, d: str) -> DataFrame:
    return rag.template_answers(questions(spark, d), context(spark, d), "antique")


def rag_answer_cleaned(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    said = F.concat(F.lit("Assistant: "), F.coalesce("text", F.lit("")), F.lit(" User:"))
    return t.select("doc_id", rag.cleaned_answer(said).alias("answer"))


def history_cap(spark: SparkSession, d: str) -> DataFrame:
    return rag.last_messages(messages(spark, d), 20).select("conversation_id", "turn", "role")


def live_conversations(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return rag.live_conversations(m, now, 30 * 86400).select("conversation_id")


FUNCTIONS = (rag_prompt, rag_template, rag_answer_cleaned, history_cap, live_conversations)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_BASE = f"""WITH h0 AS (SELECT query_id, {sq.NUMBER} AS doc_id, similarity_score AS score FROM search_results WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)),
h AS (SELECT query_id, doc_id, max(score) AS score FROM h0 WHERE doc_id IS NOT NULL GROUP BY 1, 2), r AS ({sq.ranked("h", 5)}),
c AS MATERIALIZED (SELECT r.*, d.text AS document, d.thread_id FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id),
m AS (SELECT thread_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'User' ELSE 'Assistant' END AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY thread_id ORDER BY doc_id DESC) AS back FROM documents WHERE thread_id IS NOT NULL),
q AS (SELECT quora_queries.query_id, min(text) AS text FROM quora_queries GROUP BY 1),
said AS (SELECT thread_id, string_agg(role || ': ' || text, chr(10) ORDER BY doc_id) AS s FROM m WHERE back <= 6 GROUP BY 1),
readd AS (SELECT query_id, string_agg(rank || '. ' || substr(coalesce(document, ''), 1, 300), chr(10) ORDER BY rank) AS s FROM c WHERE rank <= 3 GROUP BY 1)"""
_W = rag.WORDING["antique"]
_STRIP = [("strip",)]
_CLEANED = f"""WITH a AS (SELECT doc_id, {sq.clean("replace('Assistant: ' || coalesce(text, '') || ' User:', 'Assistant:', '')", _STRIP)} AS t FROM documents),
b AS (SELECT doc_id, {sq.clean("replace(t, 'User:', '')", _STRIP)} AS t FROM a), p AS (SELECT doc_id, t, string_split(t, '.') AS ps FROM b)
SELECT doc_id, CASE WHEN len(ps) > 1 AND length({sq.clean("ps[-1]", _STRIP)}) < 10 THEN array_to_string(list_slice(ps, 1, greatest(len(ps) - 1, 1)), '.') || '.' ELSE t END AS answer FROM p"""
SQL = {
    "rag_prompt": f"""{_BASE} SELECT q.query_id, CASE WHEN said.s IS NOT NULL THEN 'Previous conversation:' || chr(10) || said.s || chr(10) || chr(10) ELSE '' END || {sq.lit(rag.WORDING["quora"].heading)}
 || CASE WHEN readd.s IS NOT NULL THEN chr(10) || readd.s ELSE '' END || chr(10) || chr(10) || 'User question: ' || coalesce(q.text, '') || chr(10) || 'Assistant:' AS prompt
FROM q LEFT JOIN c ON c.query_id = q.query_id AND c.rank = 1 LEFT JOIN said ON said.thread_id = c.thread_id LEFT JOIN readd ON readd.query_id = q.query_id""",
    "rag_template": f"""{_BASE}, n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1) SELECT q.query_id, CASE WHEN c.query_id IS NULL THEN {sq.lit(_W.nothing)} ELSE
 CASE WHEN c.score > 0.8 THEN {sq.lit(_W.sure)} WHEN c.score > 0.6 THEN {sq.lit(_W.likely)} ELSE {sq.lit(_W.unsure)} END || chr(10) || chr(10) || coalesce(c.document, '')
 || CASE WHEN n.n > 1 THEN chr(10) || chr(10) || {sq.lit(_W.others.split("{n}")[0])} || (n.n - 1) || {sq.lit(_W.others.split("{n}")[1])} ELSE '' END END AS answer
FROM q LEFT JOIN c ON c.query_id = q.query_id AND c.rank = 1 LEFT JOIN n ON n.query_id = q.query_id""",
    "rag_answer_cleaned": _CLEANED,
    "history_cap": """SELECT conversation_id, turn, role FROM (SELECT thread_id AS conversation_id, doc_id AS turn, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'ASSISTANT' END AS role,
 row_number() OVER (PARTITION BY thread_id ORDER BY doc_id DESC) AS n FROM documents WHERE thread_id IS NOT NULL) WHERE n <= 20""",
    "live_conversations": """WITH l AS (SELECT thread_id AS conversation_id, max(created_at) AS last_at FROM documents WHERE thread_id IS NOT NULL GROUP BY 1)
SELECT conversation_id FROM l WHERE (SELECT count(*) FROM l) < 100 OR epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(date_trunc('second', last_at)) <= 30 * 86400""",
}
