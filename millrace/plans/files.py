"""Queries that go through files and stored tables: readers, sinks, saved indexes, and the engine object end to end.

Files are written to a new folder beside the checkpoints and read back; their SQL reads the original tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.engine import PROFILES, Engine
from millrace.functions import cleaning as cl
from millrace.functions import tokens as tk
from millrace.functions import wordlists as wl
from millrace.operators import catalog, fuse, rag
from millrace.operators import retrieve as rt
from millrace.operators import tfidf as tf
from millrace.plans import conversation as cv
from millrace.plans import lexical as lx
from millrace.plans import sqltext as sq
from millrace.plans import vectors as vp
from millrace.session import cut, shared_folder, spread, table
from millrace.sources import readers, sinks


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quora_queries").select(F.col("id").cast("string").alias("id"), "query_id", "text")


def _texts(rows: DataFrame) -> DataFrame:
    return readers.normalise(rows).select("id", "text", F.try_element_at("metadata", F.lit("query_id")).alias("query_id"))


def files_json(spark: SparkSession, d: str) -> DataFrame:
    """One object of objects by identifier, made from the small table of targets."""
    path = shared_folder(spark, "json")
    t = table(spark, d, "mix_targets").select("source", F.struct(F.col("source").alias("body"), "max_repeats").alias("v"))
    whole = t.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "v")))).alias("value"))  # a few rows
    whole.coalesce(1).write.text(path)
    return readers.normalise(readers.read_json(spark, path)).select("id", "text", F.try_element_at("metadata", F.lit("max_repeats")).alias("max_repeats"))


def files_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """S2, S5, K9."""
    path = shared_folder(spark, "dataset")
    q = _questions(spark, d)
    sinks.save_dataset(q, q.select("query_id"), table(spark, d, "qrels").select("query_id", "doc_id", "relevance"), path, "questions")
    return _texts(readers.read_jsonl(spark, f"{path}/docs"))


def files_delimited(spark: SparkSession, d: str) -> DataFrame:
    """S3, S5, K14."""
    path = shared_folder(spark, "export") + ".tsv"
    sinks.export_tsv(_questions(spark, d), path)
    return _texts(readers.read_delimited(spark, path))


def files_detected(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines without a suffix."""
    path = shared_folder(spark, "unnamed")
    _questions(spark, d).write.json(path)
    return _texts(readers.read_any(spark, path))


def collection_stored(spark: SparkSession, d: str) -> DataFrame:
    """Documents, queries and judgments through files into stored tables."""
    folder, out = shared_folder(spark, "collection"), shared_folder(spark, "tables")
    docs = table(spark, d, "quora_docs").groupBy("doc_id").agg(F.min("text").alias("text"))
    queries = table(spark, d, "quora_queries").groupBy("query_id").agg(F.min("text").alias("text"))
    for name, t in (("docs", docs), ("queries", queries), ("qrels", table(spark, d, "qrels").select("query_id", "doc_id", "relevance").filter("doc_id IS NOT NULL AND trim(doc_id) <> ''"))):
        sinks.export_tsv(t, f"{folder}/{name}.tsv")
    sizes = sinks.load_all(spark, folder, out)
    return spark.createDataFrame(sorted(sizes.items()), "name string, n_rows long")


def judgments_read(spark: SparkSession, d: str) -> DataFrame:
    """Positive judgments of a file."""
    path = shared_folder(spark, "qrels")
    sinks.export_tsv(table(spark, d, "qrels").select("query_id", F.lit("d").alias("doc_id"), "relevance"), path)
    return readers.read_judgments(spark, path, positive=True).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("relevance").alias("gain"))


def cleaned_stored(spark: SparkSession, d: str) -> DataFrame:
    """K8, S11."""
    path = shared_folder(spark, "cleaned")
    sinks.clean_and_store(table(spark, d, "quora_queries").select("id", "text"), "text", cl.clean("text", cl.safe()), path)
    return readers.scan(spark.read.parquet(path), columns=("id", "processed_text"), not_null="text")


def results_saved(spark: SparkSession, d: str) -> DataFrame:
    """K11."""
    path = shared_folder(spark, "results")
    per = table(spark, d, "qrels").groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"), F.avg("relevance").alias("mean"))
    sinks.save_results(per, path)
    return spark.read.schema(per.schema).json(path).select("query_id", "judged", F.round("mean", 6).alias("mean"))


def rows_appended(spark: SparkSession, d: str) -> DataFrame:
    """K3: no key, nothing replaced; a column that the table lacks is added."""
    t = table(spark, d, "qrels").select("id", "query_id")
    return sinks.append(t, t.filter("id % 2 = 0").withColumn("batch", F.lit(2)))


def index_registered(spark: SparkSession, d: str) -> DataFrame:
    """The last file of each data set and representation."""
    t = table(spark, d, "documents").filter("source IS NOT NULL").select(F.col("source").alias("dataset_name"), F.col("lang").alias("representation_type"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("file_size"))
    t = t.filter("representation_type IS NOT NULL")
    return sinks.upsert(sinks.last_wins(t.filter("seq % 2 = 0"), ["dataset_name", "representation_type"], "seq"), t.filter("seq % 2 = 1"), ["dataset_name", "representation_type"], "seq")


def index_current(spark: SparkSession, d: str) -> DataFrame:
    """Whether the vectors stand for all documents, and the documents for themselves."""
    docs, v = table(spark, d, "documents"), table(spark, d, "doc_vectors")
    rows = [("doc_vectors", catalog.is_current(v, docs)), ("documents", catalog.is_current(docs, docs))]
    return spark.createDataFrame(rows, "name string, current boolean")


def dataset_scan(spark: SparkSession, d: str) -> DataFrame:
    """A filtered scan whose JSON column is decoded."""
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset_name"), F.to_json(F.struct("title", "n_chars")).alias("metadata"))
    t = readers.decoded(readers.scan(t, dataset="forum_archive"), {"metadata": "title string, n_chars long"})
    return t.select("doc_id", F.col("metadata.title").alias("title"), F.col("metadata.n_chars").alias("n_chars"))


def constant_metadata(spark: SparkSession, d: str) -> DataFrame:
    """S13, S15."""
    t = readers.with_constant_metadata(readers.scan(table(spark, d, "quora_docs"), columns=("id", "text")), "quora", "file")
    return t.select("id", F.col("metadata")["dataset"].alias("dataset"), F.col("metadata")["source"].alias("source"))


def dataset_registry(spark: SparkSession, d: str) -> DataFrame:
    """S8."""
    return readers.registry(spark)


def saved_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The index is saved, loaded and searched; nothing is fitted again."""
    path = shared_folder(spark, "index")
    _, model, w = lx._fitted(spark, d, lx.UNI)
    sinks.save_index(w, model.vocabulary, path)
    v, w = sinks.load_index(spark, path)
    loaded = tf.Model(lx.UNI, model.n_docs, v, v.count())
    return lx._scores(rt.cosine_search(lx.search_queries(spark, d), "tokens", w, loaded, 10))


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first three documents, and one that isn't there."""
    docs = table(spark, d, "documents").select("doc_id", "title")
    return rt.lookup(docs, -5, *[r["doc_id"] for r in docs.select("doc_id").orderBy("doc_id").limit(3).collect()])  # three rows


def search_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first 50, though 80 are asked for."""
    _, model, w = lx._fitted(spark, d, lx.UNI)
    return lx._scores(rt.cosine_search(lx.search_queries(spark, d), "tokens", w, model, rt.capped(80)))


def unanswered_queries(spark: SparkSession, d: str) -> DataFrame:
    """F4."""
    _, model, w = lx._fitted(spark, d, lx.UNI)
    q = lx.search_queries(spark, d)
    return fuse.answered(q, rt.cosine_search(q, "tokens", w, model, 1))


def lifted_scores(spark: SparkSession, d: str) -> DataFrame:
    """R11."""
    hits = table(spark, d, "search_results").select("query_id", "id", F.when(F.col("rank") <= 3, F.col("similarity_score")).otherwise(0.0).alias("score")).filter("score IS NOT NULL AND NOT isnan(score)")
    return fuse.lifted(hits).groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("worst"))


def _related(spark: SparkSession, d: str) -> DataFrame:
    """A table of related terms: the words of a source's name go together."""
    s = table(spark, d, "mix_targets").select(F.split("source", "_").alias("w")).filter(F.size("w") > 1)
    return s.select(F.explode("w").alias("word"), "w").select("word", F.explode("w").alias("lemma")).filter("word <> lemma")


def expansion_table(spark: SparkSession, d: str) -> DataFrame:
    """R14."""
    q = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), tk.simple("title").alias("tokens"))
    return rt.expand_from_table(q, "tokens", _related(spark, d)).select("query_id", F.array_join("tokens", " ").alias("tokens"))


def expansion_medical(spark: SparkSession, d: str) -> DataFrame:
    """R15."""
    q = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), tk.simple("title").alias("tokens"))
    return q.select("query_id", F.array_join(rt.expand_terms(F.col("tokens"), wl.EXPANSIONS_MEDICAL, 3, 3), " ").alias("tokens"))


def tfidf_topk_retuned(spark: SparkSession, d: str) -> DataFrame:
    """Up to three words a term."""
    _, model, w = lx._fitted(spark, d, tf.CONFIGS["quora_retuned"])
    return lx._scores(rt.cosine_search(lx.search_queries(spark, d), "tokens", w, model, 10))


def _engine(spark: SparkSession, d: str, with_vectors: bool) -> Engine:
    return Engine(PROFILES["antique"], table(spark, d, "documents").select("doc_id", "text"), vp._doc_vectors(spark, d) if with_vectors else None)


def engine_search_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """R18, R19, R20."""
    q = lx.search_queries(spark, d).select("query_id", "text")
    return lx._scores(_engine(spark, d, False).search(q, "tfidf", 10, texts=True)).select("query_id", "rank", "doc_id", "score", F.length("text").alias("n"))


def engine_search_auto(spark: SparkSession, d: str) -> DataFrame:
    """Both arms twice as deep, fused."""
    q = lx.search_queries(spark, d).select("query_id", "text")
    v = vp._doc_vectors(spark, d).select(F.col("doc_id").alias("query_id"), "vector")
    return vp._fused(_engine(spark, d, True).search(q.join(v, "query_id"), "auto", 10))


def engine_chat(spark: SparkSession, d: str) -> DataFrame:
    """Context, prompt and answer of a turn; a document's title is asked in its thread."""
    t = table(spark, d, "documents").filter("doc_id % 100 = 0")
    q = t.select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("text"), F.col("thread_id").alias("conversation_id"))
    return _engine(spark, d, False).chat(q, cv.messages(spark, d), 5)


def conversations_deleted(spark: SparkSession, d: str) -> DataFrame:
    """G9."""
    m = cv.messages(spark, d)
    return rag.without_conversations(m, m.filter("turn % 7 = 0")).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


def tokens_loader(spark: SparkSession, d: str) -> DataFrame:
    """Letters only, stop words dropped; lemmas where a table gives them."""
    t = table(spark, d, "quora_docs").select("id", F.array_join(tk.loaded("text"), " ").alias("tokens"))
    return t


def tfidf_topk_question(spark: SparkSession, d: str) -> DataFrame:
    """I1, R2 over the question tokenizer (N2), corpus and queries."""
    t = table(spark, d, "documents")
    docs = spread(t.select("doc_id", "text")).select("doc_id", tk.question("text").alias("tokens"))
    model = tf.fit(docs, "tokens", lx.QUORA)
    q = t.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), tk.question("title").alias("tokens"))
    return lx._scores(rt.cosine_search(q, "tokens", tf.weights(docs, "tokens", model), model, 10))


def tfidf_topk_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """I3, R1 over the composed training tokenizer (T9), corpus and queries."""
    t = table(spark, d, "documents")
    docs = tk.composed(spread(t.select("doc_id", "text")), "text", "training").select("doc_id", "tokens")
    docs = cut(docs)  # stemmed once
    model = tf.fit(docs, "tokens", lx.ANTIQUE)
    q = tk.composed(t.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "title"), "title", "training").select("query_id", "tokens")
    return lx._scores(rt.cosine_search(q, "tokens", tf.weights(docs, "tokens", model), model, 10))


def _composed(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return tk.composed(spread(table(spark, d, "quora_docs").select("id", "text")), "text", name).select("id", F.array_join("tokens", " ").alias("tokens"))

    run.__name__ = f"tokens_composed_{name}"
    return run


FUNCTIONS = (
    files_json, files_jsonl, files_delimited, files_detected, collection_stored, judgments_read, cleaned_stored, results_saved, rows_appended, index_registered, index_current,
    dataset_scan, constant_metadata, dataset_registry, saved_index_search, document_lookup, search_capped, unanswered_queries, lifted_scores, expansion_table, expansion_medical,
    tfidf_topk_retuned, engine_search_tfidf, engine_search_auto, engine_chat, conversations_deleted, tokens_loader, tfidf_topk_question, tfidf_topk_stemmed,
    *map(_composed, tk.COMPOSED),
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_STRIPPED = sq.clean("text", [("strip",)])
_SOME = f"coalesce(text, '') NOT IN ('', '0', 'false') AND {_STRIPPED} <> ''"
_QUESTIONS = f"SELECT CAST(id AS VARCHAR) AS id, {_STRIPPED} AS text, query_id FROM quora_queries WHERE {_SOME}"
_FLAT = r"(SELECT id, query_id, regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS text FROM quora_queries)"
_TITLES = f"SELECT doc_id AS query_id, {sq.simple_tokens('title')} AS toks FROM documents"
_ANTIQUE = tf.CONFIGS["antique"]
_MED = "MAP {" + ", ".join(f"{sq.lit(k)}: {sq.words(v[:3])}" for k, v in wl.EXPANSIONS_MEDICAL.items()) + "}"
_LOADED = sq.kept(sq.split(sq.clean("text", cl.loader_base())), sq.not_in(wl.STOP_ENGLISH))
_KEEP = [w for w in wl.STOP_ENGLISH if w not in wl.KEEP_QUESTION]


def _asked(expr: str) -> str:
    # this engine's digit class is ASCII's, the rules' is not
    expr = rf"regexp_replace({expr}, '[\x{{660}}-\x{{669}}\x{{6f0}}-\x{{6f9}}\x{{966}}-\x{{96f}}\x{{ff10}}-\x{{ff19}}]', '7', 'g')"
    return sq.kept(sq.split(sq.clean(expr, cl.question())), f"length(t) >= 2 AND {sq.not_in(_KEEP)} AND NOT regexp_full_match(t, '[_-]+')")


_W = rag.WORDING["antique"]
_RRF = fuse.WEIGHTS["antique"]
SQL = {
    "files_json": "SELECT source AS id, source AS text, CAST(max_repeats AS VARCHAR) AS max_repeats FROM mix_targets",
    "files_jsonl": _QUESTIONS,
    "files_delimited": _QUESTIONS.replace("FROM quora_queries", "FROM " + _FLAT),
    "files_detected": _QUESTIONS,
    "collection_stored": """SELECT 'docs' AS name, count(DISTINCT doc_id) AS n_rows FROM quora_docs UNION ALL SELECT 'queries', count(DISTINCT query_id) FROM quora_queries
UNION ALL SELECT 'qrels', count(DISTINCT (query_id, doc_id)) FROM qrels WHERE relevance IS NOT NULL AND doc_id IS NOT NULL AND trim(doc_id) <> ''""",
    "judgments_read": "SELECT query_id, count(*) AS n, CAST(sum(relevance) AS BIGINT) AS gain FROM qrels WHERE relevance > 0 GROUP BY 1",
    "cleaned_stored": f"SELECT id, {sq.clean('text', cl.safe())} AS processed_text FROM quora_queries WHERE text IS NOT NULL",
    "results_saved": "SELECT query_id, count(*) AS judged, round(avg(relevance), 6) AS mean FROM qrels GROUP BY 1",
    "rows_appended": "SELECT id, query_id, NULL::INT AS batch FROM qrels UNION ALL SELECT id, query_id, 2 FROM qrels WHERE id % 2 = 0",
    "index_registered": """WITH t AS (SELECT source AS dataset_name, lang AS representation_type, doc_id AS seq, n_chars AS file_size FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, representation_type ORDER BY seq % 2 DESC, seq DESC) AS n FROM t) WHERE n = 1""",
    "index_current": "SELECT 'doc_vectors' AS name, (SELECT count(DISTINCT doc_id) FROM doc_vectors) = (SELECT count(*) FROM documents) AS current UNION ALL SELECT 'documents', true",
    "dataset_scan": "SELECT doc_id, title, n_chars FROM documents WHERE source = 'forum_archive'",
    "constant_metadata": "SELECT id, 'quora' AS dataset, 'file' AS source FROM quora_docs",
    "dataset_registry": "SELECT * FROM (VALUES " + ", ".join(f"({sq.lit(n)}, {k}::BIGINT)" for n, k in readers.REGISTRY) + ") t(name, documents)",
    "saved_index_search": lx.cosine_sql(lx.UNI, 10) + lx._OUT,
    "document_lookup": "SELECT doc_id, title FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)",
    "search_capped": lx.cosine_sql(lx.UNI, 50) + lx._OUT,
    "unanswered_queries": lx.cosine_sql(lx.UNI, 1) + " SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM r)",
    "lifted_scores": """WITH h AS (SELECT query_id, CASE WHEN rank <= 3 THEN similarity_score ELSE 0.0 END AS s FROM search_results),
g AS (SELECT query_id, max(s) AS a, min(s) AS b FROM h WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1)
SELECT query_id, round(CASE WHEN a = 0 AND b = 0 THEN 0.001 ELSE a END, 6) AS best, round(CASE WHEN a = 0 AND b = 0 THEN 0.001 ELSE b END, 6) AS worst FROM g""",
    "expansion_table": f"""WITH s AS (SELECT string_split(source, '_') AS w FROM mix_targets WHERE contains(source, '_')), p AS (SELECT unnest(w) AS word, w FROM s),
l AS (SELECT DISTINCT word, lemma FROM (SELECT word, unnest(w) AS lemma FROM p) WHERE word <> lemma AND length(lemma) > 2),
r AS (SELECT word, lemma FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(lemma), lemma) AS n FROM l) WHERE n <= 3),
t AS ({_TITLES}), x AS (SELECT query_id, unnest(toks) AS word FROM t), e AS (SELECT query_id, list_sort(list_distinct(list(lemma))) AS more FROM x JOIN r ON r.word = x.word GROUP BY 1)
SELECT t.query_id, array_to_string(list_filter(list_concat(toks, coalesce(more, [])), lambda w, i: list_position(list_concat(toks, coalesce(more, [])), w) = i), ' ') AS tokens FROM t LEFT JOIN e ON e.query_id = t.query_id""",
    "expansion_medical": f"""WITH t AS ({_TITLES}), a AS (SELECT query_id, list_concat(toks, flatten(list_transform(toks, lambda t: coalesce({_MED}[t], [])))) AS a FROM t)
SELECT query_id, array_to_string(list_filter(a, lambda w, i: list_position(a, w) = i AND length(w) >= 3), ' ') AS tokens FROM a""",
    "tfidf_topk_retuned": lx.cosine_sql(tf.CONFIGS["quora_retuned"], 10) + lx._OUT,
    "tfidf_topk_question": lx.cosine_sql(lx.QUORA, 10).replace(sq.simple_tokens("text"), _asked("text")).replace(sq.simple_tokens("title"), _asked("title")) + lx._OUT,
    "engine_search_tfidf": lx.cosine_sql(_ANTIQUE, 10) + " SELECT r.query_id, r.rank, r.doc_id, round(score, 6) AS score, length(d.text) AS n FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id",
    "engine_search_auto": f"""{lx.cosine_sql(_ANTIQUE, 20)}, {vp._DV},
vs AS (SELECT a.doc_id AS query_id, b.doc_id, round({vp._COS}, 12) AS score FROM dv a JOIN dv b ON a.doc_id % 100 = 0), vr AS (SELECT * FROM ({sq.ranked("vs", 20)}) WHERE score > 0),
l AS (SELECT * FROM r WHERE query_id IN (SELECT doc_id FROM dv)),
nl AS (SELECT query_id, count(*) AS n FROM l GROUP BY 1), nv AS (SELECT query_id, count(*) AS n FROM vr GROUP BY 1),
j AS (SELECT coalesce(l.query_id, x.query_id) AS query_id, coalesce(l.doc_id, x.doc_id) AS doc_id, l.rank AS lr, x.rank AS vrank, l.score AS ls, x.score AS vsc FROM l FULL OUTER JOIN vr x ON l.query_id = x.query_id AND l.doc_id = x.doc_id),
f AS (SELECT j.query_id, j.doc_id, ({_RRF.vector} / ({_RRF.constant} + coalesce(vrank, coalesce(nv.n, 0) + 1)) + {_RRF.lexical} / ({_RRF.constant} + coalesce(lr, coalesce(nl.n, 0) + 1)))
  * CASE WHEN lr IS NOT NULL AND vrank IS NOT NULL THEN {_RRF.both} ELSE 1.0 END AS hybrid_score, coalesce(ls, 0.0) AS tfidf_score, coalesce(vsc, 0.0) AS embedding_score
  FROM j LEFT JOIN nl ON nl.query_id = j.query_id LEFT JOIN nv ON nv.query_id = j.query_id),
o AS ({sq.ranked("f", 10, "hybrid_score", ", tfidf_score, embedding_score")})
SELECT query_id, rank, doc_id, round(hybrid_score, 6) AS hybrid_score, round(tfidf_score, 6) AS tfidf_score, round(embedding_score, 6) AS embedding_score FROM o""",
    "engine_chat": f"""{lx.cosine_sql(_ANTIQUE, 5)}, c AS (SELECT r.*, d.text AS document FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id),
m AS (SELECT thread_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'User' ELSE 'Assistant' END AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY thread_id ORDER BY doc_id DESC) AS back FROM documents WHERE thread_id IS NOT NULL),
said AS (SELECT thread_id, string_agg(role || ': ' || text, chr(10) ORDER BY doc_id) AS s FROM m WHERE back <= 6 GROUP BY 1),
readd AS (SELECT query_id, string_agg(rank || '. ' || substr(coalesce(document, ''), 1, 300), chr(10) ORDER BY rank) AS s FROM c WHERE rank <= 3 GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
a AS (SELECT doc_id AS query_id, coalesce(title, '') AS text, thread_id FROM documents WHERE doc_id % 100 = 0)
SELECT a.query_id, CASE WHEN said.s IS NOT NULL THEN 'Previous conversation:' || chr(10) || said.s || chr(10) || chr(10) ELSE '' END || {sq.lit(_W.heading)}
 || CASE WHEN readd.s IS NOT NULL THEN chr(10) || readd.s ELSE '' END || chr(10) || chr(10) || 'User question: ' || a.text || chr(10) || 'Assistant:' AS prompt,
 CASE WHEN c.query_id IS NULL THEN {sq.lit(_W.nothing)} ELSE CASE WHEN c.score > 0.8 THEN {sq.lit(_W.sure)} WHEN c.score > 0.6 THEN {sq.lit(_W.likely)} ELSE {sq.lit(_W.unsure)} END || chr(10) || chr(10) || coalesce(c.document, '')
 || CASE WHEN n.n > 1 THEN chr(10) || chr(10) || {sq.lit(_W.others.split("{n}")[0])} || (n.n - 1) || {sq.lit(_W.others.split("{n}")[1])} ELSE '' END END AS answer
FROM a LEFT JOIN said ON said.thread_id = a.thread_id LEFT JOIN readd ON readd.query_id = a.query_id LEFT JOIN c ON c.query_id = a.query_id AND c.rank = 1 LEFT JOIN n ON n.query_id = a.query_id""",
    "conversations_deleted": """WITH m AS (SELECT thread_id, doc_id FROM documents WHERE thread_id IS NOT NULL)
SELECT thread_id AS conversation_id, count(*) AS n FROM m WHERE thread_id NOT IN (SELECT thread_id FROM m WHERE doc_id % 7 = 0) GROUP BY 1""",
    "tokens_loader": f"SELECT id, array_to_string({_LOADED}, ' ') AS tokens FROM quora_docs",
}
