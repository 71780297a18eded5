"""One object for a data set: load, search by any method, converse, inspect. All results are lazy DataFrames.

Queries come in batches (query_id, text and, for vector methods, vector). Encoding texts to vectors, lemmatising and
generating answers need models that are not part of this package; they are passed in as functions or tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import tokens as tk
from millrace.operators import catalog, fuse, rag, retrieve, vectors
from millrace.operators import tfidf as tf
from millrace.session import spread

METHODS = ("tfidf", "embedding", "hybrid")


@dataclass(frozen=True)
class Profile:
    """What differs between data sets."""

    name: str
    tokenizer: Callable[[Column | str], Column]
    config: tf.Config
    weights: fuse.Weights
    default_method: str = "hybrid"
    wording: str = "quora"


PROFILES = {
    "quora": Profile("quora", tk.question, tf.CONFIGS["quora"], fuse.WEIGHTS["quora"]),
    "antique": Profile("antique", tk.simple, tf.CONFIGS["antique"], fuse.WEIGHTS["antique"], wording="antique"),
}


@dataclass
class Engine:
    """docs: (doc_id, text). vectors: (doc_id, vector), optional. encode: adds a vector column to (query_id, text)."""

    profile: Profile
    docs: DataFrame
    vectors: DataFrame | None = None
    encode: Callable[[DataFrame], DataFrame] | None = None
    indexes: dict[str, vectors.Cells] = field(default_factory=dict)
    active: str | None = None

    def __post_init__(self) -> None:
        self.tokenised = spread(self.docs.select("doc_id", "text")).select("doc_id", self.profile.tokenizer("text").alias("tokens"))
        self.model = tf.fit(self.tokenised, "tokens", self.profile.config)
        self.index = tf.weights(self.tokenised, "tokens", self.model)

    # vector indexes by name; without an active one search is exact
    def add_index(self, name: str, **settings) -> None:
        if self.vectors is None:
            raise ValueError("there are no vectors")
        self.indexes[name] = vectors.Cells(self.vectors, **settings)
        self.active = self.active or name

    def set_index(self, name: str | None) -> None:
        if name is not None and name not in self.indexes:
            raise KeyError(name)
        self.active = name

    def _method(self, method: str) -> str:
        method = self.profile.default_method if method == "auto" else "hybrid" if method.startswith("hybrid") else method
        if method not in METHODS:
            raise ValueError(f"method must be auto or one of {METHODS}")
        return method

    def _lexical(self, queries: DataFrame, k: int) -> DataFrame:
        q = queries.select("query_id", self.profile.tokenizer("text").alias("tokens"))
        return retrieve.cosine_search(q, "tokens", self.index, self.model, k)

    def _vector(self, queries: DataFrame, k: int) -> DataFrame:
        if self.vectors is None:
            raise ValueError("there are no vectors")
        if "vector" not in queries.columns:
            if self.encode is None:
                raise ValueError("queries have no vectors and there is no encoder")
            queries = self.encode(queries)
        if self.active:
            return self.indexes[self.active].search(queries, k)
        return vectors.flat_search(queries, self.vectors, k, positive=True)

    def search(self, queries: DataFrame, method: str = "auto", k: int = 10, texts: bool = False) -> DataFrame:
        """Ranked results; hybrid ones have both scores. Arms are fetched twice as deep as asked."""
        method = self._method(method)
        if method == "tfidf":
            out = self._lexical(queries, k)
        elif method == "embedding":
            out = self._vector(queries, k)
        else:
            out = fuse.reciprocal_ranks(self._lexical(queries, 2 * k), self._vector(queries, 2 * k), self.profile.weights, k)
        return retrieve.enrich(out, self.docs, "text") if texts else out

    def chat(self, questions: DataFrame, messages: DataFrame, k: int = 5, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(query_id, prompt, answer): generate turns (query_id, prompt) into (query_id, answer); without it answers follow templates."""
        found = self.search(questions, "embedding" if self.vectors is not None else "tfidf", k)
        context = retrieve.enrich(found, self.docs.withColumnRenamed("text", "document"), "document").withColumnRenamed("score", "similarity_score")
        prompts = rag.prompts(questions, messages, context, self.profile.wording)
        if generate is None:
            answers = rag.template_answers(questions, context, self.profile.wording)
        else:
            answers = generate(prompts).withColumn("answer", rag.cleaned_answer(F.col("answer")))
        return prompts.join(answers, "query_id", "left")

    def info(self) -> dict:
        return {
            "dataset": self.profile.name,
            "documents": self.model.n_docs,
            "terms": self.model.n_terms,
            "methods": list(METHODS) if self.vectors is not None else ["tfidf"],
            "default_method": self.profile.default_method,
            "indexes": sorted(self.indexes),
            "active_index": self.active,
        }

    def validate(self) -> DataFrame:
        return catalog.validate_index(self.index, self.model.vocabulary, self.docs)
