"""Quality classifier: logistic regression over hashed word n-grams.

The grams are words and pairs of words as they are written, the marks around
them, and a sign for a word that repeats its predecessor. A document's vector is
each gram's share of its grams, so long and short documents are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import ftrl
from annalist.llm.ngrams import Grams

SETTINGS = ftrl.Settings(Grams(lower=False, marks=True), presence=False, scale=20.0, alpha=1.0, l1=0.1, least_docs=8, sample=8_000)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", identity: str = "doc_id", text: str = "text", settings: ftrl.Settings = SETTINGS) -> ftrl.Model:
    """The model, from at most ``settings.sample`` labelled documents (see ``ftrl.fit``)."""
    return ftrl.fit(docs, labels, label, identity, text, settings)


def scored(docs: DataFrame, model: ftrl.Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality as ``name``, which replaces
    a column of that name. Null, empty and wordless texts get the model's
    prior. Repeated rows get equal scores; other columns pass through."""
    return docs.withColumn(name, ftrl.score(docs, model, F.col(text)))


def accepted(docs: DataFrame, model: ftrl.Model, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, unchanged."""
    return scored(docs, model, text, "__score").where(F.col("__score") >= least).drop("__score")
