"""Toxicity: FTRL-proximal logistic regression over n-grams and skip-grams.

The grams are lower-case words, their stems (the first letters, so that forms of
a word share a weight), pairs of neighbours and pairs with a word between. A gram
counts once per document: one slur in a long text weighs what it weighs in a
short one. Per-coordinate rates and L1 leave some hundred weights, which are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import ftrl
from annalist.llm.ngrams import Grams

SETTINGS = ftrl.Settings(Grams(skips=1, stem=4), presence=True, alpha=10.0, l1=5.0, l2=0.0, epochs=6, least_docs=5, sample=8_000)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", identity: str = "doc_id", text: str = "text", settings: ftrl.Settings = SETTINGS) -> ftrl.Model:
    """The model, from at most ``settings.sample`` labelled documents (see ``ftrl.fit``)."""
    return ftrl.fit(docs, labels, label, identity, text, settings)


def scored(docs: DataFrame, model: ftrl.Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity as ``name``, which replaces a
    column of that name. Null, empty and wordless texts get the model's prior.
    Repeated rows get equal scores; other columns pass through."""
    return docs.withColumn(name, ftrl.score(docs, model, F.col(text)))
