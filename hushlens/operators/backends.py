"""Slots for local models: what cuts sentences and finds base forms, and what turns sentences into vectors.

Models run on the workers, as Arrow functions that load them once per process. Nothing is downloaded unless the configuration
allows it; without the library or the model the engine goes on without, and the decision log says so.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

from hushlens.config import Config

#: array<struct<sentence string, lemmas array<string>>> of a text.
UNITS = ArrayType(StructType().add("sentence", StringType()).add("lemmas", ArrayType(StringType())))
#: Models where the configuration names none.
DEFAULT_SPACY, DEFAULT_ENCODER = "fr_core_news_md", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"


@dataclass(frozen=True)
class Linguistics:
    """A backend by name; units maps a text column to its sentences with their base forms, None stands for the pattern splitter."""

    name: str = "regex"
    units: Callable[[Column], Column] | None = None


def spacy_linguistics(model: str = DEFAULT_SPACY) -> Linguistics:
    """The spaCy model if library and model are installed here (and so on the workers), else the pattern splitter."""
    if importlib.util.find_spec("spacy") is None or importlib.util.find_spec(model) is None:
        return Linguistics()

    @arrow_udf(UNITS)
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import spacy

        nlp = spacy.load(model)
        kind = pa.list_(pa.struct([("sentence", pa.string()), ("lemmas", pa.list_(pa.string()))]))
        for batch in batches:
            docs = nlp.pipe("" if t is None else t for t in batch.to_pylist())
            yield pa.array([[{"sentence": s.text.strip(), "lemmas": [w.lemma_ for w in s if not (w.is_space or w.is_punct)]} for s in d.sents if s.text.strip()] for d in docs], kind)

    return Linguistics(f"spacy:{model}", units)


def transformer_encoder(config: Config) -> tuple[Callable[[Column], Column] | None, str]:
    """The configured sentence encoder as an Arrow function of unit vectors, and why there is none."""
    name = config.semantic.get("model_name", DEFAULT_ENCODER)
    local = bool(config.semantic.get("local_files_only", True))
    try:
        from sentence_transformers import SentenceTransformer

        SentenceTransformer(name, local_files_only=local)
    except Exception as e:
        return None, str(e)

    @arrow_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, local_files_only=local)
        for batch in batches:
            vectors = model.encode(["" if t is None else t for t in batch.to_pylist()], normalize_embeddings=True)
            yield pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))

    return encode, ""


def resources(config: Config) -> list[dict[str, str]]:
    """Each model the configuration asks for with its status: available, or failed and why."""
    spacy_model = config.linguistics.get("spacy_model", DEFAULT_SPACY)
    found = spacy_linguistics(spacy_model).units is not None
    out = [{"resource": "spacy_model", "name": spacy_model, "status": "available" if found else "failed", "error": "" if found else "library or model not installed"}]
    if config.semantic.get("enabled", False):
        encoder, error = transformer_encoder(config)
        out.append({"resource": "sentence_transformer", "name": config.semantic.get("model_name", DEFAULT_ENCODER), "status": "failed" if encoder is None else "available", "error": error})
    return out
