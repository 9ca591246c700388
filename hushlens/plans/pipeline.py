"""The whole analysis: chunks -> sentences -> evidence -> category results, lazily."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlens.config import Config
from hushlens.functions import text as T
from hushlens.operators import detect, report, score
from hushlens.operators.backends import Linguistics, transformer_encoder
from hushlens.sources.tables import kept


def sentences(chunks: DataFrame, config: Config, keys: Sequence[str], text: str = "text", linguistics: Linguistics = Linguistics()) -> DataFrame:
    """keys, sentence_index, sentence, norm, tokens, roots of the non-blank sentences of every chunk.

    A backend of one's own gives sentences with base forms, of which the roots are then made.
    """
    if linguistics.units is None:
        rows = chunks.select(*keys, F.posexplode(T.sentences(F.col(text))).alias("sentence_index", "sentence"))
        words = F.col("tokens")
    else:
        rows = chunks.select(*keys, F.posexplode(linguistics.units(F.col(text))).alias("sentence_index", "_u")).select(*keys, "sentence_index", "_u.sentence", "_u.lemmas")
        words = F.filter(F.transform("lemmas", lambda w: T.normalize(w, rare=False)), lambda w: w != "")
    rows = rows.withColumn("norm", T.normalize(F.col("sentence"), **config.normalization)).withColumn("tokens", T.tokens(F.col("norm")))
    return rows.withColumn("roots", T.roots(words)).drop("lemmas")


def offsets(chunks: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, sentence_index, start_char, end_char of the sentences, in code points of the text."""
    return chunks.select(*keys, F.posexplode(T.sentence_spans(F.col(text))).alias("sentence_index", "_s")).select(*keys, "sentence_index", "_s.start_char", "_s.end_char")


def semantic_status(config: Config, encoder: object | None, error: str = "") -> list[str]:
    """Log entries on the semantic layer."""
    allowed = bool(config.semantic.get("allow_network_download", False))
    local = bool(config.semantic.get("local_files_only", True))
    if not config.semantic.get("enabled", False):
        status = "disabled_config"
    elif encoder is not None:
        status = "local_loaded" if local else "loaded_with_network_allowed"
    else:
        status = "disabled_missing_local_model" if local else "disabled_load_error" if allowed else "network_disabled"
    log = ["semantic:network_allowed" if allowed else "semantic:network_disabled", f"semantic:{status}"]
    return [*log, f"semantic:error:{error}"] if error else log


@dataclass
class Analysis:
    """A plan over chunks; every stage is a DataFrame."""

    chunks: DataFrame
    config: Config
    keys: Sequence[str] = ("file_path", "chunk_id")
    text: str = "text"
    encoder: Callable[[Column], Column] | None = None
    detectors: Sequence[str | Callable[..., DataFrame]] = ("lexical", "fuzzy", "linguistic")
    linguistics: Linguistics = Linguistics()
    error: str = ""
    #: Whether several results will be asked for: the evidence is then detected once for all of them.
    several: bool = False

    def __post_init__(self) -> None:
        if self.encoder is None and self.config.semantic.get("enabled", False):
            self.encoder, self.error = transformer_encoder(self.config)

    @cached_property
    def sentences(self) -> DataFrame:
        """Cut, normalised and rooted once; detectors that read them several times then read the checkpoint."""
        rows = sentences(self.chunks, self.config, self.keys, self.text, self.linguistics)
        return kept(rows) if "fuzzy" in self.detectors else rows

    @cached_property
    def evidence(self) -> DataFrame:
        found = detect.detect(self.sentences, self.config, self.keys, self.detectors)
        if self.encoder is not None and self.config.semantic.get("enabled", False):
            found = found.unionByName(detect.semantic(self.sentences, self.config, self.keys, self.encoder))
        return detect.deduplicate(found, self.keys)

    @cached_property
    def kept_evidence(self) -> DataFrame:
        """The evidence for results that read it twice."""
        return kept(self.evidence) if self.several or "fuzzy" in self.detectors else self.evidence

    @cached_property
    def scores(self) -> DataFrame:
        return score.category_scores(self.kept_evidence, self.config, self.keys)

    @cached_property
    def results(self) -> DataFrame:
        kept = dict.fromkeys((*self.keys, *(c for c in report.METADATA if c in self.chunks.columns)))
        return score.category_results(self.chunks.select(*kept), self.scores, self.config, self.keys)

    @property
    def findings(self) -> DataFrame:
        return report.findings(self.kept_evidence, self.results, self.keys)

    @property
    def summary(self) -> DataFrame:
        return report.summary(self.results, self.config.categories[0].cat_ord)

    @property
    def audit(self) -> DataFrame:
        return report.audit(self.kept_evidence, self.results, self.keys, self.decision_log)

    @property
    def decision_log(self) -> list[str]:
        used = "fuzzy" in self.detectors and self.config.fuzzy.get("enabled", True) is not False
        return [f"linguistics_backend:{self.linguistics.name}", "fuzzy:builtin" if used else "fuzzy:disabled_or_unavailable", *semantic_status(self.config, self.encoder, self.error)]


def as_chunks(df: DataFrame, *, id_col: str, text: str = "text", file_type: Column | None = None) -> DataFrame:
    """Table rows as chunks: the id is file name and path, the whole text one chunk."""
    name = F.col(id_col).cast("string")
    return df.select(name.alias("file_path"), name.alias("file_name"), (file_type if file_type is not None else F.lit("")).alias("file_type"), F.lit("full_text").alias("chunk_id"), F.lit(None).cast("int").alias("page_number"), F.col(text).alias("text"))


def analyze_text(spark, text: str, config: Config, text_id: str = "inline_text") -> Analysis:
    """A single string."""
    return Analysis(as_chunks(spark.createDataFrame([(text_id, text)], "text_id string, text string"), id_col="text_id"), config)
