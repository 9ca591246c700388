"""Detectors: (sentences, config) -> evidence.

sentences: the chunk key, sentence_index, sentence, norm, tokens, roots. Evidence has the chunk key, cat_ord, method, score,
trigger, matched_variant, sentence, explanation, context_hits, field_hits, overlap, similarity and its emit order
(sentence_index, method_seq, term_ord). The lexicon is a literal of bounded size; sentences that cannot match any term are
dropped by one alternation pattern or one array test before terms are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlens.config import Category, Config, Term
from hushlens.functions import plain
from hushlens.functions import text as T

from hushlens.sources.tables import few, kept

from .ratio import possible_pairs, weighted_ratio

EVIDENCE = ("cat_ord", "method", "score", "trigger", "matched_variant", "sentence", "explanation", "context_hits", "field_hits", "overlap", "similarity", "sentence_index", "method_seq", "term_ord")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lexicon_literal(terms: Sequence[Term]) -> Column:
    """array<struct<cat_ord, term_ord, term, norm, roots>> of the lexicon."""
    return F.array(*(F.struct(F.lit(t.cat_ord).alias("cat_ord"), F.lit(t.term_ord).alias("term_ord"), F.lit(t.term).alias("term"), F.lit(t.norm).alias("norm"), _strings(t.roots).alias("roots")) for t in terms))


def hits(norm: Column, categories: Sequence[Category], names: Callable[[Category], Sequence[str]], cat_ord: Column) -> Column:
    """The candidates of the row's category that occur in norm, in their own spelling and order, each once.

    An empty candidate is dropped; one that normalises to nothing occurs everywhere.
    """
    out = _strings([])
    for c in categories:
        listed = list(dict.fromkeys(n for n in names(c) if n))
        if listed:
            table = F.array(*(F.struct(F.lit(n).alias("raw"), F.lit(plain.normalize(n)).alias("norm")) for n in listed))
            found = F.transform(F.filter(table, lambda x: F.contains(norm, x["norm"])), lambda x: x["raw"])
            out = F.when(cat_ord == c.cat_ord, found).otherwise(out)
    return out


def boosted(base: Column, context: Column, fields: Column) -> Column:
    """Base score plus 0.05 a context hit and 0.04 a field hit, at most 1, to 4 places."""
    return F.round(F.least(F.lit(1.0), base + F.lit(0.05) * F.size(context) + F.lit(0.04) * F.size(fields)), 4)


def with_hits(found: DataFrame, config: Config) -> DataFrame:
    cat = F.col("cat_ord")
    return found.withColumns({"context_hits": hits(F.col("norm"), config.categories, lambda c: c.context_terms, cat), "field_hits": hits(F.col("norm"), config.categories, lambda c: c.field_hints, cat)})


def _finish(found: DataFrame, keys: Sequence[str], config: Config, method: Column, seq: Column, base: Column, explanation: Column) -> DataFrame:
    out = with_hits(found, config).withColumns({"method": method, "method_seq": seq})
    out = out.withColumns({"score": boosted(base, F.col("context_hits"), F.col("field_hits")), "explanation": explanation})
    for name, kind in (("overlap", "array<string>"), ("similarity", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.select(*keys, *EVIDENCE)


def _alternation(terms: Sequence[Term]) -> str:
    return "|".join(re.escape(n).replace(r"\ ", " ") for n in sorted({t.norm for t in terms}, key=len, reverse=True))


def python_list(items: Column) -> Column:
    """An array of plain words as Python prints a list; words with an apostrophe stand in double quotes."""
    shown = F.transform(items, lambda x: F.when(F.contains(x, F.lit("'")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def exact(sentences: DataFrame, config: Config, keys: Sequence[str], methods: Sequence[str] = ("lexical", "linguistic")) -> DataFrame:
    """Evidence of the lexical and the linguistic detector in one pass over the sentences.

    lexical: a term whose normalised form is a substring of the sentence. linguistic: a term that is no substring but all of
    whose roots are among the sentence's.
    """
    terms = config.lexicon()
    rooted = [t for t in terms if t.roots]
    norm, roots = F.col("norm"), F.col("roots")
    fields = lambda seq: lambda t: F.struct(F.lit(seq).alias("seq"), t["cat_ord"].alias("cat_ord"), t["term_ord"].alias("term_ord"), t["term"].alias("term"), t["norm"].alias("norm"), t["roots"].alias("roots"))
    may, found = F.lit(False), []
    if "lexical" in methods and terms:
        may = may | norm.rlike(_alternation(terms))
        found.append(F.transform(F.filter(lexicon_literal(terms), lambda t: F.contains(norm, t["norm"])), fields(0)))
    if "linguistic" in methods and rooted:
        may = may | F.arrays_overlap(roots, _strings(sorted({t.roots[0] for t in rooted})))
        found.append(F.transform(F.filter(lexicon_literal(rooted), lambda t: ~F.contains(norm, t["norm"]) & (F.size(F.array_except(t["roots"], roots)) == 0)), fields(2)))
    if not found:
        return _none(sentences, config, keys)
    # A condition inside the explode, since where() would be pushed below the sentences' columns, which it would then compute anew.
    rows = sentences.select(*keys, "sentence_index", "sentence", "norm", F.explode(F.when(may, F.concat(*found))).alias("_t"))
    lex = F.col("_t.seq") == 0
    rows = rows.select(
        *keys, "sentence_index", "sentence", "norm", "_t.cat_ord", "_t.term_ord", F.col("_t.seq").alias("method_seq"), F.col("_t.term").alias("trigger"),
        F.when(lex, F.col("_t.norm")).otherwise(F.array_join("_t.roots", " ")).alias("matched_variant"), F.when(~lex, F.col("_t.roots")).alias("overlap"),
    )
    lex = F.col("method_seq") == 0
    said = F.when(lex, F.concat(F.lit("Correspondance lexicale exacte du terme '"), "trigger", F.lit("' dans la phrase."))).otherwise(
        F.concat(F.lit("Correspondance linguistique par racines/lemmes pour '"), "trigger", F.lit("' avec les racines detectees "), python_list(F.col("overlap")), F.lit("."))
    )
    return _finish(rows, keys, config, F.when(lex, "lexical").otherwise("linguistic"), F.col("method_seq"), F.when(lex, 0.62).otherwise(0.52), said)


def lexical(sentences: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    return exact(sentences, config, keys, ("lexical",))


def linguistic(sentences: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    return exact(sentences, config, keys, ("linguistic",))


def _none(sentences: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    """No evidence, with its columns."""
    rows = sentences.limit(0).withColumns({"cat_ord": F.lit(0), "term_ord": F.lit(0), "trigger": F.lit(""), "matched_variant": F.lit("")})
    return _finish(rows, keys, config, F.lit(""), F.lit(0), F.lit(0.0), F.lit(""))


def gram_rows(norms: DataFrame, config: Config) -> DataFrame:
    """Runs of tokens of every length a term may be compared with, at least 4 characters without blanks: norm, n, pos, gram."""
    sizes = [max(1, len(t.tokens)) for t in config.lexicon()]
    low, high = max(1, min(sizes, default=1) - config.fuzzy_delta), max(sizes, default=1) + config.fuzzy_delta
    rows = norms.select("norm", F.explode(T.ngrams(F.col("tokens"), low, high)).alias("_g")).select("norm", "_g.n", "_g.pos", "_g.gram")
    return rows.where(F.length("gram") - (F.col("n") - 1) >= 4)


def fuzzy(sentences: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    """One evidence per sentence and term that is not there as a substring, with the most similar run of tokens.

    Everything is done once for equal sentences and once for equal runs: the distinct runs of the distinct normalised sentences
    meet the terms in the JVM, a lossless bound leaves few pairs, and only these go through the ratio. Pairs that are similar
    enough go back to the sentences that hold the run, which no exchange of the runs is needed for while they are few. Of
    equally similar runs the shortest, then leftmost wins.
    """
    terms = config.lexicon()
    if not terms or config.fuzzy.get("enabled", True) is False:
        return _none(sentences, config, keys)
    threshold, delta = config.fuzzy_threshold, config.fuzzy_delta
    grams = gram_rows(sentences.dropDuplicates(["norm"]), config)
    pairs = possible_pairs(grams.select("gram", "n").distinct(), terms, threshold, delta)
    ratios = kept(pairs.withColumn("similarity", weighted_ratio(F.col("norm"), F.col("gram"))).where(F.col("similarity") >= threshold).withColumnRenamed("norm", "_term"))
    near = grams.join(few(ratios), ["gram", "n"]).where(~F.contains("norm", F.col("_term")))
    best = near.groupBy("norm", "term_id").agg(F.max(F.struct("similarity", (-F.col("n")).alias("n"), (-F.col("pos")).alias("pos"), "gram")).alias("_b"))
    best = kept(best.select("norm", "term_id", "_b.similarity", F.col("_b.gram").alias("matched_variant")))
    table = sentences.sparkSession.createDataFrame([(k, t.cat_ord, t.term_ord, t.term) for k, t in enumerate(terms)], "term_id int, cat_ord int, term_ord int, trigger string")
    found = sentences.select(*keys, "sentence_index", "sentence", "norm").join(few(best), "norm").join(F.broadcast(table), "term_id")
    text = F.concat(F.lit("Approximation fuzzy entre '"), "trigger", F.lit("' et '"), "matched_variant", F.lit("' avec une similarite de "), F.col("similarity").cast("string"), F.lit("."))
    return _finish(found, keys, config, F.lit("fuzzy"), F.lit(1), F.col("similarity") / 100 * 0.7, text)


def semantic(sentences: DataFrame, config: Config, keys: Sequence[str], encoder: Callable[[Column], Column] | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """At most one evidence per sentence and category: its nearest anchor, if near enough.

    encoder maps a text column to unit vectors (an Arrow UDF around a local model); without one there is no evidence, as
    without a model. Distinct sentences are encoded once. anchors: cat_ord, anchor_ord, anchor, vector; else they are encoded.
    """
    if encoder is None:
        return _none(sentences, config, keys)
    spark = sentences.sparkSession
    if anchors is None:
        rows = [(c.cat_ord, n, a) for c in config.categories for n, a in enumerate(c.semantic_anchors)]
        anchors = spark.createDataFrame(rows, "cat_ord int, anchor_ord int, anchor string").withColumn("vector", encoder(F.col("anchor")))
    vectors = sentences.select("sentence").distinct().withColumn("_v", encoder(F.col("sentence")))
    near = nearest_anchor(vectors, anchors, "sentence", "_v").where(F.col("similarity") >= config.semantic_threshold)
    found = sentences.join(near, "sentence").withColumns({"trigger": F.col("anchor"), "matched_variant": F.col("sentence"), "term_ord": F.lit(0), "_s": F.col("similarity")}).withColumn("similarity", F.round("similarity", 4))
    text = F.concat(F.lit("Proximite semantique entre la phrase et l'ancre '"), "anchor", F.lit("' avec une similarite de "), F.format_number("_s", 3), F.lit("."))
    return _finish(found, keys, config, F.lit("semantic"), F.lit(3), F.col("_s"), text)


#: Anchors of one block: with vectors of 768 numbers some 6 MB.
ANCHORS = 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_anchor(vectors: DataFrame, anchors: DataFrame, key: str, vector: str) -> DataFrame:
    """For every vector and category the anchor with the greatest dot product, the first of equals: key, cat_ord, anchor, similarity.

    Anchors are counted and folded into blocks of at most ANCHORS. One block, as a configuration has, is broadcast. Of more each
    vector meets every block in a join on the block's number, salted so that no task gets all vectors.
    """
    blocks = max(1, -(-anchors.count() // ANCHORS))
    place = F.pmod(F.xxhash64("cat_ord", "anchor_ord"), F.lit(blocks)).cast("int")
    packed = anchors.withColumn("_block", place).groupBy("_block").agg(F.collect_list(F.struct("cat_ord", "anchor_ord", "anchor", "vector")).alias("_anchors"))
    rows = vectors.select(key, F.col(vector).alias("_v"))
    if blocks == 1:
        rows = rows.withColumn("_block", F.lit(0)).join(F.broadcast(packed), "_block")
    else:
        salts = vectors.sparkSession.sparkContext.defaultParallelism
        packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumns({"_salt": F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"), "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).join(packed, ["_block", "_salt"])
    scored = rows.select(key, F.explode(F.transform("_anchors", lambda a: F.struct(a["cat_ord"].alias("cat_ord"), dot(F.col("_v"), a["vector"]).alias("similarity"), (-a["anchor_ord"]).alias("first"), a["anchor"].alias("anchor")))).alias("_a"))
    return scored.groupBy(key, "_a.cat_ord").agg(F.max(F.struct("_a.similarity", "_a.first", "_a.anchor")).alias("_m")).select(key, "cat_ord", F.col("_m.anchor").alias("anchor"), F.col("_m.similarity").alias("similarity"))


DETECTORS: dict[str, Callable[..., DataFrame]] = {"lexical": lexical, "fuzzy": fuzzy, "linguistic": linguistic}


def detect(sentences: DataFrame, config: Config, keys: Sequence[str], detectors: Sequence[str | Callable[..., DataFrame]] = tuple(DETECTORS)) -> DataFrame:
    """Evidence of all detectors, united; a detector of one's own is a function (sentences, config, keys) -> evidence."""
    one_pass = tuple(d for d in detectors if d in ("lexical", "linguistic"))
    frames = [exact(sentences, config, keys, one_pass)] if one_pass else []
    frames += [(DETECTORS[d] if isinstance(d, str) else d)(sentences, config, keys) for d in detectors if d not in one_pass]
    return reduce(DataFrame.unionByName, frames)


def deduplicate(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of evidence with the same chunk, category, method, trigger and sentence text the best, the first of equals.

    Rows are distributed by the chunk alone; the scores of a chunk's categories then need no further exchange.
    """
    window = Window.partitionBy(*keys, "cat_ord", "method", "trigger", "sentence").orderBy(F.desc("score"), "sentence_index", "method_seq", "term_ord")
    ranked = evidence.repartition(*keys).withColumn("_n", F.row_number().over(window))
    return ranked.where("_n = 1").drop("_n")
