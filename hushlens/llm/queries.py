"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import canon, mix, mojibake, pack, pii, residue, sentences, split, topn
from .common import small_side, table, texts, union

#: Secret of the pseudonyms in the registered query; a deployment passes its own.
SECRET = "hushlens"
#: Training position of some sources in the registered mix: positive is early.
TILT = {"courriel": 0.4, "courrier": -0.4, "compte_rendu": 0.2}


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_oversized(table(spark, sf, "chunks"), table(spark, sf, "size_limits"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that were cut into pieces within their limit, covering the text in order."""
    pieces = p1_pieces(spark, sf).where("n_pieces > 1")
    whole = F.sum(F.col("end_char") - F.col("start_char") - F.length("piece_text")) == 0
    return pieces.groupBy("chunk_key").agg(whole.alias("whole"), (F.count_distinct("piece_ord") == F.max("n_pieces")).alias("all")).where("whole and all").select("chunk_key")


def p1_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk's text put together again from its pieces."""
    return split.rebuilt(p1_pieces(spark, sf)).select("chunk_key", F.md5("text").alias("md5"))


def p1_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Per file type: chunks, those that were cut, and whether every piece keeps the limit and shares the overlap asked for."""
    limits = table(spark, sf, "size_limits").select(F.lower(F.trim("file_type")).alias("_type"), "max_chars", "overlap_chars")
    chunks = table(spark, sf, "chunks").select("chunk_key", F.lower(F.trim("file_type")).alias("_type"))
    pieces = p1_pieces(spark, sf).select("chunk_key", "piece_ord", "n_pieces", "start_char", "end_char", F.length("piece_text").alias("chars"))
    rows = pieces.join(chunks, "chunk_key").join(small_side(limits), "_type")
    order = Window.partitionBy("chunk_key").orderBy("piece_ord")
    shared = F.lag("end_char").over(order) - F.col("start_char")
    rows = rows.withColumn("kept", ((F.col("n_pieces") == 1) | (F.col("chars") <= F.col("max_chars"))) & F.coalesce(shared == F.col("overlap_chars"), F.col("start_char") == 0) & (F.coalesce("chars", F.lit(0)) == F.col("end_char") - F.col("start_char")))
    return rows.groupBy(F.col("_type").alias("file_type")).agg(F.count_if(F.expr("piece_ord = 0")).alias("chunks"), F.count_if(F.expr("piece_ord = 0 and n_pieces > 1")).alias("cut"), F.every("kept").alias("kept"))


def _both(spark: SparkSession, sf: str, work: Callable[..., DataFrame]) -> DataFrame:
    """One operator over both text columns: tab, row_id and what it gives."""
    out = []
    for name, key, text in (("chunks", "chunk_key", "text"), ("article9_findings", "finding_id", "excerpt")):
        out.append(work(texts(spark, sf, name), key=key, text=text).withColumnRenamed(key, "row_id").withColumn("tab", F.lit(name)))
    return union(out)


def _personal(spark: SparkSession, sf: str, operator: Callable[..., DataFrame], **options) -> DataFrame:
    persons = table(spark, sf, "persons")
    shapes = pii.train(persons)
    return _both(spark, sf, lambda df, key, text: operator(df, shapes, key=key, text=text, secret=SECRET, persons=persons, **options))


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every item with its place and placeholder."""
    return _personal(spark, sf, pii.items).select("tab", "row_id", "pii_type", "start_char", "end_char", "placeholder")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_items(spark, sf).where("placeholder is not null").select("tab", "row_id", "pii_type", "start_char")


def p2_masked(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf, pii.masked).select("tab", "row_id", "masked_text")


def p2_dated(spark: SparkSession, sf: str) -> DataFrame:
    """The masked texts with all dates permuted as well."""
    return _personal(spark, sf, pii.masked, dates=True).select("tab", "row_id", "masked_text")


def p3_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").where(F.lower("file_type").isin(".txt", ".md"))
    return sentences.sentence_units(chunks).select("chunk_key", "start_char", "end_char")


#: Blanks of any kind, in a form that Java and SQL both read.
BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"


def p3_covered(spark: SparkSession, sf: str) -> DataFrame:
    """How many characters that are no blanks lie in the units of every chunk."""
    return p3_units(spark, sf).groupBy("chunk_key").agg(F.sum(F.length(F.regexp_replace("unit_text", BLANK, ""))).alias("chars"))


def _top(spark: SparkSession, sf: str) -> DataFrame:
    findings = table(spark, sf, "article9_findings")
    order = [F.desc_nulls_last("category_score"), F.desc_nulls_last("raw_score"), F.asc("finding_id")]
    return topn.top_n(findings, "file_name", order, 3, salt_by="finding_id", heavy_rows=500, slice_rows=250)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("file_name", "finding_id")


def p4_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("file_name", "finding_id", "category_score", "raw_score", "rank")


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    model = mojibake.train(table(spark, sf, "documents"))
    chunks = mojibake.restore(texts(spark, sf, "chunks"), model, key="chunk_key", text="text")
    findings = mojibake.restore(texts(spark, sf, "article9_findings"), model, key="finding_id", text="excerpt")
    both = chunks.select(F.lit("chunks").alias("tab"), F.col("chunk_key").alias("row_id"), "garbled", "restored", "chain")
    return both.unionAll(findings.select(F.lit("article9_findings"), "finding_id", "garbled", "restored", "chain"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_restored(spark, sf).select("tab", "row_id")


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose form has several spellings, with its class and the representative of its spelling."""
    named = [canon.look_alike_classes(texts(spark, sf, name), key=key).withColumnRenamed(key, "row_id").withColumn("tab", F.lit(name)) for name, key in (("chunks", "chunk_key"), ("sentences", "sentence_id"))]
    return union(named)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [canon.look_alikes(texts(spark, sf, name), key=key).select(F.lit(name).alias("tab"), "id_a", "id_b") for name, key in (("chunks", "chunk_key"), ("sentences", "sentence_id"))]
    return union(pairs)


#: The fields that are brought to one form.
FIELDS = (("chunks", "chunk_key", "text"), ("sentences", "sentence_id", "text"), ("sentences", "sentence_id", "normalized_text"))


def _forms(spark: SparkSession, sf: str, form: Callable[[F.Column], F.Column]) -> DataFrame:
    return union([texts(spark, sf, name).select(F.lit(f"{name}.{text}").alias("field"), F.col(key).alias("row_id"), form(F.col(text)).alias("form")) for name, key, text in FIELDS])


def p6_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return _forms(spark, sf, canon.canonical_text)


def p6_united(spark: SparkSession, sf: str) -> DataFrame:
    """Widths, blanks, invisible characters, hyphens and accents united, letters of other scripts left: what SQL can state."""
    return _forms(spark, sf, lambda t: F.md5(canon.canonical_text(t, alike=False)))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").withColumn("source", mix.source_key(F.col("source")))
    return pack.pack(documents)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that do not fit into one container: what was packed of them lies in several and is larger than one."""
    packed = p7_containers(spark, sf)
    per = packed.where("n_pieces > 1").groupBy("doc_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.where((F.col("containers") > 1) & (F.col("tokens") > pack.CAPACITY)).select("doc_id")


def p7_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """How many characters of every document lie in containers."""
    return p7_containers(spark, sf).groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Containers filled beyond their capacity, places taken twice, texts cut though they fit, and the documents packed."""
    packed = p7_containers(spark, sf)
    loads = packed.groupBy("container").agg(F.sum("tokens").alias("load"), (F.count_distinct("place") < F.count(F.lit(1))).alias("twice"))
    texts = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    left = loads.agg(F.count_if(F.col("load") > pack.CAPACITY).alias("overfull"), F.count_if("twice").alias("twice"))
    right = texts.agg(F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= pack.CAPACITY)).alias("torn"), F.count(F.lit(1)).alias("documents"))
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return pack.fill_report(p7_containers(spark, sf))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), tilt=TILT)[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), tilt=TILT)[1]


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Per source whether the mix keeps its repeats and its share: short only with every record used to its cap, else reached by the last record."""
    chosen, report = mix.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), tilt=TILT)
    per = chosen.groupBy("source").agg(F.sum("tokens").alias("used"), F.max("tokens").alias("largest"), F.max("repeat").alias("most"), F.count(F.lit(1)).alias("records"))
    rows = report.join(per, "source", "left").na.fill(0, ["used", "largest", "most", "records"])
    full = (F.col("records") == F.col("n_rows") * F.col("max_repeats")) & (F.col("used") < F.col("demand"))
    reached = (F.col("used") >= F.col("demand")) & (F.col("used") - F.col("largest") < F.col("demand"))
    return rows.select("source", ((F.col("most") <= F.col("max_repeats")) & F.when(F.col("short"), full).otherwise(reached | (F.col("demand") == 0))).alias("kept"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).where("short").select("source")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(texts(spark, sf, "documents")).select("doc_id")


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    documents = texts(spark, sf, "documents")
    return residue.without_residue(documents, residue.residue(documents)).select("doc_id", "n_chars")


def p9_split(spark: SparkSession, sf: str) -> DataFrame:
    """How often every document is in the residue or in the corpus without it."""
    documents = texts(spark, sf, "documents")
    found = residue.residue(documents)
    both = found.select("doc_id").unionAll(residue.without_residue(documents, found).select("doc_id"))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p1_limits, p2_found, p2_items, p2_masked, p2_dated, p3_found, p3_units, p3_covered, p4_found, p4_ranked, p5_found, p5_restored, p6_found, p6_classes, p6_canonical, p6_united, p7_found, p7_containers, p7_report, p7_rebuilt, p7_kept, p8_found, p8_mix, p8_report, p8_kept, p9_found, p9_clean, p9_split)}


_RANKED = """
    select file_name, finding_id, category_score, raw_score,
           row_number() over (partition by file_name order by category_score desc nulls last, raw_score desc nulls last, finding_id) as rank
    from article9_findings where file_name is not null qualify rank <= 3
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def united(column: str) -> str:
    """SQL of the united form: characters of several letters by a map, single ones by translate(), then composed."""
    one = {k: v for k, v in canon.TABLE.items() if len(v) < 2}
    order = sorted(one, key=lambda k: not one[k])  # what turns into nothing stands beyond the end of the second list
    many = {k: v for k, v in canon.TABLE.items() if len(v) > 1}
    pairs = ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in many.items())
    spelt = f"array_to_string(list_transform(regexp_extract_all({column}, '(?s).'), lambda c: coalesce(map_extract_value(map {{{pairs}}}, c), c)), '')"
    some = f"case when regexp_matches({column}, '[{''.join(many)}]') then {spelt} else {column} end"
    out = f"translate({some}, {_quoted(''.join(order))}, {_quoted(''.join(one[k] for k in order))})"
    return f"nfc_normalize({out})"


def oracle_sql() -> dict[str, str]:
    return {
        "p6_united": " union all ".join(f"select '{name}.{text}' as field, {key} as row_id, md5({united(text)}) as form from {name}" for name, key, text in FIELDS),
        "p1_found": "select chunk_key from chunks c join size_limits s on lower(trim(c.file_type)) = lower(trim(s.file_type)) where length(text) > max_chars",
        "p1_rebuilt": "select chunk_key, md5(text) as md5 from chunks",
        "p1_limits": "select lower(trim(c.file_type)) as file_type, count(*) as chunks, count(*) filter (length(text) > max_chars) as cut, true as kept from chunks c join size_limits s on lower(trim(c.file_type)) = lower(trim(s.file_type)) group by 1",
        "p4_found": f"select file_name, finding_id from ({_RANKED})",
        "p3_covered": f"select chunk_key, length(regexp_replace(text, '{BLANK}', '', 'g')) as chars from chunks where regexp_replace(text, '{BLANK}', '', 'g') <> ''",
        "p9_split": "select doc_id, 1 as times from documents",
        "p7_rebuilt": "select doc_id, coalesce(length(text), 0) as chars from documents",
        "p7_kept": "select 0 as overfull, 0 as twice, 0 as torn, count(*) as documents from documents",
        "p8_kept": "select source, true as kept from mix_targets",
        "p4_ranked": f"select file_name, finding_id, category_score, raw_score, cast(rank as integer) as rank from ({_RANKED})",
    }
