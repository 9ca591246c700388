"""The registered queries of the core and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlens.config import MAX_CATEGORIES, Config, from_table
from hushlens.functions import text as T
from hushlens.operators import analytics, detect, score
from hushlens.operators.report import FINDINGS
from hushlens.plans import sql
from hushlens.plans.pipeline import Analysis, offsets, sentences
from hushlens.sources import files, reports
from hushlens.sources.tables import kept, read_table, widened

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("chunk_key",)
#: The detectors SQL can state; evidence_fuzzy and full_decisions have all.
EXACT = ("lexical", "linguistic")


#: Tables whose texts are worked on.
TEXTS = ("chunks", "sentences", "documents")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = read_table(spark, sf, name)
    return widened(df) if name in TEXTS else df


def config(spark: SparkSession, sf: str) -> Config:
    """Categories of the tables; at most MAX_CATEGORIES rows reach the driver."""
    return from_table(table(spark, sf, "categories").limit(MAX_CATEGORIES + 1).collect())


def analysis(spark: SparkSession, sf: str, detectors=EXACT) -> Analysis:
    return Analysis(table(spark, sf, "chunks"), config(spark, sf), KEYS, detectors=detectors)


def _join(name: str) -> F.Column:
    return F.array_join(name, "|").alias(name)


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_key", T.normalize(F.col("text")).alias("norm"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.tokens(T.normalize(F.col("text")))
    return table(spark, sf, "chunks").select("chunk_key", tokens.alias("t")).select("chunk_key", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def token_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """How often each run of 1 to 3 tokens occurs in the normalised sentences."""
    rows = table(spark, sf, "sentences").select(F.explode(T.ngrams(F.col("tokens"), 1, 3)).alias("g")).select("g.n", "g.gram")
    return rows.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("times"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_key", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_key", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


def root_forms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "sentences").select(F.explode("tokens").alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("times")).select("token", T.root(F.col("token")).alias("root"), "times")


def lexicon_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Terms then synonyms, each once, with their normalised form."""
    rows = table(spark, sf, "categories").select("cat_ord", F.col("key").alias("category_key"), F.posexplode(F.array_distinct(F.concat("terms", "synonyms"))).alias("term_ord", "term"))
    rows = rows.withColumn("norm", T.normalize(F.col("term")))
    return rows.where("norm <> ''").withColumn("roots", F.array_join(T.roots(T.tokens(F.col("norm"))), " "))


def context_field_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with their hits and boost in every category that has any."""
    c = config(spark, sf)
    rows = sentences(table(spark, sf, "chunks"), c, KEYS).select("chunk_key", "sentence_index", "norm", F.explode(F.array(*(F.lit(x.cat_ord) for x in c.categories))).alias("cat_ord"))
    rows = detect.with_hits(rows, c).where((F.size("context_hits") > 0) | (F.size("field_hits") > 0))
    return rows.select("chunk_key", "sentence_index", "cat_ord", _join("context_hits"), _join("field_hits"), detect.boosted(F.lit(0.5), F.col("context_hits"), F.col("field_hits")).alias("boosted"))


_EVIDENCE = ("chunk_key", "sentence_index", "cat_ord", "term_ord", "method", "score", "trigger", "matched_variant", "sentence", "explanation")


def _shown(evidence: DataFrame) -> DataFrame:
    return evidence.select(*_EVIDENCE, _join("context_hits"), _join("field_hits"))


def _detected(method: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        c = config(spark, sf)
        rows = sentences(table(spark, sf, "chunks"), c, KEYS)
        return _shown(detect.DETECTORS[method](kept(rows) if method == "fuzzy" else rows, c, KEYS))

    return query


def evidence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(analysis(spark, sf).evidence)


def method_scores(spark: SparkSession, sf: str) -> DataFrame:
    return score.method_scores(analysis(spark, sf).evidence, KEYS)


def category_scores(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).scores.select("chunk_key", "cat_ord", "score", "n_evidence")


_RESULT = ("chunk_key", "cat_ord", "category_key", "score", "n_evidence", "decision")


def category_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).results.select(*_RESULT)


def top3_explanation(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).results.select("chunk_key", "cat_ord", "explanation")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).findings.select("chunk_key", *FINDINGS)


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf).summary


def full_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors, the fuzzy one included."""
    return analysis(spark, sf, tuple(detect.DETECTORS)).results.select(*_RESULT)


def full_findings(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf, tuple(detect.DETECTORS)).findings.select("chunk_key", *FINDINGS)


def full_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analysis(spark, sf, tuple(detect.DETECTORS)).summary


def document_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The same analysis over rows of a table, each a chunk of its own."""
    a = Analysis(table(spark, sf, "documents").select("doc_id", "text"), config(spark, sf), ("doc_id",), detectors=EXACT)
    return a.results.select("doc_id", "cat_ord", "category_key", "score", "n_evidence", "decision")


def audit_overview(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.overview(analysis(spark, sf).audit)


def first_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.first_flagged(analysis(spark, sf).audit.drop("chunk_key")).select("text_id", "metadata.file_path", F.size("categories").alias("n_categories"))


def decision_log_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.decision_log_counts(analysis(spark, sf).audit)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "article9_findings")


def _counted(column: str) -> Query:
    return lambda spark, sf: analytics.count_by(_stored(spark, sf), column)


def pivot_file_category(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.pivot_file_category(_stored(spark, sf), [c.label for c in config(spark, sf).categories])


def top20_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).orderBy(F.desc_nulls_last("category_score"), F.desc_nulls_last("raw_score"), "finding_id").limit(20).select("finding_id", "file_name", "category_score", "raw_score")


def alerts_only(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).where("decision = 'alert'").select("finding_id", "file_name", "entity_name", "category_score")


def review_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).where("decision = 'review' and method = 'fuzzy'").select("finding_id", "file_name", "matched_text", "matched_variant", "raw_score")


def focus_file(spark: SparkSession, sf: str) -> DataFrame:
    """All findings of the file that has most."""
    rows = _stored(spark, sf).where("file_name is not null")
    return rows.join(F.broadcast(analytics.top_file(rows).select("file_name")), "file_name").select("finding_id", "file_name", "entity_name", "method", "category_score")


def evidence_semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with its nearest anchor; the anchors are the first vector of each label (10 labels), of unit length."""
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(detect.dot(F.col("embedding"), F.col("embedding"))))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", unit.alias("v"))
    anchors = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("vector")).select(F.lit(0).alias("cat_ord"), F.col("label").alias("anchor_ord"), F.col("label").cast("string").alias("anchor"), "vector")
    near = detect.nearest_anchor(rows, anchors, "vec_id", "v")
    return near.select("vec_id", "anchor", F.round("similarity", 4).alias("similarity"))


def sentence_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return offsets(table(spark, sf, "chunks"), KEYS)


def letter_counts(text: F.Column) -> F.Column:
    """A unit vector of how often each letter occurs: a stand-in for a sentence model, which SQL can state too."""
    counts = F.transform(F.array(*map(F.lit, LETTERS)), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, n: s + n * n))
    return F.transform(F.array(counts), lambda v: F.transform(v, lambda n: F.coalesce(F.try_divide(n, norm(v)), F.lit(0.0))))[0]


LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Two sentences with nearly the same letters.
LETTERS_ALIKE = 0.93


def evidence_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """The semantic detector with the stand-in encoder."""
    c = config(spark, sf).with_(semantic={"enabled": True, "similarity_threshold": LETTERS_ALIKE})
    rows = sentences(table(spark, sf, "chunks"), c, KEYS)
    return detect.semantic(rows, c, KEYS, letter_counts).select("chunk_key", "sentence_index", "cat_ord", "trigger", F.round("similarity", 3).alias("similarity"), F.round("score", 3).alias("score"))


def _folder(spark: SparkSession, sf: str, name: str) -> str:
    """A folder of this run for what a query writes and reads again: in the shared folder of spark.checkpoint.dir, where one is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{shared.rstrip('/')}/hushlens-{spark.sparkContext.applicationId}/{Path(sf).name}/{name}"


def _reports(spark: SparkSession, sf: str) -> dict[str, str]:
    return reports.write_reports(analysis(spark, sf), _folder(spark, sf, "reports"))


def written_findings_csv(spark: SparkSession, sf: str) -> DataFrame:
    return reports.read_findings(spark, _reports(spark, sf)["findings_csv"])


def written_findings_json(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(reports.FINDINGS_SCHEMA).json(_reports(spark, sf)["findings_json"])


def written_summary_csv(spark: SparkSession, sf: str) -> DataFrame:
    return reports.read_summary(spark, _reports(spark, sf)["summary_csv"])


def written_audit_json(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.overview(reports.read_audit(spark, _reports(spark, sf)["audit_json"]))


#: Files a table is written to for reading it as a directory.
FILES = 64


def _as_files(spark: SparkSession, sf: str, form: str, *columns: str) -> DataFrame:
    """The chunks written as FILES files of one form, by key, and read again as a directory: bucket and text of each file."""
    rows = table(spark, sf, "chunks").where("text is not null").withColumn("bucket", F.pmod("chunk_key", F.lit(FILES)))
    rows = rows.repartition(FILES, "bucket").sortWithinPartitions("bucket", "chunk_key").select("bucket", *columns)
    folder = _folder(spark, sf, form)
    rows.write.mode("overwrite").partitionBy("bucket").options(**({"header": True, "escape": '"'} if form == "csv" else {})).format(form).save(folder)
    got = files.read_directory(spark, folder)
    return got.select(F.regexp_extract("file_path", "bucket=(\\d+)", 1).cast("long").alias("bucket"), "file_type", F.md5("text").alias("md5"))


def files_text(spark: SparkSession, sf: str) -> DataFrame:
    return _as_files(spark, sf, "text", "text")


def files_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _as_files(spark, sf, "csv", "chunk_key", "file_name", "chunk_id")


def queries() -> dict[str, Query]:
    plain = (
        normalize_text, tokenize, token_ngrams, sentence_split, sentence_counts, root_forms, lexicon_flatten, context_field_hits, evidence_dedup, method_scores,
        category_scores, category_decisions, top3_explanation, findings, summary, full_decisions, full_findings, full_summary, document_decisions, audit_overview,
        first_flagged, sentence_offsets, evidence_semantic, written_findings_csv, written_findings_json, written_summary_csv, written_audit_json, files_text, files_csv, decision_log_counts, pivot_file_category, top20_findings, alerts_only, review_fuzzy, focus_file, evidence_semantic_topk,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {f"evidence_{m}": _detected(m) for m in detect.DETECTORS}
    out |= {"count_by_category": _counted("category_label"), "count_by_file": _counted("file_name"), "count_by_decision": _counted("decision"), "count_by_method": _counted("method")}
    return out


def oracle_sql() -> dict[str, str]:
    s = f"with {sql.sentences()}"
    se = f"{s}, {sql.evidence()}"
    shown = "chunk_key, sentence_index::int as sentence_index, cat_ord, term_ord, method, score, trigger, matched_variant, sentence, explanation, array_to_string(context_hits, '|') as context_hits, array_to_string(field_hits, '|') as field_hits"
    result = "{key}, cat_ord, category_key, score, n_evidence, decision"
    flagged = "select {key}, cat_ord, category_label, category_key, score as category_score, decision, file_name, file_path, file_type, chunk_id, page_number from r where decision <> 'clear'"
    hit = "list_transform(list_filter(c.{l}, lambda x: contains(s.norm, x.norm)), lambda x: x.raw)"
    counted = "select {c}, count(*) as n from article9_findings group by 1"
    log = "linguistics_backend:regex | fuzzy:disabled_or_unavailable | semantic:network_disabled | semantic:disabled_config"
    letters = "list_transform(string_split('" + LETTERS + "', ''), lambda k: length({x}) - length(replace({x}, k, '')))"
    unit_of = "list_transform({c}, lambda q: case when list_sum({c}) > 0 then q / sqrt(list_sum(list_transform({c}, lambda m: m * m))) else 0e0 end)"
    unit = "list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))))"
    finding_rows = f"select chunk_key, f.file_name, f.file_path, f.file_type, f.chunk_id, f.page_number, null::int as line_number, f.category_key as entity_name, f.category_label, method, trigger as matched_text, matched_variant, e1.score as raw_score, e1.score as adjusted_score, category_score, decision, array_to_string(context_hits, '|') as context_hits, array_to_string(field_hits, '|') as field_hits, sentence as excerpt, explanation from e1 join ({flagged.format(key='chunk_key')}) f using (chunk_key, cat_ord)"
    audit_rows = f"select concat_ws(':', file_name, chunk_id) as text_id, file_path, chunk_id, coalesce(string_agg(category_key || ':' || decision, ' | ' order by cat_ord) filter (decision <> 'clear'), '') as active_categories, '{log}' as decision_log from r group by chunk_key, file_name, file_path, chunk_id"
    summary_rows = "select min(file_name) as file_name, file_path, min(file_type) as file_type, 'ok' as status, count(distinct chunk_key) as chunk_count, coalesce(sum(n_evidence) filter (decision <> 'clear'), 0)::bigint as finding_count, round(coalesce(max(score) filter (decision <> 'clear'), 0.0), 4)::double as max_score, case max(case decision when 'alert' then 2 when 'review' then 1 else 0 end) when 2 then 'alert' when 1 then 'review' else 'clear' end as max_risk_level, coalesce(array_to_string(list_sort(list(distinct category_key || ':' || printf('%.2f', score)) filter (decision <> 'clear')), '|'), '') as top_categories, '' as error_message from r group by file_path"
    return {
        "normalize_text": f"select chunk_key, {sql.norm('text')} as norm from chunks",
        "tokenize": f"with n as (select chunk_key, {sql.tokens(sql.norm('text'))} as t from chunks) select chunk_key, len(t)::int as n_tokens, array_to_string(t, ' ') as tokens from n",
        "token_ngrams": "with g as (select n::int as n, unnest(list_transform(range(1, len(tokens) - n + 2), lambda i: array_to_string(tokens[i : i + n - 1], ' '))) as gram from sentences, range(1, 4) t(n)) select n, gram, count(*) as times from g group by 1, 2",
        "sentence_split": f"with {sql.sentences()} select chunk_key, sentence_index::int as sentence_index, sentence from s",
        "sentence_counts": f"select chunk_key, len({sql.sentence_list('text')})::int as n_sentences from chunks",
        "root_forms": f"with t as (select unnest(tokens) as token from sentences) select token, {sql.root('token')} as root, count(*) as times from t group by 1",
        "lexicon_flatten": f"with {sql.CATEGORIES} select cat_ord, category_key, term_ord, term, norm, array_to_string(roots, ' ') as roots from lx",
        "context_field_hits": f"{s}, {sql.CATEGORIES}, h as (select chunk_key, sentence_index::int as sentence_index, cat_ord, {hit.format(l='ctx')} as a, {hit.format(l='fld')} as b from s cross join cats c) select chunk_key, sentence_index, cat_ord, array_to_string(a, '|') as context_hits, array_to_string(b, '|') as field_hits, round(least(1.0, 0.5::double + 0.05::double * len(a) + 0.04::double * len(b)), 4) as boosted from h where len(a) + len(b) > 0",
        "evidence_lexical": f"{se} select {shown} from e where method = 'lexical'",
        "evidence_linguistic": f"{se} select {shown} from e where method = 'linguistic'",
        "evidence_dedup": f"{se} select {shown} from e1",
        "method_scores": f"{se} select chunk_key, cat_ord, method, max(score) as method_score from e1 group by 1, 2, 3",
        "category_scores": sql.pipeline("select chunk_key, cat_ord, score, n_evidence from sc"),
        "evidence_fuzzy": f"{s}, {sql.evidence(with_fuzzy=True)} select {shown} from e where method = 'fuzzy'",
        "full_decisions": sql.pipeline(f"select {result.format(key='chunk_key')} from r", with_fuzzy=True),
        "full_findings": sql.pipeline(finding_rows, with_fuzzy=True),
        "full_summary": sql.pipeline(summary_rows, with_fuzzy=True),
        "sentence_offsets": f"with recursive c as (select chunk_key, text, {sql.sentence_list('text')} as l from chunks), o as (select chunk_key, 0 as i, instr(text, l[1]) - 1 as a from c where len(l) > 0 union all select o.chunk_key, i + 1, a + length(l[i + 1]) + instr(substr(text, a + length(l[i + 1]) + 1), l[i + 2]) - 1 from o join c using (chunk_key) where i + 1 < len(l)) select chunk_key, i::int as sentence_index, a::int as start_char, (a + length(l[i + 1]))::int as end_char from o join c using (chunk_key)",
        "evidence_semantic": f"{s}, {sql.CATEGORIES}, an0 as (select c.cat_ord, ord, a as trigger, {letters.format(x='a')} as n from cats c, unnest(c.semantic_anchors) with ordinality u(a, ord)), an as (select *, {unit_of.format(c='n')} as w from an0), v0 as (select chunk_key, sentence_index, norm, {letters.format(x='sentence')} as n from s), v as (select *, {unit_of.format(c='n')} as v from v0), d as (select chunk_key, sentence_index, norm, cat_ord, trigger, ord, list_sum(list_transform(range(1, 27), lambda i: v[i] * w[i])) as d from v cross join an), b as (select * from d qualify row_number() over (partition by chunk_key, sentence_index, cat_ord order by d desc, ord) = 1) select chunk_key, sentence_index::int as sentence_index, b.cat_ord, trigger, round(round(d, 4), 3) as similarity, round(round(least(1.0, d + 0.05::double * len(list_filter(c.ctx, lambda x: contains(norm, x.norm))) + 0.04::double * len(list_filter(c.fld, lambda x: contains(norm, x.norm)))), 4), 3) as score from b join cats c using (cat_ord) where d >= {LETTERS_ALIKE}::double",
        "written_findings_csv": "select * replace (nullif(context_hits, '') as context_hits, nullif(field_hits, '') as field_hits) from (" + sql.pipeline(finding_rows.replace("select chunk_key, ", "select ", 1)) + ")",
        "written_findings_json": sql.pipeline(finding_rows.replace("select chunk_key, ", "select ", 1)),
        "written_summary_csv": f"select * replace (nullif(top_categories, '') as top_categories, null as error_message) from ({sql.pipeline(summary_rows)})",
        "written_audit_json": sql.pipeline(audit_rows),
        "files_text": f"select chunk_key % {FILES} as bucket, '.txt' as file_type, md5(replace(replace(string_agg(text || chr(10), '' order by chunk_key), chr(13) || chr(10), chr(10)), chr(13), chr(10))) as md5 from chunks where text is not null group by 1",
        "files_csv": f"with n as (select *, chunk_key % {FILES} as bucket, row_number() over (partition by chunk_key % {FILES} order by chunk_key) as k from chunks where text is not null) select bucket, '.csv' as file_type, md5(string_agg('row=' || k || ': chunk_key=' || chunk_key || ', file_name=' || coalesce(file_name, '') || ', chunk_id=' || coalesce(chunk_id, ''), chr(10) order by k)) as md5 from n group by 1",
        "category_decisions": sql.pipeline(f"select {result.format(key='chunk_key')} from r"),
        "document_decisions": sql.pipeline(f"select {result.format(key='doc_id')} from r", "documents", "doc_id"),
        "top3_explanation": sql.pipeline("select chunk_key, cat_ord, explanation from r"),
        "findings": sql.pipeline(finding_rows),
        "summary": sql.pipeline(summary_rows),
        "audit_overview": sql.pipeline(audit_rows),
        "first_flagged": sql.pipeline("select concat_ws(':', file_name, chunk_id) as text_id, file_path, count(*)::int as n_categories from r group by chunk_key, file_name, file_path, chunk_id order by bool_or(decision <> 'clear') desc, file_path, chunk_id limit 1"),
        "decision_log_counts": f"select unnest(string_split('{log}', ' | ')) as entry, (select count(*) from chunks) as n",
        "count_by_category": counted.format(c="category_label"),
        "count_by_file": counted.format(c="file_name"),
        "count_by_decision": counted.format(c="decision"),
        "count_by_method": counted.format(c="method"),
        "pivot_file_category": "select file_name, " + ", ".join(f"count(matched_text) filter (category_label = {sql.quote(x)}) as {chr(34)}{x}{chr(34)}" for x in LABELS) + " from article9_findings group by 1",
        "top20_findings": "select finding_id, file_name, category_score, raw_score from article9_findings order by category_score desc nulls last, raw_score desc nulls last, finding_id limit 20",
        "alerts_only": "select finding_id, file_name, entity_name, category_score from article9_findings where decision = 'alert'",
        "review_fuzzy": "select finding_id, file_name, matched_text, matched_variant, raw_score from article9_findings where decision = 'review' and method = 'fuzzy'",
        "focus_file": "select finding_id, file_name, entity_name, method, category_score from article9_findings where file_name = (select file_name from article9_findings where file_name is not null group by 1 order by count(*) desc, file_name limit 1)",
        "evidence_semantic_topk": f"with u as (select vec_id, label, {unit} as v from embeddings), a as (select label, arg_min(v, vec_id) as w from u group by 1), d as (select vec_id, a.label, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])) as d from u cross join a) select vec_id, label::varchar as anchor, round(d, 4) as similarity from d qualify row_number() over (partition by vec_id order by d desc, label) = 1",
    }


# The labels of the test tables' categories, which name the columns of the pivot.
LABELS = ("Culte et pratique spirituelle", "Etat de santé", "Vie intime", "Engagement civique", "Vie sociale en entreprise", "Traits corporels")
