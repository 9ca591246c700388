"""DuckDB SQL of the pipeline's stages, an independent statement of what the plans must compute."""

from __future__ import annotations

from hushlens.functions import plain, text

_B = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789'- ")


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def norm(x: str) -> str:
    source, target, many = text.tables()
    value = f"coalesce({x}, '')"
    for c in many:
        value = f"replace({value}, {quote(c)}, {quote("".join(x if x in KEPT else " " for x in plain.fold(c.lower())))})"
    united = plain.APOSTROPHES + plain.DASHES
    value = f"translate({value}, {quote(united)}, {quote(chr(39) * len(plain.APOSTROPHES) + '-' * len(plain.DASHES))})"
    value = f"translate(lower({value}), {quote(source)}, {quote(target)})"
    return rf"trim(regexp_replace(regexp_replace({value}, '[^a-z0-9\s''-]+', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens(n: str) -> str:
    return f"regexp_extract_all({n}, '[a-z0-9'']+')"


def root(t: str) -> str:
    w = f"regexp_replace({t}, '^''+|''+$', '', 'g')"
    return f"substr(substr({w}, 1, 4) || regexp_replace(substr({w}, 5), '{text.SUFFIX_PATTERN}', ''), 1, {plain.ROOT_LENGTH})"


def roots(t: str) -> str:
    return f"list_transform({t}, lambda t: {root('t')})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def sentence_list(x: str) -> str:
    parts = rf"string_split(regexp_replace(coalesce({x}, ''), '([.!?\n;]){_B}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"


def sentences(table: str = "chunks", key: str = "chunk_key", column: str = "text") -> str:
    """CTEs s (key, sentence_index, sentence, norm, tokens, roots)."""
    return f"""
    s0 as (select {key}, {sentence_list(column)} as l from {table}),
    s1 as (select {key}, unnest(range(len(l))) as sentence_index, unnest(l) as sentence from s0),
    s2 as (select *, {norm('sentence')} as norm from s1),
    s3 as (select *, {tokens('norm')} as tokens from s2),
    s as (select *, {roots('tokens')} as roots from s3)"""


CATEGORIES = f"""
    lx as (select cat_ord, category_key, term_ord, term, norm, {roots(tokens('norm'))} as roots from lexicon),
    cats as (select *, list_transform(context_terms, lambda c: {{'raw': c, 'norm': {norm('c')}}}) as ctx, list_transform(field_hints, lambda c: {{'raw': c, 'norm': {norm('c')}}}) as fld from categories)"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of at most 100 characters, by bits of a HUGEINT."""
    masks = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(length({a})), lambda i: case when substr({a}, i + 1, 1) = c then pow(2, i)::hugeint else 0::hugeint end)), 0)::hugeint)"
    full = f"(pow(2, length({a}))::hugeint - 1)"
    return f"(length({a}) - bit_count(list_reduce({masks}, lambda s, u: ((s + (s & u)) | (s - (s & u))) & {full}, {full})))"


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 1e2 when length({a}) = 0 or length({b}) = 0 then 0e0 else 2e2 * {lcs(a, b)} / (length({a}) + length({b})) end)"


def fuzzy(key: str, threshold: int = 88, delta: int = 1) -> str:
    """CTEs up to best: the most similar run of tokens for every sentence and term, where similar enough.

    Pairs are narrowed by DuckDB's own Levenshtein distance, which is at most the Indel distance, before the ratio is computed.
    Strings whose lengths differ by half count only if one holds the other, or (from 22 characters on) nearly.
    """
    words = tokens("norm")
    inside = f"list_max(list_transform(range(1 - least(la, lb), greatest(la, lb)), lambda k: {ratio('sh', 'substr(lo, greatest(0, k) + 1, least(la, lb) + least(0, k))')}))"
    return f"""
    tm as (select cat_ord, term_ord, term, norm as tn, list_distinct({words}) as tw, array_to_string(list_sort({words}), ' ') as ts, greatest(1, len({words})) as tl, length(replace(norm, ' ', '')) as tc from lx),
    g0 as (select {key}, sentence_index, n, tokens, unnest(range(len(tokens) - n + 1)) as pos from s, (select unnest(range(greatest(1, (select min(tl) from tm) - {delta}), (select max(tl) from tm) + {delta} + 1)) as n) where len(tokens) >= n),
    g as (select {key}, sentence_index, n, pos, array_to_string(tokens[pos + 1 : pos + n], ' ') as gram from g0),
    gd as (select *, length(replace(gram, ' ', '')) as gc, string_split(gram, ' ') as gw, array_to_string(list_sort(string_split(gram, ' ')), ' ') as gs from (select distinct n, gram from g) where length(replace(gram, ' ', '')) >= 4),
    pr as (select *, length(tn) as la, length(gram) as lb, length(tn) + length(gram) as lt, case when length(tn) <= length(gram) then tn else gram end as sh, case when length(tn) <= length(gram) then gram else tn end as lo
           from gd join tm on n between greatest(1, tl - {delta}) and greatest(1, tl + {delta}) and gc >= greatest(4, tc - 2)),
    near as (select *, list_sort(list_intersect(gw, tw)) as bw from pr where greatest(la, lb) < 1.5 * least(la, lb)
             and (levenshtein(tn, gram) <= lt * (1 - {threshold} / 1e2) + 1e-9 or levenshtein(ts, gs) <= lt * (1 - {threshold} / 95e0) + 1e-9 or list_has_any(gw, tw))),
    sets as (select *, array_to_string(bw, ' ') as bo, array_to_string(list_sort(list_filter(list_distinct(gw), lambda w: not list_contains(tw, w))), ' ') as og, array_to_string(list_sort(list_filter(tw, lambda w: not list_contains(gw, w))), ' ') as ot from near),
    joined as (select *, trim(bo || ' ' || ot) as fa, trim(bo || ' ' || og) as fb from sets),
    sim as (
      select n, gram, cat_ord, term_ord, greatest({ratio('tn', 'gram')}, 0.95::double * greatest({ratio('ts', 'gs')},
             case when bo <> '' and (og = '' or ot = '') then 1e2 when bo = '' then {ratio('fa', 'fb')} else greatest({ratio('fa', 'fb')}, 2e2 * length(bo) / (length(bo) + length(fa)), 2e2 * length(bo) / (length(bo) + length(fb))) end)) as similarity from joined
      union all
      select n, gram, cat_ord, term_ord, (case when greatest(la, lb) <= 8 * least(la, lb) then 0.9::double else 0.6::double end) * (case when contains(lo, sh) then 1e2 when length(sh) < 22 then 0e0 else {inside} end) from pr where greatest(la, lb) >= 1.5 * least(la, lb)),
    best as (select {key}, sentence_index, cat_ord, term_ord, gram, similarity from g join sim using (n, gram) where similarity >= {threshold}
             qualify row_number() over (partition by {key}, sentence_index, cat_ord, term_ord order by similarity desc, n, pos) = 1)"""


def evidence(key: str = "chunk_key", with_fuzzy: bool = False) -> str:
    """CTE e: lexical and linguistic evidence, fuzzy evidence if asked for; e1: deduplicated."""
    boost = "round(least(1.0, {base}::double + 0.05::double * len(context_hits) + 0.04::double * len(field_hits)), 4)"
    hits = "list_transform(list_filter(c.{l}, lambda x: contains(s.norm, x.norm)), lambda x: x.raw) as {n}"
    columns = f"s.{key}, s.sentence_index, s.sentence, l.cat_ord, l.term_ord, l.term as trigger, {hits.format(l='ctx', n='context_hits')}, {hits.format(l='fld', n='field_hits')}"
    near, united = "", ""
    if with_fuzzy:
        near = f"""{fuzzy(key)},
    fuz as (select {columns}, 'fuzzy' as method, 1 as method_seq, gram as matched_variant, 'Approximation fuzzy entre ''' || l.term || ''' et ''' || gram || ''' avec une similarite de ' || similarity::varchar || '.' as explanation, similarity
            from best b join s using ({key}, sentence_index) join lx l on l.cat_ord = b.cat_ord and l.term_ord = b.term_ord join cats c on c.cat_ord = l.cat_ord where not contains(s.norm, l.norm)),"""
        united = f" union all select * exclude similarity, {boost.format(base='(similarity / 100 * 0.7::double)')} as score from fuz"
    return f"""{CATEGORIES},{near}
    lex as (select {columns}, 'lexical' as method, 0 as method_seq, l.norm as matched_variant, 'Correspondance lexicale exacte du terme ''' || l.term || ''' dans la phrase.' as explanation
            from s join lx l on contains(s.norm, l.norm) join cats c on c.cat_ord = l.cat_ord),
    lin as (select {columns}, 'linguistic' as method, 2 as method_seq, array_to_string(l.roots, ' ') as matched_variant,
                   'Correspondance linguistique par racines/lemmes pour ''' || l.term || ''' avec les racines detectees [' ||
                   array_to_string(list_transform(l.roots, lambda r: case when contains(r, '''') then '"' || r || '"' else '''' || r || '''' end), ', ') || '].' as explanation
            from s join lx l on not contains(s.norm, l.norm) and list_has_all(s.roots, l.roots) join cats c on c.cat_ord = l.cat_ord),
    e as (select *, {boost.format(base='0.62')} as score from lex union all select *, {boost.format(base='0.52')} as score from lin{united}),
    e1 as (select * from e qualify row_number() over (partition by {key}, cat_ord, method, trigger, sentence order by score desc, sentence_index, method_seq, term_ord) = 1)"""


#: Weights where a category names none.
WEIGHTS = {"lexical": 0.4, "fuzzy": 0.25, "linguistic": 0.2, "semantic": 0.3, "presidio": 0.15}


def results(table: str = "chunks", key: str = "chunk_key") -> str:
    """CTEs sc (scores of categories with evidence) and r (all categories of all chunks)."""
    weight = lambda m: f"coalesce(c.weights['{m}'], {WEIGHTS[m]})::double"
    methods = ("lexical", "fuzzy", "linguistic")
    bests = ", ".join(f"max(score) filter (method = '{m}') as best_{m}" for m in methods)
    total = " + ".join(f"case when best_{m} is not null then best_{m} * {weight(m)} else 0 end" for m in methods)
    weights = " + ".join(f"case when best_{m} is not null then {weight(m)} else 0 end" for m in methods)
    top = f"(select {key}, cat_ord, string_agg(method || ' -> ''' || trigger || ''' (' || printf('%.2f', score) || ')', '; ' order by n) as explanation from (select *, row_number() over (partition by {key}, cat_ord order by score desc, method_seq desc, sentence_index, term_ord) as n from e1) where n <= 3 group by 1, 2)"
    return f"""
    m as (select {key}, cat_ord, {bests}, count(*) as n_evidence from e1 group by 1, 2),
    w as (select m.*, {total} as total, {weights} as weight from m join cats c using (cat_ord)),
    sc as (select *, round(least(1.0, case when weight <> 0 then total / weight else 0 end + least(0.15::double, (n_evidence - 1) * 0.03::double)), 4) as score from w),
    x as {top},
    r as (select t.*, c.cat_ord, c.key as category_key, c.label as category_label, coalesce(sc.score, 0.0)::double as score, coalesce(sc.n_evidence, 0) as n_evidence, coalesce(x.explanation, 'Aucune evidence significative.') as explanation,
                 case when coalesce(sc.score, 0) >= coalesce(c.thresholds['alert'], 0.75) then 'alert' when coalesce(sc.score, 0) >= coalesce(c.thresholds['review'], 0.45) then 'review' else 'clear' end as decision
          from {table} t cross join cats c left join sc on sc.{key} = t.{key} and sc.cat_ord = c.cat_ord left join x on x.{key} = t.{key} and x.cat_ord = c.cat_ord)"""


def pipeline(select: str, table: str = "chunks", key: str = "chunk_key", with_fuzzy: bool = False) -> str:
    return f"with {sentences(table, key)}, {evidence(key, with_fuzzy)}, {results(table, key)} {select}"
