"""SQL (DuckDB's) of the queries over traces: chunks, pools, BM25, contexts, metrics, quality, faults and their analysis."""

from __future__ import annotations

import math

from ..functions import text as T
from ..operators import faults, quality, stats

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({}, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
COUNT = r"greatest(1, len(regexp_extract_all({}, '\S+')))"
BLANK = r"(trim(coalesce({}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '')"
FORM = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
READABLE = "(length(regexp_replace({}, '" + r"[^\p{{L}}\p{{N}}_\s.,!?;:''\"()\-\x{{0400}}-\x{{04ff}}]" + "', '', 'g')) / length({}) > 0.7)"
CUT = "regexp_matches({}, '" + "|".join(T.CUT_SHORT) + "')"
REFUSED = "regexp_matches(lower({}), '" + "|".join(T.REFUSALS) + "')"
MARKED = r"regexp_matches({}, '(?i)(?:\.\.\.|…|\[TRUNCATED\]|\[\.\.\.\])\s*$')"


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tokens(text: str, lang: str = "lang") -> str:
    """Metric tokens of a text in a language."""
    own = WORDS.format(text)
    cases = " ".join(f"when {lang} = '{code}' then list_filter({own}, lambda w: not list_contains({quoted(list(stop))}, w))" for code, stop in T.STOP_WORDS.items())
    return f"(case {cases} else {own} end)"


def distinct_tokens(text: str, lang: str = "lang") -> str:
    return f"list_sort(list_distinct({tokens(text, lang)}))"


#: Chunks of documents, names as prefix || doc_id.
CHUNKS = r"""
sent as (select doc_id, unnest(s) as s, generate_subscripts(s, 1) as k from (
    select doc_id, regexp_extract_all(text, '(?s).*?(?:[.!?。！？…]+["'')\]]*\s+|\n+)|.+') as s from documents where text is not null) q),
placed as (select *, sum(length(s)) over (partition by doc_id order by k) - length(s) as pos, greatest(1, len(regexp_extract_all(s, '\S+'))) as n from sent),
parted as (select *, case when n > 400 then regexp_extract_all(s, '\S+\s*') else [] end as w from placed),
word as (select doc_id, k, unnest(w) as w, generate_subscripts(w, 1) as j, pos + length(s) - length(regexp_replace(s, '^\s+', '')) as base from parted where len(w) > 0),
atoms as (
    select doc_id, k, 0 as j, pos as a, pos + length(s) as b, n as t from parted where len(w) = 0
    union all select doc_id, k, j, base + sum(length(w)) over (partition by doc_id, k order by j) - length(w), base + sum(length(w)) over (partition by doc_id, k order by j), 1 from word),
arr as (select doc_id, list(a order by k, j) as a, list(b order by k, j) as b, list_concat([0::hugeint], list(cum order by k, j)) as total, count(*) as m
    from (select *, sum(t) over (partition by doc_id order by k, j) as cum from atoms) q group by doc_id),
win as (
    select doc_id, 0 as c, 0::bigint as i, greatest(1, len(list_filter(total, lambda x: x <= 400)) - 1)::bigint as j from arr
    union all
    select doc_id, c + 1, ni, greatest(ni + 1, len(list_filter(total, lambda x: x <= total[ni + 1] + 400)) - 1)::bigint from (
        select win.doc_id, c, total, greatest(i + 1, len(list_filter(total, lambda x: x <= total[j + 1] - 80)) - 1)::bigint as ni from win join arr using (doc_id) where j < m) q),
chunks as (select doc_id, c as chunk_index, '{prefix}' || doc_id || '__chunk_' || printf('%03d', c) as chunk_id, a[i + 1]::int as start_char, b[j]::int as end_char,
    substr(text, (a[i + 1] + 1)::bigint, (b[j] - a[i + 1])::bigint) as text from win join arr using (doc_id) join documents using (doc_id))"""

#: Samples, their pools, ranked chunks, contexts and gold, as plans.traces builds them.
TRACES = (
    CHUNKS.replace("{prefix}", "doc_")
    + ", samples as (select doc_id, 'sample_' || doc_id as sample_id, lang, text as body, s[1] as question, s[len(s) // 2 + 1] as gold_text from (select doc_id, lang, text, " + SENTENCES.format("text") + " as s from documents where doc_id is not null and text is not null) q where len(s) > 0),"
    " pool as (select p.doc_id as sample, c.doc_id as src, c.chunk_index, (c.doc_id <> p.doc_id) as far, c.chunk_id, c.text, " + WORDS.format("c.text") + " as w from samples p join chunks c on c.doc_id = p.doc_id or c.doc_id = p.doc_id + 1),"
    " stat as (select sample, count(*) as n, avg(len(w)) as avgdl from pool group by 1 having avg(len(w)) > 0),"
    " tf as (select sample, chunk_id, len(w) as dl, term, count(*) as tf from (select sample, chunk_id, w, unnest(w) as term from pool) q group by all),"
    " df as (select sample, term, count(*) as df from tf group by all),"
    " raw as (select df.*, ln(n - df + 0.5) - ln(df + 0.5) as r, avgdl from df join stat using (sample)),"
    " idf as (select sample, term, avgdl, case when r < 0 then 0.25 * avg(r) over (partition by sample) else r end as idf from raw),"
    " asked as (select sample, term, count(*) as times from (select doc_id as sample, unnest(" + WORDS.format("question") + ") as term from samples) q group by all),"
    " sums as (select sample, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from tf join asked using (sample, term) join idf using (sample, term) group by all),"
    " ranked as (select pool.*, coalesce(s, 0) as score, row_number() over (partition by sample order by round(coalesce(s, 0), 9) desc, far, chunk_index) as rank from pool join stat using (sample) left join sums using (sample, chunk_id)),"
    " top as (select * from ranked where rank <= 5),"
    " ctx as (select doc_id as sample, 0::bigint as r, []::varchar[] as seen, []::varchar[] as selected, []::varchar[] as dropped, []::varchar[] as repeated, []::varchar[] as parts, 0::bigint as tokens from samples"
    " union all select sample, r + 1, case when once_more then seen else list_append(seen, key) end, case when once_more or over_it then selected else list_append(selected, chunk_id) end, case when over_it and not once_more then list_append(dropped, chunk_id) else dropped end,"
    " case when once_more then list_append(repeated, chunk_id) else repeated end, case when once_more or over_it then parts else list_append(parts, piece) end, case when once_more or over_it then tokens else tokens + cost end from ("
    " select *, len(selected) > 0 and tokens + cost > 3000 as over_it from (select *, list_contains(seen, key) as once_more, " + COUNT.format("piece") + " as cost from ("
    " select ctx.*, top.chunk_id, " + FORM.format("top.text") + " as key, '[' || (len(selected) + 1) || '] (source: doc_' || top.src || ')' || chr(10) || top.text as piece from ctx join top on top.sample = ctx.sample and top.rank = ctx.r + 1) a) b) c),"
    " made as (select *, array_to_string(parts, chr(10) || chr(10)) as context from ctx qualify row_number() over (partition by sample order by r desc) = 1),"
    " gold as (select *, gs + length(gold_text) as ge from (select doc_id as sample, gold_text, nullif(instr(body, gold_text), 0) - 1 as gs from samples) q),"
    " covered as (select gold.sample, any_value(gold_text) as gold_text, any_value(gs) as gs, any_value(ge) as ge, coalesce(list(c.chunk_id order by c.chunk_index) filter (c.chunk_id is not null), []) as covering,"
    " coalesce(bool_or(c.start_char <= gs and ge <= c.end_char), false) as preserved from gold left join chunks c on c.doc_id = gold.sample and c.start_char < ge and gs < c.end_char group by gold.sample),"
    " found as (select sample, list(chunk_id order by rank) as ids, list(text order by rank) as texts, list('doc_' || src order by rank) as sources from top group by sample),"
    " held as (select sample, list(chunk_id order by far, chunk_index) as known from pool group by sample),"
    " traces as (select 'sample_' || doc_id || '__documents_bm25_v1' as trace_id, doc_id as sample, lang, question as query, g.gold_text as answer, g.gold_text, covering, preserved, coalesce(ids, []) as ids, coalesce(texts, []) as texts, coalesce(sources, []) as sources,"
    " coalesce(known, []) as known, selected, dropped, repeated, context, len(dropped) > 0 as truncated, covering as gold from samples join covered g on g.sample = doc_id join made m on m.sample = doc_id left join found f on f.sample = doc_id left join held h on h.sample = doc_id)"
)

_GOLD = "list_sort(list_distinct(gold))"
_SEL = "list_sort(list_distinct(selected))"


def metrics(source: str, key: str = "trace_id") -> str:
    """CTEs that end in `results` (key, metric_name, stage, score, label, status, warnings, error) of the rows of a table with
    the columns of `traces`."""
    return f"""
facts as (select *, {_GOLD} as g, {_SEL} as sel, list_filter(ids[1:5], lambda x: list_contains(gold, x)) as hits, ids[1:5] as got, {BLANK.format("query")} or {BLANK.format("answer")} as mute, {BLANK.format("context")} or {BLANK.format("answer")} as dumb,
    {distinct_tokens("query")} as qt, {distinct_tokens("answer")} as atk, {distinct_tokens("context")} as ct, {SENTENCES.format("answer")} as ss from {source}),
more as (select *, len(list_intersect(g, sel)) as common, len(list_intersect(qt, atk)) as shared,
    len(list_filter(list_transform(ss, lambda s: {distinct_tokens("s")}), lambda t: len(t) > 0 and len(list_intersect(t, ct)) / len(t) >= 0.5)) as told,
    len(list_filter(texts, lambda t: {BLANK.format("t")} or {MARKED.format("t")})) as bad from facts),
results as (
    select {key}, 'retrieval.hit_at_k' as metric_name, 'retrieval' as stage, case when len(g) > 0 then (len(hits) > 0)::int::double end as score, case when len(g) = 0 then 'unknown' when len(hits) > 0 then 'hit' else 'miss' end as label,
        case when len(g) = 0 then 'skipped' else 'ok' end as status, case when len(g) = 0 then 'no_gold_evidence' else '' end as warnings, null::varchar as error from more
    union all select {key}, 'retrieval.recall_at_k', 'retrieval', case when len(g) > 0 then len(list_distinct(hits)) / len(g) end, case when len(g) = 0 then 'unknown' when len(list_distinct(hits)) = len(g) then 'complete' when len(hits) > 0 then 'partial' else 'miss' end,
        case when len(g) = 0 then 'skipped' else 'ok' end, case when len(g) = 0 then 'no_gold_evidence' else '' end, null from more
    union all select {key}, 'retrieval.precision_at_k', 'retrieval', case when len(g) > 0 and len(got) > 0 then len(hits) / len(got) end,
        case when len(g) = 0 or len(got) = 0 then 'unknown' when len(hits) / len(got) >= 0.8 then 'high' when len(hits) > 0 then 'partial' else 'none' end,
        case when len(g) = 0 then 'skipped' when len(got) = 0 then 'error' else 'ok' end, case when len(g) = 0 then 'no_gold_evidence' else '' end, case when len(g) > 0 and len(got) = 0 then 'empty_retrieval' end from more
    union all select {key}, 'retrieval.mrr', 'retrieval', case when len(g) > 0 then coalesce(1.0::double / list_position(got, hits[1]), 0) end, case when len(g) = 0 then 'unknown' when len(hits) > 0 then 'ranked' else 'miss' end,
        case when len(g) = 0 then 'skipped' else 'ok' end, case when len(g) = 0 then 'no_gold_evidence' else '' end, null from more
    union all select {key}, 'chunking.gold_evidence_preservation', 'chunking', ok::int::double, case when ok then 'complete' else 'lost' end, 'ok', '', null
        from (select *, preserved and len(gold) > 0 and (len(known) = 0 or len(list_intersect(gold, known)) > 0) as ok from more) q
    union all select {key}, 'chunking.chunk_integrity', 'chunking', case when len(texts) > 0 then 1 - bad / len(texts) end, case when len(texts) = 0 then 'unknown' when 1 - bad / len(texts) >= 0.8 then 'intact' when bad < len(texts) then 'degraded' else 'broken' end,
        case when len(texts) = 0 then 'skipped' else 'ok' end, case when len(texts) = 0 then 'no_chunks' else '' end, null from more
    union all select {key}, 'context.evidence_coverage', 'context', case when len(g) > 0 then common / len(g) end, case when len(g) = 0 then 'unknown' when common = len(g) then 'complete' when common > 0 then 'partial' else 'missing' end,
        case when len(g) = 0 then 'skipped' else 'ok' end, case when len(g) = 0 then 'no_gold_evidence' else '' end, null from more
    union all select {key}, 'context.noise_ratio', 'context', case when len(g) > 0 and len(sel) > 0 then (len(sel) - common) / len(sel) end,
        case when len(g) = 0 or len(sel) = 0 then 'unknown' when (len(sel) - common) / len(sel) <= 0.2 then 'low_noise' when (len(sel) - common) / len(sel) <= 0.5 then 'moderate_noise' else 'high_noise' end,
        case when len(g) = 0 or len(sel) = 0 then 'skipped' else 'ok' end, case when len(g) = 0 then 'no_gold_evidence' when len(sel) = 0 then 'no_selected_chunks' else '' end, null from more
    union all select {key}, 'context.context_truncation', 'context', (not truncated)::int::double, case when truncated then 'truncated' else 'not_truncated' end, 'ok', '', null from more
    union all select {key}, 'generation.answer_relevance', 'generation', case when not mute and len(qt) > 0 then shared / len(qt) end,
        case when mute or len(qt) = 0 then 'unknown' when shared / len(qt) >= 0.5 then 'relevant' when shared > 0 then 'weakly_relevant' else 'unrelated' end,
        case when mute or len(qt) = 0 then 'skipped' else 'ok' end, case when mute then 'empty_query_or_answer' when len(qt) = 0 then 'no_valid_query_tokens' else '' end, null from more
    union all select {key}, 'generation.faithfulness', 'generation', case when not dumb and len(ss) > 0 then told / len(ss) end,
        case when dumb or len(ss) = 0 then 'unknown' when told / len(ss) >= 0.8 then 'supported' when told / len(ss) >= 0.5 then 'partially_supported' else 'unsupported' end,
        case when dumb or len(ss) = 0 then 'skipped' else 'ok' end, case when dumb then 'empty_context_or_answer' when len(ss) = 0 then 'no_answer_sentences' else '' end, null from more)"""


def _tag(condition: str, name: str) -> str:
    return f"case when {condition} then ['{name}'] else [] end"


#: Quality tags of `traces`, in the order of the rule groups.
TAGS = (
    "tagged as (select *, list_concat("
    + ", ".join(
        [
            _tag("lang is null", "missing_fields"),
            f"case when {BLANK.format('query')} then ['empty_query'] when length(query) < 3 then ['query_too_short'] when length(query) > 500 then ['query_too_long'] when not {READABLE.format('query', 'query')} then ['unreadable_query'] else [] end",
            f"case when {BLANK.format('answer')} then ['empty_reference_answer'] when length(answer) < 2 then ['answer_too_short'] when not {READABLE.format('answer', 'answer')} then ['unreadable_answer'] else [] end",
            _tag("len(gold) = 0", "gold_evidence_no_chunk_ids"),
            _tag("not preserved", "gold_evidence_lost_in_chunking"),
            "case when len(texts) = 0 then ['no_retrieved_chunks'] else list_filter(list_transform(texts[1:10], lambda t: case when "
            + BLANK.format("t")
            + " then 'empty_retrieved_chunk' when length(t) < 20 then 'chunk_too_short' when "
            + CUT.format("t")
            + " then 'chunk_truncated' else '' end), lambda x: x <> '') end",
            _tag("len(list_distinct(texts)) < len(texts)", "duplicate_retrieved_chunks"),
            f"case when {BLANK.format('context')} then ['empty_final_context'] when length(context) < 50 then ['context_too_short'] when {CUT.format('context')} then ['context_truncated'] else [] end",
            f"case when len(gold) = 0 then [] when len(list_intersect({_GOLD}, {_SEL})) = 0 then ['gold_evidence_not_in_context'] when len(list_intersect({_GOLD}, {_SEL})) < len({_GOLD}) then ['gold_evidence_partial_in_context'] else [] end",
            f"case when {BLANK.format('answer')} then ['empty_generated_answer'] when length(answer) < 2 then ['answer_too_short'] when {CUT.format('answer')} then ['answer_truncated'] else [] end",
            _tag("not " + BLANK.format("answer") + " and " + REFUSED.format("answer"), "possible_safety_refusal"),
            "case when lang = 'en' then [] else ['unsupported_language_' || coalesce(lang, 'None')] end",
        ]
    )
    + ") as tags from traces),"
    f" graded as (select *, case when len(tags) = 0 then 'none' when len(list_intersect(tags, {quoted(quality.HIGH)})) > 0 then 'high' when len(list_intersect(tags, {quoted(quality.MEDIUM)})) > 0 then 'medium' else 'low' end as severity from tagged)"
)

HEALTHY = f"healthy as (select * from traces where len(gold) > 0 and len(list_intersect({_GOLD}, {_SEL})) = len({_GOLD}))"


def number(*parts: str) -> str:
    """What faults.drawn() gives."""
    return "('0x' || substr(md5(" + " || '|' || ".join([f"'{faults.SEED}'", *parts]) + "), 1, 8))::bigint"


def draw(name: str, n: str | int, key: str = "trace_id") -> str:
    return f"({number(repr(name), key)} % ({n}))"


def rebuilt(ids: str, names: str, sources: str, texts: str) -> str:
    """The context of ids whose chunks are in three lists."""
    at = f"list_position({names}, x)"
    return (
        f"array_to_string(list_transform({ids}, lambda x, i: '[' || i || '] (source: ' || coalesce({sources}[{at}], 'unknown') || ')' || chr(10) || coalesce({texts}[{at}], 'Chunk ' || x)), chr(10) || chr(10))"
    )


#: The prompt, written out here as well: it must not follow a slip in operators.generation.
PROMPT = """('You are a question-answering assistant.' || chr(10) || chr(10) || 'Answer the question using only the supplied context.' || chr(10) || 'Do not introduce unsupported facts.' || chr(10)
    || 'If the context is insufficient, explicitly state that the answer' || chr(10) || 'cannot be determined from the provided context.' || chr(10) || chr(10)
    || 'Question:' || chr(10) || query || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:')"""


def faulty(source: str, count: int = 20) -> str:
    """CTEs that end in `faulty`: the traces of a table with each fault in `count` of them, and the method."""
    n = "len(texts)"
    one = f"greatest({n}, 1)"
    number_of = lambda name, *more: number(repr(name), "trace_id", *more)
    rest = "trace_id, sample, lang, gold_text, covering, preserved, known, dropped, repeated, truncated, gold"
    old = "replace(prompt, query, new_query) as prompt"

    def some(fault: str, columns: str = "*") -> str:
        return f"(select {columns} from (select *, {PROMPT} as prompt from {source}) s order by {number("'trace'", repr(fault), 'trace_id')}, trace_id limit {count})"

    def answers(fault: str, values: list[str], method: str) -> str:
        return f"select '{fault}' as fault, '{method}' as method, {rest}, query, {quoted(values)}[{draw(method, len(values))} + 1] as answer, ids, texts, sources, selected, context, prompt from {some(fault)} t"

    marks = ", ".join(f"coalesce(nullif(instr(part, '{m}'), 0) + low, 0)" for m in (". ", "! ", "? ", ", ", "; "))
    garbage = faults.GARBAGE.replace("'", "''")
    short = lambda share: f"substr(query, 1, floor(length(query) * {share})::bigint) || '...'"
    return f"""
f1 as (select *, list_filter(ids, lambda x, i: sources[i] = 'doc_' || sample) as gone, list_filter(ids, lambda x, i: sources[i] <> 'doc_' || sample) as ids2, list_filter(texts, lambda x, i: sources[i] <> 'doc_' || sample) as texts2,
    list_filter(sources, lambda x: x <> 'doc_' || sample) as sources2 from {some('missing_evidence')} t),
f1b as (select *, list_filter(selected, lambda x: not list_contains(gone, x)) as selected2 from f1),
f2 as (select *, texts[k + 1] as t, length(texts[k + 1]) as size, floor(length(texts[k + 1]) * (0.3::double + {draw('cut', 400)} / 1000::double))::bigint as middle from (select *, {draw('chunk', one)} as k from {some('chunk_truncation')} u) t),
f2b as (select *, substr(t, low + 1, high - low) as part, {n} > 0 and size >= 50 as fits from (select *, greatest(0, middle - 50) as low, least(size, middle + 50) as high from f2) q),
f2c as (select *, least(greatest(middle, {marks}), size - 10) as cut from f2b),
f3 as (select *, {n} > 1 and texts[a + 1] <> '' and texts[b + 1] <> '' as fits from (select *, (a + 1 + {draw('second', f'greatest({n} - 1, 1)')}) % {one} as b from (select *, {draw('first', one)} as a from {some('chunk_merge')} t) u) v),
f4 as (select *, list_append(selected, 'distractor_' || (1000 + {draw('distractor', 9000)})) as selected2 from {some('distractor_context')} t),
f5 as (select *, {draw('way', 3)} as way, regexp_extract_all(query, '\\S+') as words from {some('corrupted_query')} t),
f5b as (select *, case when way = 0 then {short(f"(0.2::double + {draw('share', 300)} / 1000::double)")}
    when way = 1 and len(words) > 2 then array_to_string(list_transform(list_sort(list_transform(words, lambda x, i: {{'k': {number_of('word', '(i - 1)::varchar')}, 'i': i, 'x': x}})), lambda s: s.x), ' ') when way = 1 then {short('0.3::double')}
    else substr(query, 1, {draw('place', 'length(query) + 1')}) || array_to_string(list_transform(range(1, 11), lambda i: substr('{garbage}', {number_of('sign', 'i::varchar')} % {len(faults.GARBAGE)} + 1, 1)), '') || substr(query, {draw('place', 'length(query) + 1')} + 1) end as new_query from f5),
f6 as (select *, {quoted(faults.OUT_OF_SCOPE)}[{draw('scope', len(faults.OUT_OF_SCOPE))} + 1] as new_query from {some('out_of_scope')} t),
f7 as (select *, {{'t': trace_id, 'id': ids[{draw('own chunk', one)} + 1], 'text': texts[{draw('own chunk', one)} + 1], 'src': sources[{draw('own chunk', one)} + 1]}} as own, {number("'partner'", 'trace_id')} as h, {draw('replace', one)} as k from {some('irrelevant_document')} t),
f7b as (select *, coalesce(lead(own) over (order by h, trace_id), first_value(own) over (order by h, trace_id)) as other from f7),
f7c as (select *, other.t <> trace_id and other.id is not null and {n} > 0 as fits from f7b),
f7d as (select *, case when fits then list_transform(ids, lambda x, i: case when i = k + 1 then other.id else x end) else ids end as ids2, case when fits then list_transform(texts, lambda x, i: case when i = k + 1 then other.text else x end) else texts end as texts2,
    case when fits then list_transform(sources, lambda x, i: case when i = k + 1 then other.src else x end) else sources end as sources2, case when fits then list_transform(selected, lambda x, i: case when i = k + 1 then other.id else x end) else selected end as selected2 from f7c),
faulty as (
    select 'missing_evidence' as fault, case when len(gone) > 0 then 'removed ' || len(gone) || ' chunks with gold evidence' else 'no_chunks_with_gold_evidence' end as method, {rest}, query, answer, ids2 as ids, texts2 as texts, sources2 as sources, selected2 as selected,
        case when len(gone) > 0 then {rebuilt('selected2', 'ids2', 'sources2', 'texts2')} else context end as context, prompt from f1b
    union all select 'chunk_truncation', case when {n} = 0 then 'no_chunks_to_truncate' when t = '' then 'invalid_chunk' when fits then 'truncated chunk at position ' || cut else 'chunk_too_short_to_truncate' end, {rest}, query, answer, ids,
        case when fits then list_transform(texts, lambda x, i: case when i = k + 1 then substr(x, 1, cut) || ' [TRUNCATED]' else x end) else texts end, sources, selected, context, prompt from f2c
    union all select 'chunk_merge', case when fits then 'merged chunks from docs ' || sources[a + 1] || ' and ' || sources[b + 1] when {n} > 1 then 'empty_chunk_text' else 'not_enough_chunks' end, {rest}, query, answer,
        case when fits then list_filter(ids, lambda x, i: i <> b + 1) else ids end, case when fits then list_filter(list_transform(texts, lambda x, i: case when i = a + 1 then x || ' [MERGED] ' || texts[b + 1] else x end), lambda x, i: i <> b + 1) else texts end,
        case when fits then list_filter(sources, lambda x, i: i <> b + 1) else sources end, selected, context, prompt from f3
    union all select 'distractor_context', 'added distractor chunk', {rest}, query, answer, list_append(ids, selected2[len(selected2)]), list_append(texts, '{faults.DISTRACTOR}'), list_append(sources, 'distractor_doc_' || (1000 + {draw('distractor source', 9000)})), selected2,
        {rebuilt('selected2', 'ids', 'sources', 'texts')}, prompt from f4
    union all select 'corrupted_query', case way when 0 then 'truncate applied' when 1 then 'scramble applied' else 'insert_garbage applied' end, {rest}, new_query, answer, ids, texts, sources, selected, context, {old} from f5b
    union all select 'out_of_scope', 'replaced with out-of-scope question', {rest}, new_query, answer, ids, texts, sources, selected, context, {old} from f6
    union all select 'irrelevant_document', case when other.t = trace_id then 'no_other_traces_with_chunks' when other.id is null then 'other_trace_no_chunks' when not fits then 'no_chunks_to_replace' else 'replaced chunk at position ' || k || ' with chunk from ' || other.t end, {rest}, query, answer,
        ids2, texts2, sources2, selected2, case when fits and k < len(selected) then {rebuilt('selected2', 'ids2', 'sources2', 'texts2')} else context end, prompt from f7d
    union all {answers('unsupported_answer', faults.UNSUPPORTED, 'replaced with unsupported answer')}
    union all {answers('contradictory_answer', faults.CONTRADICTORY, 'replaced with contradictory answer')})"""


_DIRECTIONS = ", ".join(f"('{f}', '{m}', '{d}')" for f, m, d in stats.direction_table())
_SIGN = "(case when metric_name in (" + ", ".join(f"'{m}'" for m in stats.LOWER_IS_BETTER) + ") then -1 else 1 end)"

#: Healthy traces, all faults in twenty of them each, both sides scored, and the differences.
DELTAS = (
    "with recursive " + TRACES + ", " + HEALTHY + ", " + faulty("healthy") + ", both_sides as (select 'healthy' as fault, trace_id, lang, query, answer, ids, texts, selected, context, gold, known, preserved, truncated from healthy where trace_id in (select trace_id from faulty)"
    " union all select fault, trace_id, lang, query, answer, ids, texts, selected, context, gold, known, preserved, truncated from faulty), " + metrics("both_sides", "fault, trace_id") + ","
    " pairs as (select f.fault as fault_type, f.metric_name, f.trace_id, h.score as h_score, f.score, case when 'error' in (f.status, h.status) then 'error' when 'skipped' in (f.status, h.status) or f.score is null or h.score is null then 'skipped' else 'ok' end as state"
    " from results f join results h on h.fault = 'healthy' and h.trace_id = f.trace_id and h.metric_name = f.metric_name where f.fault <> 'healthy'),"
    " deltas as (select *, case when state = 'ok' then score - h_score end as delta from pairs)"
)
SUMMARY = (
    DELTAS + ", sided as (select fault_type, metric_name, delta, rank() over w + (count(*) over (partition by fault_type, metric_name, abs(delta)) - 1) / 2 as r from deltas where delta <> 0 window w as (partition by fault_type, metric_name order by abs(delta))),"
    " effect as (select fault_type, metric_name, sum(case when delta > 0 then r else -r end) / sum(r) as e from sided group by all),"
    " directions as (select * from (values " + _DIRECTIONS + ") t(fault_type, metric_name, d)),"
    " base as (select fault_type, metric_name, count(delta) as n, avg(h_score) filter (state = 'ok') as hm, avg(score) filter (state = 'ok') as fm, avg(delta) as md, median(delta) as med, stddev_pop(delta) as sd, avg(delta * " + _SIGN + ") as qd,"
    " count(*) filter (delta * " + _SIGN + " > 0) as up, count(*) filter (delta * " + _SIGN + " < 0) as down, count(*) filter (delta = 0) as same, count(*) filter (state = 'skipped') as skipped, count(*) filter (state = 'error') as errors from deltas group by all),"
    " summary as (select 'bm25' as retriever, fault_type, metric_name, n as sample_count, round(hm, 6) + 0.0::double as healthy_mean, round(fm, 6) + 0.0::double as fault_mean, round(md, 6) + 0.0::double as mean_delta, round(med, 6) + 0.0::double as median_delta, round(sd, 6) + 0.0::double as std_delta,"
    " up as improved_count, down as degraded_count, same as unchanged_count, coalesce(d, 'unspecified') as expected_direction, case d when 'decrease' then md < 0 when 'increase' then md > 0 end as direction_match,"
    " round(md / case when sd > 1e-12 then sd end, 6) + 0.0::double as standardized_effect, case when n > 0 then round(coalesce(e, 0), 6) + 0.0::double end as rank_biserial_effect, round(qd, 6) + 0.0::double as quality_mean_delta, skipped as skipped_count, errors as error_count"
    " from base left join effect using (fault_type, metric_name) left join directions using (fault_type, metric_name))"
)


def intervals(rounds: int = 2000) -> str:
    """CTEs that end in `intervals` (fault_type, metric_name, ci_95_lower, ci_95_upper) of `deltas`: each round weights a delta by a
    Poisson number of mean 1, drawn from 32 bits of an MD5 (four draws a hash); the limits are the chances of up to 12, added up."""
    limits, chance, total = [], math.exp(-1), 0.0
    for k in range(13):
        total += chance
        limits.append(int(total * 2**32))
        chance /= k + 1
    weight = " + ".join(f"(x >= {n})::int" for n in limits)
    return f"""
    hashes as (select fault_type, metric_name, delta, b, md5('42|' || fault_type || '|' || metric_name || '|' || trace_id || '|' || b) as h from deltas, range({-(-rounds // 4)}) blocks(b) where delta is not null),
    draws as (select fault_type, metric_name, delta, b * 4 + d as round, ('0x' || substr(h, d * 8 + 1, 8))::bigint as x from hashes, range(4) digits(d)),
    weights as (select fault_type, metric_name, delta, round, {weight} as w from draws where round < {rounds}),
    means as (select fault_type, metric_name, round, sum(w * delta) / sum(w) as m from weights group by all having sum(w) > 0),
    intervals as (select fault_type, metric_name, round(quantile_cont(m, 0.025), 6) + 0.0::double as ci_95_lower, round(quantile_cont(m, 0.975), 6) + 0.0::double as ci_95_upper from means group by all)"""
