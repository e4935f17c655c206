"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ivfpq, langid, licenses, merkle, mixing, packing, repair, ring, simhash, token_counts, toxicity, vector_codes, whitening
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_output(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings"))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mixture that uses every document and none of a source more than twice as often as those of another."""
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=2.0, whole=True)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_repair_token_output,
        op2_toxicity,
        op3_language_id,
        op4_merkle_fingerprints,
        op5_token_counts,
        op6_ivfpq_neighbours,
        op7_temperature_mixing,
        op8_simhash_near_dedup,
        op9_best_fit_packing,
        op10_ring_sharding,
        op11_license_scan,
        op12_embedding_whitening,
        op13_vector_codes,
    ]
    return {f.__name__: f for f in own}


#: Leaves, sections and roots as in merkle.py, over the same columns.
MERKLE_SQL = r"""
with ordered as (
    select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
        coalesce(lead(coalesce(text, '')) over (order by doc_id nulls first, md5(coalesce(text, ''))),
                 first_value(coalesce(text, '')) over (order by doc_id nulls first, md5(coalesce(text, '')))) as next
    from documents),
texts as (
    select *, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) as edited from ordered),
leaves as (
    select *, [[substr(md5(x), 1, 12) for x in regexp_extract_all(t, '[^.!?\n]{0,120}[.!?\n]+[ ]*|[^.!?\n]{1,120}')] for t in [text, edited, next]] as l
    from texts),
bodies as (
    select *, [regexp_replace(array_to_string([h || case when substr(h, 1, 1) in ('0', '1') then ';' else ',' end for h in x], ''), '[;,]$', '') for x in l] as b
    from leaves),
prints as (
    select *, [md5(array_to_string([substr(md5(s), 1, 12) for s in string_split(x, ';')], ',')) || '|' || x for x in b] as p
    from bodies),
trees as (
    select *, [list_distinct(list_concat([string_split(x, '|')[1]],
        case when string_split(x, '|')[2] = '' then [] else ['s' || substr(md5(s), 1, 12) for s in string_split(string_split(x, '|')[2], ';')] end,
        [h for h in string_split_regex(string_split(x, '|')[2], '[;,]') if h <> ''])) for x in p] as d
    from prints)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, p[1] as fingerprint, p[2] as edited_fingerprint,
    2.0 * len(list_intersect(d[1], d[2])) / (len(d[1]) + len(d[2])) as near_edited,
    2.0 * len(list_intersect(d[1], d[3])) / (len(d[1]) + len(d[3])) as near_next,
    case when b[2] = '' then '' else array_to_string([i - 1 for i in range(1, len(string_split(b[2], ';')) + 1)
        if b[1] = '' or not list_contains(string_split(b[1], ';'), string_split(b[2], ';')[i])], ',') end as changed_sections
from trees
"""


#: Words, grams, diagonals and spans as in licenses.py, over the same columns; grams are compared as texts.
LICENSE_SQL = r"""
with phrases(label, base, k, phrase) as (values
    ('gpl', true, 2, 'gnu general public license'), ('apache', true, 2, 'apache license'), ('cc-by', true, 2, 'cc by'), ('mit', true, 2, 'mit license'),
    ('apache-2.0', false, 4, 'licensed under the apache license version 2 0'),
    ('apache-2.0', false, 4, 'you may not use this file except in compliance with the license you may obtain a copy of the license at'),
    ('bsd', false, 4, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
    ('cc-by-nc-4.0', false, 4, 'licensed under cc by nc 4 0'),
    ('cc-by-sa', false, 4, 'this work is licensed under a creative commons attribution sharealike license'),
    ('gpl-3.0', false, 4, 'this work is licensed under the gnu general public license version 3'),
    ('gpl', false, 4, 'you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
    ('isc', false, 4, 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
    ('mit', false, 4, 'released under the mit license'),
    ('mit', false, 4, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
    ('mpl-2.0', false, 4, 'this source code form is subject to the terms of the mozilla public license v 2 0'),
    ('unlicense', false, 4, 'this is free and unencumbered software released into the public domain')),
templates as (
    select row_number() over () as t, label, base, k, string_split(phrase, ' ') as w, len(w) as length, length - k + 1 as grams from phrases),
places as (
    select t, label, base, k, length, grams, unnest(range(grams)) as place, w from templates),
grams as (
    select * exclude (w), array_to_string(w[place + 1 : place + k], ' ') as gram from places),
texts as (
    select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from documents),
starts as (
    select uid, words, unnest(range(len(words))) as start from texts),
own as (
    select uid, start, k, array_to_string(words[start + 1 : start + k], ' ') as gram from starts, (values (2), (4)) sizes(k)),
votes as (
    select uid, t, label, base, length, grams, start - place as diagonal, bit_or(1::bigint << place) as seen, min(start) as first, max(start) + max(k) - 1 as last
    from own join grams using (k, gram) group by all),
begun as (
    select *, coalesce(base or diagonal - lag(diagonal) over (partition by uid, t order by diagonal) > least(8, length // 3), true) as begins from votes),
merged as (
    select *, max(case when begins then diagonal end) over (partition by uid, t order by diagonal) as merged from begun),
found as (
    select uid, label, base, length, grams, max(bit_count(seen)) as alone, bit_count(bit_or(seen)) as seen, min(first) as first, max(last) as last
    from merged group by uid, t, label, base, length, grams, merged),
spans as (
    select *, seen / grams as share, case when base then seen = grams else alone = grams or (seen / grams >= 0.6 and last - first + 1 <= 2 * length) end as good from found)
select doc_id, len(any_value(words))::bigint as n_words, count(*) filter (good and base) as n_base, min(first) filter (good and base) as first_word, max(first) filter (good and base) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (good and base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label) filter (good), '') as labels,
    coalesce(max(share), 0.0)::double as score
from texts left join spans using (uid) group by uid, doc_id
"""


def codebook_sql(rounds: int = 2) -> str:
    """The codebooks' rounds one after another, over vectors of 64 components: all entries are compared with every part."""
    far = " + ".join(f"(r.x[{j}] - b.x[{j}]) ** 2" for j in range(1, 5))
    mean = ", ".join(f"floor(sum(x[{j}])::double / count(*))::bigint" for j in range(1, 5))
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
codes{i} as (
    select n, p, arg_min(e, far * 64 + e) as code, min(far) as far from (select r.n, r.p, b.e, ({far})::bigint as far from parts r join books{i} b using (p)) group by n, p)""")
        if i < rounds:
            steps.append(f"""
means{i} as (
    select p, code as e, [{mean}] as x from codes{i} join parts using (n, p) group by p, code),
books{i + 1} as (
    select p, e, coalesce(m.x, b.x) as x from books{i} b left join means{i} m using (p, e))""")
    return f"""
with kept as (
    select row_number() over (order by vec_id) as n, vec_id, label, [floor(256 * c::double)::bigint for c in embedding] as x from embeddings
    where embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
parts as (
    select n, p, x[4 * p + 1 : 4 * p + 4] as x from kept, range(16) places(p)),
books0 as (
    select p, n - 1 as e, x from parts where n <= 64),{",".join(steps)},
digest as (
    select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from books{rounds}),
coded as (
    select n, string_agg(printf('%02x', code), '' order by p) as code, sum(far)::bigint as error from codes{rounds} group by n)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (n), digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_merkle_fingerprints": MERKLE_SQL, "op11_license_scan": LICENSE_SQL, "op13_vector_codes": codebook_sql()}
