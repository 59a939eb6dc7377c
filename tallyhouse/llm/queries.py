"""The registered queries of this subpackage and their DuckDB text."""

from __future__ import annotations

import public_tokenizers

from tallyhouse.llm import (
    bpe,
    digests,
    language,
    neighbours,
    packed,
    phrases,
    positions,
    repeats,
    runs,
    scoring,
    shards,
    simhash,
    warc,
)
from tallyhouse.llm.shared import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {
    "op1_multi_index_hashing": lambda spark, d: neighbours.op1_multi_index_hashing(
        table(spark, d, "embeddings")
    ),
    "op2_hypergeometric_shards": lambda spark, d: shards.op2_hypergeometric_shards(
        table(spark, d, "documents")
    ),
    "op3_simhash_pivot_tables": lambda spark, d: simhash.op3_simhash_pivot_tables(
        table(spark, d, "documents")
    ),
    "op4_packed_ids": lambda spark, d: packed.op4_packed_ids(table(spark, d, "documents"), WORD_BPE),
    "op5_attention_scores": lambda spark, d: scoring.op5_attention_scores(
        table(spark, d, "documents"), WORD_BPE
    ),
    "op6_forced_boundary_bpe": lambda spark, d: bpe.op6_forced_boundary_bpe(
        table(spark, d, "documents"), WORD_BPE
    ),
    "op7_suffix_array_repeats": lambda spark, d: repeats.op7_suffix_array_repeats(
        table(spark, d, "documents")
    ),
    "op8_positional_decontamination": lambda spark, d: positions.op8_positional_decontamination(
        table(spark, d, "documents"), table(spark, d, "benchmark")
    ),
    "op9_warc_index_first": lambda spark, d: warc.op9_warc_index_first(table(spark, d, "pages")),
    "op10_marginalised_unigrams": lambda spark, d: language.op10_marginalised_unigrams(
        table(spark, d, "documents"), PIECES
    ),
    "op11_setm_collocations": lambda spark, d: phrases.op11_setm_collocations(
        table(spark, d, "documents")
    ),
    "op12_digest_index": lambda spark, d: digests.op12_digest_index(table(spark, d, "documents")),
    "op13_minimizer_runs": lambda spark, d: runs.op13_minimizer_runs(table(spark, d, "documents")),
}

WORDS = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"""

ORACLE = {
    "op7_suffix_array_repeats": """
        with d as (
          select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b,
                 octet_length(encode(coalesce(text, ''))) as n
          from documents
        ), strings as (
          select r, doc_id, p, array_slice(b, p, p + 49) as s
          from (select r, doc_id, b, unnest(range(1, n - 48)) as p from d) x
        ), firsts as (
          select s, min(doc_id) as least from strings group by s
        ), gone as (
          select r, p, lag(p) over (partition by r order by p) as before
          from strings join firsts using (s) where least < doc_id
        ), spans as (
          select r, min(p) as a, max(p) + 49 as e
          from (select r, p, sum((before is null or p > before + 50)::int)
                    over (partition by r order by p) as k from gone) g
          group by r, k
        ), pieces as (
          select r, coalesce(lag(e) over w, 0) + 1 as a, s.a - 1 as e from spans s
          window w as (partition by r order by s.a)
          union all select r, coalesce(max(e), 0) + 1, any_value(n)
          from d left join spans using (r) group by r
        ), kept as (
          select r, string_agg(hex(array_slice(b, a, e)), '' order by a) as h
          from pieces join d using (r) where a <= e group by r
        ), counts as (
          select r, sum(e - a + 1)::bigint as n_removed, count(*) as n_spans from spans group by r
        )
        select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed,
               coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(h, ''))) as kept_sha256
        from d left join counts using (r) left join kept using (r)
    """,
    "op8_positional_decontamination": f"""
        with d as (
          select row_number() over () as r, doc_id, {WORDS} as w from documents
        ), i as (
          select distinct item_id, {WORDS} as w from benchmark
        ), windows as (
          select item_id, least(len(w), 13) as n,
                 unnest([w[k:k + least(len(w), 13) - 1] for k in range(1, greatest(len(w) - 11, 2))]) as win
          from i where len(w) > 0
        ), lengths as (
          select distinct n from windows
        ), runs as (
          select r, n, unnest(range(1, len(w) - n + 2)) as p, w from d, lengths where len(w) >= n
        ), hits as (
          select r, p, runs.n, item_id
          from (select r, p, n, w[p:p + n - 1] as win from runs) runs join windows using (win)
        ), words as (
          select r, count(distinct q) as n_hit
          from (select r, unnest(range(p, p + n)) as q from hits) group by r
        ), items as (
          select r, count(distinct item_id) as n_items,
                 sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as names
          from hits group by r
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, coalesce(names, sha256('')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join words using (r) left join items using (r)
    """,
    "op9_warc_index_first": """
        with p as (
          select page_id, encode(coalesce(html, '')) as payload from pages
        ), d as (
          select page_id, octet_length(payload)::bigint as payload_bytes,
                 sha1(payload) as payload_digest
          from p
        ), k as (
          select payload_digest, payload_bytes, max(page_id) as kept
          from d where payload_bytes >= 1000 group by all
        )
        select d.page_id, d.payload_bytes, d.payload_digest,
               case when k.kept <> d.page_id then 'revisit' else 'response' end as record_type,
               case when k.kept <> d.page_id then k.kept end as refers_to
        from d left join k using (payload_digest, payload_bytes)
    """,
    "op11_setm_collocations": r"""
        with pieces as (
          select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) as piece
          from documents
        ), words as (
          select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
        ), totals as (
          select lang, sum(len(w))::bigint as n from words group by lang
        ), f as (
          select lang, size, array_to_string(g, ' ') as phrase, count(*) as f
          from (select lang, size, unnest([w[i:i + size - 1] for i in range(1, len(w) - size + 2)]) as g
                from words, (select unnest([1, 2, 3, 4]) as size) s where len(w) >= size) x
          group by all having count(*) >= 30
        ), cuts as (
          select lang, phrase, size, f as a, unnest(range(1, size)) as k, string_split(phrase, ' ') as w
          from f where size > 1
        ), scores as (
          select c.lang, c.phrase, c.a, k, l.f as l, r.f as r,
                 (2000000::hugeint * c.a) // (l.f + r.f) as score
          from cuts c
          join f l on l.lang = c.lang and l.phrase = array_to_string(w[1:k], ' ')
          join f r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1:], ' ')
        ), lowest as (
          select * from scores
          qualify row_number() over (partition by lang, phrase order by score, k) = 1
        ), inner_parts as (
          select lang, f, unnest([w[i:i + n - 1] for i in range(1, size - n + 2)]) as g
          from (select lang, f, size, string_split(phrase, ' ') as w, unnest(range(2, size)) as n
                from f where size > 2) x
        ), longer as (
          select lang, array_to_string(g, ' ') as phrase, max(f) as m from inner_parts group by all
        ), ranked as (
          select x.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
          from lowest x left join longer using (lang, phrase)
          where m is null or 100::hugeint * m < 80::hugeint * a
        )
        select lang, rank, phrase, a, l, r, n, score::bigint as score
        from ranked join totals using (lang) where rank <= 2000
    """,
    "op12_digest_index": """
        with t as (
          select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                   'abcdefghijklmnopqrstuvwxyz') as text
          from documents
        ), g as (
          select text, max(doc_id) as keep_id, count(*) as group_size from t group by text
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256
        from t join g using (text)
    """,
}
