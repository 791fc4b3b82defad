"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import quality_rules as Q, substring_fm as S

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = f"""
with docs as (select doc_id, {_WORDS.format('text')} as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + {S.WINDOW_WORDS - 1}], ' ') as k
            from (select doc_id, ws, unnest(range(1, len(ws) - {S.WINDOW_WORDS - 2})) as i from docs where len(ws) >= {S.WINDOW_WORDS})),
origins as (select k, min(doc_id) as first from windows group by k),
gone as (select distinct doc_id, unnest(range(i, i + {S.WINDOW_WORDS})) as i from windows join origins using (k) where first < doc_id),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from docs),
kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs left join kept using (doc_id)"""

RULES = rf"""
with docs as (select doc_id, source, coalesce(text, '') as text, {_WORDS.format('text')} as ws from documents),
lines as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from docs),
windows as (select doc_id, i, array_to_string(ws[i:i + {Q.REPEAT_WINDOW - 1}], ' ') as k
            from (select doc_id, ws, unnest(range(1, len(ws) - {Q.REPEAT_WINDOW - 2})) as i from docs where len(ws) >= {Q.REPEAT_WINDOW})),
twice as (select doc_id, k from windows group by all having count(*) > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {Q.REPEAT_WINDOW})) as p from windows semi join twice using (doc_id, k)) group by doc_id),
each as (select doc_id, source, text, array_to_string({_WORDS.format(_LOWER.format('line'))}, ' ') as line from (select doc_id, source, text, unnest(ls) as line from lines)),
hosts as (select source, greatest(count(distinct text) * {Q.MAX_LINE_SHARE}, {Q.MIN_LINE_TEXTS}) as most from docs group by source),
bad as (select source, line from each join hosts using (source) group by source, line, most
        having count(distinct text) > {Q.MIN_LINE_TEXTS} and count(distinct text) > most),
cut as (select doc_id, sum(len(string_split(line, ' '))) as n from each semi join bad using (source, line) group by doc_id),
counts as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
           len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, coalesce(cut.n, 0) as removed
           from lines left join repeats using (doc_id) left join cut using (doc_id)),
judged as (select *, n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - removed >= {Q.MIN_KEPT_SHARE} * n_words as kept
from judged"""
