"""SQL for DuckDB that gives the rows of the queries it can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from seams.llm.quality import RULES, STATS
from seams.llm.suffix_dedup import LENGTH

_LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

#: Every window of ten words, or the whole of a shorter item, is joined with all runs of as many words in the documents.
DECONTAMINATE = rf"""
with word_lists as (
  select 'd' as kind, cast(doc_id as varchar) as id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'i', cast(item_id as varchar), regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark where item_id is not null),
item_windows as (
  select distinct id as item, least(len(w), 10) as span, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as words
  from (select id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from word_lists where kind = 'i' and len(w) > 0)),
spans as (select distinct span from item_windows),
doc_windows as (
  select id, i, span, array_to_string(w[i : i + span - 1], ' ') as words
  from (select id, w, span, unnest(range(1, len(w) - span + 2)) as i from word_lists, spans where kind = 'd' and len(w) >= span)),
hits as (select id, i, span, item from doc_windows join item_windows using (span, words)),
hit_words as (select id, count(distinct p) as n_hit from (select distinct id, unnest(range(i, i + span)) as p from hits) group by id),
hit_items as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, item from hits) group by id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents join word_lists on kind = 'd' and word_lists.id = cast(doc_id as varchar)
left join hit_words on hit_words.id = cast(doc_id as varchar) left join hit_items on hit_items.id = cast(doc_id as varchar)"""

#: Sets meet through every shingle that they share; components are the closure of their links.
JACCARD = rf"""
with recursive word_lists as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from word_lists where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, edges.b from reach join edges on reach.b = edges.a),
least_of as (select a, min(b) as component_id from reach group by a)
select documents.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents left join sizes on sizes.doc_id = documents.doc_id join least_of on a = documents.doc_id"""

#: 5 hexadecimal digits are 4 of base32.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(floor(cast('0x' || substr(h, {5 * g + 1}, 5) as bigint) / {32 ** (3 - k)}) as bigint) % 32 + 1, 1)" for g in range(8) for k in range(4)
)

REVISITS = f"""
with payloads as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
firsts as (select payload, min(page_id) as first_id from payloads group by payload)
select page_id, cast(strlen(payload) as bigint) as payload_bytes, {_BASE32} as payload_digest,
 case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from payloads join firsts using (payload)"""

#: All strings of LENGTH bytes by themselves; stretches of removed bytes are islands of those that are not the first.
REPEATS = f"""
with bytes as (select doc_id, encode(coalesce(text, '')) as b from documents),
windows as (select doc_id, i, b[i : i + {LENGTH - 1}] as s from (select doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) as i from bytes)),
again as (select doc_id, i from windows qualify row_number() over (partition by s order by doc_id, i) > 1),
heads as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + {LENGTH}, 0) as head from again),
numbered as (select doc_id, i, sum(head::int) over (partition by doc_id order by i) as island from heads),
islands as (select doc_id, min(i) as a, max(i) + {LENGTH} as z from numbered group by doc_id, island),
cuts as (select doc_id, a, z from islands union all select doc_id, octet_length(b) + 1, null from bytes),
pieces as (select doc_id, a, coalesce(lag(z) over (partition by doc_id order by a, z nulls last), 1) as begin_at from cuts),
kept as (select doc_id, unhex(coalesce(string_agg(hex(b[begin_at : a - 1]), '' order by a), '')) as left_over from pieces join bytes using (doc_id) where a > begin_at group by doc_id),
removed as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans from islands group by doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(left_over, ''::blob)) as kept_sha256
from bytes left join kept using (doc_id) left join removed using (doc_id)"""


def _quality(alpha: float = 0.02, delta: float = 0.05, cost: float = 5.0) -> str:
    """Counts of each text, then per language and rule the walk over the cutoffs with the binomial tail summed term by term."""
    count = lambda inside: f"length(t) - length(regexp_replace(t, '[{inside}]', '', 'g'))"
    ratio = {r: "{} / greatest({}, 1)".format(*form.split(" / ")) for r, (form, _) in RULES.items()}
    grid = ", ".join(f"('{r}', {k}, {c})" for r, (_, cutoffs) in RULES.items() for k, c in enumerate(cutoffs))
    share = alpha / len(RULES)
    return rf"""
with texts as (select doc_id, lang, coalesce(text, '') as t from documents),
word_lists as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from texts),
windows as (select doc_id, i, array_to_string(w[i : i + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from word_lists where len(w) > 2)),
often as (select doc_id, i from windows qualify count(*) over (partition by doc_id, s) > 1),
repeats as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 3)) as p from often) group by doc_id),
stats as (
  select doc_id, coalesce(lang, '') as stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {count("#*$%&|<>")} as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(lines) as n_lines, {count("A-Z")} as n_capitals, {count("!")} as n_exclaims
  from texts join word_lists using (doc_id) left join repeats using (doc_id)),
marks as (select doc_id, max(quality) > 0 as ok from labels where quality is not null and doc_id is not null group by doc_id),
ratios as ({" union all ".join(f"select doc_id, stratum, '{r}' as rule, {x} as ratio from stats" for r, x in ratio.items())}),
grid(rule, k, cut) as (values {grid}),
holdout as (
  select stratum, rule, k, cast(cut as double) as cut, count_if(ok) as n_clean, count_if(not ok) as n_bad, count_if(ok and ratio > cast(cut as double)) as clean, count_if(not ok and ratio > cast(cut as double)) as bad
  from ratios join marks using (doc_id) join grid using (rule) group by all),
tested as (
  select *, clean < n_clean * {share}::double and list_sum(list_transform(range(cast(clean as bigint) + 1), lambda j: exp(lgamma(n_clean + 1) - lgamma(j + 1) - lgamma(greatest(n_clean - j, 0) + 1) + j * ln({share}::double) + (n_clean - j) * ln(1 - {share}::double))))
    <= {delta / len(RULES)}::double / (select count(distinct stratum) from holdout) as holds
  from holdout where n_clean > 0),
walked as (select *, bad / greatest(n_bad, 1) - {cost}::double * clean / n_clean as gain from tested qualify bool_and(holds) over (partition by stratum, rule order by k)),
chosen as (select stratum, rule, arg_max(cut, (gain, -k)) as cut from walked where gain > 0 group by stratum, rule),
ruled_out as (select distinct doc_id from ratios join chosen using (stratum, rule) where ratio > cut)
select doc_id, {", ".join(f"cast({c} as bigint) as {c}" for c in STATS)}, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and doc_id not in (select doc_id from ruled_out) as kept
from stats"""


ORACLES = {"op1_decontaminate": DECONTAMINATE, "op2_jaccard": JACCARD, "op3_warc": REVISITS, "op5_suffix_dedup": REPEATS, "op9_quality": _quality()}
