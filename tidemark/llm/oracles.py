"""DuckDB SQL for the corpus queries that it can express, over whole tables."""

from __future__ import annotations

from functools import reduce

from tidemark.llm.quality import LEVELS, RATES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x20\x09-\x0D]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UP}', '{_LOW}')"


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_BLANKS}'), lambda x: x <> '')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({_lower(f'coalesce({text}, chr(32))')}, '{_GAP}'), lambda x: x <> '')"


# The metrics of the quality rules, for each row of documents.
_METRICS = f"""
docs as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t, {_tokens('text')} w from documents),
triples as (select rid, unnest(range(1, len(w) - 1)) i, w from docs where len(w) >= 3),
named as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from triples),
twice as (select rid, i from named qualify count(*) over (partition by rid, g) > 1),
inside as (select rid, count(distinct i + k) n from twice, range(3) r(k) group by rid),
lines as (select rid, unnest(string_split(t, chr(10))) line from docs),
line_counts as (select rid, count(*) n_lines, count(*) filter (trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '')
    - count(distinct line) filter (trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '') n_dup_lines from lines group by rid),
metrics as (
    select d.rid, doc_id, lang, source, hash(t) text_hash, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, n_dup_lines::bigint n_dup_lines, coalesce(i.n, 0)::bigint n_repeat_words, n_lines
    from docs d join line_counts using (rid) left join inside i using (rid)),
rated as (
    select *, case when word_chars > 0 then n_symbols / word_chars else 0 end symbol_rate, case when n_lines > 0 then n_dup_lines / n_lines else 0 end dup_line_rate,
        case when n_words > 0 then n_repeat_words / n_words else 0 end repeat_rate, case when n_words > 0 then word_chars / n_words else 0 end long_word_rate,
        n_words < 50 or n_repeat_words * 100 > n_words * 50 base_failed
    from metrics)"""

_LEVEL_ROWS = ", ".join(f"({i}, {', '.join(f'{c}::double' for c in level)})" for i, level in enumerate(LEVELS))
_OVER = " or ".join(f"{r} > cut_{r}" for r in RATES)

_OP10 = f"""
with {_METRICS},
good as (select doc_id from labels group by doc_id having min(quality) = 1),
texts as (
    select lang, text_hash, min(doc_id) doc_id, {', '.join(f'max({c}) {c}' for c in RATES)} from rated semi join good using (doc_id) where not base_failed group by lang, text_hash),
worst as (select doc_id, lang, {', '.join(f'max({c}) {c}' for c in RATES)} from texts group by doc_id, lang),
levels(level, {', '.join(f'cut_{r}' for r in RATES)}) as (values {_LEVEL_ROWS}),
counts as (select lang, level, count(*) n, count(*) filter ({_OVER}) k from worst, levels group by lang, level),
strata as (select count(*) s from (select distinct lang from worst)),
tails as (
    select lang, level, case when k >= n then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))) from range(k + 1) r(i)) end p
    from counts),
accepted as (select lang, level, bool_and(p <= 0.05 / s) over (partition by lang order by level) ok from tails, strata),
chosen as (select lang, max(level) level from accepted where ok group by lang),
cutoffs as (select * from chosen join levels using (level))
select r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce({_OVER}, false) kept
from rated r left join cutoffs c on r.lang is not distinct from c.lang"""

_OP1 = f"""
with {_METRICS},
keyed as (
    select *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
        / ((1 - least(symbol_rate, 0.95)) * (1 - least(dup_line_rate, 0.95)) * (1 - least(repeat_rate, 0.95))) k
    from rated),
sizes as (select source, sum(n_words)::bigint source_size from keyed group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 r from sizes),
capped as (select *, [5.0, 2.0, 1.0][(r % 3 + 1)::int]::double weight, source_size * 2.0::double cap from ranked),
filled as (
    select *, (sum(source_size) over ())::double * 1.5 total, cap / weight ratio from capped),
levelled as (
    select *, (total - (sum(cap) over (order by ratio, r) - cap)) / sum(weight) over (order by ratio, r rows between current row and unbounded following) lvl from filled),
targets as (select source, source_size, least(cap, weight * max(lvl) over ()) target from levelled),
planned as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint epochs from targets),
budgets as (select *, floor(target - epochs * source_size)::bigint budget from planned),
merged as (select source, k, coalesce(doc_id::varchar, '') id, n_words, count(*) rows_ from keyed group by all),
running as (select *, sum(n_words * rows_) over (partition by source order by k, id, n_words) - n_words * rows_ before from merged),
parts as (
    select r.source, k, id, n_words, case when before + n_words * rows_ <= budget then n_words when before > budget then 0 else floor((budget - before) / rows_) end::bigint part
    from running r join budgets b on r.source is not distinct from b.source)
select d.doc_id, d.n_words size, b.source_size, b.target, (b.epochs * d.n_words + p.part)::bigint taken
from keyed d join budgets b on d.source is not distinct from b.source
join parts p on d.source is not distinct from p.source and d.k = p.k and coalesce(d.doc_id::varchar, '') = p.id and d.n_words = p.n_words"""

_OP3 = f"""
with docs as (select row_number() over () rid, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
lines as (select rid, doc_id, unnest(l) line, generate_subscripts(l, 1) pos from docs),
keyed as (select *, {_lower("trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')")} key from lines),
repeated as (select key, max(doc_id) keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, r.key is not null and k.doc_id is distinct from r.keeper gone from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from marked group by rid, doc_id"""

_OP6 = """
with payloads as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) h from pages),
firsts as (select *, min(page_id) over (partition by h) f from payloads)
select page_id, n payload_bytes, h payload_digest, case when n >= 100 and page_id > f then 'revisit' else 'response' end record_type,
    case when n >= 100 and page_id > f then f end refers_to
from firsts"""

_OP7 = f"""
with recursive docs as (select row_number() over () rid, doc_id, {_tokens(_lower('text'))} w from documents),
shingles as (
    select distinct rid, g from (
        select rid, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') g from (select rid, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) i from docs where len(w) > 0))),
sizes as (select rid, count(*) n from shingles group by rid),
shared as (select a.rid u, b.rid v, count(*) c from shingles a join shingles b on a.g = b.g and a.rid < b.rid group by all),
links as (select u, v from shared join sizes a on a.rid = u join sizes b on b.rid = v where 100 * c >= 85 * (a.n + b.n - c)),
sides as (select u, v from links union all select v, u from links),
reached(rid, x) as (select rid, rid from docs union select r.rid, b.v from reached r join sides b on r.x = b.u),
least_ids as (select r.rid, min(d.doc_id) component_id from reached r join docs d on r.x = d.rid group by r.rid)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from docs left join sizes using (rid) join least_ids using (rid)"""

_OP8 = f"""
with items as (select item_id, {_words('text')} w from benchmark),
starts as (select item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from items where len(w) > 0),
windows as (select distinct item_id::varchar item, n, array_to_string(w[i:i + n - 1], ' ') gram from starts),
docs as (select row_number() over () rid, doc_id, {_words('text')} w from documents),
positions as (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from docs, (select distinct n from windows) where len(w) >= n),
probes as (select rid, n, i, array_to_string(w[i:i + n - 1], ' ') gram from positions),
hits as (select p.rid, p.n, p.i, item from probes p join windows x on p.gram = x.gram and p.n = x.n),
counts as (select rid, count(distinct i + k) n_hit from (select distinct rid, n, i, unnest(range(n)) k from hits) group by rid),
held as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from hits where item is not null) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join counts using (rid) left join held using (rid)"""

_OP11 = f"""
with docs as (select row_number() over () rid, doc_id, {_words('text')} w from documents),
whole as (select count(*) n_docs, sum(len(w))::bigint total from docs where len(w) > 0),
held as (select rid, term, count(*) tf from (select rid, unnest(w) term from docs) group by rid, term),
dfs as (select term, count(*) df from held group by term),
items as (select row_number() over () iid, item_id, {_words('text')} w from benchmark),
asked as (select iid, item_id, term, count(*) times from (select iid, item_id, unnest(w) term from items) group by all),
scored as (
    select iid, item_id, rid, doc_id, sum(times * floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint
        * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * len(w) * n_docs) // total)))))::bigint score
    from asked join held using (term) join dfs using (term) join docs using (rid), whole group by all),
ranked as (select *, row_number() over (partition by iid order by score desc, doc_id nulls last) rank from scored where score > 0)
select item_id, rank::int rank, doc_id, score from ranked where rank <= 10"""

# CRC-32 by half bytes; the table of its 16 remainders comes from the polynomial.
_NIBBLES = "([" + ", ".join(str(_crc) for _crc in (reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), n) for n in range(16))) + "]::bigint[])"


def _features(table: str, key: str) -> str:
    return f"""
{table}_words as (select rid, {key} doc_id, w from (select row_number() over () rid, *, {_words('text')} w from {table})),
{table}_features as (
    select rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from {table}_words),
{table}_counts as (select rid, f, count(*) n from {table}_features group by all)"""


_STEP = f"xor(c >> 4, {_NIBBLES}[(xor(c, h) & 15) + 1])"
_OP13 = f"""
with {_features('documents', 'doc_id')}, {_features('benchmark', 'item_id')},
named as (select f, hex(encode(f)) x from (select f from documents_counts union select f from benchmark_counts)),
digits as (select f, flatten(list_transform(range(1, length(x), 2), lambda i: [('0x' || x[i + 1])::bigint, ('0x' || x[i])::bigint])) d from named),
hashed as (select f, xor(list_reduce(d, lambda c, h: {_STEP}, 4294967295::bigint), 4294967295) % 10000 bucket from digits),
s as (select bucket, sum(n) s from documents_counts join hashed using (f) group by bucket),
t as (select bucket, sum(n) t from benchmark_counts join hashed using (f) group by bucket),
totals as (select (select coalesce(sum(s), 0) from s) s_all, (select coalesce(sum(t), 0) from t) t_all),
gains as (
    select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::double / ((s + 1) * (t_all + 10000))::double))::bigint gain from s left join t using (bucket), totals),
sums as (select rid, sum(n)::bigint n_features, floor(sum(n * gain) / sum(n)::double)::bigint weight from documents_counts join hashed using (f) join gains using (bucket) group by rid),
scored as (
    select rid, doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint score
    from documents_words left join sums using (rid)),
ranked as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first) end r from scored)
select doc_id, n_features, weight, score, case when r <= (select 25 * count(*) // 100 from scored where n_words >= 20) then r end rank from ranked"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": _OP1,
    "op3_line_dedup": _OP3,
    "op6_warc_index": _OP6,
    "op7_jaccard_join": _OP7,
    "op8_decontaminate": _OP8,
    "op10_quality_rules": _OP10,
    "op11_ranked_search": _OP11,
    "op13_importance_resample": _OP13,
}
