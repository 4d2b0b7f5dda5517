"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from epilane.llm.rules import CHAR_CLASSES, COMMON_SHARE, MAX_DISTANCE, MIN_DOCUMENTS, MIN_PART, MIN_WORDS

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexed: str) -> str:
    """Base32 of 40 hex digits: five of them, 20 bits, give four letters."""
    letters = []
    for group in range(8):
        value = " + ".join(
            f"(strpos('0123456789abcdef', substr({hexed}, {5 * group + k + 1}, 1)) - 1) * {16 ** (4 - k)}"
            for k in range(5)
        )
        letters += [
            f"substr('{_BASE32}', cast(((cast({value} as bigint) >> {shift}) & 31) as int) + 1, 1)"
            for shift in (15, 10, 5, 0)
        ]
    return " || ".join(letters)


WARC = f"""
with payloads as (select page_id, coalesce(html, '') as payload from pages),
tops as (select *, sha1(payload) as h, max(page_id) over (partition by payload) as top from payloads)
select page_id, cast(strlen(payload) as bigint) as payload_bytes, {_base32('h')} as payload_digest,
  case when page_id is null and top is not null or page_id < top then 'revisit' else 'response' end as record_type,
  case when page_id is null or page_id < top then top end as refers_to
from tops
"""

_WORD = r"[^ \t\n\x0B\f\r]"
_CHARS = ["space", *CHAR_CLASSES, "wide", "other"]
_CLASSES = ",\n  ".join(
    f"len(regexp_extract_all(text, '{rx.replace(chr(39), chr(39) * 2)}')) as {name}"
    for name, rx in CHAR_CLASSES.items()
)
_OTHER = " - ".join(["word_chars", "wide", *CHAR_CLASSES])

RULES = f"""
with base as (select row_number() over (order by doc_id) as r, doc_id, lang, coalesce(text, '') as text from documents),
words as (select r, unnest(ws) as w, unnest(range(len(ws))) as i
  from (select r, regexp_extract_all(text, '{_WORD}+') as ws from base) x),
counted as (select r, count(*) as n_words, cast(sum(length(w)) as bigint) as word_chars from words group by 1),
windows as (select r, i, concat_ws(' ', w, lead(w, 1) over q, lead(w, 2) over q, lead(w, 3) over q, lead(w, 4) over q) as five,
    lead(w, 4) over q as last from words window q as (partition by r order by i)),
repeated as (select r, i from (select r, i, count(*) over (partition by r, five) as c from windows where last is not null) x where c > 1),
covered as (select r, count(distinct i + k) as n_repeat_words from repeated cross join (select unnest(range(5)) as k) y group by 1),
lines as (select r, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from base) x where regexp_matches(line, '{_WORD}') group by 1),
stats as (select b.r, doc_id, lang, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  length(text) - coalesce(word_chars, 0) as space, strlen(text) - length(text) as wide,
  {_CLASSES}
  from base b left join counted c on c.r = b.r left join covered o on o.r = b.r left join lines l on l.r = b.r),
judged as (select *, greatest({_OTHER}, 0) as other, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from stats),
weights as (select lang, lower(w) as bin, sum(cast(1 as double) / n_words) as weight
  from words w join judged j on j.r = w.r where n_words >= {MIN_WORDS} and lang is not null group by 1, 2),
langs as (select lang, round(sum(weight)) as docs from weights group by 1
  having round(sum(weight)) >= greatest({MIN_DOCUMENTS}, {MIN_PART} * (select sum(weight) from weights))),
vocab as (select w.lang, bin from weights w join langs l on l.lang = w.lang where weight >= {COMMON_SHARE} * docs),
common as (select w.r, v.bin, count(*) as c from words w join judged j on j.r = w.r
  join vocab v on v.lang = j.lang and v.bin = lower(w.w) group by 1, 2),
bins as ({" union all ".join(f"select r, lang, base_failed, 'chars' as kind, '{c}' as bin, cast({c} as double) as c from judged" for c in _CHARS)}
  union all select c.r, lang, base_failed, 'common', bin, cast(c as double) from common c join judged j on j.r = c.r
  union all select j.r, lang, base_failed, 'common', '', cast(n_words - coalesce(k, 0) as double) from judged j
    left join (select r, sum(c) as k from common group by 1) s on s.r = j.r),
totals as (select r, lang, kind, sum(c) as total from bins group by 1, 2, 3),
summed as (select lang, kind, bin, sum(c) as c from bins
  where not base_failed and lang in (select lang from vocab) group by 1, 2, 3),
shares as (select lang, kind, bin, c / sum(c) over (partition by lang, kind) as q from summed),
-- Bins that a document lacks give q * log2(q / (q / 2)) = q; the others are added up here.
met as (select t.r, t.kind, t.total,
    sum(case when b.c > 0 then b.c / t.total * log2((b.c / t.total) / ((b.c / t.total + q) / 2))
        + case when q > 0 then q * log2(q / ((b.c / t.total + q) / 2)) else 0 end else 0 end) as part,
    sum(case when b.c > 0 then q else 0 end) as met_q
  from totals t join bins b on b.r = t.r and b.kind = t.kind
  join shares s on s.lang = t.lang and s.kind = b.kind and s.bin = b.bin group by 1, 2, 3),
-- Bins that a language lacks give p * log2(p / (p / 2)) = p.
unmet as (select t.r, t.kind, sum(b.c / t.total) as p from totals t join bins b on b.r = t.r and b.kind = t.kind
  left join shares s on s.lang = t.lang and s.kind = b.kind and s.bin = b.bin
  where t.total > 0 and s.q is null and b.c > 0 group by 1, 2),
near as (select m.r, avg(case when total > 0 then sqrt(greatest((part + (1 - met_q) + coalesce(p, 0)) / 2, 0)) else 1 end) as distance
  from met m left join unmet u on u.r = m.r and u.kind = m.kind group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  case when n_words >= {MIN_WORDS} then round(distance, 6) end as distance,
  not base_failed and coalesce(case when n_words >= {MIN_WORDS} then distance <= {MAX_DISTANCE} end, true) as kept
from judged j left join near n on n.r = j.r
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINKS = f"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}+') as ws from documents),
words as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from split where len(ws) >= 5),
windows as (select doc_id, concat_ws(' ', w, lead(w, 1) over q, lead(w, 2) over q, lead(w, 3) over q, lead(w, 4) over q) as s,
    lead(w, 4) over q as last from words window q as (partition by doc_id order by i)),
sets as (select distinct doc_id, s from windows where last is not null
  union all select doc_id, array_to_string(ws, ' ') from split where len(ws) between 1 and 4),
sizes as (select doc_id, count(*) as n from sets group by 1),
met as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on b.s = a.s and b.doc_id > a.doc_id group by 1, 2),
links as (select x, y from met join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= {{per_cent}} * (a.n + b.n - c)),
ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, w.y from reach r join ways w on w.x = r.other)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id{{more}}
from (select doc_id, min(other) as component_id from reach group by 1) d left join sizes s on s.doc_id = d.doc_id
"""
NEAR_DUP = _LINKS.format(per_cent=75, more=", d.doc_id = component_id as kept")
SHINGLE_JOIN = _LINKS.format(per_cent=80, more="")


def _kmeans(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Assignments and codebooks of the vector codes, one pair of tables a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""far{k} as (select b.r, b.part, e.entry, sum((b.v - e.v) * (b.v - e.v)) as far
  from bits b join book{k} e on e.part = b.part and e.place = b.place group by 1, 2, 3),
set{k} as (select r, part, min(entry) as entry, min(far) as far
  from (select *, min(far) over (partition by r, part) as least from far{k}) x where far = least group by 1, 2)"""
        )
        if k < rounds:
            steps.append(
                f"""sum{k} as (select b.part, s.entry, b.place, cast(sum(b.v) as bigint) as s, count(*) as c
  from bits b join set{k} s on s.r = b.r and s.part = b.part group by 1, 2, 3),
book{k + 1} as (select o.part, o.entry, o.place, coalesce((s - ((s % c) + c) % c) // c, o.v) as v
  from book{k} o left join sum{k} n on n.part = o.part and n.entry = o.entry and n.place = o.place)"""
            )
    tables = ",\n".join(steps)
    return f"""
with numbered as (select row_number() over () as n, * from embeddings where embedding is not null),
unusable as (select distinct n from (select n, unnest(embedding) as x from numbered) u
  where x is null or isnan(x) or isinf(x)),
kept as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding
  from numbered where n not in (select n from unusable)),
wide as (select r, unnest(embedding) as x, unnest(range(len(embedding))) as i, len(embedding) // {parts} as w from kept),
bits as (select r, i // w as part, i % w as place, cast(floor({scale}.0::double * x::double) as bigint) as v from wide),
book0 as (select part, r - 1 as entry, place, v from bits where r <= {entries}),
{tables},
coded as (select r, string_agg(printf('%02x', cast(entry as int)), '' order by part) as code, cast(sum(far) as bigint) as error
  from set{rounds} group by 1),
digest as (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, place)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept k join coded c on c.r = k.r cross join digest
"""


VECTOR_CODES = _kmeans()
