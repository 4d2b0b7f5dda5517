"""ANSI SQL for each registered query, on the same derived views."""

from __future__ import annotations

import re

from epilane.plans import tables

# Names of the steps that read themselves.
_RECURSIVE = ("walk", "fill", "levels", "rounds", "search")

_VIEW = {
    "counts": tables.COUNTS,
    "bed": tables.BED,
    "windows": tables.WINDOWS,
    "genome": tables.GENOME,
    "aln": tables.ALIGNMENTS,
    "hits": tables.HITS,
    "gene_diff": tables.GENE_DIFF,
}


def _with(views: str, *ctes: str, body: str) -> str:
    parts = [f"{v} as ({tables.oracle_text(_VIEW[v])})" for v in views.split()]
    parts += [c.strip() for c in ctes]
    recursive = any(re.search(rf"\b{name}\b as \(", c) for c in ctes for name in _RECURSIVE)
    return f"with {'recursive ' * recursive}" + ",\n".join(parts) + "\n" + body.strip()


_SITES = """
sites as (select chrom, pos from counts group by 1, 2 having sum(case when meth + unmeth >= 3 then 1 else 0 end) >= 1)
"""
_CLUSTERED = """
gaps as (select chrom, pos, case when pos - lag(pos) over (partition by chrom order by pos) <= 100 then 0 else 1 end as opens from sites),
islands as (select chrom, pos, sum(opens) over (partition by chrom order by pos rows unbounded preceding) as island from gaps),
clustered as (select chrom, pos, min(pos) over (partition by chrom, island) as region_start from islands)
"""
_REGIONS = """
extents as (select chrom, region_start, max(pos) as end_, count(*) as cpg from clustered group by 1, 2 having count(*) >= 2),
regions as (select c.chrom, e.region_start as start, e.end_, e.cpg, c.sample, cast(sum(c.meth + c.unmeth) as bigint) as n, cast(sum(c.meth) as bigint) as x
  from counts c join clustered s on c.chrom = s.chrom and c.pos = s.pos
  join extents e on e.chrom = s.chrom and e.region_start = s.region_start
  group by 1, 2, 3, 4, 5 having sum(c.meth + c.unmeth) >= 20)
"""
_GROUPED = """
stats as (select chrom, start, end_, cpg, substr(sample, 1, 1) as g, count(*) as k, avg(x / n) as mu, var_samp(x / n) as v,
    min(x / n) as lo, max(x / n) as hi, sum(n) as n, sum(x) as x from regions group by 1, 2, 3, 4, 5),
names as (select 'A' as g1, 'N' as g2 union all select 'A', 'R' union all select 'N', 'R'),
keys as (select distinct chrom, start, end_, cpg from stats),
pairs as (select k.*, n.g1, n.g2, a.k as k1, b.k as k2, a.mu as mu1, b.mu as mu2, b.mu - a.mu as diff, a.v as v1, b.v as v2,
    a.lo as lo1, a.hi as hi1, b.lo as lo2, b.hi as hi2, a.n as n1, a.x as x1, b.n as n2, b.x as x2
  from keys k cross join names n
  left join stats a on a.chrom = k.chrom and a.start = k.start and a.g = n.g1
  left join stats b on b.chrom = k.chrom and b.start = k.start and b.g = n.g2)
"""
_SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]

_GENOME_TEXT = """
chroms as (select chrom, string_agg(seq, '' order by chunk_no) as seq from genome group by 1)
"""

_SPLIT_FLOAT = """
big as (select chrom, region_start, max(pos) - region_start as span, count(*) as n,
    least(cast(ceil((max(pos) - region_start) / 150.0) as bigint), count(*) // 2) as k
  from clustered group by 1, 2 having count(*) >= 2),
placed as (select c.chrom, c.region_start, c.pos, row_number() over (partition by c.chrom, c.region_start order by c.pos) - 1 as j,
    b.n, case when b.span > 150 then b.k else 1 end as k, cast(b.span as double) / b.k as len
  from clustered c join big b on b.chrom = c.chrom and b.region_start = c.region_start),
walk as (
  select chrom, region_start, j, 0 as first, cast(region_start as double) as prev, 0 as cuts, 0 as cut from placed where j = 0
  union all
  select w.chrom, w.region_start, p.j,
    case when p.pos > w.prev + p.len and p.j - w.first >= 2 and w.cuts < p.k - 1 then p.j else w.first end,
    case when p.pos > w.prev + p.len and p.j - w.first >= 2 and w.cuts < p.k - 1 then w.prev + p.len else w.prev end,
    case when p.pos > w.prev + p.len and p.j - w.first >= 2 and w.cuts < p.k - 1 then w.cuts + 1 else w.cuts end,
    case when p.pos > w.prev + p.len and p.j - w.first >= 2 and w.cuts < p.k - 1 then 1 else 0 end
  from walk w join placed p on p.chrom = w.chrom and p.region_start = w.region_start and p.j = w.j + 1),
slots as (select chrom, region_start, n, k, unnest(range(1, cast(k as bigint) + 1)) as slot from (select distinct chrom, region_start, n, k from placed) z),
ends as (select s.chrom, s.region_start, s.slot, coalesce(w.j, s.n) as e from slots s
  left join walk w on w.chrom = s.chrom and w.region_start = s.region_start and w.cut = 1 and w.cuts = s.slot),
fill as (
  select s.chrom, s.region_start, s.slot, s.n as e from slots s where s.slot = s.k
  union all
  select f.chrom, f.region_start, e.slot, case when f.e - e.e < 2 then f.e - 2 else e.e end
  from fill f join ends e on e.chrom = f.chrom and e.region_start = f.region_start and e.slot = f.slot - 1),
pieces as (select p.chrom, p.region_start, p.pos, count(f.e) as piece from placed p
  left join fill f on f.chrom = p.chrom and f.region_start = p.region_start and f.e <= p.j group by 1, 2, 3)
"""

ORACLES = {
    "regions_nx": _with(
        "counts", _SITES, _CLUSTERED, _REGIONS,
        body="select chrom, start, end_ as \"end\", cpg, "
        + ", ".join(
            f"max(case when sample = '{s}' then n end) as \"{s}-N\", max(case when sample = '{s}' then x end) as \"{s}-X\""
            for s in _SAMPLES
        )
        + " from regions group by 1, 2, 3, 4",
    ),
    "regions_fraction": _with(
        "counts", _SITES, _CLUSTERED, _REGIONS,
        body="select chrom, start, end_ as \"end\", cpg, "
        + ", ".join(f"round(max(case when sample = '{s}' then x / n end), 6) as \"{s}\"" for s in _SAMPLES)
        + " from regions group by 1, 2, 3, 4",
    ),
    "qualify_sites": _with(
        "counts",
        body="""select chrom, pos, count(case when meth + unmeth >= 60 then 1 end) as n_samples from counts
                group by 1, 2 having count(case when meth + unmeth >= 60 then 1 end) >= 4""",
    ),
    "cluster_sites": _with("counts", _SITES, _CLUSTERED, body="select chrom, pos, region_start from clustered"),
    "split_regions": _with(
        "counts", _SITES, _CLUSTERED, _SPLIT_FLOAT,
        body="select chrom, min(pos) as start, max(pos) as \"end\", count(*) as cpg from pieces group by chrom, region_start, piece",
    ),
    "union_samples": _with("counts", body="select sample, chrom, pos, meth, unmeth from counts"),
    "bed_combine": _with(
        "counts bed genome", _GENOME_TEXT,
        "wide as (select distinct chrom, start - 1 as start, end_ + 1 as end_ from bed)",
        """sums as (select w.chrom, w.start, w.end_, c.sample, sum(c.meth) as m, sum(c.meth + c.unmeth) as t
             from wide w join counts c on c.chrom = w.chrom and c.pos >= w.start + 1 and c.pos < w.end_ + 1
             group by 1, 2, 3, 4 having sum(c.meth + c.unmeth) > 0)""",
        """text as (select w.chrom, w.start, w.end_,
             upper(substr(g.seq, greatest(w.start, 0) + 1, w.end_ - greatest(w.start, 0))) as seq
             from wide w join chroms g on g.chrom = w.chrom)""",
        body="""select w.chrom, w.start, w.end_ as "end", s.sample, round(s.m / s.t, 6) as frac,
                  cast((length(t.seq) - length(replace(t.seq, 'CG', ''))) / 2 as int) as cpg
                from wide w left join text t on t.chrom = w.chrom and t.start = w.start and t.end_ = w.end_
                left join sums s on s.chrom = w.chrom and s.start = w.start and s.end_ = w.end_""",
    ),
    "interval_join": _with(
        "counts bed",
        body="""select b.name, b.chrom, b.start, b.end_ as "end", c.pos, c.sample, c.meth, c.unmeth
                from bed b join counts c on c.chrom = b.chrom and c.pos >= b.start and c.pos < b.end_""",
    ),
    "interval_join_left": _with(
        "counts bed",
        body="""select b.name, b.chrom, b.start, b.end_ as "end", c.pos, c.sample, c.meth, c.unmeth
                from bed b left join counts c on c.chrom = b.chrom and c.pos >= b.start and c.pos < b.end_""",
    ),
    "pairwise_diff": _with(
        "counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED,
        "best as (select *, max(abs(diff)) over (partition by chrom, start) as top from pairs)",
        body="""select chrom, start, end_ as "end", cpg, g1, g2, round(mu1, 6) as mu1, round(mu2, 6) as mu2,
                  round(diff, 6) as diff from best where top >= 0.05""",
    ),
    "welch_stat": _with(
        "counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED,
        """tests as (select *, case when k1 >= 2 and k2 >= 2 and not (lo1 = hi1 and lo2 = hi2) then 1 end as ok,
             v1 / k1 + v2 / k2 as se from pairs)""",
        body="""select chrom, start, end_ as "end", cpg, g1, g2, round(mu1, 6) as mu1, round(mu2, 6) as mu2,
                  round(diff, 6) as diff, round(case when ok = 1 then (mu1 - mu2) / sqrt(se) end, 6) as t,
                  round(case when ok = 1 then se * se / ((v1 / k1) * (v1 / k1) / (k1 - 1) + (v2 / k2) * (v2 / k2) / (k2 - 1)) end, 6) as df
                from tests""",
    ),
    "ztest_stat": _with(
        "counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED,
        "pooled as (select *, (x1 + x2) / (n1 + n2) as p from pairs)",
        body="""select chrom, start, end_ as "end", cpg, g1, g2, round(x1 / n1, 6) as mu1, round(x2 / n2, 6) as mu2,
                  round(x2 / n2 - x1 / n1, 6) as diff,
                  round(case when p is null then null when p in (0, 1) then 0
                       else (x2 / n2 - x1 / n1) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)) end, 6) as z
                from pooled""",
    ),
    "specific_diffs": _with(
        "counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED,
        """flat as (select chrom, start, end_, cpg, max(case when g1 = 'A' and g2 = 'N' then diff end) as an,
             max(case when g1 = 'A' and g2 = 'R' then diff end) as ar, max(case when g1 = 'N' and g2 = 'R' then diff end) as nr
             from pairs group by 1, 2, 3, 4)""",
        body="""select chrom, start, end_ as "end", cpg, round(an, 6) as "A_N", round(ar, 6) as "A_R", round(nr, 6) as "N_R",
                  case when an > 0 then 'up' else 'down' end as direction
                from flat where (an >= 0.1 and ar < an / 2) or (an <= -0.1 and ar > an / 2)""",
    ),
}


def _calls_cte(skip: int, paired: str, same_chrom: str = "true") -> str:
    """Calls by direct case analysis of the three CIGARs of the derived reads."""
    return f"""
raw_calls as (select a.line_no, a.qname, a.rname as chrom, a.flag, a.cigar, t.i, substr(a.xm, cast(t.i + 1 as int), 1) as call,
    case when a.xg = 'GA' then 1 else 0 end as rc, a.pos, ({paired}) as paired
  from aln a cross join (select unnest(range(32)) as i) t
  where (a.flag & {skip}) = 0 and substr(a.xm, cast(t.i + 1 as int), 1) in ('z', 'Z')),
placed_calls as (select line_no, qname, chrom, call, paired,
    pos + i - rc + case cigar
      when '16M2I14M' then case when i < 16 then 0 when i = 16 then -1 else -2 end
      when '10M3D22M' then case when i < 10 or (i = 10 and rc = 1) then 0 else 3 end
      else 0 end as loc,
    cigar = '16M2I14M' and i in (16 + rc, 17 + rc) as ins
  from raw_calls),
first_mates as (select qname, min(line_no) as line_no, arg_min(rname, line_no) as chrom from aln a where (a.flag & {skip}) = 0 and ({paired}) group by 1),
first_sites as (select distinct f.qname, f.line_no, f.chrom, c.loc from first_mates f join placed_calls c on c.line_no = f.line_no),
calls as (select c.line_no, c.qname, c.chrom, c.loc, c.call, c.ins from placed_calls c
  left join first_sites f on f.qname = c.qname and f.loc = c.loc and f.line_no <> c.line_no and c.paired and {same_chrom}
  where f.qname is null)
"""


_CALLS = _calls_cte(2308, "(a.flag & 1) = 1 and a.rnext in ('=', a.rname)")
_CALLS_OLD = _calls_cte(4, "(a.flag & 1) = 1", "f.chrom = c.chrom")

_LINKED = """
hits as (select w.name, c.qname, c.loc as pos, count(case when c.call = 'z' then 1 end) as u, count(case when c.call = 'Z' then 1 end) as m
  from windows w join calls c on c.chrom = w.chrom and c.loc >= w.start and c.loc < w.end_ group by 1, 2, 3),
region_sites as (select distinct name, pos from hits),
region_reads as (select distinct name, qname from hits),
patterns as (select r.name, r.qname, count(*) as sites,
    string_agg(case when h.u = 1 then '0' when h.m = 1 then '1' else '-' end, '' order by s.pos) as pattern
  from region_reads r join region_sites s on s.name = r.name
  left join hits h on h.name = r.name and h.qname = r.qname and h.pos = s.pos group by 1, 2)
"""

_SPANS = """
spans as (select *, pos - 1 as st, pos - 1 + 32 + case cigar when '16M2I14M' then -2 when '10M3D22M' then 3 else 0 end as en,
    (flag & 16) <> 0 as rev from aln where (flag & 2308) = 0),
chroms as (select chrom, max(end_) as length from windows group by 1),
frags as (
  select arg_max(rname, line_no) as chrom, min(case when rev then en else st end) as st, max(case when rev then en else st end) as en, qname
  from spans where (flag & 2) <> 0 group by qname having count(*) = 2
  union all
  select rname, case when rev then least(en - 60, st) else st end, case when rev then en else greatest(st + 60, en) end, qname
  from spans where (flag & 2) = 0)
"""

_RC = "case when (flag & 16) <> 0 then translate(reverse(seq), 'ACGTN', 'TGCAN') else seq end"
_RQ = "case when (flag & 16) <> 0 then reverse(qual) else qual end"

_DEDUP = f"""
copies as (select line_no, qname, flag, rname, pos, cigar, {tables.COPIED_SEQ} as seq, {tables.COPIED_XM} as xm from aln),
keyed as (select *, case when (flag & 16) <> 0 then pos + 32 + case cigar when '16M2I14M' then -2 when '10M3D22M' then 3 else 0 end else pos end as loc,
    (flag & 16) <> 0 as rev from copies where (flag & 4) = 0)
"""
_DEDUP_OUT = "line_no, qname, flag, rname, pos, cigar, seq"

_KEYS_TEXT = """
scored as (select a.line_no, cast(sum(ascii(substr(a.qual, cast(t.i + 1 as int), 1)) - 33) as bigint) as score
  from aln a cross join (select unnest(range(32)) as i) t group by 1),
dupkeys as (select a.line_no, a.qname, a.flag, s.score,
    concat('(''', a.rname, ''', ', case when (a.flag & 16) <> 0 then a.pos + case a.cigar when '16M2I14M' then 30 when '10M3D22M' then 35 else 32 end else a.pos end,
      ', ', {splices}'''', case when (a.flag & 16) <> 0 then '-' else '+' end, ''')') as key
  from aln a join scored s on s.line_no = a.line_no where (a.flag & 4) = 0)
"""
_DUPKEYS = _KEYS_TEXT.replace("{splices}", "'(), ', ")
_DUPKEYS_PICARD = _KEYS_TEXT.replace("{splices}", "")

_PILE = """
over as (select w.name, w.chrom, a.line_no, a.qname, a.pos, a.cigar, a.xm, a.seq,
    a.pos + 32 + case a.cigar when '16M2I14M' then -2 when '10M3D22M' then 3 else 0 end as loc3
  from windows w join aln a on a.rname = w.chrom
  where (a.pos between w.start and w.end_)
     or (a.pos + 32 + case a.cigar when '16M2I14M' then -2 when '10M3D22M' then 3 else 0 end between w.start and w.end_)
     or (a.pos <= w.start and a.pos + 32 + case a.cigar when '16M2I14M' then -2 when '10M3D22M' then 3 else 0 end >= w.end_)),
bounds as (select name, chrom, min(pos) as min_loc, max(loc3) as max_loc from over group by 1, 2)
"""
_ALIGN = """
insp as (select distinct name, pos + 16 as p from over where cigar = '16M2I14M'),
texts as (select name, 'read' as kind, line_no, qname, pos, loc3 - 1 as last, cigar, {text} as txt from over),
basepos as (select r.name, r.kind, r.line_no, r.qname, r.pos, r.cigar, p.p,
    case r.cigar
      when '16M2I14M' then case when p.p < r.pos + 16 then substr(txt, cast(p.p - r.pos + 1 as int), 1) else substr(txt, cast(p.p - r.pos + 3 as int), 1) end
      when '10M3D22M' then case when p.p < r.pos + 10 then substr(txt, cast(p.p - r.pos + 1 as int), 1)
                                when p.p < r.pos + 13 then '-' else substr(txt, cast(p.p - r.pos - 2 as int), 1) end
      else substr(txt, cast(p.p - r.pos + 1 as int), 1) end as base,
    case when r.cigar = '16M2I14M' and p.p = r.pos + 16 then substr(txt, 17, 2) else '--' end as insert
  from (select * from texts{more}) r, lateral (select unnest(range(cast(r.pos as bigint), cast(r.last + 1 as bigint))) as p) p),
aligned as (select b.name, b.kind, b.line_no, b.qname, b.pos,
    string_agg(case when i.p is not null and b.p > b.pos then concat(b.insert, b.base) else b.base end, '' order by b.p) as text
  from basepos b left join insp i on i.name = b.name and i.p = b.p group by 1, 2, 3, 4, 5),
pads as (select a.name, a.pos, a.pos - d.min_loc + 2 * count(i.p) as pad
  from (select distinct name, pos from aligned) a join bounds d on d.name = a.name
  left join insp i on i.name = a.name and i.p <= a.pos group by a.name, a.pos, d.min_loc),
rows_ as (select a.*, cast(p.pad as bigint) as pad from aligned a join pads p on p.name = a.name and p.pos = a.pos)
"""
_GENOME_ROWS = """
 union all select b.name, 'genome', null, 'genome', b.min_loc, b.max_loc - 1, '', upper(substr(g.seq, cast(b.min_loc as int), cast(b.max_loc - b.min_loc as int)))
  from bounds b join chroms g on g.chrom = b.chrom"""
_MASKED = "translate(xm, 'hHxX', '....')"

_MATRIX = """
widths as (select b.name, b.min_loc, b.max_loc - b.min_loc + 2 * count(i.p) as width from bounds b left join insp i on i.name = b.name and i.p < b.max_loc
  group by b.name, b.min_loc, b.max_loc),
letters as (select r.name, r.line_no, r.pad + t.k as col, substr(r.text, cast(t.k + 1 as int), 1) as c
  from rows_ r, lateral (select unnest(range(length(r.text))) as k) t),
loci as (select distinct l.name, l.col from letters l join widths w on w.name = l.name where l.c in ('z', 'Z') and l.col < w.width),
steps as (select name, col, case when col - lag(col) over (partition by name order by col) = 1 then 0 else 1 end as opens from loci),
runs as (select name, col, sum(opens) over (partition by name order by col) as run from steps),
halves as (select name, col, (row_number() over (partition by name, run order by col) - 1) % 2 as half from runs),
gencols as (select b.name, p.p, k.k, row_number() over (partition by b.name order by p.p, k.k) - 1 as col,
    case when k.k < 2 and p.p > b.min_loc then 1 else 0 end as gap
  from bounds b, lateral (select unnest(range(cast(b.min_loc as bigint), cast(b.max_loc as bigint))) as p) p, lateral (select unnest(range(3)) as k) k
  left join insp i on i.name = b.name and i.p = p.p where k.k = 2 or i.p is not null),
tally as (select name, col, cast(sum(gap) over (partition by name order by col) as bigint) as gaps from gencols),
sites2 as (select h.name, h.col as col0, case when n.half = 1 then n.col end as col1, h.col + w.min_loc - t.gaps as chr_pos
  from halves h left join halves n on n.name = h.name and n.col = h.col + 1
  join tally t on t.name = h.name and t.col = h.col join widths w on w.name = h.name where h.half = 0),
cells as (select r.name, r.line_no, r.qname, r.pos, s.col0, s.col1, s.chr_pos, r.pad, r.pad + length(r.text) as stop,
    case when s.col0 < r.pad then ' ' when s.col0 >= r.pad + length(r.text) then null else substr(r.text, cast(s.col0 - r.pad + 1 as int), 1) end as c0,
    case when s.col1 < r.pad then ' ' when s.col1 >= r.pad + length(r.text) then null else substr(r.text, cast(s.col1 - r.pad + 1 as int), 1) end as c1
  from rows_ r join sites2 s on s.name = r.name),
marks as (select *, case
    when c0 is null then '-'
    when col1 is null and c0 = ' ' then '-'
    when col1 is not null and c1 = ' ' then '-'
    when c0 = 'z' then '0' when c0 = 'Z' then '1'
    when col1 is null then 'x'
    when c1 is null then '-'
    when c1 = 'z' then '0' when c1 = 'Z' then '1' else 'x' end as mark from cells)
"""

_SCORED = """
scored as (select chrom, start, end_, cpg, g1, g2, mu1, mu2, diff, round(1 - abs(diff), 3) as pval from pairs where diff is not null)
"""
_TESTS = ("counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED, _SCORED)

ORACLES |= {
    "cpg_calls": _with("aln", _CALLS, body="select * from calls"),
    "cpg_calls_old": _with("aln", _CALLS_OLD, body="select * from calls"),
    "cpg_counts": _with(
        "aln", _CALLS,
        body="""select chrom, loc as pos, count(case when call = 'Z' then 1 end) as meth, count(case when call = 'z' then 1 end) as unmeth,
                  round(100.0 * count(case when call = 'Z' then 1 end) / count(*), 6) as pct
                from calls where not ins group by 1, 2 having count(*) >= 2""",
    ),
    "cpg_summary": _with(
        "aln", _CALLS,
        "base as (select count(*) as reads, count(case when (flag & 4) = 0 then 1 end) as mapped from aln where (flag & 2304) = 0)",
        "agg as (select count(*) as calls, count(case when call = 'Z' then 1 end) as methylated from calls)",
        body="""select reads, mapped, calls, methylated, calls - methylated as unmethylated,
                  round(100.0 * methylated / calls, 6) as pct from base cross join agg""",
    ),
    "linked_methylation": _with(
        "aln windows", _CALLS, _LINKED,
        body="""select w.name, w.chrom, w.start, w.end_ as "end", coalesce(p.sites, 0) as sites, p.qname,
                  coalesce(p.pattern, '<none>') as pattern from windows w left join patterns p on p.name = w.name""",
    ),
    "linked_sites": _with(
        "aln windows", _CALLS, _LINKED,
        body="select name, pos, row_number() over (partition by name order by pos) - 1 as idx from region_sites",
    ),
    "sam_to_bed": _with(
        "aln windows", _SPANS,
        body="""select f.chrom, greatest(st, 0) as start, least(en, length) as "end", qname,
                  (st < 0 or en > length) as clamped from frags f left join chroms c on c.chrom = f.chrom""",
    ),
    "sam_to_fastq": _with(
        "aln",
        "firsts as (select *, row_number() over (partition by qname order by line_no) as k from aln where (flag & 2304) = 0)",
        body=f"select qname as name, {_RC} as seq, {_RQ} as qual from firsts where k = 1",
    ),
    "sam_to_fastq_pe": _with(
        "aln",
        body=f"""select case when (flag & 2) = 0 then 'unpaired' when (flag & 64) <> 0 then '1' else '2' end as "end",
                   concat(qname, case when (flag & 2) = 0 then '' when (flag & 64) <> 0 then ' /1' else ' /2' end) as name,
                   {_RC} as seq, {_RQ} as qual from aln where (flag & 2304) = 0""",
    ),
    "fastq_pe_roundtrip": _with(
        "aln",
        f"ends as (select qname, flag, {_RC} as seq, {_RQ} as qual from aln where (flag & 2304) = 0 and (flag & 2) <> 0)",
        body="""select concat(a.qname, ' /1') as name_1, concat(b.qname, ' /2') as name_2, a.seq as seq_1, b.seq as seq_2,
                  a.qual as qual_1, b.qual as qual_2 from ends a join ends b on b.qname = a.qname
                where (a.flag & 64) <> 0 and (b.flag & 64) = 0""",
    ),
    "filter_reads_keep": _with(
        "aln",
        body="""select line_no, qname, flag, rname, pos, cigar, seq, qual from aln
                where qname in (select concat('r', o_orderkey) from orders where o_orderstatus = 'F')""",
    ),
    "filter_reads_drop": _with(
        "aln",
        body="""select line_no, qname, flag, rname, pos, cigar, seq, qual from aln
                where qname not in (select concat('r', o_orderkey) from orders where o_orderstatus = 'F')""",
    ),
    "alignments_per_read": _with(
        "aln",
        body="""select qname, count(case when (flag & 128) = 0 then 1 end) as first, count(case when (flag & 128) <> 0 then 1 end) as last
                from aln where (flag & 4) = 0 group by 1""",
    ),
    "read_score": _with(
        "aln", _DUPKEYS,
        body="""select qname, 'pair' as kind, cast(sum(score) as bigint) as score from dupkeys where (flag & 2304) = 0 and (flag & 1) = 1 and (flag & 8) = 0 group by 1
                union all select qname, 'single', arg_max(score, line_no) from dupkeys where (flag & 2304) = 0 and ((flag & 1) = 0 or (flag & 8) <> 0) group by 1""",
    ),
    "dedup_seq": _with(
        "aln", _DEDUP,
        "ranked as (select *, row_number() over (partition by rname, loc, rev, seq order by line_no) as k from keyed)",
        body=f"select {_DEDUP_OUT} from ranked where k = 1",
    ),
    "dedup_xm": _with(
        "aln", _DEDUP,
        "ranked as (select *, row_number() over (partition by rname, loc, rev, xm order by line_no) as k from keyed)",
        body=f"select {_DEDUP_OUT} from ranked where k = 1",
    ),
    "dedup_consensus": _with(
        "aln", _DEDUP,
        "counted as (select *, count(*) over (partition by rname, loc, rev, seq) as c, min(line_no) over (partition by rname, loc, rev, seq) as f from keyed)",
        "ranked as (select *, row_number() over (partition by rname, loc, rev order by c desc, f, line_no) as k from counted)",
        body=f"select {_DEDUP_OUT} from ranked where k = 1",
    ),
    "top_sequence": _with(
        "aln", _DEDUP,
        "counted as (select rname, loc, rev, seq, count(*) as copies, min(line_no) as first from keyed group by 1, 2, 3, 4)",
        "ranked as (select *, row_number() over (partition by rname, loc, rev order by copies desc, first) as k from counted)",
        body='select rname, loc, rev as "reverse", seq, copies from ranked where k = 1',
    ),
    "dedup_summary": _with(
        "aln", _DEDUP,
        "marked as (select row_number() over (partition by rname, loc, rev order by line_no) as a, row_number() over (partition by rname, loc, rev, seq order by line_no) as b from keyed)",
        body="""select count(*) as reads, count(case when a = 1 then 1 end) as uniq, count(case when a > 1 and b = 1 then 1 end) as not_seq,
                  count(case when b > 1 then 1 end) as dups from marked""",
    ),
    "dups_se": _with(
        "aln", _DUPKEYS,
        "named as (select *, concat(qname, '#', line_no) as name from dupkeys where (flag & 2304) = 0)",
        "ranked as (select *, row_number() over (partition by key order by score desc, name) as k, first_value(name) over (partition by key order by score desc, name) as parent from named)",
        body="select name as qname, concat('aln:', key) as aln, parent, 'single-end' as type from ranked where k > 1",
    ),
    "dups_input": _with(
        "aln", _DUPKEYS,
        """p as (select a.qname, least(a.line_no, b.line_no) as line_no, a.key as aln0, b.key as aln1,
             concat('(', least(a.key, b.key), ', ', greatest(a.key, b.key), ')') as key
           from dupkeys a join dupkeys b on b.qname = a.qname and (a.flag & 64) <> 0 and (b.flag & 128) <> 0
             and (a.flag & 8) = 0 and (b.flag & 8) = 0)""",
        "po as (select key, arg_min(qname, line_no) as parent, min(line_no) as line_no from p group by 1)",
        """ends as (select aln0 as key, p.line_no, p.qname from p join po on po.key = p.key and po.line_no = p.line_no
           union all select aln1, p.line_no, p.qname from p join po on po.key = p.key and po.line_no = p.line_no)""",
        """s as (select qname, line_no, key, min(line_no) over (partition by qname) as first from dupkeys
             where (flag & 1) = 0 or (flag & 8) <> 0)""",
        "claims as (select key, 0 as stage, line_no as a, line_no as b, qname from ends union all select key, 1, first, line_no, qname from s)",
        "so as (select key, qname as parent, row_number() over (partition by key order by stage, a, b) as k from claims)",
        """sh as (select s.qname, s.key, so.parent, row_number() over (partition by s.qname order by s.line_no) as k
             from s join so on so.key = s.key and so.k = 1 where so.parent <> s.qname)""",
        body="""select p.qname, concat('aln:', p.key) as aln, po.parent, 'paired-end' as type from p join po on po.key = p.key where po.parent <> p.qname
                union all select qname, concat('aln:', key), parent, 'single-end' from sh where k = 1""",
    ),
    "dups_picard": _with(
        "aln", _DUPKEYS_PICARD,
        "prim as (select * from dupkeys where (flag & 256) = 0)",
        """p as (select qname, min(line_no) as line_no, arg_min(key, line_no) as aln0, arg_max(key, line_no) as aln1 from prim
             where (flag & 8) = 0 group by 1 having count(*) > 1)""",
        "pk as (select *, concat('(', least(aln0, aln1), ', ', greatest(aln0, aln1), ')') as key from p)",
        "pr as (select *, first_value(qname) over (partition by key order by line_no) as parent from pk)",
        """ends as (select aln0 as key, line_no, qname from pr where parent = qname union all select aln1, line_no, qname from pr where parent = qname)""",
        "eo as (select key, arg_max(qname, line_no) as parent from ends group by 1)",
        "s as (select *, first_value(qname) over (partition by key order by line_no) as first from prim where (flag & 8) <> 0)",
        body="""select qname, concat('aln:', key) as aln, parent, 'paired-end' as type from pr where parent <> qname
                union all select s.qname, concat('aln:', s.key), coalesce(eo.parent, s.first), 'SE->PE' from s left join eo on eo.key = s.key
                where eo.parent is not null or s.first <> s.qname""",
    ),
    "context_quality": _with(
        "aln",
        """ch as (select substr(xm, cast(t.i + 1 as int), 1) as c, ascii(substr(qual, cast(t.i + 1 as int), 1)) - 33 as q
             from aln cross join (select unnest(range(32)) as i) t)""",
        body="""select c as context, count(case when q < 30 then 1 end) as bad, count(case when q >= 30 then 1 end) as good,
                  round(count(case when q < 30 then 1 end) / count(*), 6) as bad_frac from ch where c in ('h', 'H', 'x', 'X', 'z', 'Z') group by 1""",
    ),
    "base_quality": _with(
        "aln",
        "firsts as (select *, row_number() over (partition by qname order by line_no) as k from aln where (flag & 2304) = 0)",
        f"fq as (select {_RC} as seq, {_RQ} as qual from firsts where k = 1)",
        """ch as (select substr(seq, cast(t.i + 1 as int), 1) as c, ascii(substr(qual, cast(t.i + 1 as int), 1)) - 33 as q
             from fq cross join (select unnest(range(32)) as i) t)""",
        body="select c as base, round(avg(q), 6) as mean, round(stddev_pop(q), 6) as std, count(*) as n from ch group by 1",
    ),
    "region_reads": _with(
        "aln windows", _PILE,
        body="""select o.name, o.line_no, o.qname, o.pos, o.pos - b.min_loc as pad,
                  case when cigar = '10M3D22M' then concat(substr(xm, 1, 10), '---', substr(xm, 11)) else xm end as text
                from over o join bounds b on b.name = o.name""",
    ),
    "region_genome": _with(
        "aln windows genome", _GENOME_TEXT, _PILE,
        body="""select b.name, b.chrom, b.min_loc, b.max_loc,
                  upper(substr(g.seq, cast(b.min_loc as int), cast(b.max_loc - b.min_loc as int))) as seq
                from bounds b join chroms g on g.chrom = b.chrom""",
    ),
    "region_alignment": _with(
        "aln windows genome", _GENOME_TEXT, _PILE,
        _ALIGN.replace("{text}", _MASKED).replace("{more}", _GENOME_ROWS),
        body="select name, kind, line_no, qname, pos, pad, text from rows_",
    ),
    "region_alignment_seq": _with(
        "aln windows", _PILE, _ALIGN.replace("{text}", "seq").replace("{more}", ""),
        body="select name, kind, line_no, qname, pos, pad, text from rows_",
    ),
    "region_cpg_matrix": _with(
        "aln windows", _PILE, _ALIGN.replace("{text}", "xm").replace("{more}", ""), _MATRIX,
        body="""select r.name, r.line_no, r.qname, r.pos, coalesce(string_agg(m.mark, '' order by m.col0), '') as pattern
                from rows_ r left join marks m on m.name = r.name and m.line_no = r.line_no group by 1, 2, 3, 4""",
    ),
    "region_cpg_summary": _with(
        "aln windows", _PILE, _ALIGN.replace("{text}", "xm").replace("{more}", ""), _MATRIX,
        body="""select name, chr_pos, concat(chr_pos, case when col1 is not null then '+1' else '' end) as site,
                  count(case when mark = '1' then 1 end) as meth, count(case when mark = '0' then 1 end) as unmeth
                from marks group by 1, 2, 3""",
    ),
    "cpg_motif_count": _with(
        "genome",
        body="""select chrom, chunk_no, cast((length(seq) - length(replace(upper(seq), 'CG', ''))) / 2 as int) as cpg from genome""",
    ),
    "extract_segments": _with(
        "bed genome", _GENOME_TEXT,
        body="""select b.chrom, b.start as pos, b.end_ - b.start as len, upper(substr(g.seq, b.start + 1, b.end_ - b.start)) as seq,
                  b.end_ >= length(g.seq) as past_end from bed b left join chroms g on g.chrom = b.chrom""",
    ),
    "extract_segments_rc": _with(
        "bed genome", _GENOME_TEXT,
        body="""select b.chrom, b.start as pos, b.end_ - b.start as len,
                  translate(reverse(upper(substr(g.seq, b.start + 1, b.end_ - b.start))), 'ACGTN', 'TGCAN') as seq,
                  b.end_ >= length(g.seq) as past_end from bed b left join chroms g on g.chrom = b.chrom""",
    ),
    "gene_matrix": """
select p_brand as "Symbol", cast(max(p_size) as bigint) as "Length",
  """ + ", ".join(
        f"cast(round(sum(case when l_returnflag = '{f}' then cast(l_quantity as bigint) * l_linenumber / 2 end)) as bigint) as \"{f}\""
        for f in "ANR"
    ) + " from lineitem join part on l_partkey = p_partkey group by 1",
    "significant_genes": _with(
        "gene_diff",
        "rows_ as (select * from gene_diff where sample_1 <> 's2' and sample_2 <> 's2')",
        body="""select gene, sample_1, sample_2, case when status = 'OK' then fold else 0 end as value from rows_
                where gene in (select gene from rows_ where significant = 'yes')""",
    ),
    "heatmap": _with(
        "gene_diff",
        "top as (select max(case when significant = 'yes' and not isinf(fold) then abs(fold) end) as top from gene_diff)",
        """folds as (select gene, case when sample_1 = 's3' then sample_2 else sample_1 end as sample,
             case when sample_1 = 's3' then 1 else -1 end as sgn,
             case when status <> 'OK' then 0 when isinf(fold) then case when fold > 0 then top else 0 - top end else fold end as v
           from gene_diff cross join top where (sample_1 = 's3' or sample_2 = 's3')
             and gene in (select gene from gene_diff where significant = 'yes'))""",
        body="select gene, "
        + ", ".join(
            f"max(case when sample = '{s}' then case when sgn = 1 then v else 0 - v end end) as {s}"
            for s in ("s1", "s2", "s4", "s5", "s6")
        )
        + " from folds group by 1",
    ),
    "bh_fdr": _with(
        *_TESTS,
        """ranked as (select *, pval * count(*) over (partition by g1, g2)
             / count(*) over (partition by g1, g2 order by pval range between unbounded preceding and current row) as raw from scored)""",
        body="""select chrom, start, end_ as "end", cpg, g1, g2, round(mu1, 6) as mu1, round(mu2, 6) as mu2, round(diff, 6) as diff, pval,
                  round(least(1.0, min(raw) over (partition by g1, g2 order by pval desc range between unbounded preceding and current row)), 6) as fdr
                from ranked""",
    ),
    "dmr_filter": _with(
        *_TESTS,
        """passing as (select chrom, start from scored where cpg >= 3 and abs(diff) >= 0.02 and pval <= 1 and diff >= 0
             group by 1, 2 having count(*) >= 2)""",
        body="""select s.chrom, s.start, s.end_ as "end", s.cpg, g1, g2, round(mu1, 6) as mu1, round(mu2, 6) as mu2, round(diff, 6) as diff, pval
                from scored s join passing p on p.chrom = s.chrom and p.start = s.start""",
    ),
    "group_means": _with(
        *_TESTS,
        "sides as (select chrom, start, end_, cpg, g1 as grp, mu1 as mu from scored union all select chrom, start, end_, cpg, g2, mu2 from scored)",
        body='select chrom, start, end_ as "end", cpg, grp as "group", round(avg(mu), 6) as mu from sides group by 1, 2, 3, 4, 5',
    ),
    "attach_tests": _with(
        *_TESTS,
        "allregions as (select chrom, region_start as start, max(pos) as end_, count(*) as cpg from clustered group by 1, 2)",
        body="""select r.chrom, r.start, r.end_ as "end", r.cpg, t.g1, t.g2, round(t.diff, 6) as diff, t.pval
                from allregions r left join scored t on t.chrom = r.chrom and t.start = r.start""",
    ),
    "sites_natural_order": _with(
        "counts",
        body="select chrom, pos, sample, cast(substr(chrom, 4) as bigint) as chrom_no from counts order by 4, 2, 3",
    ),
    "chrom_first_seen": _with(
        "counts",
        "seen as (select *, row_number() over (partition by chrom order by sample, pos) as k from counts)",
        body="select chrom, sample, pos from seen where k = 1",
    ),
    "sam_roundtrip": _with(
        "aln", body="select qname, flag, rname, pos, cigar, rnext, pnext, seq, qual, xm, xg from aln"
    ),
    "counts_roundtrip": _with("counts", body="select sample, chrom, pos, meth, unmeth from counts"),
    "fasta_roundtrip": _with(
        "genome", _GENOME_TEXT,
        body="""select chrom, k as chunk_no, k * 100 as offset, substr(seq, cast(k * 100 + 1 as int), 100) as seq
                from chroms, lateral (select unnest(range(0, cast(ceil(length(seq) / 100.0) as bigint))) as k) t""",
    ),
}
ORACLES["fastq_roundtrip"] = ORACLES["sam_to_fastq"]

ORACLES["split_regions_integer"] = _with(
    "counts", _SITES, _CLUSTERED,
    """levels as (
  select chrom, pos, region_start, max(pos) over (partition by chrom, region_start) - region_start as span, 0 as level,
    count(*) over (partition by chrom, region_start) as n from clustered
  union all
  select chrom, pos, new_start, max(pos) over (partition by chrom, new_start) - new_start, level + 1, n from (
    select *, min(pos) over (partition by chrom, region_start, piece) as new_start from (
      select *, least(cast(ceil(span / 150.0) as bigint) - 1,
          (greatest(pos - region_start, 1) - 1) // (span // cast(ceil(span / 150.0) as bigint))) as piece
      from levels where span > 150) x) y)""",
    "last as (select *, row_number() over (partition by chrom, pos order by level desc) as k from levels where n >= 2)",
    body="""select chrom, region_start as start, max(pos) as "end", count(*) as cpg from last where k = 1 group by 1, 2""",
)
ORACLES["dups_ranked"] = _with(
    "aln", _DUPKEYS,
    """p as (select a.qname, a.key as aln0, b.key as aln1, a.score + b.score as score,
         concat('(', least(a.key, b.key), ', ', greatest(a.key, b.key), ')') as key
       from dupkeys a join dupkeys b on b.qname = a.qname and (a.flag & 64) <> 0 and (b.flag & 128) <> 0
         and (a.flag & 8) = 0 and (b.flag & 8) = 0)""",
    "pr as (select *, first_value(qname) over (partition by key order by score desc, qname) as parent from p)",
    """ends as (select aln0 as key, qname, score from pr where parent = qname union all select aln1, qname, score from pr where parent = qname)""",
    "pe_owner as (select key, qname as parent, row_number() over (partition by key order by score desc, qname) as k from ends)",
    "single_rows as (select * from dupkeys where (flag & 1) = 0 or (flag & 8) <> 0)",
    "sscore as (select qname, arg_max(score, line_no) as score from single_rows where (flag & 2304) = 0 group by 1)",
    "srank as (select qname, row_number() over (order by score desc, qname) as r from sscore)",
    """edges as (select s.qname, s.line_no, s.key, k.r, o.parent as pe_parent,
         case when max(case when o.parent is not null then 1 else 0 end) over (partition by s.qname) = 1 then 2 else 0 end as status
       from single_rows s join srank k on k.qname = s.qname left join pe_owner o on o.key = s.key and o.k = 1)""",
    """rounds as (
  select qname, line_no, key, r, pe_parent, status, 0 as step from edges
  union all
  select qname, line_no, key, r, pe_parent, case when status = 0 and beaten = 1 then 2 else status end, step + 1 from (
    select *, max(case when kept_here = 1 and status <> 1 then 1 else 0 end) over (partition by qname) as beaten from (
      select qname, line_no, key, r, pe_parent, step, status, max(case when status = 1 then 1 else 0 end) over (partition by key) as kept_here from (
        select * exclude (status, best), case when status = 0 and min(best) over (partition by qname) = 1 then 1 else status end as status from (
          select *, case when r = min(case when status = 0 then r end) over (partition by key) then 1 else 0 end as best,
            max(case when status = 0 then 1 else 0 end) over () as open from rounds) a where open = 1) b) c) d)""",
    "final as (select * from rounds where step = (select max(step) from rounds))",
    "owner as (select key, arg_min(qname, r) as parent, min(r) as r from final where status = 1 group by 1)",
    """hit as (select f.qname, f.key, coalesce(f.pe_parent, o.parent) as parent, row_number() over (partition by f.qname order by f.line_no) as k
       from final f left join owner o on o.key = f.key and o.r < f.r
       where f.status = 2 and (f.pe_parent is not null or o.parent is not null))""",
    body="""select qname, concat('aln:', key) as aln, parent, 'paired-end' as type from pr where parent <> qname
            union all select qname, concat('aln:', key), parent, 'single-end' from hit where k = 1""",
)

# p-values by Simpson's rule on 400 steps: the normal density from 0 to |z|, and the t
# tail after substituting the angle (fourth power, so the integrand is smooth at 0).
_SIMPSON = """
steps as (select i, case when i in (0, 400) then 1.0 when i % 2 = 1 then 4.0 else 2.0 end as w from (select unnest(range(401)) as i) t)
"""
ORACLES["ztest_pvalues"] = _with(
    "counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED, _SIMPSON,
    "pooled as (select *, (x1 + x2) / (n1 + n2) as p from pairs)",
    """zs as (select *, x2 / n2 - x1 / n1 as d, case when p is null then null when p in (0, 1) then 0
         else (x2 / n2 - x1 / n1) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)) end as z from pooled)""",
    """areas as (select chrom, start, g1, g2, least(abs(z), 10) / 1200 * sum(w * exp(0 - power(least(abs(z), 10) * i / 400, 2) / 2)) as area
         from zs cross join steps where z is not null group by chrom, start, g1, g2, z)""",
    """tested as (select zs.*, 1 - 2 * area / sqrt(2 * pi()) as pval from zs
         left join areas a on a.chrom = zs.chrom and a.start = zs.start and a.g1 = zs.g1 and a.g2 = zs.g2)""",
    "kept as (select distinct chrom, start from tested where abs(d) >= 0.02 and pval <= 0.05)",
    body="""select t.chrom, t.start, end_ as "end", cpg, g1, g2, round(x1 / n1, 6) as mu1, round(x2 / n2, 6) as mu2,
              round(d, 6) as diff, round(z, 6) as z, round(pval, 6) as pval
            from tested t join kept k on k.chrom = t.chrom and k.start = t.start""",
)
ORACLES["welch_pvalues"] = _with(
    "counts", _SITES, _CLUSTERED, _REGIONS, _GROUPED, _SIMPSON,
    """ws as (select *, k1 >= 2 and k2 >= 2 as enough, lo1 = hi1 and lo2 = hi2 as flat, v1 / k1 + v2 / k2 as se,
         (v1 / k1) * (v1 / k1) / (k1 - 1) + (v2 / k2) * (v2 / k2) / (k2 - 1) as sd from pairs)""",
    """ts as (select *, case when enough and not flat then (mu1 - mu2) / sqrt(se) end as t,
         case when enough and not flat then se * se / sd end as df from ws)""",
    """tails as (select chrom, start, g1, g2, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) *
           sum(w * 4 * power(b * i / 400, 3) * power(sin(power(b * i / 400, 4)), df - 1)) * b / 1200 as tail
         from (select *, power(atan2(sqrt(df), abs(t)), 0.25) as b from ts where t is not null) x cross join steps
         group by chrom, start, g1, g2, df, b)""",
    """tested as (select ts.*, case when not enough or diff is null then null when diff = 0 then 1 when flat then 0 else tail end as pval
         from ts left join tails a on a.chrom = ts.chrom and a.start = ts.start and a.g1 = ts.g1 and a.g2 = ts.g2)""",
    "kept as (select distinct chrom, start from tested where abs(diff) >= 0.05 and pval <= 0.2)",
    body="""select t.chrom, t.start, end_ as "end", cpg, g1, g2, round(mu1, 6) as mu1, round(mu2, 6) as mu2,
              round(diff, 6) as diff, round(t, 6) as t, round(df, 6) as df, round(pval, 6) as pval
            from tested t join kept k on k.chrom = t.chrom and k.start = t.start""",
)

# The dispersion search of the Wald test, written out for groups of two samples.
_LOW, _HIGH = "-5.0", "ln(0.99)"
_RATIO = "((sqrt(5.0) - 1) / 2)"


def _goal(at: str) -> str:
    a, b = f"(m * (exp(0 - ({at})) - 1))", f"((1 - m) * (exp(0 - ({at})) - 1))"

    def one(n, x):
        return (
            f"lgamma({x} + {a}) + lgamma({n} - {x} + {b}) - lgamma({n} + {a} + {b})"
            f" - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
        )

    return (
        f"({one('na', 'xa')} + case when nb > 0 then {one('nb', 'xb')} else 0.0 end"
        f" - power(({at}) - pm, 2) / (2 * power(ps, 2)))"
    )


_SEARCH_KEYS = "id, na, xa, nb, xb, m, pm, ps"
_WALD = (
    """
arms as (select chrom, start, end_, cpg, substr(sample, 1, 1) as g, count(*) as k, cast(sum(n) as double) as tn, cast(sum(x) as double) as tx,
    min(n) as least_n, avg(x / n) as mf, var_samp(x / n) as vf,
    cast(arg_min(n, sample) as double) as na, cast(arg_min(x, sample) as double) as xa,
    cast(case when count(*) > 1 then arg_max(n, sample) else 0 end as double) as nb,
    cast(case when count(*) > 1 then arg_max(x, sample) else 0 end as double) as xb
  from regions group by 1, 2, 3, 4, 5)
""",
    """
teach as (select g, ln(vf / least(greatest(mf, 1e-5), 1 - 1e-5) / (1 - least(greatest(mf, 1e-5), 1 - 1e-5))) as lp
  from arms where k = 2 and least_n > 10 and vf > 0)
""",
    """
prior as (select g, quantile_cont(lp, 0.5) as pm, (quantile_cont(lp, 0.75) - quantile_cont(lp, 0.25)) / 1.39 as ps from teach group by 1)
""",
    """
numbered as (select a.*, row_number() over (order by chrom, start, a.g) as id, (tx + 0.5) / (tn + 1) as mu,
    least(greatest((tx + 0.5) / (tn + 1), 1e-5), 1 - 1e-5) as m, p.pm, p.ps from arms a join prior p on p.g = a.g)
""",
    f"""
ends as (select {_SEARCH_KEYS}, {_LOW} as lo, {_HIGH} as hi, {_HIGH} - {_RATIO} * ({_HIGH} - ({_LOW})) as l, {_LOW} + {_RATIO} * ({_HIGH} - ({_LOW})) as r from numbered)
""",
    f"""
search as (
  select {_SEARCH_KEYS}, 0 as step, cast(lo as double) as lo, cast(hi as double) as hi, cast(l as double) as l, cast(r as double) as r,
    {_goal('l')} as fl, {_goal('r')} as fr from ends
  union all
  select {_SEARCH_KEYS}, step + 1, nlo, nhi, case when better then fresh else r end, case when better then l else fresh end,
    case when better then v else fr end, case when better then fl else v end
  from (select *, {_goal('fresh')} as v
    from (select *, case when better then nhi - {_RATIO} * (nhi - nlo) else nlo + {_RATIO} * (nhi - nlo) end as fresh
      from (select *, fl > fr as better, case when fl > fr then r else hi end as nhi, case when fl > fr then lo else l end as nlo
        from search where step < 40) a) b) c)
""",
    f"""
tops as (select *, {_goal('c - 0.001')} as f0, {_goal('c')} as f1, {_goal('c + 0.001')} as f2 from (select *, (lo + hi) / 2 as c from search where step = 40) s)
""",
    f"""
found as (select id, least(greatest(case when f0 - 2 * f1 + f2 < 0 and abs(0.001 * (f0 - f2) / (2 * (f0 - 2 * f1 + f2))) <= 0.001
    then c + 0.001 * (f0 - f2) / (2 * (f0 - 2 * f1 + f2)) else c end, {_LOW}), {_HIGH}) as lp from tops)
""",
    f"""
fitted as (select n.chrom, n.start, n.end_, n.cpg, n.g, n.mu, least(lp - ({_LOW}), {_HIGH} - lp) < 1e-6 as edge,
    n.mu * (1 - n.mu) * (na * (1 + (na - 1) * exp(lp)) + nb * (1 + (nb - 1) * exp(lp))) / (tn * tn) as v
  from numbered n join found f on f.id = n.id)
""",
    """
names as (select 'A' as g1, 'N' as g2 union all select 'A', 'R' union all select 'N', 'R')
""",
    """
waldrows as (select a.chrom, a.start, a.end_, a.cpg, a.g as g1, b.g as g2, a.mu as mu1, b.mu as mu2, b.mu - a.mu as diff,
    (b.mu - a.mu) / sqrt(a.v + b.v) as stat, a.edge or b.edge as at_edge
  from fitted a join fitted b on b.chrom = a.chrom and b.start = a.start and b.g > a.g join names n on n.g1 = a.g and n.g2 = b.g)
""",
    """
steps as (select i, case when i in (0, 2000) then 1.0 when i % 2 = 1 then 4.0 else 2.0 end as w from (select unnest(range(2001)) as i) t)
""",
    """
areas as (select chrom, start, g1, g2, least(abs(stat), 10) / 6000 * sum(w * exp(0 - power(least(abs(stat), 10) * i / 2000, 2) / 2)) as area
  from waldrows cross join steps group by chrom, start, g1, g2, stat)
""",
    """
valued as (select r.*, greatest(1 - 2 * area / sqrt(2 * pi()), 0.0) as pval from waldrows r
  join areas a on a.chrom = r.chrom and a.start = r.start and a.g1 = r.g1 and a.g2 = r.g2)
""",
    """
raised as (select *, pval * count(*) over (partition by g1, g2)
    / count(*) over (partition by g1, g2 order by pval range between unbounded preceding and current row) as raw from valued)
""",
    """
tested as (select *, least(1.0, min(raw) over (partition by g1, g2 order by pval desc range between unbounded preceding and current row)) as fdr from raised)
""",
)
_WALD_CELLS = ("diff", "pval", "fdr")
ORACLES["wald_test"] = _with(
    "counts", _SITES, _CLUSTERED, _REGIONS, *_WALD,
    "kept as (select distinct chrom, start from tested where cpg >= 2 and abs(diff) >= 0.02 and pval <= 0.05)",
    body="""select t.chrom, t.start, end_ as "end", cpg, g1, g2, round(mu1, 6) as mu1, round(mu2, 6) as mu2, round(diff, 6) as diff,
              round(stat, 6) as stat, round(pval, 6) as pval, at_edge, round(fdr, 6) as fdr
            from tested t join kept k on k.chrom = t.chrom and k.start = t.start""",
)
ORACLES["wald_wide"] = _with(
    "counts", _SITES, _CLUSTERED, _REGIONS, *_WALD,
    body='select chrom, start, end_ as "end", cpg, '
    + ", ".join(
        f"""round(max(case when g1 = '{g}' then mu1 when g2 = '{g}' then mu2 end), 6) as "{g}:mu\""""
        for g in "ANR"
    )
    + ", "
    + ", ".join(
        f"""round(max(case when g1 = '{a}' and g2 = '{b}' then {c} end), 6) as "{a}->{b}:{c}\""""
        for a, b in (("A", "N"), ("A", "R"), ("N", "R"))
        for c in _WALD_CELLS
    )
    + " from tested group by 1, 2, 3, 4",
)

ORACLES["extract_segments_indexed"] = ORACLES["extract_segments"]
