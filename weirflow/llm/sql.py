"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from weirflow.llm.mixing import EMPTY_BYTES, ENTRIES, PART
from weirflow.llm.url_filter import BIN, BINS, CONTEXTS, HELD_OUT, MICRO, ORDER, SEEN, SIZE, SYMBOLS


def mixing(weights: dict[str, float], other: float, epochs: float = 1.0, seed: int = 7) -> str:
    """Poisson counts by inversion: the number of cumulative probabilities up to the hashed uniform number."""
    named = ", ".join(f"('{n}', {float(w)}::double)" for n, w in [*weights.items(), ("", other)])
    known = ", ".join(f"'{n}'" for n in weights)
    return f"""
with recursive pools as (
  select *, case when source in ({known}) then source else '' end as pool, greatest(coalesce(strlen(text), 0), {EMPTY_BYTES}) as size from documents),
held as (select pool, sum(size)::bigint as pool_bytes, weight from pools join (values {named}) w(pool, weight) using (pool) group by all),
rates as (select pool, weight / (select sum(weight) from held) * {float(epochs)}::double * (select sum(pool_bytes) from held)::bigint / pool_bytes as rate from held),
parts as (select pool, greatest(ceil(rate / {PART}), 1)::int as parts, rate / greatest(ceil(rate / {PART}), 1) as mean from rates),
cumulative as (
  select pool, parts, mean, 0 as k, exp(-mean) as p, exp(-mean) as c from parts
  union all select pool, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from cumulative where k < {ENTRIES}),
digests as (select *, coalesce(md5(text), '~') as digest from pools),
draws as (
  select doc_id, digest, pool, part, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::varchar, '~') || '|' || digest || '|' || part), 1, 13))::bigint::double * pow(2::double, -52) as u
  from (select distinct doc_id, digest, pool from digests) join (select pool, parts, unnest(range(1, parts + 1)) as part from parts) using (pool)),
counts as (select doc_id, digest, pool, count(*) filter (c <= u)::int as n_copies from draws join cumulative using (pool) group by all)
select d.doc_id, text, lang, source, n_chars, n_copies, unnest(range(n_copies))::int as copy
from digests d join counts c on d.doc_id is not distinct from c.doc_id and d.digest = c.digest and d.pool = c.pool
"""


def decontamination(window: int = 13, share: float = 0.8, short: int = 8) -> str:
    """All windows of all diagonals on which enough words agree, without any hashing; items of under ``short`` words agree in all."""
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')".format
    return f"""
with d as (select doc_id, row_number() over () as r, {words("text")} as w from documents),
dw as (select doc_id, r, unnest(w) as word, generate_subscripts(w, 1) - 1 as p from d),
i as (select item_id, len(w) as n, least(len(w), {window}) as compared, case when len(w) < {short} then len(w) else ceil(least(len(w), {window}) * {share}) end as need, unnest(w) as word, generate_subscripts(w, 1) - 1 as q from (select item_id, {words("text")} as w from benchmark)),
same as (select doc_id, r, item_id, n, compared, need, p - q as diagonal, q from dw join i using (word)),
lines as (select doc_id, r, item_id, n, compared, need, diagonal, list(q) as qs from same group by all having count(*) >= need),
runs as (select doc_id, item_id, compared, need, diagonal + s as place, len(list_filter(qs, lambda x: x >= s and x < s + compared)) as matched
  from (select *, unnest(range(n - compared + 1)) as s from lines)),
best as (select *, row_number() over (partition by doc_id, item_id order by matched desc, place) as k from runs where matched >= need)
select doc_id, item_id, place::int as word_at, matched::int as matched, compared::int as compared from best where k = 1
"""


def url_filter(rules: dict[str, str]) -> str:
    """Rules, Witten-Bell estimates of the longest known context and the cut of least balanced error on the held-out fold."""
    ordered = sorted(rules, key=lambda r: (-len(r), r), reverse=False)
    split = {r: r.partition("/") for r in ordered}
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{s}{p}') then '{r}'" for r, (h, s, p) in split.items())
    said = " ".join(f"when rule = '{r}' then '{v}'" for r, v in rules.items())
    a_z, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    symbol = f"strpos('{SYMBOLS}', c)"
    model = ""
    for y in ("yes", "no"):
        model += f""",
g_{y} as (select n, ctx, c, count(*) as k from grams where kind = '{y}' group by all),
w_{y} as (select n, ctx, sum(k)::double as all_k, count(*) as kinds from g_{y} group by all),
p0_{y} as (select 0 as n, 0 as ctx, c, (coalesce(k, 0) + 1) / (coalesce((select sum(k) from g_{y} where n = 0), 0) + {SIZE}) as p from range({SIZE}) r(c) left join (select c, k from g_{y} where n = 0) using (c))"""
        for n in range(1, ORDER + 1):
            model += f""",
p{n}_{y} as (select s.n, s.ctx, r.c, case when all_k > 0 then (coalesce(k, 0) + kinds * p) / (all_k + kinds) else p end as p
  from known s cross join range({SIZE}) r(c) join p{n - 1}_{y} b on b.ctx = s.ctx % {SIZE ** (n - 1)} and b.c = r.c
  left join g_{y} g on g.n = s.n and g.ctx = s.ctx and g.c = r.c left join w_{y} w on w.n = s.n and w.ctx = s.ctx where s.n = {n})"""
        model += f",\nl_{y} as (" + " union all ".join(f"select n, ctx, c, ln(p) as l from p{n}_{y}" for n in range(ORDER + 1)) + ")"
    lags = ", ".join(f"lag(s, {j}) over w as a{j}" for j in range(1, ORDER + 1))
    before = lambda n: " + ".join([f"a{j} * {SIZE ** (j - 1)}" for j in range(1, n + 1)]) or "0"
    of_order = "case n " + " ".join(f"when {n} then {before(n)}" for n in range(ORDER + 1)) + " end"
    held = ", ".join(f"'{x}'" for x in HELD_OUT)
    return f"""
with raw as (select page_id, url, row_number() over () as r, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parsed as (select page_id, url, r, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{a_z}', '{lower}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from raw),
ruled as (select *, case {said} end as said from (select *, case {fits} end as rule from parsed)),
plain as (select *, coalesce(substr(md5(url), 1, 1) in ({held}), false) as held, translate(lower(coalesce(url, '')), '123456789&=#%_+:;,~@!$*()', '{"0" * 9 + "?" * 16}') as u from ruled),
letters as (select r, said, held, i, {symbol} as s from (select r, said, held, unnest(range(1, length(u) + 1)) as i, substr(u, unnest(range(1, length(u) + 1)), 1) as c from plain)),
coded as (select r, said, held, i, s as c, {lags} from letters window w as (partition by r order by i)),
placed as (select r, said, held, i, c, n, {of_order} as ctx from (select *, unnest(range(least(i - 1, {ORDER}) + 1)) as n from coded)),
grams as (select n, ctx, c, case said when 'allow' then 'yes' else 'no' end as kind from placed where said is not null and not held),
known as (select n, ctx from grams where n > 0 group by all having count(*) >= greatest({SEEN}, ceil((select count(*) from grams where n = 0) / {CONTEXTS})) union all select 0, 0){model},
ratios as (select n, ctx, c, case when (select count(distinct kind) from grams) = 2 then round((y.l - o.l) * {MICRO})::bigint else 0 end as ratio from l_yes y join l_no o using (n, ctx, c)),
longest as (select r, i, c, n, ctx from placed join known using (n, ctx) qualify row_number() over (partition by r, i order by n desc) = 1),
scores as (select r, floor(sum(ratio)::bigint / count(*))::bigint as score from longest join ratios using (n, ctx, c) group by r),
every as (select p.*, coalesce(s.score, 0) as score from plain p left join scores s using (r)),
bins as (select least(greatest(floor(score / {BIN}), -{BINS}), {BINS})::int as bin, count(*) filter (said = 'allow') as yes, count(*) filter (said = 'block') as no from every where said is not null and held group by 1),
cuts as (select bin, coalesce(sum(yes) over b, 0) / sum(yes) over () - coalesce(sum(no) over b, 0) / sum(no) over () as e, sum(yes) over () as y, sum(no) over () as n from bins window b as (order by bin rows between unbounded preceding and 1 preceding)),
cut as (select coalesce((select bin * {BIN} from cuts where y > 0 and n > 0 order by e, abs(bin), bin limit 1), 0)::bigint as t)
select page_id, host, path, rule, coalesce(said, case when score >= t then 'allow' else 'block' end) as verdict, score / {MICRO}::double as score, t / {MICRO}::double as threshold from every, cut
"""
