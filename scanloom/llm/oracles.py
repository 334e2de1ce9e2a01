"""DuckDB SQL of the operators that SQL can express, each by brute force.

The others' results rest on trained models, tokenizers or a parser, which DuckDB
lacks; they are tested against brute force.
"""

from __future__ import annotations

from scanloom.llm import decontaminate
from scanloom.llm.hostrules import RULES, HostRuleParams
from scanloom.llm.licenses import NOTICES, LicenseParams, whole_templates
from scanloom.llm.mixing import MixParams
from scanloom.llm.pii import KINDS, PiiParams
from scanloom.llm.simhash import RADIUS, SEED, SHINGLE


def hosts_sql(params: HostRuleParams = HostRuleParams()) -> str:
    """op7: measures by regular expressions and lists, rates by the same moments."""
    sums = ", ".join(f"sum(cast({r} as integer)) {r}" for r in RULES)
    corpus = ", ".join(f"sum({r}) f_{r}, sum({r} * {r} / n) q_{r}" for r in RULES)
    ok = []
    for rule, bound in zip(RULES, params.max_rates):
        mean, chance = f"(f_{rule} / docs)", "(hosts / docs)"
        even = f"({mean} * (1 - {mean}))"
        between = f"case when {even} > 0 and {chance} < 1 then (q_{rule} / docs - {mean} * {mean} - {even} * {chance}) / ({even} * (1 - {chance})) end"
        strength = f"case when {even} > 0 and {chance} < 1 then 1 / greatest(0.0001, least(0.999, {between})) - 1 else {params.default_strength} end"
        ok.append(f"({rule} + {mean} * ({strength})) / (n + ({strength})) <= {bound}")
    return rf"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select r, p, array_to_string(w[p : p + 4], ' ') s from (select r, w, unnest(range(1, len(w) - 3)) p from d where len(w) >= 5)),
dup as (select r, p from (select r, p, count(*) over (partition by r, s) c from g) where c > 1),
hit as (select r, count(distinct q) n from (select r, unnest(range(p, p + 5)) q from dup) group by r),
l as (select r, count(*) n_lines, count(*) - count(distinct x) n_dup from (select r, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
m as (select r, doc_id, source, len(w) n_words, len(array_to_string(w, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, coalesce(n_dup, 0) n_dup_lines, coalesce(n, 0) n_repeat_words, coalesce(n_lines, 0) n_lines from d left join hit using (r) left join l using (r)),
f as (select *, n_words < {params.min_words} or 100 * n_repeat_words > {params.max_repeat_percent} * n_words base_failed, n_symbols > {params.max_symbols_per_word} * greatest(n_words, 1) symbols_failed, n_dup_lines > {params.max_dup_line_share} * greatest(n_lines, 1) lines_failed from m),
h as (select source, cast(count(*) as double) n, {sums} from f group by source),
c as (select sum(n) docs, cast(count(*) as double) hosts, {corpus} from h),
v as (select source, {' and '.join(ok)} host_ok from h, c)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed, not base_failed and host_ok kept, symbols_failed, lines_failed
from f join v on f.source is not distinct from v.source
"""


def licenses_sql(params: LicenseParams = LicenseParams()) -> str:
    """op1: every sentence, comment and whole text against every template, and the same joins."""
    terms = r"regexp_extract_all(lower({0}), '[a-z]+|[0-9]+(?:\.[0-9]+)*')"
    mark = r"^[ \t]*(?:#+!?|//+[/!]*|/\*+|\*+/?|--+|;+|%+|<!--+|(?i:rem|dnl)\b)"
    bare = f"regexp_replace({{0}}, '(?m){mark}', ' ', 'g')"
    own_name = r"regexp_matches(path, '(^|/)((?i)(un)?licen[cs]e|(?i)copying|(?i)copyright|(?i)notice)[^/]*$')"

    def listed(named: tuple[tuple[str, str], ...]) -> str:
        return ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(named))

    def weighed(name: str, named: tuple[tuple[str, str], ...]) -> str:
        return f"""
{name}_t as (select notice, license, term, count(*) tf from (select notice, license, unnest({terms.format('text')}) term from (values {listed(named)}) t(notice, license, text)) group by all),
{name}_i as (select term, ln((1.0 + {len(named)}) / (1 + count(*))) + 1 idf from {name}_t group by term),
{name}_w as (select notice, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by notice)) weight from {name}_t join {name}_i using (term)),"""

    def scored(name: str, source: str, n: int) -> str:
        return f"""
{name}_st as (select r, k, i, words, term, count(*) tf from (select r, k, i, len(ts) words, unnest(ts) term from (select r, k, i, {terms.format('x')} ts from {source})) group by all),
{name}_u as (select r, k, i, words, term, tf * coalesce(idf, ln({n} + 1.0) + 1) raw from {name}_st left join {name}_i using (term)),
{name}_n as (select r, k, i, sqrt(sum(raw * raw)) norm from {name}_u group by r, k, i),
{name}_s as (select r, k, i, words, license, notice, round(sum(raw * weight) / any_value(norm), 6) score from {name}_u join {name}_w using (term) join {name}_n using (r, k, i) group by r, k, i, words, notice, license),
{name}_b as (select r, k, words, license, score, notice < {len(NOTICES)} short from {name}_s where score >= {params.threshold} qualify row_number() over (partition by r, k, i order by score desc, license, notice) = 1),"""

    everything = whole_templates()
    return rf"""
with {weighed('few', NOTICES)} {weighed('all', everything)}
d as (select row_number() over () r, doc_id, concat_ws('/', source, lang, cast(doc_id as varchar)) path, coalesce(text, '') t from documents),
p as (select *, regexp_replace(path, '/?[^/]*$', '') dir from d),
sl as (select r, 0 k, string_split(regexp_replace(t, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)) l from d union all select r, 1, string_split(regexp_replace({bare.format('t')}, '([.!?])\s+|\n[ \t\r]*\n\s*', '\1' || chr(1), 'g'), chr(1)) from d),
s as (select r, k, unnest(range(1, len(l) + 1)) i, unnest(l) x from sl),
ln as (select r, unnest(range(1, len(y) + 1)) i, unnest(y) x from (select r, string_split(t, chr(10)) y from d)),
lm as (select r, i, x, sum(case when regexp_matches(x, '{mark}') then 0 else 1 end) over (partition by r order by i) g from ln),
cm as (select r, string_agg(x, chr(10) order by i) x from lm where regexp_matches(x, '{mark}') group by r, g),
lg as (select r, unnest(list_transform(string_split(t, '/*')[2:], lambda y: string_split(y, '*/')[1])) x from d union all select r, unnest(list_transform(string_split(t, '<!--')[2:], lambda y: string_split(y, '-->')[1])) from d union all select r, unnest(string_split(t, repeat(chr(34), 3))[2:]) from d union all select r, unnest(string_split(t, repeat(chr(39), 3))[2:]) from d),
bk as (select r, 2 k, row_number() over () i, {bare.format('x')} x from (select r, t x from d union all select r, x from cm union all select r, x from lg)),
{scored('few', 's', len(NOTICES))} {scored('all', 'bk', len(everything))}
b as (select * from few_b union all select * from all_b),
o as (select r, arg_min(license, (short, -score, license)) own, arg_min(score, (short, -score, license)) own_score, greatest(coalesce(sum(case when k = 0 then words end), 0), coalesce(sum(case when k = 1 then words end), 0), coalesce(max(case when k = 2 then words end), 0)) found from b group by r),
a as (select doc_id, path, dir, own, own_score, own is not null and ({own_name} or found >= {params.file_share} * len({terms.format('t')})) is_file from p left join o using (r)),
lic as (select dir licensed_by, arg_min(own, (-own_score, own)) given, max(own_score) given_score from a where is_file group by dir),
up as (select distinct dir, dir || '/' under from a),
near as (select up.dir, licensed_by, given, given_score from up join lic on licensed_by = '' or starts_with(up.under, licensed_by || '/') qualify row_number() over (partition by up.dir order by len(licensed_by) desc) = 1)
select doc_id, path, coalesce(own, given) license, case when own is not null then own_score else given_score end score, case when is_file then 'file' when own is not null then 'header' when given is not null then 'inherited' else 'none' end origin, case when own is null then licensed_by end licensed_by
from a left join near using (dir)
"""


def mixing_sql(params: MixParams = MixParams()) -> str:
    """op10: seats given one by one to the highest quotients, words taken one by one."""

    def seeded(*parts: str) -> str:
        told = ", ".join(f"coalesce(cast({p} as varchar), chr(1))" for p in parts)
        return f"cast('0x' || substr(md5(concat_ws(chr(2), '{params.seed}', {told})), 1, 15) as bigint)"

    def seats(votes: str, group: str, tie: str) -> str:
        over = f"partition by {group}" if group else ""
        return f"(select * exclude (k, place), count(*) filter (where place <= seats and vote > 0) quota from (select *, row_number() over ({over} order by vote / (2 * k + 1) desc, {tie}) place from (select *, unnest(range({params.max_repeat} * cast(blocks as bigint) + 2)) k from {votes})) group by all)"

    weights = ", ".join(map(str, params.cycle))
    return rf"""
with recursive d as (select row_number() over () r, doc_id, source, {seeded('doc_id', 'source', 'text')} o, cast(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) as bigint) size from documents),
sz as (select source, count(*) n, cast(sum(size) as bigint) source_size, ([{weights}])[(row_number() over (order by source nulls last) - 1) % {len(params.cycle)} + 1] weight from d group by source),
wf as (select 0 n, list({{'source': source, 'size': source_size, 'weight': weight, 'capped': false}}) l from sz
 union all select n + 1, list_transform(l, lambda x: {{'source': x.source, 'size': x.size, 'weight': x.weight, 'capped': x.capped or x.weight * rate >= {params.max_repeat} * x.size}}) from
 (select *, ({params.total_share} * list_sum(list_transform(l, lambda x: x.size)) - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.capped), lambda x: {params.max_repeat} * x.size)), 0)) / nullif(list_sum(list_transform(list_filter(l, lambda x: not x.capped), lambda x: x.weight)), 0) rate from wf where n <= (select count(*) from sz))),
la as (select l, ({params.total_share} * list_sum(list_transform(l, lambda x: x.size)) - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.capped), lambda x: {params.max_repeat} * x.size)), 0)) / nullif(list_sum(list_transform(list_filter(l, lambda x: not x.capped), lambda x: x.weight)), 0) rate from wf order by n desc limit 1),
tg as (select x.source source, case when x.capped then cast({params.max_repeat} * x.size as double) else x.weight * rate end target from (select unnest(l) x, rate from la)),
dl as (select d.*, source_size, o % least(cast(ceil(n / {params.shard_docs}.0) as bigint), {params.max_shards}) shard from d join sz on d.source is not distinct from sz.source),
sh as (select source, shard, cast(ceil(sum(size) / {params.block_words}.0) as bigint) blocks from dl group by all),
sv as (select sz.source, target, b.blocks, case when source_size > 0 then target / source_size * b.blocks else 0.0 end vote from sz join tg on tg.source is not distinct from sz.source join (select source, sum(blocks) blocks from sh group by source) b on b.source is not distinct from sz.source),
sq as (select source, target, least(quota, {params.max_repeat} * blocks) source_quota from {seats('(select *, round(sum(vote) over ()) seats from sv)', '', 'source')}),
hq as (select source, shard, target, blocks, least(quota, {params.max_repeat} * blocks) quota, case when blocks > 0 then {seeded('source', 'shard')} % greatest(blocks, 1) else 0 end start from {seats('(select sh.source, shard, target, blocks, cast(blocks as double) vote, source_quota seats from sh join sq on sh.source is not distinct from sq.source)', 'source', 'shard')}),
pl as (select *, coalesce(sum(size) over (partition by source, shard order by o, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) begin from dl),
wd as (select r, unnest(range(cast(begin as bigint), cast(begin + size as bigint))) // {params.block_words} b, h.blocks, quota, start from pl p join hq h on p.source is not distinct from h.source and p.shard = h.shard),
tk as (select r, sum(quota // blocks + case when (b - start + blocks) % blocks < quota % blocks then 1 else 0 end) taken from wd group by r)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) taken from pl left join tk using (r) join tg on tg.source is not distinct from pl.source
"""


#: The plain patterns of personal data, in order of ``pii.KINDS``.
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def pii_sql(params: PiiParams = PiiParams()) -> str:
    """op9: positions by running lengths, and every pair of an entity and a word counted."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digit = f"cast(substr(reverse({digits}), cast(j as integer), 1) as integer)"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda j: case when j % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end)) % 10 = 0"
    valid = f"case kind when 0 then true when 1 then regexp_full_match(v, '{part}[.]{part}[.]{part}[.]{part}') when 2 then len({digits}) between 16 and 19 and {luhn} else len({digits}) between 8 and 15 end"
    found = " union all ".join(f"select r, {k} kind, regexp_extract_all(t, '{p}') ms, string_split_regex(t, '{p}') ps from d" for k, p in enumerate((*PLAIN, r"\p{L}+")))
    names = "(['" + "', '".join((*KINDS, "term")) + "'])[kind + 1]"
    told = f"string_agg({names} || ':' || s || ':' || e, ',' order by kind, s, e)"
    counts = ", ".join(f"cast(coalesce(n_{k}, 0) as bigint) n_{k}" for k in KINDS)
    sums = ", ".join(f"count(*) filter (where kind = {k}) n_{name}" for k, name in enumerate(KINDS))
    return rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
m as ({found}),
x as (select r, kind, unnest(range(len(ms))) i, unnest(ms) v, unnest(ps[1:len(ms)]) p from m where len(ms) > 0),
y as (select r, kind, v, cast(sum(len(p) + len(v)) over (partition by r, kind order by i) as bigint) e from x),
b as (select r, kind, lower(v) v, e - len(v) s, e from y where kind < {len(KINDS)} and {valid}),
w as (select r, lower(v) v, e - len(v) s, e from y where kind = {len(KINDS)} and len(v) >= {params.min_letters}),
tm as (select distinct r, v from w),
nt as (select v, count(*) n from tm group by v),
en as (select distinct r, kind, v from b),
pr as (select en.kind, en.v e, tm.v, count(*) n from en join tm using (r) group by all),
dt as (select distinct pr.v from pr join nt using (v) where pr.n >= {params.support} and pr.n >= nt.n * {2.0 ** -params.slack!r}),
ts as (select w.r, {len(KINDS)} kind, w.s, w.e from w join dt using (v) where not exists (select 1 from b where b.r = w.r and b.s < w.e and b.e > w.s)),
al as (select r, kind, s, e from b union all select * from ts),
o as (select r, {sums}, count(*) filter (where kind = {len(KINDS)}) n_terms, {told} spans, {told} filter (where kind < {len(KINDS)}) base from al group by r)
select doc_id, {counts}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, cast(coalesce(n_terms, 0) as bigint) n_terms from d left join o using (r)
"""


def simhash_sql() -> str:
    """op4: XXH64 in 128-bit whole numbers, a lane at a time for all shingles; every pair of fingerprints; sets by reachability."""
    low64, p1, p2, p3, p4, p5 = f"{(1 << 64) - 1}::uhugeint", *(f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def mul(a: str, b: str) -> str:
        return f"((({a}) * {b}) & {low64})"

    def rot(a: str, k: int) -> str:
        return f"({mul(a, f'{1 << k}::uhugeint')} + (({a}) >> {64 - k}))"

    def added(*terms: str) -> str:
        return f"(({' + '.join(terms)}) & {low64})"

    def turned(acc: str, lane: str) -> str:
        return mul(rot(added(acc, mul(lane, p2)), 31), p1)

    def lane(at: str, size: int) -> str:
        parts = " || ".join(f"substr(x, cast(2 * ({at}) + {2 * k + 1} as integer), 2)" for k in reversed(range(size)))
        return f"cast(cast('0x' || {parts} as ubigint) as uhugeint)"

    seed = SEED
    stripes = ", ".join(f"list_reduce(list_transform(range(n // 32), lambda j: {lane(f'32 * j + {8 * k}', 8)}), lambda a, l: {turned('a', 'l')}, {start}::uhugeint) v{k}" for k, start in enumerate(((seed + 11400714785074694791 + 14029467366897019727) % (1 << 64), (seed + 14029467366897019727) % (1 << 64), seed, (seed - 11400714785074694791) % (1 << 64))))
    merged = added(*(rot(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    steps = "".join(f"a{k + 1} as (select * exclude acc, case when n < 32 then acc else {added(mul(f'xor(acc, {turned("0::uhugeint", f"v{k}")})', p1), p4)} end acc from a{k}),\n" for k in range(4))
    eight = added(mul(rot(f"xor(a, {turned('0::uhugeint', 'l')})", 27), p1), p4)
    four = added(mul(rot(f"xor(acc, {mul(lane('n // 8 * 8', 4), p1)})", 23), p2), p3)
    single = mul(rot(f"xor(a, {mul('l', p5)})", 11), p1)
    bits = " + ".join(f"case when 2 * sum((h >> {b}) & 1) > count(*) then {1 << b}::uhugeint else 0::uhugeint end" for b in range(64))
    return rf"""
with recursive d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (select r, array_to_string(w[p : p + {SHINGLE - 1}], ' ') s from (select r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) p from d where len(w) > 0)),
ds as (select s, hex(encode(s)) x, octet_length(encode(s)) n from (select distinct s from sh)),
st as (select s, x, n, {stripes} from ds),
a0 as (select *, {added(f"case when n < 32 then {(seed + 2870177450012600261) % (1 << 64)}::uhugeint else {merged} end", "0::uhugeint")} acc from st),
{steps}b0 as (select s, x, n, {added('acc', 'n::uhugeint')} acc from a4),
b1 as (select s, x, n, list_reduce(list_transform(range(n // 32 * 4, n // 8), lambda j: {lane('8 * j', 8)}), lambda a, l: {eight}, acc) acc from b0),
b2 as (select s, x, n, case when n % 8 >= 4 then {four} else acc end acc from b1),
b3 as (select s, list_reduce(list_transform(range(n // 4 * 4, n), lambda j: {lane('j', 1)}), lambda a, l: {single}, acc) acc from b2),
c1 as (select s, {mul(f'xor(acc, acc >> 33)', p2)} acc from b3),
c2 as (select s, {mul(f'xor(acc, acc >> 29)', p3)} acc from c1),
hs as (select s, xor(acc, acc >> 32)::ubigint h from c2),
fp as (select r, {bits} f from sh join hs using (s) group by r),
fd as (select doc_id, coalesce(f, 0::uhugeint) f from d left join fp using (r)),
nd as (select f, min(doc_id) m from fd group by f),
lk as (select a.f a, b.f b from nd a join nd b on bit_count(xor(a.f, b.f)::hugeint) <= {RADIUS}),
rc as (select f a, f b from nd union select rc.a, lk.b from rc join lk on lk.a = rc.b),
co as (select a f, min(m) component_id from rc join nd on nd.f = rc.b group by a)
select doc_id, lower(lpad(hex(f::ubigint), 16, '0')) fingerprint, component_id from fd join co using (f)
"""


ORACLES = {"op4_simhash": simhash_sql(), "op9_pii": pii_sql(), "op10_mixing": mixing_sql(), "op1_licenses": licenses_sql(), "op6_decontaminate": decontaminate.ORACLE, "op7_hostrules": hosts_sql()}
