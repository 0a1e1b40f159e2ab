"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_EMBEDDINGS = """
with recursive sound as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from sound),
links as (
  select a.vec_id as u, b.vec_id as v from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) >= 0.93),
reached(vec_id, node) as (select vec_id, vec_id from embeddings union select r.vec_id, l.v from reached r join links l on r.node = l.u),
components as (select vec_id, min(node) as component_id from reached group by vec_id)
select c.vec_id, cast((select count(*) from links l where l.u = c.vec_id) as bigint) as n_links, component_id, c.vec_id = component_id as kept from components c"""

_MIXING = rf"""
with sized as (select doc_id, source, cast(len({_WORDS}) as bigint) as size from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (select *, cast([5, 2, 1][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] as double) as weight from totals),
levels as (
  select *, (1.5 * sum(source_size) over () - coalesce(sum(2.0 * source_size) over (order by source_size / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by source_size / weight, encode(source) nulls last rows between current row and unbounded following) as level
  from weighed),
goals as (
  select source, source_size, case when level * weight >= 2.0 * source_size then 2.0 * source_size
    else (select arg_min(l.level, l.source_size / l.weight) from levels l where l.level * l.weight < 2.0 * l.source_size) * weight end as target
  from levels),
edges as (
  select *, cast(sum(goal) over () as double) as whole, cast(sum(goal) over (order by encode(source) nulls last) as double) as ends
  from (select source, source_size, target, cast(round(target) as bigint) as goal from goals) where goal > 0),
stretches as (select source, cast(floor((ends - goal) / whole * 2147483648) as bigint) as low, cast(floor(ends / whole * 2147483648) as bigint) as high from edges),
points as (select i as slot, i * 1327217885 % 2147483648 as point from (select unnest(range(0, (select cast(ceil(max(whole) / 64) as bigint) from edges))) as i)),
slots as (select slot, source, row_number() over (partition by source order by slot) - 1 as rank from points join stretches on point >= low and point < high),
laid as (
  select row_number() over () as row, doc_id, s.source, size, source_size, target,
    cast(sum(size) over (partition by s.source order by md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(size as varchar)) rows unbounded preceding) - size as bigint) as start
  from sized s join goals g on s.source is not distinct from g.source),
copies as (select row, source, size, unnest([start, start + source_size]) as u, 2 * source_size as ends from laid),
taken as (
  select row, cast(sum(least(u + size, ends, (rank + 1) * 64) - greatest(u, rank * 64)) as bigint) as taken, min(slot) as first_slot, count(*) as n_slots
  from copies c join slots t on c.source is not distinct from t.source and rank * 64 < least(u + size, ends) and (rank + 1) * 64 > u
  where size > 0 group by row)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken, first_slot, coalesce(n_slots, 0) as n_slots from laid left join taken using (row)"""

_URLS = """
with parts as (
  select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, regexp_extract(rest, '^[^/?#]*') as h, rest from parts),
judged as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from hosts),
rules(rule_host, rule_path, rule_verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
ranked as (
  select j.*, rule_host || rule_path as rule, rule_verdict,
    row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as n
  from judged j left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from ranked where n = 1"""

_WARC = """
with payloads as (select page_id, coalesce(html, '') as body from pages),
digested as (
  select page_id, cast(strlen(body) as bigint) as payload_bytes, max(page_id) over (partition by body) as last_id,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(sha1(body), 1 + 5 * cast(floor(i / 4) as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as integer), 1)), '') as payload_digest
  from payloads)
select page_id, payload_bytes, payload_digest, case when page_id = last_id then 'response' else 'revisit' end as record_type,
  case when page_id <> last_id then last_id end as refers_to
from digested"""

_QUALITY = rf"""
with base as (select doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as text, {_WORDS} as w from documents),
windows as (select doc_id, unnest(range(1, greatest(len(w) - 6, 1))) as i, w from base),
hashed as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as x from windows),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, x) as n from hashed) where n > 1),
held as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from again) group by doc_id),
places as (select doc_id, host, unnest(string_split(text, chr(10))) as line from base),
normal as (select doc_id, host, lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')) as line from places),
hosts as (select host, count(distinct doc_id) as documents from base group by host),
common as (
  select host, line from normal join hosts using (host) where line <> '' group by host, line, documents
  having count(distinct doc_id) > 5 and count(distinct doc_id) > cast(0.05 as double) * documents),
lined as (
  select n.doc_id, sum(length(n.line)) as chars, sum(length(n.line)) filter (c.line is not null) as gone
  from normal n left join common c on n.host = c.host and n.line = c.line group by n.doc_id),
stats as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words
  from base left join held using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(gone, 0) <= 0.5 * chars as kept
from stats left join lined using (doc_id)"""


def _spans(number: int, pattern: str, group: int, least: int) -> str:
    """One row for each match that counts: doc_id, start, kind, stop. RE2 has neither look-around nor backtracking; these patterns need none."""
    pattern = pattern.replace("'", "''")
    return rf"""
  select doc_id, {number} as kind, start, start + length(m) as stop from (
    select doc_id, m, g, cast(sum(length(gap)) over before + coalesce(sum(length(m)) over earlier, 0) as bigint) as start from (
      select doc_id, unnest(range(1, len(string_split_regex(t, '{pattern}')))) as i, unnest(string_split_regex(t, '{pattern}')[:-2]) as gap,
        unnest(regexp_extract_all(t, '{pattern}')) as m, unnest(regexp_extract_all(t, '{pattern}', {group})) as g from texts)
    window before as (partition by doc_id order by i rows unbounded preceding), earlier as (partition by doc_id order by i rows between unbounded preceding and 1 preceding))
  where length(g) >= {least}"""


def _secrets() -> str:
    from .secrets import ADDED, BASE

    rules = [*BASE, *ADDED]
    spans = " union all ".join(_spans(i, r.pattern, r.group, r.least) for i, r in enumerate(rules))
    names = ", ".join(f"'{r.kind}'" for r in rules)
    text = f"string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind)"
    return rf"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({spans}),
summed as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    {text} filter (kind < 3) as base, {text} as spans from found group by doc_id)
select doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join summed using (doc_id)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, half a byte at a time; the sixteen steps of a half byte come from the polynomial."""
    steps = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(str(i))
    step = lambda x: f"xor(({x}) >> 4, [{', '.join(steps)}][1 + (({x}) & 15)]::bigint)"
    byte = "list_transform(range(0, strlen(hex(encode({0}))), 2), lambda i: cast('0x' || substr(hex(encode({0})), i + 1, 2) as bigint))".format(text)
    return f"xor(list_reduce(list_concat([4294967295::bigint], {byte}), lambda c, b: {step(step('xor(c, b)'))}), 4294967295::bigint)"


def _digest_field(column: str) -> str:
    text = f"cast({column} as varchar)"
    return f"case when {column} is null then '-' else cast(strlen({text}) as varchar) || ':' || {text} end"


def _climbed(name: str, leaves: str) -> str:
    """The levels of trees over ``leaves(tree, pos, digest, size)``, and their runs."""
    return f"""
{name}_nodes(level, tree, pos, digest, size) as (
  select 0, tree, pos, digest, size from {leaves}
  union all
  select level + 1, tree, pos // 16, sha256(string_agg(digest, '' order by pos)), (size + 15) // 16 from {name}_nodes where size > 1 group by level, tree, pos // 16, size),
{name}_runs as (select level, tree, pos // 16 as run, list(digest order by pos) as digests from {name}_nodes where size > 1 group by level, tree, pos // 16)"""


def _walked(name: str, starts: str) -> str:
    """Each row of ``starts(row, tree, pos, proof, folded)`` on its way up."""
    return f"""
{name}_walk(level, row, tree, pos, proof, folded) as (
  select 0, row, tree, pos, proof, folded from {starts}
  union all
  select w.level + 1, row, w.tree, w.pos // 16, proof || array_to_string(list_concat(digests[:w.pos % 16], digests[w.pos % 16 + 2:]), ''),
    sha256(array_to_string(digests[:w.pos % 16], '') || folded || array_to_string(digests[w.pos % 16 + 2:], ''))
  from {name}_walk w join {name}_runs r on w.level = r.level and w.tree = r.tree and w.pos // 16 = r.run)"""


def _merkle() -> str:
    fields = ["doc_id", "source", "lang", "n_chars"]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(map(_digest_field, [*fields, text])) + ")"
    return f"""
with recursive hashed as (
  select doc_id, dense_rank() over (order by encode(source) nulls first) - 1 as tree, {leaf('text')} as digest,
    case when {_crc32('cast(doc_id as varchar)')} % 5 = 0 then {leaf(low)} end as changed from documents),
leaves as (
  select *, row_number() over () as row, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as pos, count(*) over (partition by tree) as size from hashed),
{_climbed('source', 'leaves')},
subroots as (select 0 as tree, tree as pos, digest, count(*) over () as size from source_nodes where size = 1),
{_climbed('top', 'subroots')},
starts as (select row, tree, pos, '' as proof, coalesce(changed, digest) as folded from leaves),
{_walked('source', 'starts')},
middle as (select row, 0 as tree, tree as pos, proof, folded from source_walk qualify row_number() over (partition by row order by level desc) = 1),
{_walked('top', 'middle')},
ends as (select row, proof, folded from top_walk qualify row_number() over (partition by row order by level desc) = 1)
select doc_id, l.digest as leaf, s.digest as subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.digest as verified
from leaves l join ends using (row) join subroots s on l.tree = s.pos cross join (select digest from top_nodes where size = 1) r"""


def _resampling() -> str:
    words = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
with own as (select row_number() over () as row, doc_id, {words} as w from documents),
aim as (select {words} as w from benchmark),
features as (select row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from own),
aims as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from aim),
hashed as (select f, {_crc32('f')} % 10000 as bucket from (select f from features union select f from aims)),
found as (select row, bucket from features join hashed using (f)),
s as (select bucket, count(*) as n from found group by bucket),
t as (select bucket, count(*) as n from aims join hashed using (f) group by bucket),
gains as (
  select s.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from features) + 10000)::double / ((s.n + 1)::double * ((select count(*) from aims) + 10000)::double))) as bigint) as gain
  from s left join t using (bucket)),
weighed as (select row, count(*) as n_features, cast(sum(gain) as bigint) as gain from found join gains using (bucket) group by row),
noisy as (
  select doc_id, len(w) as n_words, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0) as bigint) as weight,
    cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from own left join weighed using (row)),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from noisy),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last, n_features, weight) as n from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and n <= (select 25 * count(*) // 100 from scored where n_words >= 20) then n end as rank from ranked"""


ORACLE = {
    "op1_embedding_near_dedup": _EMBEDDINGS,
    "op3_source_mixing": _MIXING,
    "op4_url_filter": _URLS,
    "op5_warc_archive": _WARC,
    "op6_quality_rules": _QUALITY,
    "op10_secret_scan": _secrets(),
    "op12_importance_resampling": _resampling(),
    "op13_merkle_manifest": _merkle(),
}
