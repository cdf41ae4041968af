"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from billgrid.llm import licenses

#: Smallest id reachable from each node of ``links`` (a, b in both directions) by way of ``nodes`` (id).
_REACH = """reach(id, r) as (select id, id from nodes union select l.b, reach.r from reach join links l on l.a = reach.id where reach.r < l.b),
    comp as (select id, min(r) as component_id from reach group by id)"""

_NEAR_VECTORS = f"""
with recursive v as (select vec_id as id, embedding::double[] as e from embeddings),
    usable as (select id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    links as (select p.id as a, q.id as b from usable p join usable q on p.id <> q.id and len(p.e) = len(q.e) and list_cosine_similarity(p.e, q.e) >= 0.9),
    nodes as (select id from v), {_REACH}
select v.id as vec_id, (select count(*) from links where a = v.id) as n_links, component_id, v.id = component_id as kept
from v join comp on comp.id = v.id"""

_JACCARD = rf"""
with recursive w as (
        select doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    s as (select distinct id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ') || ' .'] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
    n as (select id, count(*) as n from s group by id),
    both_ as (select p.id as a, q.id as b, count(*) as i from s p join s q on p.sh = q.sh and p.id <> q.id group by 1, 2),
    links as (select a, b from both_ join n x on x.id = a join n y on y.id = b where 100 * i >= 75 * (x.n + y.n - i)),
    nodes as (select id from w), {_REACH}
select w.id as doc_id, coalesce(n.n, 0) as n_shingles, component_id from w left join n on n.id = w.id join comp on comp.id = w.id"""


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return rf"""
with given(template, license, text) as (values {rows}),
    tw as (select template, license, {words.format("text")} as ws from given),
    ts as (select distinct template, license, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh from tw),
    tn as (select template, count(*) as n from ts group by 1),
    dw as (select doc_id, {words.format("coalesce(text, '')")} as ws from documents),
    ds as (select doc_id, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh from dw),
    hits as (select doc_id, template, license, n, i - 1 as p, sh from ds join ts using (sh) join tn using (template)),
    windows as (select doc_id, template, license, n, sh, unnest([p // n, p // n - 1]) as w from hits),
    share as (select doc_id, template, license, w * n as first_word, count(distinct sh) / n as containment from windows where w >= 0 group by doc_id, template, license, w, n),
    best as (select doc_id, template, license, max(containment) as c, arg_min(first_word, (-containment, first_word)) as place from share where containment >= 0.75 group by 1, 2, 3),
    found as (select doc_id, count(*) as n_matches, array_to_string(list_sort(list_distinct(list(license))), ',') as licenses,
        string_agg(template || ':' || license || ':' || printf('%.4f', c::double) || ':' || place, ',' order by template) as matches from best group by 1)
select d.doc_id, coalesce(n_matches, 0) as n_matches, coalesce(licenses, '') as licenses, coalesce(matches, '') as matches from documents d left join found using (doc_id)"""


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    nearest = """select v.vec_id, v.p, arg_min(b.j, (v.xx - 2 * list_inner_product(v.x, b.c) + b.cc, b.j)) as j, min(v.xx - 2 * list_inner_product(v.x, b.c) + b.cc) as d
        from parts v join b{k} b on b.p = v.p group by v.vec_id, v.p"""
    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} as materialized ({nearest.format(k=k)}),
    m{k} as (select p, j, pos, floor(sum(x) / count(*)) as y from (select v.p, a.j, unnest(range(1, len(v.x) + 1)) as pos, unnest(v.x) as x from parts v join a{k} a on a.vec_id = v.vec_id and a.p = v.p) group by p, j, pos),
    b{k + 1} as materialized (select p, j, c, list_inner_product(c, c) as cc from (select b.p, b.j, coalesce(n.c, b.c) as c from b{k} b left join (select p, j, list(y order by pos) as c from m{k} group by p, j) n on n.p = b.p and n.j = b.j))""")
    return f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    cut as (select vec_id, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] as x from (select vec_id, e, unnest(range({parts})) as p from kept)),
    parts as materialized (select vec_id, p, x, list_inner_product(x, x) as xx from cut),
    b0 as materialized (select p, j, c, list_inner_product(c, c) as cc from (select p, row_number() over (partition by p order by vec_id) - 1 as j, x as c from parts) where j < {entries}),
    {", ".join(steps)},
    a{rounds} as materialized ({nearest.format(k=rounds)}),
    coded as (select vec_id, string_agg(printf('%02x', j), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id),
    sums as (select label, sum(error)::bigint as label_error from coded join kept using (vec_id) group by label),
    digest as (select sha256(string_agg(x::bigint::varchar, ',' order by p, j, pos)) as codebooks_sha256 from (select p, j, unnest(range(len(c))) as pos, unnest(c) as x from b{rounds}))
select vec_id, code, error, label_error, codebooks_sha256 from coded join kept using (vec_id) join sums on sums.label is not distinct from kept.label cross join digest"""


_IMPORTANCE = r"""
with crc_step as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as step),
    words as (select kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
        from (select 'given' as kind, doc_id as id, text from documents union all select 'target', null, text from benchmark)),
    grams as (select kind, id, unnest(ws) as gram from words
        union all select kind, id, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))) from words where len(ws) > 1
        union all select kind, id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) from words where len(ws) > 2),
    summed as materialized (select kind, id, gram, count(*) as n from grams group by all),
    hashed as materialized (select gram, xor(list_reduce([4294967295] || list_transform(range(1, octet_length(encode(gram)) + 1), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i - 1, 2))::bigint), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
        from (select distinct gram from summed), crc_step),
    counts as (select bucket, coalesce(sum(n) filter (kind = 'given'), 0)::double as s, coalesce(sum(n) filter (kind = 'target'), 0)::double as t from summed join hashed using (gram) group by bucket),
    gains as (select bucket, floor(1000 * ln(((t + 1) * (sum(s) over () + 10000)) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from counts),
    weights as (select id, sum(n * gain) as weight from summed join hashed using (gram) join gains using (bucket) where kind = 'given' group by id),
    scored as (select id as doc_id, len(ws) as n_words, len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) as n_features, coalesce(weight, 0)::bigint as weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint)::bigint as score from words left join weights using (id) where kind = 'given'),
    ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when place <= 5 * n // 100 then place end as rank from scored left join ranked using (doc_id)"""


CHECKS = {"op2_near_vectors": _NEAR_VECTORS, "op5_license_scan": _license_sql(), "op6_jaccard_join": _JACCARD, "op11_importance": _IMPORTANCE, "op12_vector_codes": _vector_codes_sql()}
