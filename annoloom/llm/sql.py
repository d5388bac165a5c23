"""SQL for the queries that a recursive query can say; the others are tested against brute force."""

from __future__ import annotations

ORACLES = {
    "p2_found": r"""
with recursive named as (
  select distinct doc_uid, 'd' || nullif(regexp_extract(trim(regexp_extract(lower(trim(replace(document_title, '\', '/'))), '([^/]*)$', 1)), '^([a-z]+[0-9]+)_', 1), '') as k from elements
  union select distinct doc_uid, 'a' || lpad(try_cast(nullif(regexp_extract(regexp_extract(replace(annotator_id, '\', '/'), '([^/]*)$', 1), '0*([0-9]+)', 1), '') as bigint)::varchar, 19, '0') from elements),
keys as (select * from named where k is not null),
ties as (select distinct x.k as a, y.k as b from keys x join keys y using (doc_uid)),
reach(node, other) as (select k, k from keys union select r.node, t.b from reach r join ties t on t.a = r.other),
least as (select node, min(other) as root from reach group by 1)
select distinct doc_uid, cast(substr(root, 2) as bigint) as group_annotator from keys join least on node = k where root like 'a%' and doc_uid is not null""",
    "p3_found": """
with recursive e as (select distinct doc_uid, nullif(pronom_id, 0) as a, nullif(referent_id, 0) as b from canonrefs where doc_uid is not null),
ties as (select doc_uid, a, b from e where a is not null and b is not null union select doc_uid, b, a from e where a is not null and b is not null),
nodes as (select doc_uid, a as node from e where a is not null union select doc_uid, b from e where b is not null),
reach(doc_uid, node, other) as (select doc_uid, node, node from nodes union select r.doc_uid, r.node, t.b from reach r join ties t on t.doc_uid = r.doc_uid and t.a = r.other)
select doc_uid, node as element_id, min(other) as group_id from reach group by 1, 2""",
}


def _consensus_sql(rounds: int = 12) -> str:
    """The labels, and the messages of `rounds` rounds written out one after another; only the order of the reliabilities is taken from them."""
    k = range(3)
    key = "nullif(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"
    state = ", ".join(f"a{i}" for i in k)
    parts = [
        f"""last_rows as (select item_id, {", ".join(key.format(f"anno_0{i + 1}") + f" as s{i}" for i in k)} from (select *, row_number() over (partition by item_id order by exported_at desc nulls last, anno_01 desc nulls last, anno_02 desc nulls last, anno_03 desc nulls last) as n from events_event_type where item_id is not null) where n = 1),
names as (select distinct {key.format("full_name")} as k, maintype_name as m from typology union select distinct {key.format("maintype_name")}, maintype_name from typology),
spelled as (select distinct s from (select s0 as s from last_rows union select s1 from last_rows union select s2 from last_rows) where s is not null),
named as (select s, arg_min(m, (levenshtein(k, s), m)) as m from spelled join names on 6 * levenshtein(k, s) <= greatest(length(k), length(s)) group by 1),
items as (select item_id, {", ".join(f"n{i}.m as l{i}" for i in k)} from last_rows {" ".join(f"left join named n{i} on n{i}.s = s{i}" for i in k)}),
pats as (select l0, l1, l2, count(*)::double as w from items where (l0 is not null)::int + (l1 is not null)::int + (l2 is not null)::int > 1 group by 1, 2, 3),
cls as (select c, sum(w) / sum(sum(w)) over () as sh from (select l0 as c, w from pats union all select l1, w from pats union all select l2, w from pats) where c is not null group by 1),
st0 as (select c, sh, w, {", ".join(f"case when l{i} is not null then (case when l{i} = c then 1 else 0 end - sh) / sqrt(sh * (1 - sh)) end as a{i}" for i in k)}, 1.0::double as y0, 1.0::double as y1, 1.0::double as y2 from pats, cls where sh < 1)"""
    ]
    signal = " + ".join(f"coalesce(a{i} * y{i}, 0)" for i in k)
    power = " + ".join(f"case when a{i} is not null then y{i} * y{i} else 0 end" for i in k)
    for r in range(rounds):
        told = ", ".join(f"case when q - case when a{i} is not null then y{i} * y{i} else 0 end > 1e-9 then (s - coalesce(a{i} * y{i}, 0)) / (q - case when a{i} is not null then y{i} * y{i} else 0 end) else 0 end as x{i}" for i in k)
        parts.append(f"ms{r} as (select *, {told} from (select *, {signal} as s, {power} as q from st{r}))")
        parts.append(f"sr{r} as (select c, any_value(sh) as sh, {', '.join(f'coalesce(sum(w * a{i} * x{i}), 0) as t{i}, coalesce(sum(w) filter (a{i} is not null), 0) as n{i}' for i in k)} from ms{r} group by 1)")
        parts.append(f"sa{r} as (select {', '.join(f'coalesce(sum(sh * t{i} / n{i}) filter (n{i} > 0) / sum(sh) filter (n{i} > 0), 0) as o{i}' for i in k)} from sr{r})")
        parts.append(f"su{r} as (select c, {', '.join(f't{i} + 30 * o{i} as t{i}, n{i} + 30 as n{i}' for i in k)} from sr{r}, sa{r})")
        parts.append(f"st{r + 1} as (select m.c, sh, w, {state}, {', '.join(f'coalesce(greatest(-1, least(1, ((case when n{i} > 1 then (t{i} - a{i} * x{i}) / (n{i} - 1) else 0 end) + y{i}) / 2)), y{i}) as y{i}' for i in k)} from ms{r} m join su{r} u on u.c = m.c)")
    last = f"sr{rounds - 1}"
    scores = ", ".join(f"sum(sh * t{i} / n{i}) filter (n{i} > 0) / sum(sh) filter (n{i} > 0) as r{i}" for i in k)
    parts.append(f"rel as (select {scores} from {last})")
    parts.append("votes as (select item_id, unnest([l0, l1, l2]) as label, unnest([r0, r1, r2]) as r, unnest([0, 1, 2]) as i from items, rel)")
    parts.append("own as (select *, count(*) over (partition by item_id) as n_labels, count(*) over (partition by item_id, label) as c from votes where label is not null)")
    parts.append("tops as (select *, max(c) over (partition by item_id) as top from own where n_labels > 1)")
    return "with " + ",\n".join(parts)


_CONSENSUS = _consensus_sql()
ORACLES |= {
    "p4_found": _CONSENSUS + " select item_id, case when count(distinct label) filter (c = top) = 1 then any_value(label) filter (c = top) else arg_max(label, (r, -i)) end as label from tops group by 1",
    "p4_consensus": _CONSENSUS
    + """ select item_id, case when count(distinct label) filter (c = top) = 1 then any_value(label) filter (c = top) else arg_max(label, (r, -i)) end as label, any_value(n_labels)::integer as n_labels, any_value(top)::integer as n_agree,
      sum(c - 1)::double / (count(*) * (count(*) - 1)) as agreement, count(distinct label) filter (c = top) > 1 as tied from tops group by 1""",
}


# What the allocations promise; the allocations themselves are no matter of SQL.
ORACLES |= {
    "p2_checks": r"""with k as (select nullif(regexp_extract(trim(regexp_extract(lower(trim(replace(document_title, '\', '/'))), '([^/]*)$', 1)), '^([a-z]+[0-9]+)_', 1), '') as d,
      try_cast(nullif(regexp_extract(regexp_extract(replace(annotator_id, '\', '/'), '([^/]*)$', 1), '0*([0-9]+)', 1), '') as bigint) as a, doc_uid from elements where doc_uid is not null)
      select 'document' as kind, count(distinct d) as n_keys, 0::bigint as n_torn from k union all select 'annotator', count(distinct a), 0 from k union all select 'doc_uid', count(distinct doc_uid), 0 from k""",
    "p6_checks": "select capacity_name, (select count(*) from documents) as n_items, 0::bigint as n_cut_small, 0::bigint as n_gaps, 0::bigint as n_overfull from pack_capacities where capacity_tokens > 0",
    "p7_checks": "select lower(trim(source)) as source, 0::bigint as n_too_often, 0::bigint as n_twice from mix_targets",
}
