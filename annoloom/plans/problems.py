"""The general problems' queries: nested records (p1) and orphan references (p5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import flatten_records
from ..operators.orphans import orphan_references
from ..session import spread
from ..sources.tables import table

KINDS = {"filler": 0, "discontiguous": 1, "participant": 2}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = flatten_records(spread(table(spark, sf_dir, "raw_annotations").select("record_id", "payload")), "children")
    return (
        children.filter(F.col("layer").isin("filler", "discontiguous") & F.col("link_id").isNotNull())
        .select("doc_uid", "event_id", F.col("layer").alias("child_layer"), "link_id", "element_id")
        .distinct()
    )


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_records(spread(table(spark, sf_dir, "raw_annotations").select("record_id", "payload")), "events")


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_records(spread(table(spark, sf_dir, "raw_annotations").select("record_id", "payload")), "documents")


def p1_referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_records(spread(table(spark, sf_dir, "raw_annotations").select("record_id", "payload")), "referents")


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (("fillers", "link_id", "filler"), ("discont_triggers", "link_id", "discontiguous"), ("canonrefs", "referent_id", "participant"))
    return reduce(
        DataFrame.unionByName,
        (table(spark, sf_dir, name).select(F.lit(name).alias("ref_table"), F.lit(KINDS[layer]).alias("kind"), "doc_uid", "element_id", F.col(col).alias("ref_id"), "ingested_at") for name, col, layer in parts),
    )


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "links").filter(F.col("layer").isin("filler", "discontiguous"))
    people = table(spark, sf_dir, "elements").filter(F.col("layer") == "participant")
    kind = lambda: F.when(F.col("layer") == "filler", KINDS["filler"]).when(F.col("layer") == "discontiguous", KINDS["discontiguous"]).otherwise(KINDS["participant"])
    return links.select(kind().alias("kind"), "doc_uid", F.col("link_id").alias("id"), "ingested_at", "deleted_at").unionByName(
        people.select(kind().alias("kind"), "doc_uid", F.col("element_id").alias("id"), "ingested_at", "deleted_at")
    )


def p5_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_references(spark, sf_dir), _targets(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_orphans(spark, sf_dir).select("ref_table", "doc_uid", "element_id", "ref_id", "arrival_month")


def p5_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_orphans(spark, sf_dir).groupBy("ref_table", "arrival_month").agg(
        F.count("*").alias("n_orphans"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_documents, p1_events, p1_referents, p5_found, p5_by_month)}

# Payloads in SQL: a walk down the trees of valid JSON texts, one more text opened inside a field. Ids of opened nodes follow their host's.
NESTED_SQL = r"""with recursive base as (
  select record_id as rid, [t.id::bigint] as nid, case when t.parent is not null then [t.parent::bigint] end as pid, replace(replace(lower(t.key), '_', ''), '-', '') as k, t.key as raw, t.type as kind, t.atom
  from (select * from raw_annotations where json_valid(payload)) r, json_tree(r.payload) t),
hosts as (select rid, nid, json_extract_string(atom, '$') as txt from base where kind = 'VARCHAR' and k = 'annotation' and json_valid(json_extract_string(atom, '$'))),
held as (select h.rid, h.nid as host, t.id, t.parent, t.key, t.type, t.atom from hosts h, json_tree(h.txt) t),
node as (
  select b.rid, b.nid, b.pid, b.k, b.raw, coalesce(r.type, b.kind) as kind, b.atom from base b left join held r on r.rid = b.rid and r.host = b.nid and r.parent is null
  union all select rid, list_append(host, id::bigint), case when parent = (select min(r.id) from held r where r.rid = h.rid and r.host = h.host) then host else list_append(host, parent::bigint) end, replace(replace(lower(key), '_', ''), '-', ''), key, type, atom from held h where parent is not null),
shape as (select rid, pid as nid, count(*) as n, bool_or(k in ('docuid', 'events')) as is_doc, bool_or(raw = 'items') as counted, bool_and(regexp_full_match(raw, '_?[0-9]+')) as mapped from node where pid is not null group by 1, 2),
tree as (select n.*, coalesce(s.n, 0) as n_fields, coalesce(is_doc, false) and kind = 'OBJECT' as is_doc, coalesce(counted, false) and kind = 'OBJECT' as counted, coalesce(mapped, false) and kind = 'OBJECT' and not coalesce(counted, false) as mapped from node n left join shape s on s.rid = n.rid and s.nid = n.nid),
walk(rid, nid, state, doc, event, outer_event, layer, link, kind, counted, mapped, n_fields) as (
  select rid, nid, case when is_doc then 'doc' else 'out' end, case when is_doc then nid end, null::bigint[], null::bigint[], null::varchar, null::varchar, kind, counted, mapped, n_fields from tree where pid is null
  union all
  select rid, nid, state, doc, case when state = 'events' and kind = 'OBJECT' then nid else event end, outer_event, layer, link, kind, counted, mapped, n_fields from (
    select t.rid, t.nid, case
        when w.state = 'out' then case when t.is_doc then 'doc' else 'out' end
        when w.state = 'doc' then case when w.kind = 'OBJECT' and t.k = 'events' then 'events' when w.kind = 'OBJECT' and t.k = 'metadata' then 'end' else 'doc' end
        when w.state = 'events' and w.kind = 'ARRAY' then 'events'
        when w.state in ('events', 'args') and w.kind = 'OBJECT' then case when w.state = 'events' and t.k in ('coordination', 'events', 'subevents') then 'events' when t.k in ('participants', 'fillers', 'discontiguous', 'discontiguoustriggers') then 'box' when w.state = 'events' and t.k = 'args' then 'args' else 'end' end
        when w.state = 'box' and (w.kind = 'ARRAY' or w.mapped or (w.counted and t.raw = 'items')) then 'box' else 'end' end as state,
      case when w.state = 'out' and t.is_doc then t.nid else w.doc end as doc, w.event,
      case when w.state = 'events' and w.kind = 'OBJECT' and t.k in ('coordination', 'events', 'subevents') then w.nid else w.outer_event end as outer_event,
      case when w.state = 'box' then w.layer else case t.k when 'participants' then 'participant' when 'fillers' then 'filler' else 'discontiguous' end end as layer,
      case when w.state = 'box' and w.mapped and left(t.raw, 1) <> '_' then t.raw end as link, t.kind, t.counted, t.mapped, t.n_fields
    from walk w join tree t on t.rid = w.rid and t.pid = w.nid where w.kind in ('OBJECT', 'ARRAY')) where state <> 'end'),
field as (select rid, pid as nid, k, arg_max(nid, nid) as at, arg_max(kind, nid) as kind, arg_max(atom, nid) as atom from tree where pid is not null and k is not null group by 1, 2, 3),
word as (select *, case when kind = 'VARCHAR' then json_extract_string(atom, '$') end as txt,
  nullif(case when kind = 'VARCHAR' then try_cast(nullif(regexp_extract(json_extract_string(atom, '$'), '^\s*\+?0*([0-9]+)\s*$', 1), '') as bigint) when kind in ('UBIGINT', 'BIGINT') then try_cast(atom::varchar as bigint) when kind = 'DOUBLE' and atom::double = floor(atom::double) then try_cast(atom::double as bigint) end, 0) as num0,
  case when kind = 'VARCHAR' then try_cast(nullif(regexp_extract(json_extract_string(atom, '$'), '^\s*\+?0*([0-9]+)\s*$', 1), '') as integer) when kind in ('UBIGINT', 'BIGINT') then try_cast(atom::varchar as integer) end as place from field),
f as (select *, case when num0 > 0 then num0 end as num from word),
docs as (select w.rid as record_id, w.nid, u.num as doc_uid from walk w left join f u on u.rid = w.rid and u.nid = w.nid and u.k = 'docuid' where w.state = 'doc' and w.nid = w.doc),
evs as (select w.rid as record_id, d.doc_uid, w.doc, w.nid, w.outer_event, (row_number() over (partition by w.rid, w.doc order by w.nid) - 1)::integer as event_no from walk w join docs d on d.record_id = w.rid and d.nid = w.doc where w.state = 'events' and w.kind = 'OBJECT'),
kids as (select w.*, e.event_no, e.doc_uid, i.num as event_id, el.at as element from walk w join evs e on e.record_id = w.rid and e.nid = w.event left join f i on i.rid = w.rid and i.nid = w.event and i.k = 'elementid'
  left join f el on el.rid = w.rid and el.nid = w.nid and el.k = 'element' and el.kind = 'OBJECT' where w.state = 'box' and w.kind = 'OBJECT' and not w.counted and not w.mapped and w.n_fields > 0),
children as (select kids.*, coalesce(l.num, case when try_cast(kids.link as bigint) > 0 then try_cast(kids.link as bigint) end) as link_id, case when e2.k is not null then e2.num else e1.num end as element_id, ro.txt as role
  from kids left join f l on l.rid = kids.rid and l.nid = kids.nid and l.k = 'linkid' left join f e1 on e1.rid = kids.rid and e1.nid = kids.nid and e1.k = 'elementid' left join f e2 on e2.rid = kids.rid and e2.nid = kids.element and e2.k = 'elementid'
  left join f ro on ro.rid = kids.rid and ro.nid = kids.nid and ro.k = 'role')
"""


def _field(owner: str, name: str, alias: str, rid: str = "rid") -> str:
    return f"left join f {alias} on {alias}.rid = {owner.split('.')[0]}.{rid} and {alias}.nid = {owner} and {alias}.k = '{name}'"


_ORPHANS = """
with refs as (
  select ref_table, layer, doc_uid, element_id, ref_id, min(ingested_at) as first_at from (
    select 'fillers' as ref_table, 'filler' as layer, doc_uid, element_id, link_id as ref_id, ingested_at from fillers
    union all select 'discont_triggers', 'discontiguous', doc_uid, element_id, link_id, ingested_at from discont_triggers
    union all select 'canonrefs', 'participant', doc_uid, element_id, referent_id, ingested_at from canonrefs)
  where ref_id <> 0 group by all),
goals as (
  select layer, doc_uid, id, min(ingested_at) as first_at, max(ingested_at) as last_at from (
    select layer, doc_uid, link_id as id, ingested_at from links where layer in ('filler', 'discontiguous')
    union all select layer, doc_uid, element_id, ingested_at from elements where layer = 'participant')
  where id <> 0 group by all),
gone as (
  select distinct g.layer, g.doc_uid, g.id from goals g join (
    select layer, doc_uid, link_id as id, ingested_at, deleted_at from links
    union all select layer, doc_uid, element_id, ingested_at, deleted_at from elements where layer = 'participant') x
  on x.layer = g.layer and x.doc_uid = g.doc_uid and x.id = g.id and x.ingested_at = g.last_at and x.deleted_at is not null),
orphans as (
  select r.ref_table, r.doc_uid, r.element_id, r.ref_id, strftime(r.first_at, '%Y-%m') as arrival_month,
    case when g.id is null then 'missing' when d.id is not null then 'deleted' else 'late' end as reason
  from refs r
  left join goals g on g.layer = r.layer and g.doc_uid = r.doc_uid and g.id = r.ref_id
  left join gone d on d.layer = r.layer and d.doc_uid = r.doc_uid and d.id = r.ref_id
  where g.id is null or d.id is not null or g.first_at > r.first_at)
"""

ORACLES = {
    "p1_found": NESTED_SQL + "select distinct doc_uid, event_id, layer as child_layer, link_id, element_id from children where layer in ('filler', 'discontiguous') and link_id is not null",
    "p1_documents": NESTED_SQL
    + f"""select d.record_id, d.doc_uid, t.txt as document_title, case when a.kind = 'OBJECT' then i.txt else a.txt end as annotator_id from docs d left join f m on m.rid = d.record_id and m.nid = d.nid and m.k = 'metadata' and m.kind = 'OBJECT'
      left join f t on t.rid = d.record_id and t.nid = m.at and t.k = 'documenttitle' left join f a on a.rid = d.record_id and a.nid = m.at and a.k = 'annotator' {_field("a.at", "id", "i")}""",
    "p1_events": NESTED_SQL
    + f"""select e.record_id, e.doc_uid, e.event_no, o.event_no as parent_event_no, i.num as event_id, t.txt as event_type, s.txt as event_subtype, case when p.kind = 'OBJECT' then g.txt else p.txt end as polarity_negation, m.txt as modality, b.place as begin_pos, z.place as end_pos, x.txt as text
      from evs e left join evs o on o.record_id = e.record_id and o.nid = e.outer_event {_field("e.nid", "elementid", "i", "record_id")} {_field("e.nid", "type", "t", "record_id")} {_field("e.nid", "subtype", "s", "record_id")} {_field("e.nid", "begin", "b", "record_id")} {_field("e.nid", "end", "z", "record_id")} {_field("e.nid", "text", "x", "record_id")}
      left join f ab on ab.rid = e.record_id and ab.nid = e.nid and ab.k = 'attributes' and ab.kind = 'OBJECT' left join f p on p.rid = e.record_id and p.nid = ab.at and p.k = 'polarity' left join f m on m.rid = e.record_id and m.nid = ab.at and m.k = 'modality' {_field("p.at", "negation", "g")}""",
    "p1_referents": NESTED_SQL
    + f"""select c.rid as record_id, c.doc_uid, c.event_no, c.event_id, c.layer, c.link_id, c.element_id, p.num as pronom_id, r.num as referent_id from children c join f l on l.rid = c.rid and l.nid = c.nid and l.k = 'canonicalreferents' and l.kind = 'ARRAY'
      join tree o on o.rid = c.rid and o.pid = l.at and o.kind = 'OBJECT' {_field("o.nid", "pronomid", "p")} {_field("o.nid", "referentid", "r")}""",
    "p5_found": _ORPHANS + "select ref_table, doc_uid, element_id, ref_id, arrival_month from orphans",
    "p5_by_month": _ORPHANS
    + """select ref_table, arrival_month, count(*) as n_orphans, count(*) filter (reason = 'missing') as n_missing,
      count(*) filter (reason = 'deleted') as n_deleted, count(*) filter (reason = 'late') as n_late from orphans group by all""",
}
