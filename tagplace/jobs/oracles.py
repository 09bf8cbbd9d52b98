"""SQL twins of the registered queries, for DuckDB on the same tables. Doubles are rounded as in the queries."""

from __future__ import annotations

from . import fixtures as fx

_E2 = "power(8.1819190842622e-2, 2)"
_N = f"(6378137.0 / sqrt(1 - {_E2} * sin(radians(latitude)) * sin(radians(latitude))))"
_XYZ = f"{_N} * cos(radians(latitude)) * cos(radians(longitude)) as x, {_N} * cos(radians(latitude)) * sin(radians(longitude)) as y, (1 - {_E2}) * {_N} * sin(radians(latitude)) as z"

_DOCS = f"docs as materialized ({fx.duck(fx.MEDIA_DOCS)}), pts as materialized (select id, location_id, {_XYZ} from docs)"
_CENTERS = f"""{_DOCS}, centers as materialized (
  select label, round(avg(x), 3) as x, round(avg(y), 3) as y, round(avg(z), 3) as z
  from (select *, cast(floor(location_id / 100.0) as int) * 4 + cast(floor((location_id % 100) / 5.0) as int) as label from pts) group by label
)"""
_NEAR = """near as materialized (
  select id, px, py, pz, label, d2 from (
    select p.id, p.x as px, p.y as py, p.z as pz, c.label, power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2) as d2,
           row_number() over (partition by p.id order by power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2), c.label) as k
    from pts p cross join centers c) where k = 1
)"""
_TERMS = """total as (select count(*) as m from docs), words as materialized (select id, unnest(tags) as tag from docs),
terms as materialized (select tag, count(*) as n, ln((select m from total) / cast(count(*) as double)) as weight from words group by tag having count(*) > 5),
features as materialized (select id, w.tag, sum(weight) as w from words w join terms t on w.tag = t.tag group by id, w.tag)"""
_NB = f"""{_CENTERS}, {_NEAR}, {_TERMS}, labels as (select id, label from near),
theta as materialized (select label, tag, sum(w) as sum_w, ln(sum(w) + 1) as log_w from features join labels using (id) group by label, tag),
classes as materialized (
  select l.label, l.n, coalesce(s.sum_w, 0) as sum_w, ln(l.n + 1) - ln((select count(*) from labels) + (select count(distinct label) from labels)) as pi,
         ln(coalesce(s.sum_w, 0) + (select count(*) from terms)) as log_denom
  from (select label, count(*) as n from labels group by label) l left join (select label, sum(sum_w) as sum_w from theta group by label) s on l.label = s.label
)"""


def _scores(ids: str, features: str) -> str:
    """scores (id, label, score) and ranked (.., p, rank, before) of the rows ``ids``."""
    return f"""mass as (select id, sum(w) as mass from {features} group by id),
shared as (select id, label, sum(w * log_w) as shared from {features} join theta using (tag) group by id, label),
scores as materialized (
  select i.id, c.label, pi - coalesce(mass, 0) * log_denom + coalesce(shared, 0) as score
  from {ids} i cross join classes c left join mass m on m.id = i.id left join shared s on s.id = i.id and s.label = c.label
), soft as (
  select *, score - max(score) over (partition by id) as behind from scores
), prob as (
  select *, exp(behind) / sum(exp(behind)) over (partition by id) as p from soft
), ranked as materialized (
  select *, row_number() over w as rank, coalesce(sum(p) over (partition by id order by round(behind, 6) desc, label rows between unbounded preceding and 1 preceding), 0) as before
  from prob window w as (partition by id order by round(behind, 6) desc, label)
)"""


_ALL = f"with {_NB}, {_scores('docs', 'features')}"
_SALES = f"""raw as ({fx.duck(fx.MEDIA_SALES_RAW)}), sales as materialized (
  select * from (select *, row_number() over (partition by id order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as k from raw) where k = 1
)"""
_B = "sqrt(power(6378137.0, 2) * (1 - power(8.1819190842622e-2, 2)))"
_LLA = f"""bent as (select *, sqrt(x * x + y * y) as p, atan2(z * 6378137.0, sqrt(x * x + y * y) * {_B}) as th from {{points}}),
lla as (select *, atan2(y, x) as lo, atan2(z + (power(6378137.0, 2) - power({_B}, 2)) / power({_B}, 2) * {_B} * power(sin(th), 3), p - {_E2} * 6378137.0 * power(cos(th), 3)) as la from bent)"""

#: Cells of the fixed centres: a hull face is a plane through three centres that has all others on one side.
_CELLS = f"""{_CENTERS}, {_LLA.format(points='centers')}, sea as materialized (
  select label, la, lo, n * cos(la) * cos(lo) as x, n * cos(la) * sin(lo) as y, (1 - {_E2}) * n * sin(la) as z
  from (select label, la, lo, 6378137.0 / sqrt(1 - {_E2} * sin(la) * sin(la)) as n from lla)
), planes as (
  select a.label as a, b.label as b, c.label as c, a.x as ax, a.y as ay, a.z as az, (a.x + b.x + c.x) / 3 as x, (a.y + b.y + c.y) / 3 as y, (a.z + b.z + c.z) / 3 as z,
    (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) as nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) as ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) as nz
  from sea a join sea b on a.label < b.label join sea c on b.label < c.label
), faces as materialized (
  select a, b, c, any_value(p.x) as x, any_value(p.y) as y, any_value(p.z) as z from (
    select p.*, (d.x - ax) * nx + (d.y - ay) * ny + (d.z - az) * nz as side from planes p join sea d on d.label <> a and d.label <> b and d.label <> c
  ) p group by a, b, c having min(side) > 0 or max(side) < 0
), {_LLA.format(points='faces').replace('bent', 'bent_faces').replace('lla', 'face_places')}"""

#: Trailing empty terms are dropped: text keeps its inner and leading ones.
_REQUEST_TEXT = "rtrim(regexp_replace(lower(text), '[^a-z]+', '+', 'g'), '+')"
_ASKED = f"asked as materialized (select request_id as id, cnt, case when {_REQUEST_TEXT} = '' then [] else string_split({_REQUEST_TEXT}, '+') end as tags from ({fx.duck(fx.REQUESTS)}))"

_FLAT = f"""{_DOCS}, flat_rows as (select location_id as class_no, unnest(tags) as tag from docs),
flat_counts as materialized (select cast(class_no as bigint) as class_no, tag, count(*) as n from flat_rows group by class_no, tag),
flat_classes as materialized (
  select cast(location_id as bigint) as class_no, 'c' || location_id as class, count(*) / cast((select count(*) from docs) as double) as prior,
         min(latitude) as lat, min(longitude) as lon, cast(sum(greatest(len(tags), 1)) as bigint) as size
  from docs group by location_id
)"""


def _flat(bag: str, k: str) -> str:
    return f"""with {_FLAT}, {_ASKED}, bags as materialized ({bag}),
pairs as (select b.id, b.tag, c.* from bags b cross join flat_classes c),
factors as (select p.*, (coalesce(n, 0) + {k}) / (size + {k}) as f from pairs p left join flat_counts f on f.class_no = p.class_no and f.tag = p.tag),
post as (
  select id, class_no, class, case when min(f) = 0 then null else sum(ln(nullif(f, 0))) + ln(any_value(prior)) end as post from factors group by id, class_no, class
), shared as (
  select *, coalesce(exp(post - max(post) over (partition by id)), 0) as e, row_number() over (partition by id order by round(post, 9) desc nulls last, class_no) as rank from post
), even as (select *, sum(e) over (partition by id) as total from shared)
select id, rank, class_no, class, round(e / case when total = 0 then 1 else total end, 6) as confidence from even where rank <= 3"""


_PAGES = f"""pages as materialized ({fx.duck(fx.PAGES)}), kept as materialized (
  select * exclude (e) from (select *, coalesce(sum(case when n_geo = 0 then 1 else 0 end) over (partition by user_id order by page_no rows between unbounded preceding and 1 preceding), 0) as e from pages) where e = 0
)"""
_FOLLOWS = f"follows as materialized ({fx.duck(fx.FOLLOWS)}), sampled as materialized (select user_id, follower_id from (select *, row_number() over (partition by user_id order by md5('42:' || user_id || ':' || follower_id), follower_id) as k from follows) where k <= 5)"
_FEED = f"""feed as (
  select *, cast(floor((row_number() over (partition by user_id order by ts desc, event_id desc) - 1) / 3.0) as int) as page_no from events
), paged as (
  select *, case when user_id % 10 = 0 then 400 else 200 end as code, event_type in ('view', 'purchase') as geo from feed
), heads as (
  select user_id, page_no, code, count(*) as n, sum(geo::int) as n_geo from paged group by user_id, page_no, code
), kept as (
  select * from (select *, coalesce(sum(case when n_geo = 0 then 1 else 0 end) over (partition by user_id order by page_no rows between unbounded preceding and 1 preceding), 0) as e from heads where code = 200) where e = 0
), found as (
  select p.* from paged p join kept k using (user_id, page_no) where p.geo
)"""
_MEDIA = f"with {_FEED} select event_id as id, '2015-10-01 10:00:00' as date, event_type as tag, user_id, event_id % 40 as location_id from (select *, row_number() over (partition by event_id order by user_id, page_no) as k from found) where k = 1"

_LINE = """lines as (
  select id, trim((case when id % 5 = 0 then ' ' else '' end) || id || ',' || user_id || ',2015-10-01 10:00:00,"{' || array_to_string(tags, ',')
    || (case when id % 7 = 3 then '""x""' else '' end) || '}",' || location_id || ',' || (case when id % 3 = 0 then '' else location_name end) || ',' || user_id || '.5,'
    || (case when id % 11 = 4 then 'abc' else '7.25' end) || (case when id % 13 = 5 then ',9' else '' end)) as line, * exclude (id) from docs
), cells as (
  select *, case when regexp_full_match(line, '("[^"]*"|[^",]*)(,("[^"]*"|[^",]*))*')
    then list_transform(regexp_extract_all(',' || line, ',("[^"]*"|[^",]*)', 1), lambda c: case when c[1] = '"' then c[2:-2] else c end) else [] end as f from lines
)"""


_COVER = f"{_ALL}, {_LLA.format(points='centers')} select id, rank, {{label}}round(degrees(la), 6) as lat, round(degrees(lo), 6) as lon, round(r.p, 6) as probability{{more}} from ranked r join lla l on l.label = r.label where round(before, 9) < 0.75"
_UNIFORM = "(('0x' || substr(md5('42:{turn}:' || id), 1, 12))::bigint / 281474976710656.0)"
#: Who may be visited after the first pages: not private, with a next page, and with a geotagged medium there.
_LATER = f"""{_FEED}, early as (select user_id from heads where page_no = 0 and code = 200 and n = 3 and n_geo > 0), rest as (
  select *, coalesce(sum(case when n_geo = 0 then 1 else 0 end) over (partition by user_id order by page_no rows between unbounded preceding and 1 preceding), 0) as e from heads join early using (user_id) where page_no > 0
), again as (select p.* from paged p join (select user_id, page_no from rest where e = 0) k using (user_id, page_no) where p.geo)"""


def oracle_sql() -> dict[str, str]:
    tag_text = "(case when doc_id % 4 = 1 then '' else '{' end || regexp_replace(text, '[ ]+', ',', 'g') || case when doc_id % 5 = 2 then '}{' else '' end || '}')"
    return {
        "csv_fields": f"with {_DOCS}, {_LINE} select id, len(f) as n, md5(array_to_string(f, '|')) as fields_md5 from cells",
        "media_csv": f"with {_DOCS}, {_LINE} select id, user_id, greatest(len(tags), 1) as n_tags, '2015-10-01 10:00:00' as date, cast(location_id as bigint) as location_id, f[6] as location_name, cast(f[7] as double) as latitude, cast(f[8] as double) as longitude from cells where len(f) = 8 and f[8] <> 'abc'",
        "tag_list": f"""with t as (select doc_id, regexp_replace({tag_text}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') as t from documents),
l as (select doc_id, case when regexp_full_match(t, '\\{{[^{{}}]*\\}}') then string_split(t[2:-2], ',') else [] end as l from t)
select doc_id, len(l) as n, md5(array_to_string(l, '|')) as tags_md5 from l""",
        "request_terms": """with t as (select conv_id, turn, string_split(regexp_replace(regexp_replace(lower(translate(text, ' .', '+,')), '[+,]+$', ''), '[+,]', chr(1), 'g'), chr(1)) as t from conversations)
select conv_id, turn, count(*) as n_rows, cast(sum(case when t = [''] then 0 else len(t) end) as bigint) as n_terms, min(md5(array_to_string(t, '|'))) as terms_md5 from t group by conv_id, turn""",
        "media_samples": f"with rows as ({fx.duck(fx.SALES_MEDIA)}), places as ({fx.duck(fx.PLACES)}), firsts as (select * from (select *, row_number() over (partition by id order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as k from rows) where k = 1) select f.id, user_id, array_to_string(tags, ' ') as tags, location_id, name as location_name, latitude, longitude from firsts f join places p on f.location_id = p.id",
        "ecef": f"with {_DOCS} select id, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z from pts",
        "ecef_roundtrip": f"with {_DOCS}, {_LLA.format(points='pts')} select id, round(degrees(la), 6) as lat, round(degrees(lo), 6) as lon, abs(p / cos(la) - 6378137.0 / sqrt(1 - {_E2} * sin(la) * sin(la))) < 0.01 as at_sea_level from lla",
        "tag_counts": f"with {_DOCS} select tag, count(*) as n from (select unnest(tags) as tag from docs) group by tag",
        "idf_terms": f"with {_DOCS}, {_TERMS} select tag, n, round(weight, 9) as weight from terms",
        "tag_weights": f"with {_DOCS}, {_TERMS} select id, tag, round(w, 6) as w from features",
        "cell_assign": f"with {_CENTERS}, {_NEAR} select id, label, round(d2, 0) as d2 from near",
        "cell_cost": f"with {_CENTERS}, {_NEAR} select round(sum(d2 / 1e9), 3) as cost_e9, count(*) as n from near",
        "cell_centroids": f"with {_CENTERS}, {_NEAR} select c.label, round(coalesce(avg(px), any_value(c.x)), 3) as x, round(coalesce(avg(py), any_value(c.y)), 3) as y, round(coalesce(avg(pz), any_value(c.z)), 3) as z, count(n.id) as n from centers c left join near n on n.label = c.label group by c.label",
        "candidate_weights": f"with {_CENTERS}, {_SALES}, sp as materialized (select id, {_XYZ} from sales), one as (select id, label from (select p.id, c.label, row_number() over (partition by p.id order by power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2), c.label) as k from sp p cross join centers c) where k = 1) select c.label, count(o.id) as weight from centers c left join one o on o.label = c.label group by c.label",
        "cell_corners": f"with {_CELLS} select unnest([a, b, c]) as label, round(degrees(la), 6) as lat, round(degrees(lo), 6) as lon from face_places",
        "kml_cell_texts": f"""with {_CELLS}, edges as (
  select unnest([a, b, c]) as label, unnest([b, c, a]) as p, unnest([c, a, b]) as q, round(degrees(la), 2) as lat, round(degrees(lo), 2) as lon from face_places
), seen as materialized (
  select o.label, o.other, (-dx * sin(lo) + dy * cos(lo)) / depth as u, (-dx * sin(la) * cos(lo) - dy * sin(la) * sin(lo) + dz * cos(la)) / depth as v from (
    select e.label, e.other, i.la, i.lo, j.x - i.x as dx, j.y - i.y as dy, j.z - i.z as dz,
      -((j.x - i.x) * cos(i.la) * cos(i.lo) + (j.y - i.y) * cos(i.la) * sin(i.lo) + (j.z - i.z) * sin(i.la)) as depth
    from (select label, p as other from edges union select label, q from edges) e join sea i on i.label = e.label join sea j on j.label = e.other
  ) o
), middles as (
  select m.label, mu, mv, atan2(v0 - mv, u0 - mu) as a0 from (select label, avg(u) as mu, avg(v) as mv, arg_min(u, u) as u0, arg_min(v, u) as v0 from seen group by label) m
), turned as (
  select e.label, lat, lon, (atan2((s.v + t.v) / 2 - mv, (s.u + t.u) / 2 - mu) - a0 + 8 * pi()) % (2 * pi()) as turn
  from edges e join seen s on s.label = e.label and s.other = p join seen t on t.label = e.label and t.other = q join middles m on m.label = e.label
), rings as (
  select label, string_agg(lon || ',' || lat || ',0.0' || chr(10), '' order by turn) || arg_min(lon || ',' || lat || ',0.0' || chr(10), turn) as ring from turned group by label
), parts as (
  select 0 as section, '' as sort, '<kml>' || chr(10) || '<Document>' as v union all select 9, '', '</Document>' || chr(10) || '</kml>'
  union all select 5, lpad(cast(label as varchar), 12, '0'), '<Placemark>' || chr(10) || '<Style><LineStyle><width>2</width></LineStyle></Style>' || chr(10) || '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || chr(10) || ring || '</coordinates></LinearRing></outerBoundaryIs></Polygon>' || chr(10) || '</Placemark>' from rings
) select section, sort, md5(v) as value_md5 from parts""",
        "class_counts": f"with {_DOCS} select location_name as place, cast(count(*) // 10 as int) as k, cast(count(*) * 3 // 40 as int) as k_folds from docs group by location_name having count(*) >= 14",
        "kml_points": f"""with {_CENTERS}, {_NEAR}, rows as (select cast(label as varchar) as c, array_to_string(tags, ' & ') as t, round(latitude, 2) as la, round(longitude, 2) as lo from docs join near using (id)),
parts as (
  select 0 as section, '' as sort, '<kml>' || chr(10) || '<Document>' as v union all select 9, '', '</Document>' || chr(10) || '</kml>'
  union all select distinct 3, c, '<Style id="cell-' || c || '"><IconStyle>' || chr(10) || '<color>ff' || substr(md5(c), 1, 6) || '</color>' || chr(10) || '<Icon><href>http://maps.google.com/mapfiles/kml/shapes/placemark_circle.png</href></Icon>' || chr(10) || '</IconStyle></Style>' from rows
  union all select 5, c, '<Placemark>' || chr(10) || '<description>' || replace(t, '&', '&amp;') || '</description>' || chr(10) || '<styleUrl>#cell-' || c || '</styleUrl>' || chr(10) || '<Point><coordinates>' || lo || ',' || la || '</coordinates></Point>' || chr(10) || '</Placemark>' from rows
) select section, sort, md5(v) as value_md5 from parts""",
        "nb_classes": f"with {_NB} select label, n, round(sum_w, 6) as sum_w, round(pi, 6) as pi, round(log_denom, 6) as log_denom from classes",
        "nb_theta": f"with {_NB} select label, tag, round(sum_w, 6) as sum_w, round(log_w, 6) as log_w from theta",
        "nb_scores": f"{_ALL} select id, label, round(score, 4) as score from scores",
        "nb_top_k": f"{_ALL} select id, cast(rank as int) as rank, label, round(p, 6) as probability from ranked where rank <= 3",
        "nb_cover": f"{_ALL} select id, cast(rank as int) as rank, label, round(p, 6) as probability from ranked where round(before, 9) < 0.75",
        "nb_argmax": f"{_ALL} select id, label from ranked where rank = 1",
        "predict_location": f"{_ALL}, {_LLA.format(points='centers')} select id, r.label, round(degrees(la), 6) as lat, round(degrees(lo), 6) as lon, round(r.p, 6) as probability from ranked r join lla l on l.label = r.label where rank = 1",
        "score_requests": _requests(),
        "stream_score": _requests(),
        "hit_rates": f"{_ALL}, levels(level) as (values (1), (4), (16)) select level, round(avg(case when rank <= level then 1.0 else 0.0 end), 6) as rate from levels cross join (select l.id, r.rank from labels l left join ranked r on r.id = l.id and r.label = l.label) group by level",
        "fold_sizes": f"with {_DOCS} select cast(('0x' || substr(md5('42:' || id), 1, 8))::bigint % 5 as int) as fold, count(*) as n from docs group by fold",
        "cross_validate": _cross(5),
        "class_frequency": f"with {_FLAT} select class_no, round(prior, 9) as prior, size as n_tags from flat_classes",
        "class_tag_counts": f"with {_FLAT} select class_no, tag, n from flat_counts",
        "flat_mle": _flat("select distinct item_id as id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) as tag from benchmark", "0"),
        "flat_smoothed": _flat("select distinct id, unnest(tags) as tag from asked", "0.001"),
        "insert_coordinates": f"""with {_FLAT}, t as (select class_no, list_sort(list_distinct(list(tag))) as tags from flat_counts group by class_no)
select c.class_no, md5(class || ',0.5,' || round(lat, 2) || ',' || round(lon, 2) || ',' || array_to_string(tags, ',') || ',') as value_md5 from flat_classes c join t using (class_no)""",
        "pages_until_empty": f"with {_PAGES} select * from kept",
        "user_scrape_state": f"""with {_PAGES}, coded as (select user_id, page_no, n_geo, case when user_id % 10 = 0 then 400 else 200 end as code, case when n_media = 3 then cast(page_no as varchar) end as next_max_id from kept),
last as (select * from (select *, row_number() over (partition by user_id order by page_no desc) as k from coded) where k = 1)
select user_id, case when code = 200 then next_max_id end as next_max_id, code = 200 and next_max_id is null as fully_scraped, code = 400 as private, code = 200 and n_geo = 0 as stopped from last""",
        "insert_if_absent": f"with {_SALES} select id, user_id, l_partkey, l_suppkey from sales where id not in (select o_orderkey * 10 + 1 from orders where o_orderstatus = 'F')",
        "sample_successors": f"with {_FOLLOWS} select * from sampled",
        "expand_frontier": _frontier(),
        "frontier_by_key": _frontier(),
        "rows_by_key": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')",
        "lacking_by_key": "select o_orderkey as l_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
        "upsert_by_key": """with l as (select l_orderkey, l_linenumber, l_quantity, o_orderpriority = '1-URGENT' as urgent, o_orderstatus as status from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_quantity from l where status in ('F', 'O') and (not urgent or l_orderkey not in (select l_orderkey from l where urgent and l_linenumber = 1))
union all select l_orderkey, l_linenumber, -l_quantity from l where urgent and l_linenumber = 1""",
        "random_users": "select c_custkey as id from customer order by md5('42:' || c_custkey), c_custkey limit 25",
        "class_model_files": f"""with {_FLAT}, t as (select class_no, string_agg(repeat(tag || ',', n), '' order by tag) as tags from flat_counts group by class_no)
select cast(row_number() over (order by c.class_no) - 1 as bigint) as line, class, round(prior, 9) as prior, round(lat, 6) as lat, round(lon, 6) as lon, md5(rtrim(tags, ',')) as tags_md5 from flat_classes c join t using (class_no)""",
        "class_predictions_json": f"select a.id, a.rank, a.class_no, a.confidence, round(b.lat, 6) as lat, round(b.lon, 6) as lon from ({_flat('select distinct id, unnest(tags) as tag from asked', '0.001')}) a join (with {_FLAT} select class_no, lat, lon from flat_classes) b using (class_no)",
        "predict_cover": _COVER.format(label="r.label, ", more=""),
        "predictions_json_read": _COVER.format(label="200 as status, '' as error, ", more=", true as has_polygon"),
        "cluster_csv": f"with {_CENTERS}, {_NEAR} select md5(array_to_string(tags, ',')) as tags_md5, round(latitude, 2) as lat, round(longitude, 2) as lon, 'c' || label as cluster from docs join near using (id)",
        "train_resumed": f"with {_NB} select label, n, round(sum_w, 6) as sum_w, round(pi, 6) as pi, round(log_denom, 6) as log_denom from classes",
        "train_clusters": f"""with {_DOCS}, {_TERMS}
select 'centers' as name, m // 100 as n from total union all select 'cells', m // 100 from total union all select 'labelled', m from total union all select 'terms', (select count(*) from terms) union all select 'assigned', m from total
union all select * from (values ('off_mean', 0::bigint), ('open_rings', 0), ('dear', 0)) v""",
        "stored_tables": f"""with m as ({_MEDIA}), u as (with {_FEED} select distinct user_id as id from kept union select distinct user_id from heads where code = 400)
select 'users' as name, count(*) as n, count(distinct id) as n_ids, cast(sum(id) as bigint) as sum_ids from u union all select 'locations', count(distinct location_id), count(distinct location_id), cast(sum(distinct location_id) as bigint) from m union all select 'media', count(*), count(distinct id), cast(sum(id) as bigint) from m""",
        "captions": f"select id, case when tag = 'view' then 'seen ' || id end as caption from ({_MEDIA})",
        "place_names": "select event_id as id, case when event_type in ('view', 'purchase') then 'p' || (event_id % 40) else 'nowhere' end as place from events where user_id % 10 <> 0",
        "query_terms": """with t as (select conv_id, turn, string_split_regex(text, '[^A-Za-z0-9_]+') as t from conversations)
select conv_id, turn, count(*) as n_rows, cast(sum(len(t)) as bigint) as n_terms, min(md5(array_to_string(t, '|'))) as terms_md5 from t group by conv_id, turn""",
        "batch_requests": f"with r as ({fx.duck(fx.REQUESTS)}), t as (select request_id, cnt, string_split(regexp_replace(lower(text), '[^a-z]+', '+', 'g'), '+') as t from r) select 'p' || request_id as param, cast(coalesce(cnt, -1) as bigint) as cnt, len(t) as n_tags, md5(array_to_string(t, '|')) as tags_md5 from t",
        "zip_rows": "select a.i, c_custkey, s_suppkey, s_name from (select c_custkey, row_number() over (order by c_custkey) - 1 as i from customer) a join (select s_suppkey, s_name, row_number() over (order by s_name desc, s_suppkey) - 1 as i from supplier) b using (i)",
        "cap_frontier": "select o_orderkey as user_id from orders order by md5('42:' || o_orderkey), o_orderkey limit 5000",
        "merge_frontier": f"with {_FOLLOWS} select user_id from follows union select follower_id from follows",
        "sample_one": f"with {_DOCS} select id from docs order by {_UNIFORM.format(turn=0)}, id limit 1",
        "oversample_centers": f"with {_CENTERS}, {_NEAR} select round(px, 3) as x, round(py, 3) as y, round(pz, 3) as z from near where {_UNIFORM.format(turn=1)} < 2.0 * 30 * d2 / (select sum(d2) from near)",
        "surface_points": f"""with {_DOCS}, up as (select id, x * 1.001 as x, y * 1.001 as y, z * 1.001 as z from pts), {_LLA.format(points='up')},
ground as (select id, degrees(la) as latitude, degrees(lo) as longitude from lla), put as (select id, {_XYZ} from ground)
select p.id, round(p.x, 2) as sx, round(p.y, 2) as sy, round(p.z, 2) as sz, round(sqrt(power(u.x - o.x, 2) + power(u.y - o.y, 2) + power(u.z - o.z, 2)), 2) as lift from put p join up u using (id) join pts o using (id)""",
        "seed_users": "select distinct user_id from events where user_id % 10 <> 0",
        "ingest_known_users": f"with {_LATER} select event_id as id, event_type as tag, user_id, event_id % 40 as location_id from (select *, row_number() over (partition by event_id order by user_id, page_no) as k from again) where k = 1",
        "active_users": f"with {_FEED}, last as (select *, row_number() over (partition by user_id order by page_no desc) as k from kept) select user_id as id, cast(page_no as varchar) as next_max_id from last where k = 1 and n = 3",
        "ingest_media": _MEDIA,
        "stream_ingest": _MEDIA,
        "ingest_users": f"""with {_FEED}, last as (select *, row_number() over (partition by user_id order by page_no desc) as k from kept)
select user_id as id, case when n = 3 then cast(page_no as varchar) end as next_max_id, n <> 3 as fully_scraped, false as private, n_geo = 0 as stopped from last where k = 1
union all select distinct user_id, null, false, true, false from heads where code = 400""",
    }


def _frontier() -> str:
    return f"""with {_FOLLOWS}, l0 as (select c_custkey as user_id from customer where c_custkey in (select user_id from events) order by md5('42:' || c_custkey), c_custkey limit 25),
l1 as (select distinct follower_id as user_id from sampled join l0 using (user_id) where follower_id not in (select user_id from l0)),
l2 as (select distinct follower_id as user_id from sampled join l1 using (user_id) where follower_id not in (select user_id from l0) and follower_id not in (select user_id from l1))
select user_id, 0 as level from l0 union all select user_id, 1 from l1 union all select user_id, 2 from l2"""


def _requests() -> str:
    return f"""with {_NB}, {_ASKED}, said as (select id, unnest(tags) as tag from asked), req as (select id, s.tag, sum(weight) as w from said s join terms t on s.tag = t.tag group by id, s.tag),
{_scores('asked', 'req')}
select a.id as request_id, r.rank, r.label, round(r.p, 6) as probability from ranked r join asked a on a.id = r.id where r.rank <= a.cnt or (a.cnt is null and round(r.before, 9) < 0.75)"""


def _cross(folds: int) -> str:
    """Each fold's model from the other folds' rows, with the same fixed centres."""
    parts = []
    for k in range(folds):
        parts.append(f"""t{k} as materialized (select tag, ln((select count(*) from folded where fold <> {k}) / cast(count(*) as double)) as weight from words join folded using (id) where fold <> {k} group by tag having count(*) > 5),
f{k} as materialized (select id, tag, sum(weight) as w from words join t{k} using (tag) group by id, tag),
theta{k} as materialized (select label, tag, sum(w) as sum_w, ln(sum(w) + 1) as log_w from f{k} join folded using (id) where fold <> {k} group by label, tag),
c{k} as materialized (
  select l.label, ln(l.n + 1) - ln((select count(*) from folded where fold <> {k}) + (select count(distinct label) from folded where fold <> {k})) as pi, ln(coalesce(s.sum_w, 0) + (select count(*) from t{k})) as log_denom
  from (select label, count(*) as n from folded where fold <> {k} group by label) l left join (select label, sum(sum_w) as sum_w from theta{k} group by label) s on l.label = s.label),
s{k} as materialized (
  select i.id, i.label as truth, c.label, pi - coalesce(mass, 0) * log_denom + coalesce(shared, 0) as score
  from (select * from folded where fold = {k}) i cross join c{k} c left join (select id, sum(w) as mass from f{k} group by id) m on m.id = i.id
  left join (select id, label, sum(w * log_w) as shared from f{k} join theta{k} using (tag) group by id, label) h on h.id = i.id and h.label = c.label),
r{k} as (select *, row_number() over (partition by id order by round(behind, 6) desc, label) as rank from (select *, score - max(score) over (partition by id) as behind from s{k})),
h{k} as (select level, avg(case when rank <= level then 1.0 else 0.0 end) as rate from (values (1), (4), (16)) v(level) cross join (select i.id, r.rank from (select * from folded where fold = {k}) i left join r{k} r on r.id = i.id and r.label = i.label) group by level)""")
    every = " union all ".join(f"select * from h{k}" for k in range(folds))
    return f"""with {_CENTERS}, {_NEAR}, words as materialized (select id, unnest(tags) as tag from docs),
folded as materialized (select id, label, cast(('0x' || substr(md5('42:' || id), 1, 8))::bigint % {folds} as int) as fold from near),
{', '.join(parts)} select level, round(avg(rate), 6) as rate from ({every}) group by level"""
