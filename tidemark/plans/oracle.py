"""The registered queries in plain SQL, for an independent engine.

Containment is tested against every edge of every zone, without cells.
"""

from __future__ import annotations

CELL_ID = "((floor({x} / {s})::bigint + 1073741824) * 2147483648 + floor({y} / {s})::bigint + 1073741824)"


def cell(x: str, y: str, size: int) -> str:
    return CELL_ID.format(x=f"({x})", y=f"({y})", s=f"{size}.0")


INPUTS = {
    "zb": """
        select k as zone_id, cast(1 + k % 4 as int) as severity, 'Z' || (1 + k % 4) as zone_code,
               (m * 48271) % 1000000 + t * 1000000 as cx, (m * 16807 + 13 * m * m) % 1000000 as cy, w
        from (select cast(p_partkey as bigint) as k, p_partkey % 20000 as m, p_partkey // 20000 as t,
                     1000 + 200 * cast(p_size as bigint) as w from part)""",
    "zv": """
        select zone_id, 1 as i, cx - w as x, cy - w as y from zb union all
        select zone_id, 2, cx + w, cy - w from zb union all
        select zone_id, 3, cx + w, cy + w from zb union all
        select zone_id, 4, cx, cy from zb union all
        select zone_id, 5, cx - w, cy + w from zb""",
    "ze": """
        select a.zone_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2
        from zv a join zv b on a.zone_id = b.zone_id and b.i = a.i % 5 + 1 where a.y <> b.y""",
    "bd": """
        select k as building_id, (7919 * m + 3 * m * m) % 1000000 + t * 1000000 as x,
               (104729 * m + 7 * m * m) % 1000000 as y, 500 + (31 * k) % 4000 as first_floor_mm,
               case when k % 11 = 0 then 'NGVD29' else 'NAVD88' end as datum
        from (select cast(o_orderkey as bigint) as k, o_orderkey % 150000 as m, o_orderkey // 150000 as t from orders)""",
    "el": """
        select k as bfe_id, (31337 * m) % 1000000 + t * 1000000 as x, (71993 * m + 11 * m * m) % 1000000 as y,
               1000 + (97 * k) % 3000 as bfe_mm, case when k % 7 = 0 then 'NGVD29' else 'NAVD88' end as datum
        from (select cast(s_suppkey as bigint) as k, s_suppkey % 1000 as m, s_suppkey // 1000 as t from supplier)""",
    "pn": """
        select k + 25 * t as panel_id, version, (k % 5) * 200000 + t * 1000000 as x0, (k // 5) * 200000 as y0,
               case when version = 1 then date '2008-01-01' + cast(10 * k as int)
                    else date '2019-01-01' + cast(30 * k as int) end as effective_date
        from (select cast(n_nationkey as bigint) as k from nation),
             (select unnest(range(0, (select max(s_suppkey) // 1000 + 1 from supplier))) as t),
             (values (1), (2)) v(version)""",
    "sv": """
        select case when mixed % 3 = 0 then 1 when mixed % 53 = 1 then null else k end as building_id,
               case when mixed % 41 = 2 then null else (k % 150000) * 7 % 1000000 end as x,
               (k % 150000) * 11 % 1000000 as y, l_shipdate as measured_at,
               l_partkey * 10000 + l_suppkey * 10 + l_linenumber as survey_no, k as source_no
        from (select *, cast(l_orderkey as bigint) as k, l_orderkey + l_linenumber + l_suppkey as mixed from lineitem)""",
    "hits": """
        select b.building_id, z.zone_id, z.severity, z.zone_code
        from bd b join zb z on b.x between z.cx - z.w and z.cx + z.w and b.y between z.cy - z.w and z.cy + z.w
        where (select count(*) from ze e
               where e.zone_id = z.zone_id and (e.y1 > b.y) <> (e.y2 > b.y)
                 and case when e.y2 > e.y1 then (b.x - e.x1) * (e.y2 - e.y1) < (e.x2 - e.x1) * (b.y - e.y1)
                          else (b.x - e.x1) * (e.y2 - e.y1) > (e.x2 - e.x1) * (b.y - e.y1) end) % 2 = 1""",
    "best": """
        select building_id, zone_id, severity, zone_code from hits
        qualify row_number() over (partition by building_id order by severity desc, zone_id) = 1""",
    "tagged": """
        select b.building_id, p.panel_id, coalesce(h.severity, 0) as severity, b.first_floor_mm
        from bd b left join best h using (building_id)
        left join pn p on p.version = 2 and b.x >= p.x0 and b.x < p.x0 + 200000 and b.y >= p.y0 and b.y < p.y0 + 200000""",
    "near": """
        select b.building_id, e.bfe_id, e.bfe_mm, e.datum,
               (b.x - e.x) * (b.x - e.x) + (b.y - e.y) * (b.y - e.y) as d2,
               row_number() over (partition by b.building_id
                                  order by (b.x - e.x) * (b.x - e.x) + (b.y - e.y) * (b.y - e.y), e.bfe_id) as n
        from bd b join el e on (b.x - e.x) * (b.x - e.x) + (b.y - e.y) * (b.y - e.y) <= 2500000000""",
    "held": """
        select *, lead(effective_date) over (partition by panel_id order by effective_date, version) as valid_to from pn""",
    "ranked": """
        select *, row_number() over (partition by building_id
                                     order by measured_at desc, survey_no desc, x desc, y desc, source_no desc) as n
        from sv where building_id is not null and x is not null and y is not null""",
    "zt": """
        select zone_id, string_agg(x || ' ' || y, ';' order by i) as outline,
               min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1
        from zv group by zone_id""",
}

# Which inputs each input reads, in the order they must be defined.
ORDER = list(INPUTS)
NEEDS = {
    "zv": ["zb"], "ze": ["zv"], "hits": ["bd", "zb", "ze"], "best": ["hits"], "tagged": ["bd", "best", "pn"],
    "near": ["bd", "el"], "held": ["pn"], "ranked": ["sv"], "zt": ["zv"],
}


def sql(uses: str, body: str) -> str:
    """``body`` with the definitions of the inputs it uses in front."""
    wanted: set[str] = set()
    queue = uses.split()
    while queue:
        name = queue.pop()
        wanted.add(name)
        queue += NEEDS.get(name, [])
    return "with " + ", ".join(f"{n} as ({INPUTS[n]})" for n in ORDER if n in wanted) + body


def in_panel(b: str, p: str) -> str:
    return f"{b}.x >= {p}.x0 and {b}.x < {p}.x0 + 200000 and {b}.y >= {p}.y0 and {b}.y < {p}.y0 + 200000"


def sampled(step: int) -> str:
    """Sample points in zones: every square of the box, tested on all edges."""
    return f"""
        , sq as (
            select zone_id, c * {step} + {step // 2} as px, r * {step} + {step // 2} as py
            from (select zone_id, unnest(range(floor((cx - w) / {step}.0)::bigint, floor((cx + w) / {step}.0)::bigint + 1)) as c,
                         cy, w from zb),
                 lateral (select unnest(range(floor((cy - w) / {step}.0)::bigint, floor((cy + w) / {step}.0)::bigint + 1)) as r)
        ), inside as (
            select s.zone_id, s.px, s.py from sq s join ze e on e.zone_id = s.zone_id
            where (e.y1 > s.py) <> (e.y2 > s.py)
              and case when e.y2 > e.y1 then (s.px - e.x1) * (e.y2 - e.y1) < (e.x2 - e.x1) * (s.py - e.y1)
                       else (s.px - e.x1) * (e.y2 - e.y1) > (e.x2 - e.x1) * (s.py - e.y1) end
            group by s.zone_id, s.px, s.py having count(*) % 2 = 1
        )"""


SHARED = "cast(amount * 1000000 // nullif(total, 0) as bigint) as share_ppm"
SUMMARY = """
    select {cell} as cell_id, datum, count(v) as n_values, min(v) as min_value, max(v) as max_value,
           sum(v)::double / count(v) as mean_value, quantile_cont(v, 0.5)::double as median_value
    from ({rows}) group by 1, 2"""

ORACLE: dict[str, str] = {
    "points_in_zones": sql("hits", " select building_id, zone_id, severity from hits"),
    "points_in_zones_or_none": sql(
        "hits", " select b.building_id, h.zone_id, h.zone_code from bd b left join hits h using (building_id)"
    ),
    "buildings_in_zones": sql(
        "hits", " select building_id, x, y from bd where building_id in (select building_id from hits)"
    ),
    "buildings_outside_zones": sql(
        "hits", " select building_id, x, y from bd where building_id not in (select building_id from hits)"
    ),
    "zone_of_building": sql("best", " select building_id, zone_id, severity from best"),
    "zone_prevalence": sql("tagged", f"""
        select *, {SHARED} from (
            select panel_id, severity, count(*) as amount, cast(sum(count(*)) over (partition by panel_id) as bigint) as total
            from tagged group by panel_id, severity)"""),
    "zone_prevalence_rollup": sql("tagged", f"""
        , g as (select panel_id, severity, count(*) as amount, grouping(panel_id, severity) as level
                from tagged group by rollup (panel_id, severity)),
          t as (select panel_id, severity, level, amount,
                       case when level = 3 then amount else (select count(*) from tagged u where u.panel_id = g.panel_id) end as total
                from g)
        select *, {SHARED} from t"""),
    "zone_prevalence_weighted_cube": sql("tagged", f"""
        , g as (select panel_id, severity, cast(sum(first_floor_mm) as bigint) as amount, grouping(panel_id, severity) as level
                from tagged group by cube (panel_id, severity)),
          t as (select panel_id, severity, level, amount,
                       cast(case when level >= 2 then (select sum(first_floor_mm) from tagged)
                            else (select sum(first_floor_mm) from tagged u where u.panel_id = g.panel_id) end as bigint) as total
                from g)
        select *, {SHARED} from t"""),
    "panel_on_date": sql("held bd", f"""
        select b.building_id, p.panel_id, p.version, cast(p.effective_date as varchar) as effective_date from bd b
        left join held p on {in_panel('b', 'p')} and p.effective_date <= date '2019-12-31'
             and (p.valid_to is null or p.valid_to > date '2019-12-31')"""),
    "panel_as_of_each": sql("held bd", f"""
        , asked as (select building_id, x, y, date '2005-01-01' + cast(building_id * 37 % 7000 as int) as asked_on from bd)
        select b.building_id, cast(b.asked_on as varchar) as asked_on, p.panel_id, p.version from asked b
        left join held p on {in_panel('b', 'p')} and p.effective_date <= b.asked_on
             and (p.valid_to is null or p.valid_to > b.asked_on)"""),
    "building_cells": sql("bd", f" select building_id, {cell('x', 'y', 10000)} as cell_id, {cell('x', 'y', 80000)} as parent_id from bd"),
    "zone_cover": sql("zb", """
        select zone_id, (c + 1073741824) * 2147483648 + r + 1073741824 as cell_id
        from (select zone_id, unnest(range(floor((cx - w) / 10000.0)::bigint, floor((cx + w) / 10000.0)::bigint + 1)) as c, cy, w from zb),
             lateral (select unnest(range(floor((cy - w) / 10000.0)::bigint, floor((cy + w) / 10000.0)::bigint + 1)) as r)"""),
    "zone_cells_sampled": sql("zb ze", f"""{sampled(2500)}
        select {cell('px', 'py', 10000)} as cell_id, zone_id, count(*) as samples, count(*) * 1000000 // 16 as share_ppm
        from inside group by 1, 2"""),
    "zone_area_prevalence": sql("zb ze", f"""{sampled(2500)}
        , sums as (select {cell('px', 'py', 80000)} as parent_id, severity, count(*) as n
                   from inside join zb using (zone_id) group by 1, 2)
        select parent_id, severity, n / 16.0 as amount, sum(n) over (partition by parent_id) / 16.0 as total,
               cast(n * 1000000 // cast(sum(n) over (partition by parent_id) as bigint) as bigint) as share_ppm
        from sums"""),
    "points_in_geojson_zones": sql("hits", """
        select building_id, zone_id as feature_id, zone_code from hits
        where zone_id % 31 <> 4 and zone_id % 37 <> 5 and zone_id % 41 <> 6"""),
    "zone_cell_centres": sql("zb ze", f"{sampled(10000)} select {cell('px', 'py', 10000)} as cell_id, zone_id from inside"),
    "coverage_cells": sql("bd", f' select {cell("x", "y", 10000)} as cell_id, count(*) as "rows" from bd group by 1'),
    "bfe_cells": sql("el", SUMMARY.format(cell=cell("x", "y", 100000), rows="select x, y, datum, bfe_mm as v from el")),
    "first_floor_cells": sql("bd", SUMMARY.format(cell=cell("x", "y", 100000), rows="select x, y, datum, first_floor_mm as v from bd")),
    "nearest_bfe": sql("near", """
        select b.building_id, n.bfe_id as near_bfe_id, n.bfe_mm as near_bfe_mm, n.datum as near_datum, n.d2 as near_d2
        from bd b left join near n on n.building_id = b.building_id and n.n = 1"""),
    "nearest_bfe_same_datum": sql("bd el", """
        select b.building_id, b.datum, e.bfe_id as near_bfe_id, e.bfe_mm as near_bfe_mm, e.d2 as near_d2
        from bd b left join (
            select p.building_id, t.*, (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) as d2, row_number() over (
                partition by p.building_id order by (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y), t.bfe_id) as n
            from bd p join el t on p.datum = t.datum
            where (p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) <= 2500000000) e
        on e.building_id = b.building_id and e.n = 1"""),
    "nearest_bfe_three": sql("near", """
        select b.building_id, cast(n.n as int) as near_rank, n.bfe_id as near_bfe_id, n.d2 as near_d2
        from bd b left join near n on n.building_id = b.building_id and n.n <= 3"""),
    "zone_rings": sql("zt", " select zone_id as feature_id, 0 as part, 0 as ring, x0, y0, x1, y1, outline from zt"),
    "clean_buildings": sql("ranked", " select building_id, x, y, survey_no, source_no from ranked where n = 1"),
    "clean_buildings_rejected": sql("ranked", """
        , bad as (
            select building_id, x, y, survey_no, source_no,
                   case when building_id is null then 'null key' else 'null coordinate' end as reason, 1 as copies
            from sv where building_id is null or x is null or y is null)
        , late as (
            select building_id, x, y, survey_no, source_no, 'superseded' as reason, count(*) as copies
            from ranked where n > 1 group by building_id, x, y, survey_no, source_no, measured_at)
        select * from bad union all select * from late"""),
    "clean_zones": sql("zt", """
        select zone_id, outline from zt where zone_id % 29 <> 3 and zone_id % 17 <> 1 and zone_id % 23 <> 2"""),
    "clean_zones_rejected": sql("zb", """
        select zone_id as source_id, case when zone_id % 29 = 3 then 'null key' else 'degenerate ring' end as reason,
               cast(1 as bigint) as copies
        from zb where zone_id % 29 = 3 or zone_id % 17 = 1 or zone_id % 23 = 2"""),
    "buildings_wide": sql("best near pn", f"""
        , h as (select building_id, 40 + building_id % 60 as h from bd)
        select b.building_id, b.x, b.y, b.first_floor_mm, b.datum,
               case when b.building_id % 10 <> 0 then
                   (x - h.h) || ' ' || (y - h.h) || ';' || (x + h.h) || ' ' || (y - h.h) || ';' ||
                   (x + h.h) || ' ' || (y + h.h) || ';' || (x - h.h) || ' ' || (y + h.h) end as outline,
               z.zone_id, z.zone_code, z.severity, n.bfe_id as near_bfe_id, n.bfe_mm as near_bfe_mm,
               n.datum as near_datum, n.d2 as near_d2, p.panel_id, p.version as panel_version,
               case when b.datum = n.datum then b.first_floor_mm - n.bfe_mm end as above_mm
        from bd b join h using (building_id) left join best z using (building_id)
        left join near n on n.building_id = b.building_id and n.n = 1
        left join pn p on p.version = 2 and {in_panel('b', 'p')}"""),
    "layer_violations": sql("sv", """
        , broken as (
            select 'required' as rule, 'x' as columns, 1 as violations, 'bigint' as sample
            union all select 'required', 'height_mm', 1, 'missing'
            union all select 'not_null', 'building_id', count(*), min(source_no)::varchar from sv where building_id is null
            union all select 'not_null', 'x', count(*), min(source_no)::varchar from sv where x is null
            union all select 'not_null', 'y', count(*), min(source_no)::varchar from sv where y is null
            union all select 'range', 'y', count(*), min(source_no)::varchar from sv where y < 0 or y > 100000
            union all select 'allowed', 'survey_no', count(*), min(source_no)::varchar from sv where survey_no not in (1, 2, 3)
            union all select 'unique', 'building_id', count(*), min(building_id)::varchar
                from (select building_id from sv where building_id is not null group by 1 having count(*) > 1)
            union all select 'unique', 'source_no,survey_no', count(*),
                case when count(*) > 0 then '{"source_no":' || min(source_no) || ',"survey_no":'
                     || arg_min(survey_no, source_no * 1000000000000 + survey_no) || '}' end
                from (select source_no, survey_no from sv group by 1, 2 having count(*) > 1)
            union all select 'foreign_key', 'building_id', count(*), min(building_id)::varchar
                from sv where building_id = 1 or building_id not in (select o_orderkey from orders))
        select * from broken where violations > 0"""),
    "zone_geojson": sql("zt zb", """
        select zone_id as feature_id, 0 as part, 0 as ring, x0, y0, x1, y1, zone_code, outline
        from zt join zb using (zone_id) where zone_id % 31 <> 4 and zone_id % 37 <> 5 and zone_id % 41 <> 6"""),
    "zone_geojson_rejected": sql("zb", """
        select case when zone_id % 41 = 6 then 'malformed line' when zone_id % 31 = 4 then 'not a feature'
                    else 'no whole-number id' end as reason,
               count(*) as lines
        from zb where zone_id % 31 = 4 or zone_id % 37 = 5 or zone_id % 41 = 6 group by 1"""),
    "published_layer": sql("bd", """
        select building_id, first_floor_mm, building_id % 4 as district from bd where building_id % 4 = 2 and x < 500000"""),
    "published_layers": """
        select 'first_floor' as name, 'main' as role, '1.0' as contract, (select count(*) from orders) as "rows"
        union all select 'elevation', 'dependent', '1.0', (select count(*) from supplier)""",
}
ORACLE["buildings_wide_joined"] = ORACLE["buildings_wide"]
# Each cell has fewer values than the sketch keeps, so its median is a value.
ORACLE["first_floor_cells_approximate"] = ORACLE["first_floor_cells"].replace("quantile_cont", "quantile_disc")


def in_pentagons(boxes: str, points: str, key: str, more: str = "") -> str:
    """Points in the pentagons of centre and half width, tested on all their edges."""
    return f"""
        with bx as ({boxes}), pt as ({points}), v as (
            select {key}, 1 as i, cx - w as x, cy - w as y from bx union all
            select {key}, 2, cx + w, cy - w from bx union all select {key}, 3, cx + w, cy + w from bx union all
            select {key}, 4, cx, cy from bx union all select {key}, 5, cx - w, cy + w from bx
        ), e as (
            select a.{key}, a.x as x1, a.y as y1, b.x as x2, b.y as y2
            from v a join v b on a.{key} = b.{key} and b.i = a.i % 5 + 1 where a.y <> b.y
        )
        select p.building_id, b.{key}{more}
        from pt p join bx b on p.x between b.cx - b.w and b.cx + b.w and p.y between b.cy - b.w and b.cy + b.w
        where (select count(*) from e
               where e.{key} = b.{key} and (e.y1 > p.y) <> (e.y2 > p.y)
                 and case when e.y2 > e.y1 then (p.x - e.x1) * (e.y2 - e.y1) < (e.x2 - e.x1) * (p.y - e.y1)
                          else (p.x - e.x1) * (e.y2 - e.y1) > (e.x2 - e.x1) * (p.y - e.y1) end) % 2 = 1"""


_BASINS = """
    select k + 25 * t as basin_id, (k * 337919) % 1000000 + t * 1000000 as cx, (k * 570817) % 1000000 as cy, 100000 + 6000 * k as w
    from (select cast(n_nationkey as bigint) as k from nation),
         (select unnest(range(0, (select max(s_suppkey) // 1000 + 1 from supplier))) as t)"""
_TOWN = f"select zone_id, severity, cx // 100 as cx, cy // 100 as cy, w // 100 as w from ({INPUTS['zb']})"
ORACLE["points_in_basins"] = in_pentagons(_BASINS, INPUTS["bd"], "basin_id")
ORACLE["points_in_town_zones"] = in_pentagons(
    _TOWN, f"select building_id, x // 100 as x, y // 100 as y from ({INPUTS['bd']})", "zone_id", ", b.severity"
)
ORACLE["nearest_gauge"] = sql("bd", """
    , ga as (
        select k as gauge_id, 100000 + (m % 5) * 200000 + (m * 7919) % 700 + t * 1000000 as x,
               100000 + (m // 5 % 5) * 200000 + (m * 104729) % 900 as y, (31 * k) % 5000 as level_mm
        from (select cast(p_partkey as bigint) as k, p_partkey % 20000 as m, p_partkey // 20000 as t from part)
    ), found as (
        select b.building_id, g.gauge_id, g.level_mm, (b.x - g.x) * (b.x - g.x) + (b.y - g.y) * (b.y - g.y) as d2
        from bd b join ga g on (b.x - g.x) * (b.x - g.x) + (b.y - g.y) * (b.y - g.y) <= 2500000000
        qualify row_number() over (partition by b.building_id
            order by (b.x - g.x) * (b.x - g.x) + (b.y - g.y) * (b.y - g.y), g.gauge_id) = 1
    )
    select b.building_id, f.gauge_id as near_gauge_id, f.level_mm as near_level_mm, f.d2 as near_d2
    from bd b left join found f using (building_id)""")
for _name in (
    "points_in_basins", "points_in_town_zones", "points_in_zones", "points_in_zones_or_none", "buildings_in_zones", "buildings_outside_zones", "panel_as_of_each",
    "nearest_bfe", "nearest_bfe_three", "nearest_bfe_same_datum",
):
    ORACLE[f"{_name}_shuffled"] = ORACLE[_name]
