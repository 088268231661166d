"""The registered queries: every rule, on layers derived from the test tables, through the engine.

Layers are built as WKB and checked by the same code as files are; closed forms stand in the SQL alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.checks import attributes, crs, duplicates, geometry, topology
from terrasift.checks.base import to_metric
from terrasift.config import AttributesRule, CrsRule, Domain, DuplicatesRule, FuzzyRule, GeometryRule, Suite, TopologyRule
from terrasift.functions.geo import geo_area, line_string, point, ring_polygon
from terrasift.model import FID, CheckResult, LayerFrame
from terrasift.operators.spread import spread
from terrasift.plans.run import checked, failing_rows, overview

PARCELS = """
select *, x0 + case when fid%20>=18 then 10 when fid%7=0 then 12 when fid%11=0 then 8 else 10 end x1, y0+10 y1
from (select p_partkey fid, p_brand zone, p_size,
  case when p_size=13 then 'bowtie' when p_size=50 and p_partkey%3=0 then 'null'
       when p_size=49 and p_partkey%3=0 then 'empty' else 'rect' end kind,
  cast((case when p_partkey%20=19 then p_partkey-1 else p_partkey end)%50*10 as double) x0,
  cast(floor((case when p_partkey%20=19 then p_partkey-1 else p_partkey end)/50)*10 as double) y0
from part)
"""
ROADS = """
select o_orderkey fid, o_orderkey a,
  case when o_orderkey%10=9 then o_orderkey when o_custkey%13=0 then o_orderkey+1000000 else o_orderkey+1 end b
from orders
"""
SITES = """
select c_custkey fid, c_mktsegment segment,
  floor(c_custkey/2)%40*1e1 + case when c_custkey%2=0 then 0e0 when c_nationkey%2=0 then 5e-1
                                   when c_nationkey%5=0 then 0e0 else 5e0 end x,
  floor(c_custkey/80)*1e1 y from customer
"""
ORDERS = """
select o_orderkey fid, o_custkey cust, o_orderstatus status, o_totalprice price,
  nullif(substr(o_orderpriority,3),'LOW') priority,
  case when o_orderkey%50=49 then concat('O-',cast(o_orderkey-1 as varchar(20)))
       when o_orderkey%60=7 then cast(null as varchar(20))
       else concat('O-',cast(o_orderkey as varchar(20))) end code
from orders
"""
METRES = "EPSG:3857"


def table(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spread(spark.sql(sql.replace(f"from {name}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet")).withColumnRenamed("fid", FID))


def parcels(spark: SparkSession, sf_dir: str, rect_only: bool = False) -> LayerFrame:
    df = table(spark, sf_dir, PARCELS, "part")
    if rect_only:
        df = df.where("kind = 'rect'")
    ring = lambda *c: F.array(*[F.col(x) for x in c])
    rect = ring("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0")
    bow = ring("x0", "y0", "x1", "y1", "x1", "y0", "x0", "y1", "x0", "y0")
    shape = F.when(F.col("kind") == "rect", rect).when(F.col("kind") == "bowtie", bow).when(F.col("kind") == "empty", F.array().cast("array<double>"))
    return LayerFrame("parcels", sf_dir, df.select(FID, "zone", "p_size", ring_polygon(shape).alias("geometry")), crs=METRES)


def roads(spark: SparkSession, sf_dir: str) -> LayerFrame:
    df = table(spark, sf_dir, ROADS, "orders")
    node = lambda c: [(F.col(c) % 1000).cast("double"), F.floor(F.col(c) / 1000).cast("double")]
    return LayerFrame("roads", sf_dir, df.select(FID, line_string(F.array(*node("a"), *node("b"))).alias("geometry")), crs=METRES)


def sites(spark: SparkSession, sf_dir: str) -> LayerFrame:
    df = table(spark, sf_dir, SITES, "customer")
    return LayerFrame("sites", sf_dir, df.select(FID, "segment", point("x", "y").alias("geometry")), crs=METRES)


def orders_attr(spark: SparkSession, sf_dir: str) -> LayerFrame:
    return LayerFrame("orders_attr", sf_dir, table(spark, sf_dir, ORDERS, "orders"), geom_col=None)


def rows(spark: SparkSession, results: list[CheckResult]) -> DataFrame:
    """check, status, n_total, n_failed of results."""
    return spark.createDataFrame([(r.check, r.status.value, r.n_total, r.n_failed) for r in results], "check_name string, status string, n_total long, n_failed long")


def _attr(rule: AttributesRule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rows(spark, attributes.run(orders_attr(spark, d), "orders_attr", d, rule))


def _domain(column: str, **domain) -> Callable[[SparkSession, str], DataFrame]:
    return _attr(AttributesRule(domains={column: Domain(**domain)}))


def _geom(**rule) -> Callable[[SparkSession, str], DataFrame]:
    base = {"valid": False, "no_empty": False, "no_missing": False}
    return lambda spark, d: rows(spark, geometry.run(parcels(spark, d), "parcels", d, GeometryRule(**base | rule)))


def layer_crs(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, crs.run(parcels(spark, d), "parcels", d, CrsRule(expected_epsg=4326)) + crs.run(LayerFrame("x", d, parcels(spark, d).df), "x", d, CrsRule()))


def geom_fix(spark: SparkSession, d: str) -> DataFrame:
    """Areas of the repaired layer, by id."""
    layer = parcels(spark, d)
    result = geometry.run(layer, "parcels", d, GeometryRule(fix=True))[-1]
    return layer.df.where("geometry is not null").select(F.col(FID).alias("fid"), F.round(geo_area("geometry"), 6).alias("area"), F.lit(result.fixed).cast("long").alias("n_fixed"))


def geom_valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return geometry.run(parcels(spark, d), "parcels", d, GeometryRule())[-1].failing.select(F.col(FID).alias("fid"))


def geom_type_mode(spark: SparkSession, d: str) -> DataFrame:
    n, kind = overview(parcels(spark, d))
    return spark.createDataFrame([(n, kind)], "n_features long, geometry_type string")


def dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, duplicates.run(parcels(spark, d, True), "parcels", d, DuplicatesRule()))


def dup_exact_members(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.run(sites(spark, d), "sites", d, DuplicatesRule())[0].failing.select(F.col(FID).alias("fid"))


def dup_fuzzy_iou(spark: SparkSession, d: str) -> DataFrame:
    found = duplicates.near_pairs(parcels(spark, d, True), FuzzyRule(enabled=True, min_overlap=0.1))
    return found.select("l", "r", F.round("iou", 6).alias("iou"))


def dup_fuzzy_dwithin(spark: SparkSession, d: str) -> DataFrame:
    found = duplicates.near_pairs(sites(spark, d), FuzzyRule(enabled=True, predicate="dwithin", max_distance=1.0))
    return found.select("l", "r", F.round("distance", 6).alias("distance"))


def topo_overlaps(spark: SparkSession, d: str) -> DataFrame:
    work = parcels(spark, d, True).df.select(FID, F.col("geometry").alias("g"))
    return topology.overlap_pairs(work).select("l", "r", F.round("area", 6).alias("area"))


def topo_overlaps_check(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, topology.run(parcels(spark, d, True), "parcels", d, TopologyRule(enabled=True, no_overlaps=True)))


def topo_gaps(spark: SparkSession, d: str) -> DataFrame:
    work = parcels(spark, d, True).df.select(FID, F.col("geometry").alias("g"))
    return topology.gap_areas(work).groupBy(F.round("area", 6).alias("area")).agg(F.count("*").alias("n"))


def _dangles(tolerance: float) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: topology.dangling_ends(roads(spark, d).df.select(FID, F.col("geometry").alias("g")), tolerance).select("fid", "x", "y")


def to_metric_utm(spark: SparkSession, d: str) -> DataFrame:
    """Sites as degrees, turned to metres: ids and rounded coordinates."""
    df = table(spark, d, SITES, "customer").select(FID, point(F.lit(8.0) + F.col("x") / 1000, F.lit(47.0) + F.col("y") / 1000).alias("geometry"))
    moved, note = to_metric(LayerFrame("sites", d, df, crs="EPSG:4326"))
    from terrasift.functions.geo import geo_box

    b = geo_box(F.col("geometry"))
    return moved.df.select(F.col(FID).alias("fid"), F.round(b["xmin"], 3).alias("x"), F.round(b["ymin"], 3).alias("y"), F.lit(note).alias("note"))


def issues_top200(spark: SparkSession, d: str) -> DataFrame:
    result = attributes.run(orders_attr(spark, d), "orders_attr", d, AttributesRule(not_null=["priority"]))[0]
    return spark.createDataFrame([(i.feature_id, i.message) for i in result.issues], "fid long, message string")


def failures_collect(spark: SparkSession, d: str) -> DataFrame:
    layer = parcels(spark, d)
    results = geometry.run(layer, "parcels", d, GeometryRule()) + attributes.run(layer, "parcels", d, AttributesRule(domains={"p_size": Domain(max=45)}))
    return failing_rows(layer, results).select(F.col(FID).alias("fid"), "checks")


SUITE = Suite(
    name="derived layers",
    defaults={"geometry": {"valid": True}, "topology": {"enabled": True}},
    layers={
        "parcels": {"attributes": {"required": ["zone"], "domains": {"p_size": {"max": 45}}}},
        "roads": {"geometry": {"enabled": False}, "topology": {"no_dangles": True}},
        "sites": {"duplicates": {"severity": "error"}},
        "orders_attr": {"crs": {"required": False}, "attributes": {"not_null": ["priority"], "max_null_fraction": {"priority": 0.1, "code": 0.5}, "unique": ["code"], "domains": {"price": {"min": 2000, "max": 300000}, "code": {"regex": "O-[0-9]{1,3}"}}}},
    },
)


def suite_results(spark: SparkSession, d: str) -> list[tuple[str, CheckResult]]:
    out = []
    for make in (parcels, roads, sites, orders_attr):
        layer = make(spark, d)
        out += [(layer.name, r) for r in checked(layer, SUITE.rules_for(layer.name))]
    return out


def suite_report(spark: SparkSession, d: str) -> DataFrame:
    found = [(layer, r.check, r.status.value, r.n_total, r.n_failed) for layer, r in suite_results(spark, d)]
    return spark.createDataFrame(found, "layer string, check_name string, status string, n_total long, n_failed long")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return suite_report(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "suite_report": suite_report, "status_counts": status_counts,
        "attr_required": _attr(AttributesRule(required=["cust", "nope", "status"])), "attr_missing_col": _attr(AttributesRule(not_null=["nope"])),
        "attr_not_null": _attr(AttributesRule(not_null=["priority", "code", "price"])), "attr_completeness": _attr(AttributesRule(max_null_fraction={"priority": 0.1, "code": 0.5})),
        "attr_unique": _attr(AttributesRule(unique=["code", "cust"])),
        "attr_domain_allowed": _domain("priority", allowed=["URGENT", "HIGH"]), "attr_domain_min": _domain("price", min=2000), "attr_domain_max": _domain("price", max=300000),
        "attr_domain_regex": _domain("code", regex="O-[0-9]{1,3}"), "attr_domain_combined": _domain("code", allowed=["O-1", "O-2", "O-1000"], regex="O-[0-9]{1,3}"),
        "geom_no_missing": _geom(no_missing=True), "geom_no_empty": _geom(no_empty=True), "geom_valid": _geom(valid=True), "geom_valid_rows": geom_valid_rows, "geom_fix": geom_fix, "geom_type_mode": geom_type_mode,
        "dup_exact": dup_exact, "dup_exact_members": dup_exact_members, "dup_fuzzy_iou": dup_fuzzy_iou, "dup_fuzzy_dwithin": dup_fuzzy_dwithin,
        "topo_overlaps": topo_overlaps, "topo_overlaps_check": topo_overlaps_check, "topo_gaps": topo_gaps, "topo_dangles": _dangles(0.0), "topo_dangles_snap": _dangles(2.0),
        "layer_crs": layer_crs, "to_metric_utm": to_metric_utm, "issues_top200": issues_top200, "failures_collect": failures_collect,
    }


# SQL


def _counted(check: str, bad: str, fail: str = "fail") -> str:
    return f"select '{check}' check_name, case when count(*) filter ({bad}) > 0 then '{fail}' else 'pass' end status, count(*) n_total, count(*) filter ({bad}) n_failed from o"


def _unique_sql(column: str) -> str:
    return f"select 'attributes.unique[{column}]' check_name, case when count({column}) > count(distinct {column}) then 'fail' else 'pass' end status, count(*) n_total, count({column}) - count(distinct {column}) n_failed from o"


def oracle_sql() -> dict[str, str]:
    o, p = f"with o as ({ORDERS}) ", f"with o as ({PARCELS}) "
    rect = f"with p as (select * from ({PARCELS}) where kind = 'rect') "
    overlap = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
    meet = "a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"
    ends = f"with r as ({ROADS}), e as (select fid, a n from r union all select fid, b n from r), q as (select fid, (n % 1000)::double x, floor(n / 1000)::double y from e)"
    null = "priority is null"
    suite = f"""
with p as ({PARCELS}), s as ({SITES}), o as ({ORDERS}), r as ({ROADS}),
pd as (select count(*) n from p where kind = 'rect' group by x0, y0, x1, y1 union all select count(*) from p where kind = 'bowtie' group by x0, y0, x1, y1),
sd as (select count(*) n from s group by x, y), rd as (select count(*) n from r group by least(a, b), greatest(a, b)),
e as (select a n from r union all select b from r),
x(layer, check_name, bad, fail, n_total, n_failed) as (
  select 'parcels', 'crs', 0, 'fail', 0, 0 union all select 'roads', 'crs', 0, 'fail', 0, 0 union all select 'sites', 'crs', 0, 'fail', 0, 0 union all select 'orders_attr', 'crs', 0, 'fail', 0, 0
  union all select 'parcels', 'geometry.no_missing', count(*) filter (kind = 'null'), 'fail', count(*), count(*) filter (kind = 'null') from p
  union all select 'parcels', 'geometry.no_empty', count(*) filter (kind = 'empty'), 'fail', count(*), count(*) filter (kind = 'empty') from p
  union all select 'parcels', 'geometry.valid', count(*) filter (kind = 'bowtie'), 'fail', count(*), count(*) filter (kind = 'bowtie') from p
  union all select 'parcels', 'duplicates.exact', (select sum(n - 1) from pd), 'warn', count(*), (select sum(n - 1) from pd) from p
  union all select 'parcels', 'attributes.required', 0, 'fail', count(*), 0 from p
  union all select 'parcels', 'attributes.domain[p_size]', count(*) filter (p_size > 45), 'fail', count(*), count(*) filter (p_size > 45) from p
  union all select 'roads', 'duplicates.exact', (select sum(n - 1) from rd), 'warn', count(*), (select sum(n - 1) from rd) from r
  union all select 'roads', 'topology.no_dangles', (select count(*) from (select n from e group by n having count(*) = 1)), 'warn', count(*), (select count(*) from (select n from e group by n having count(*) = 1)) from r
  union all select 'sites', 'geometry.no_missing', 0, 'fail', count(*), 0 from s union all select 'sites', 'geometry.no_empty', 0, 'fail', count(*), 0 from s union all select 'sites', 'geometry.valid', 0, 'fail', count(*), 0 from s
  union all select 'sites', 'duplicates.exact', (select sum(n - 1) from sd), 'fail', count(*), (select sum(n - 1) from sd) from s
  union all select 'orders_attr', 'geometry', -1, 'skip', 0, 0
  union all select 'orders_attr', 'attributes.not_null[priority]', count(*) filter ({null}), 'fail', count(*), count(*) filter ({null}) from o
  union all select 'orders_attr', 'attributes.completeness[priority]', (avg(case when {null} then 1 else 0 end) > 0.1)::int, 'fail', count(*), case when avg(case when {null} then 1 else 0 end) > 0.1 then count(*) filter ({null}) else 0 end from o
  union all select 'orders_attr', 'attributes.completeness[code]', (avg(case when code is null then 1 else 0 end) > 0.5)::int, 'fail', count(*), case when avg(case when code is null then 1 else 0 end) > 0.5 then count(*) filter (code is null) else 0 end from o
  union all select 'orders_attr', 'attributes.unique[code]', count(code) - count(distinct code), 'fail', count(*), count(code) - count(distinct code) from o
  union all select 'orders_attr', 'attributes.domain[price]', count(*) filter (price < 2000 or price > 300000), 'fail', count(*), count(*) filter (price < 2000 or price > 300000) from o
  union all select 'orders_attr', 'attributes.domain[code]', count(*) filter (not regexp_full_match(code, 'O-[0-9]{{1,3}}')), 'fail', count(*), count(*) filter (not regexp_full_match(code, 'O-[0-9]{{1,3}}')) from o
)
select layer, check_name, case when bad > 0 then fail when bad < 0 then 'skip' else 'pass' end status, n_total::bigint n_total, n_failed::bigint n_failed from x
"""
    return {
        "suite_report": suite, "status_counts": f"select status, count(*) n from ({suite}) group by 1",
        "attr_required": f"{o} select 'attributes.required' check_name, 'fail' status, count(*) n_total, 1::bigint n_failed from o",
        "attr_missing_col": "select 'attributes.missing[nope]' check_name, 'fail' status, 0::bigint n_total, 1::bigint n_failed",
        "attr_not_null": o + " union all ".join(_counted(f"attributes.not_null[{c}]", f"{c} is null") for c in ("priority", "code", "price")),
        "attr_completeness": o + " union all ".join(f"select 'attributes.completeness[{c}]' check_name, case when s > {lim} then 'fail' else 'pass' end status, n n_total, case when s > {lim} then k else 0 end n_failed from (select count(*) n, count(*) filter ({c} is null) k, count(*) filter ({c} is null) / count(*) s from o)" for c, lim in (("priority", 0.1), ("code", 0.5))),
        "attr_unique": f"{o} {_unique_sql('code')} union all {_unique_sql('cust')}",
        "attr_domain_allowed": o + _counted("attributes.domain[priority]", "priority not in ('URGENT', 'HIGH')"),
        "attr_domain_min": o + _counted("attributes.domain[price]", "price < 2000"), "attr_domain_max": o + _counted("attributes.domain[price]", "price > 300000"),
        "attr_domain_regex": o + _counted("attributes.domain[code]", "not regexp_full_match(code, 'O-[0-9]{1,3}')"),
        "attr_domain_combined": o + _counted("attributes.domain[code]", "code not in ('O-1', 'O-2', 'O-1000') or not regexp_full_match(code, 'O-[0-9]{1,3}')"),
        "geom_no_missing": p + _counted("geometry.no_missing", "kind = 'null'"), "geom_no_empty": p + _counted("geometry.no_empty", "kind = 'empty'"), "geom_valid": p + _counted("geometry.valid", "kind = 'bowtie'"),
        "geom_valid_rows": f"select fid from ({PARCELS}) where kind = 'bowtie'",
        "geom_fix": f"select fid, round(case kind when 'empty' then 0 when 'bowtie' then 0.5 else 1 end * (x1 - x0) * (y1 - y0), 6) area, (select count(*) from ({PARCELS}) where kind = 'bowtie') n_fixed from ({PARCELS}) where kind <> 'null'",
        "geom_type_mode": f"select count(*) n_features, 'Polygon' geometry_type from ({PARCELS})",
        "dup_exact": f"{rect} select 'duplicates.exact' check_name, 'warn' status, sum(n)::bigint n_total, sum(n - 1)::bigint n_failed from (select count(*) n from p group by x0, y0, x1, y1)",
        "dup_exact_members": f"with s as ({SITES}) select fid from (select fid, count(*) over (partition by x, y) n from s) where n > 1",
        "dup_fuzzy_iou": f"{rect} select l, r, round(i / (s - i), 6) iou from (select a.fid l, b.fid r, {overlap} i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) s from p a join p b on a.fid < b.fid and {meet}) where i / (s - i) >= 0.1",
        "dup_fuzzy_dwithin": f"with s as ({SITES}) select a.fid l, b.fid r, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) distance from s a join s b on a.fid < b.fid and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1",
        "topo_overlaps": f"{rect} select a.fid l, b.fid r, round({overlap}, 6) area from p a join p b on a.fid < b.fid and {meet}",
        "topo_overlaps_check": f"{rect} select 'topology.no_overlaps' check_name, 'warn' status, count(*) n_total, (select count(distinct f) from (select unnest([a.fid, b.fid]) f from p a join p b on a.fid < b.fid and {meet})) n_failed from p",
        "topo_dangles": f"{ends} select min(fid) fid, x, y from q group by x, y having count(*) = 1",
        "topo_dangles_snap": f"{ends} select min(fid) fid, min(x) x, min(y) y from q group by round_even(x / 2, 0), round_even(y / 2, 0) having count(*) = 1",
        "layer_crs": f"select 'crs' check_name, 'fail' status, 0::bigint n_total, 0::bigint n_failed union all select 'crs', 'fail', count(*), count(*) from ({PARCELS})",
        "issues_top200": f"{o} select fid, 'null in ''priority''' message from o where priority is null order by fid limit 200",
        "failures_collect": f"""with f as (select fid, 'geometry.no_missing' c from ({PARCELS}) where kind = 'null' union all select fid, 'geometry.no_empty' from ({PARCELS}) where kind = 'empty'
  union all select fid, 'geometry.valid' from ({PARCELS}) where kind = 'bowtie' union all select fid, 'attributes.domain[p_size]' from ({PARCELS}) where p_size > 45) select fid, string_agg(c, ', ' order by c) checks from f group by fid""",
    }
