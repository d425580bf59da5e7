"""All queries of the library but those of the training-data subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.functions import text
from feldspar.operators import build, cache, documents, gates, graph, process, resolution, segments, tabular
from feldspar.session import shared_dir
from feldspar.sources.adapters import business_graph, document_graph, process_graph, table
from feldspar.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# the business graph ---------------------------------------------------------------------------------------------------

_ENTITIES = """SELECT 'region:'||r_regionkey AS entity_id, 'region' AS type_id, r_name AS label FROM region
 UNION ALL SELECT 'nation:'||n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'customer:'||c_custkey, 'customer', c_name FROM customer
 UNION ALL SELECT 'supplier:'||s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part:'||p_partkey, 'part', p_name FROM part
 UNION ALL SELECT 'orders:'||o_orderkey, 'orders', o_orderkey::VARCHAR FROM orders"""
_LINKS = """SELECT 'located_in' AS t, 'nation:'||n_nationkey AS a, 'region:'||n_regionkey AS b FROM nation UNION ALL SELECT 'located_in', 'customer:'||c_custkey, 'nation:'||c_nationkey FROM customer
 UNION ALL SELECT 'located_in', 'supplier:'||s_suppkey, 'nation:'||s_nationkey FROM supplier UNION ALL SELECT 'placed_by', 'orders:'||o_orderkey, 'customer:'||o_custkey FROM orders"""
_BOTH = f"WITH e AS ({_ENTITIES}), l AS ({_LINKS}), i AS (SELECT t||'|'||a||'|'||b AS link_id, a AS x, b AS y FROM l UNION ALL SELECT t||'|'||a||'|'||b, b, a FROM l)"


@query(f"WITH e AS ({_ENTITIES}) SELECT type_id, upper(type_id[1])||type_id[2:] AS name, 'active' AS status, CASE type_id WHEN 'customer' THEN 3 WHEN 'orders' THEN 2 WHEN 'nation' THEN 1 WHEN 'region' THEN 0 ELSE 1 END::BIGINT AS property_count, count(*) AS entity_count FROM e GROUP BY 1")
def types(spark, sf):
    return graph.types(business_graph(spark, sf))


@query(f"WITH e AS ({_ENTITIES}) SELECT entity_id, label, 1::BIGINT AS alias_count FROM e WHERE type_id = 'supplier'")
def entities_by_type(spark, sf):
    return graph.entities(business_graph(spark, sf), type="Supplier").select("entity_id", "label", "alias_count")


@query(f"WITH e AS ({_ENTITIES}) SELECT entity_id, type_id FROM e")
def entities_by_interface(spark, sf):
    return graph.entities(business_graph(spark, sf), interface="Thing").select("entity_id", "type_id")


@query(f"WITH e AS ({_ENTITIES}) SELECT entity_id, label FROM e WHERE contains(lower(label), 'an')")
def search_label(spark, sf):
    return graph.search(business_graph(spark, sf), "AN").select("entity_id", "label")


@query("SELECT 'Thing' AS interface_id, 1::BIGINT AS property_count, 'customer,nation,orders,part,region,supplier' AS implemented_by UNION ALL SELECT 'Valued', 0, 'customer,orders,part,supplier' UNION ALL SELECT 'Traded', 0, ''")
def interface_closure(spark, sf):
    return graph.interfaces(business_graph(spark, sf)).select("interface_id", "property_count", F.array_join("implemented_by", ",").alias("implemented_by"))


@query("SELECT 'customer:'||c_custkey AS entity_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def derived_count(spark, sf):
    return graph.derived(business_graph(spark, sf)).where("prop = 'order_count'").select("entity_id", F.col("value").cast("bigint").alias("n"))


@query("SELECT 'customer:'||c_custkey AS entity_id, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def derived_sum(spark, sf):
    return graph.derived(business_graph(spark, sf)).where("prop = 'order_total'").select("entity_id", F.round(F.col("value").cast("double"), 2).alias("total"))


@query("SELECT 'nation:'||n_nationkey AS entity_id, count(c_custkey) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def derived_collect(spark, sf):
    v = F.from_json("value", "array<double>")
    return graph.derived(business_graph(spark, sf)).where("prop = 'balances'").select("entity_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(f"{_BOTH} SELECT x AS entity_id, link_id, y AS neighbor, label AS neighbor_label FROM i LEFT JOIN e ON e.entity_id = y")
def links_of(spark, sf):
    return graph.links(business_graph(spark, sf)).select("entity_id", "link_id", "neighbor", "neighbor_label")


@query(f"{_BOTH}, d1 AS (SELECT DISTINCT y FROM i WHERE x = 'region:1'), d2 AS (SELECT DISTINCT y FROM i WHERE x IN (FROM d1) AND y NOT IN (FROM d1) AND y <> 'region:1') SELECT 'region:1' AS entity_id, 0 AS depth UNION ALL SELECT y, 1 FROM d1 UNION ALL SELECT y, 2 FROM d2")
def traverse_depth2(spark, sf):
    return graph.traverse(business_graph(spark, sf), "region:1", 2)[0].select("entity_id", "depth")


@query(f"{_BOTH}, d1 AS (SELECT DISTINCT y FROM i WHERE x = 'region:1') SELECT 0 AS depth, x AS entity_id, link_id FROM i WHERE x = 'region:1' UNION ALL SELECT 1, x, link_id FROM i WHERE x IN (FROM d1)")
def traverse_path(spark, sf):
    return graph.traverse(business_graph(spark, sf), "region:1", 2)[1]


@query("SELECT 'ref' AS code, 'links.located_in|customer:'||c_custkey||'|nation:'||c_nationkey AS location FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'ref', 'links.located_in|supplier:'||s_suppkey||'|nation:'||s_nationkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'ref', 'links.located_in|nation:3|region:'||n_regionkey FROM nation WHERE n_nationkey = 3")
def gate_references(spark, sf):
    g = business_graph(spark, sf)
    kinds = g.link_types.withColumn("from_type_id", F.lit("*")).withColumn("to_type_id", F.lit("*"))
    broken = g.with_(entities=g.entities.where("entity_id <> 'nation:3'").withColumn("aliases", F.lit(None).cast(g.entities.schema["aliases"].dataType)), link_types=kinds)
    return gates.references(broken).where("location NOT LIKE 'entit%'").select("code", "location")


@query(f"WITH e AS ({_ENTITIES}) SELECT 'grounding' AS code, 'entities.'||entity_id AS location FROM e")
def gate_grounding(spark, sf):
    return gates.grounding(business_graph(spark, sf)).where("location LIKE 'entities.%' AND message = 'cites no fact'").select("code", "location")


# the document graph ---------------------------------------------------------------------------------------------------


@query("SELECT 'orphan_entity' AS kind, 'd:'||d.doc_id AS entity_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def gaps_orphans(spark, sf):
    return graph.gaps(document_graph(spark, sf)).select("kind", "entity_id")


@query("SELECT count(*) AS entities, count(*) AS facts, (SELECT count(DISTINCT source) FROM documents WHERE source <> 'src3') AS sources FROM documents")
def show(spark, sf):
    g = document_graph(spark, sf)
    return graph.show(g.with_(version=spark.createDataFrame([("ontology.v1", "o", "p", "v")], "schema string, ontology_id string, profile string, version_id string"))).select("entities", "facts", "sources")


@query("SELECT 'd:'||doc_id AS entity_id, 'f:'||doc_id AS fact_id, source AS source_id, source <> 'src3' AS resolved, CASE WHEN source <> 'src3' THEN 'file' END AS source_kind FROM documents")
def receipts(spark, sf):
    g = document_graph(spark, sf)
    return graph.receipts(g, g.entities.select("entity_id", "fact_ids"), ["entity_id"]).select("entity_id", "fact_id", "source_id", "resolved", "source_kind")


_MEMBERS = "SELECT doc_id AS e, doc_id AS f, -1 AS ord FROM documents UNION ALL SELECT d.doc_id, m.doc_id, (m.doc_id - d.doc_id - 1)::INT FROM documents d JOIN documents m ON m.doc_id IN (d.doc_id + 1, d.doc_id + 2) WHERE d.doc_id % 10 = 0"


@query(f"WITH m AS ({_MEMBERS}) SELECT 'd:'||e AS entity_id, 'f:'||f AS fact_id FROM m")
def facts_of(spark, sf):
    return graph.facts(document_graph(spark, sf)).select("entity_id", "fact_id")


@query(f"WITH m AS ({_MEMBERS}) SELECT 'd:'||e AS entity_id, 'd:'||f AS from_entity, CASE WHEN toxic = 1 THEN '[withheld]' ELSE n_chars::VARCHAR END AS value, coalesce(toxic = 1, false) AS withheld FROM m JOIN documents d ON d.doc_id = f LEFT JOIN labels l ON l.doc_id = f")
def security_masked(spark, sf):
    return graph.properties(document_graph(spark, sf)).select("entity_id", "from_entity", "value", "withheld")


@query(f"WITH m AS ({_MEMBERS}) SELECT 'd:'||e AS entity_id, CASE WHEN bool_or(coalesce(toxic = 1, false)) THEN '[withheld]' ELSE max(n_chars)::VARCHAR END AS head, bool_or(coalesce(toxic = 1, false)) AS withheld FROM m JOIN documents d ON d.doc_id = f LEFT JOIN labels l ON l.doc_id = f GROUP BY 1")
def reducer_heads(spark, sf):
    return graph.heads(document_graph(spark, sf)).select("entity_id", "head", "withheld")


@query("SELECT 'd:'||doc_id AS entity_id, CASE WHEN doc_id % 10 = 0 THEN 'canonical' WHEN doc_id % 10 IN (1, 2) THEN 'member' ELSE 'independent' END AS role, CASE WHEN doc_id % 10 <= 2 THEN 'd:'||(doc_id - doc_id % 10) END AS canonical, CASE WHEN doc_id % 10 <= 2 THEN 'agentverified' END AS method FROM documents")
def resolve_role(spark, sf):
    return graph.resolve(document_graph(spark, sf)).select("entity_id", "role", "canonical", "method")


@query("SELECT 'security' AS code, 'entities.d:'||doc_id AS location FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")
def gate_security(spark, sf):
    return gates.security(document_graph(spark, sf)).select("code", "location")


@query("SELECT 'envelope' AS code, 'sources.'||source AS location FROM documents WHERE source <> 'src3' GROUP BY 2")
def gate_envelope(spark, sf):
    return gates.envelope(document_graph(spark, sf)).select("code", "location")


@query("SELECT doc_id, CASE WHEN b.h IS NULL THEN 'deleted' WHEN a.h IS NULL THEN 'new' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN lower(text) ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 1) b USING (doc_id)")
def source_classify(spark, sf):
    d = table(spark, sf, "documents").withColumn("source_id", F.col("doc_id").cast("string"))
    prior = d.where("doc_id % 5 <> 0").withColumn("hash", F.sha2("text", 256))
    now = d.where("doc_id % 5 <> 1").withColumn("hash", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.lower("text")).otherwise(F.col("text")), 256))
    return build.classify(prior, now).select(F.col("source_id").cast("long").alias("doc_id"), "change")


# processes ------------------------------------------------------------------------------------------------------------

#: The SQL of this part cuts the events by these fixed dates; the queries give its results.
_BASELINE_END, _CURRENT_START = "2024-01-01 02:00:00", "2024-01-30 22:00:00"


def _process_graph(spark, sf):
    return process_graph(spark, sf, baseline_end=_BASELINE_END, since=_CURRENT_START)


_EVENTS = "SELECT event_id, 'lu_'||(user_id % 10) AS lu, event_type AS step, ts, value FROM events"
_STEPS = f"""WITH e AS ({_EVENTS}), n AS (SELECT lu, step, count(*) AS n FROM e GROUP BY 1, 2), c AS (SELECT DISTINCT lu, step FROM e WHERE ts >= TIMESTAMP '2024-01-30 22:00:00'),
 s AS (SELECT n.lu, n.step, n % 2 = 0 AS de_jure, n % 2 = 1 AS espoused, n % 7 = 0 AS conflict, c.lu IS NOT NULL AS de_facto FROM n LEFT JOIN c ON c.lu = n.lu AND c.step = n.step),
 t AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN de_jure AND de_facto THEN 'confirmed' WHEN de_jure THEN 'de_jure_only' WHEN de_facto THEN 'de_facto_only' WHEN espoused THEN 'espoused_only' ELSE 'unsupported' END AS status FROM s)"""


@query(f"WITH e AS ({_EVENTS}) SELECT lu AS logic_unit_id, count(DISTINCT step) AS step_count, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 22:00:00') AS event_count FROM e GROUP BY 1")
def logic_units(spark, sf):
    return process.logic_units(_process_graph(spark, sf)).select("logic_unit_id", "step_count", "event_count")


@query(f"{_STEPS} SELECT lu AS logic_unit_id, step AS step_id, de_jure, de_facto, espoused, conflict, status FROM t")
def conformance(spark, sf):
    return process.steps(_process_graph(spark, sf)).select("logic_unit_id", "step_id", "de_jure", "de_facto", "espoused", "conflict", "status")


@query(_STEPS + " SELECT lu AS logic_unit_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in process.STATUSES) + " FROM t GROUP BY 1")
def conformance_summary(spark, sf):
    return process.conformance_summary(_process_graph(spark, sf))


@query(f"""WITH e AS ({_EVENTS}), b AS (SELECT lu, list(DISTINCT step) AS x FROM e WHERE ts < TIMESTAMP '2024-01-01 02:00:00' GROUP BY 1), c AS (SELECT lu, list(DISTINCT step) AS y FROM e WHERE ts >= TIMESTAMP '2024-01-30 22:00:00' GROUP BY 1),
 j AS (SELECT b.lu, x, coalesce(y, []) AS y FROM b LEFT JOIN c USING (lu) WHERE b.lu < 'lu_7'), d AS (SELECT lu, 1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS drift FROM j)
 SELECT lu AS logic_unit_id, round(drift, 6) AS drift, CASE WHEN drift >= 0.35 THEN 'demote' WHEN drift >= 0.15 THEN 'alert' ELSE 'none' END AS action FROM d""")
def drift(spark, sf):
    d = process.drift(_process_graph(spark, sf))
    return d.select("logic_unit_id", F.round("drift", 6).alias("drift"), process.drift_action(F.col("drift")).alias("action"))


@query("""SELECT 'entities' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'links', 0 UNION ALL SELECT 'facts', count(*) FROM documents
 UNION ALL SELECT 'entity_types', count(*) FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT 'link_types', 0
 UNION ALL SELECT 'resolutions', count(*) FILTER (doc_id % 10 = 0) FROM documents""")
def manifest_counts(spark, sf):
    return graph.counts(document_graph(spark, sf))


@query(f"""WITH e AS ({_ENTITIES}), n AS (SELECT 'customer:'||c_custkey AS entity_id, coalesce(k, 0)::VARCHAR AS v FROM customer
  LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS k FROM orders GROUP BY 1) USING (c_custkey))
 SELECT entity_id, upper(type_id[1])||type_id[2:] AS type_name, label, 1 AS n_aliases, CASE WHEN type_id IN ('region', 'nation') THEN 0 ELSE 1 END AS n_properties,
  CASE type_id WHEN 'customer' THEN 2 WHEN 'nation' THEN 1 ELSE 0 END AS n_derived, 0 AS n_heads, v AS order_count
 FROM e LEFT JOIN n USING (entity_id)""")
def entity_views(spark, sf):
    v = graph.views(business_graph(spark, sf))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("aliases", "properties", "derived", "heads")]
    return v.select("entity_id", "type_name", "label", *sizes, F.element_at("derived", F.lit("order_count")).alias("order_count"))


@query("""SELECT DISTINCT c_mktsegment AS name, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'BUILDING' ELSE c_mktsegment END AS canonical FROM customer""")
def canonical_names(spark, sf):
    names = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    proposals = [("AUTOMOBILE", "MACHINERY"), ("MACHINERY", "BUILDING"), ("BUILDING", "NO SUCH SEGMENT"), ("NOT THERE", "HOUSEHOLD")]
    return resolution.canonical_names(names, proposals)


@query(f"SELECT logic_unit_id, drift, action FROM ({ORACLES['drift']}) WHERE action <> 'none'")
def conformance_loop(spark, sf):
    _, acted = process.run_conformance(_process_graph(spark, sf))
    return acted.select("logic_unit_id", F.round("drift", 6).alias("drift"), "action")


@query(f"{_STEPS} SELECT lu AS logic_unit_id, round(avg(de_facto::INT), 6) AS ratio FROM t GROUP BY 1")
def eligibility(spark, sf):
    return process.eligible(_process_graph(spark, sf)).select("logic_unit_id", F.round("ratio", 6).alias("ratio"))


@query(f"WITH e AS ({_EVENTS}), u AS (SELECT DISTINCT lu FROM e WHERE ts < TIMESTAMP '2024-01-01 02:00:00' AND lu < 'lu_7'), f AS (SELECT lu, greatest(0, CASE WHEN lu < 'lu_5' THEN CASE WHEN lu < 'lu_2' THEN 2 ELSE 3 END ELSE 1 END - CASE WHEN lu < 'lu_3' THEN 1 ELSE 0 END) AS low FROM u) SELECT 'logic_units.'||lu AS location FROM f WHERE 2 > low")
def gate_autonomy(spark, sf):
    return gates.autonomy(_process_graph(spark, sf)).select("location")


@query(f"{_STEPS} SELECT 'logic_units.'||lu||'.'||step AS location FROM t WHERE lu < 'lu_7' AND conflict UNION ALL SELECT 'logic_units.'||lu||'.'||step FROM t WHERE lu < 'lu_7' AND NOT de_facto")
def gate_eligibility(spark, sf):
    return gates.eligibility(_process_graph(spark, sf)).select("location")


# tables and JSON ------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_shipmode_like AS l_linestatus, round(q, 2) AS l_quantity FROM (SELECT l_returnflag, l_linestatus AS l_shipmode_like, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2 ORDER BY q DESC, 1, 2 LIMIT 3)")
def agg_topn(spark, sf):
    return tabular.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"], "sum", 3).withColumn("l_quantity", F.round("l_quantity", 2))


_PROFILE = "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 4)::DOUBLE AS min, round(quantile_cont({c}, 0.5), 4) AS q50, round(max({c}), 4)::DOUBLE AS max FROM lineitem"


@query(" UNION ALL ".join(_PROFILE.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def profile_numeric(spark, sf):
    p = tabular.profile_numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return p.select("column", "n_null", "n_unique", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "min", "q50", "max")


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def profile_categorical(spark, sf):
    return tabular.profile_categorical(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]).select("column", "value", "n")


@query("SELECT 1.0::DOUBLE AS completeness")
def completeness(spark, sf):
    return tabular.completeness(table(spark, sf, "orders"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN {n} AND count(DISTINCT {c}) < count(*) AND count(DISTINCT {c}) > least(20, count(*) / 2) THEN 'measure' ELSE 'dimension' END AS role FROM customer" for c, n in (("c_custkey", "true"), ("c_name", "false"), ("c_nationkey", "true"), ("c_acctbal", "true"), ("c_mktsegment", "false"))))
def infer_roles(spark, sf):
    return tabular.roles(table(spark, sf, "customer")).select("column", "role")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_dig(spark, sf):
    return table(spark, sf, "events").select("event_id", tabular.dig(F.col("props"), "k").alias("k"))


@query()
def json_stats(spark, sf):
    return tabular.json_stats(tabular.json_nodes(table(spark, sf, "events"), "event_id", "props"))


@query()
def json_schema(spark, sf):
    return tabular.json_schema(table(spark, sf, "events"), "props")


# names and text -------------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN ('the', 'and', 'of', 'for', 'a', 'an'))"


@query(f"SELECT doc_id, array_to_string({_TOKENS.format(c='text')}, ' ') AS name FROM documents")
def normalized_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("name"))


@query("SELECT p_partkey, sha256(p_name)[1:12] AS sha, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slug_ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.sha12(F.col("p_name")).alias("sha"), text.slug(F.col("p_name")).alias("slug"))


_SIM = """WITH p AS (SELECT DISTINCT p_name AS s FROM part), t AS (SELECT s, TOKENS AS w FROM p), n AS (SELECT s, list_distinct(w) AS w, array_to_string(w, ' ') AS n FROM t),
 j AS (SELECT a.s AS x, b.s AS y, CASE WHEN a.n = b.n THEN 1.0 WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN 0.9 ELSE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) END AS score FROM n a JOIN n b ON a.s < b.s) SELECT x AS a, y AS b, round(score, 4) AS confidence FROM j WHERE score > 0""".replace("TOKENS", _TOKENS.format(c="s"))


@query(_SIM)
def surface_sim_pairs(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("entity_id"), F.lit("part").alias("type_id"), F.col("p_name").alias("surface")).distinct()
    return resolution.candidates(names).select("a", "b", F.round("confidence", 4).alias("confidence"))


@query("SELECT 'part:'||p_partkey AS entity_id, 'part:'||min(p_partkey::VARCHAR) OVER (PARTITION BY array_to_string(list_sort(string_split(p_name, ' ')), ' ')) AS root FROM part QUALIFY count(*) OVER (PARTITION BY array_to_string(list_sort(string_split(p_name, ' ')), ' ')) > 1")
def resolve_clusters(spark, sf):
    s = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("part").alias("type_id"), F.col("p_name").alias("surface"))
    by = s.withColumn("n", F.array_join(F.array_sort(text.tokens(F.col("surface"))), " "))
    first = by.groupBy("n").agg(F.min("entity_id").alias("a"))
    return resolution.components(by.join(first, "n").where("a <> entity_id").select("a", F.col("entity_id").alias("b")))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\bgo to\b|\bnavigate\b|\bopen the\b|\bvisit\b') THEN 'goto' WHEN regexp_matches(text, '(?i)\bclick\b|\bpress the\b|\btap\b|\bselect the .*button\b') THEN 'click' WHEN regexp_matches(text, '(?i)\benter\b|\btype\b|\bfill\b') THEN 'fill' WHEN regexp_matches(text, '(?i)\bchoose\b|\bselect\b') THEN 'select' END AS verb FROM documents")
def action_verbs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.action_verb(F.col("text")).alias("verb"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(f, '^(.{1,200}?[.!?])(?: |$)', 1), ''), left(f, 200)) AS sentence FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^[ \\t\\r\\n]*#+', ''), '[ \\t\\r\\n\\x0b\\f]+', ' ', 'g')) AS f FROM documents)")
def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, 'token = \"[0-9a-f]+\"', '[REDACTED]', 'g'), '[a-z.0-9]+@mail[0-9]+\\.example\\.com', '[REDACTED]', 'g') AS text FROM documents")
def redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redact(F.col("text"), ('token = "[0-9a-f]+"', r"[a-z.0-9]+@mail[0-9]+\.example\.com")).alias("text"))


@query("SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda b: regexp_replace(b, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), lambda b: b <> ''))::BIGINT AS blocks FROM documents")
def doc_blocks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(documents.blocks(F.col("text"))).cast("long").alias("blocks"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1), ' ') AS links, array_to_string(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1), ' ') AS headings FROM pages")
def html_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(documents.html_links(F.col("html")), " ").alias("links"), F.array_join(documents.html_headings(F.col("html")), " ").alias("headings"))


@query()
def html_pages(spark, sf):
    p = documents.html_pages(table(spark, sf, "pages"), "page_id", "html")
    return p.select(F.col("key").alias("page_id"), "title", "text", "n_links", F.size("headings").alias("n_headings"))


# segments, references, streams ----------------------------------------------------------------------------------------


@query("WITH a AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM a) SELECT conv_id, run::BIGINT AS run, role, min(turn) AS start, max(turn) AS \"end\", count(*) AS n FROM b GROUP BY 1, 2, 3")
def runs(spark, sf):
    c = table(spark, sf, "conversations").withColumn("score", F.lit(0.0))
    return segments.runs(c, "conv_id", "turn", "role", "turn", "turn", "score").select("conv_id", "run", "role", "start", "end", "n")


@query("WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT DISTINCT user_id, n * g // 4 AS i FROM n, range(4) r(g) WHERE n > 4) SELECT user_id, event_id FROM n WHERE n <= 4 UNION ALL SELECT n.user_id, n.event_id FROM n JOIN k ON k.user_id = n.user_id AND k.i = n.i WHERE n.n > 4")
def thin_budget(spark, sf):
    return segments.thin(table(spark, sf, "events"), "user_id", "event_id", 4).select("user_id", "event_id")


@query("SELECT conv_id, g * max_turn / 4 AS t FROM (SELECT conv_id, max(turn)::DOUBLE AS max_turn FROM conversations GROUP BY 1), range(5) r(g)")
def frame_grid(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").cast("double").alias("m"))
    return c.select("conv_id", F.explode(segments.grid(F.lit(0.0), F.col("m"), count=5)).alias("t"))


@query("WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_partkey % 50 + 1 AS a, l_partkey % 50 + 1 + l_quantity::INT AS b FROM lineitem), j AS (SELECT x.id AS a_id, y.id AS b_id, greatest(0, least(x.b, y.b) - greatest(x.a, y.a) + 1) / least(x.b - x.a + 1, y.b - y.a + 1) AS s FROM p x JOIN p y ON y.l_orderkey = x.l_orderkey AND x.id < y.id) SELECT a_id, b_id, round(s, 6) AS overlap FROM j WHERE s >= 0.5")
def lineref_overlap(spark, sf):
    at = F.col("l_partkey") % 50 + 1
    d = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("f/"), F.col("l_orderkey").cast("string"), F.lit(":"), at.cast("string"), F.lit("-"), (at + F.col("l_quantity").cast("int")).cast("string")).alias("ref"))
    return cache.overlapping(d, d).where("a_id < b_id").select("a_id", "b_id", F.round("overlap", 6).alias("overlap"))


@query("SELECT 'f:'||o_custkey AS file, CASE WHEN i THEN 'deleted' ELSE 'added' END AS change FROM (SELECT DISTINCT o_custkey, o_custkey % 3 = 0 AS i FROM orders WHERE o_custkey % 3 < 2)")
def sync_diff(spark, sf):
    f = table(spark, sf, "orders").select("o_custkey", F.concat(F.lit("f:"), F.col("o_custkey").cast("string")).alias("file"))
    return cache.sync_diff(f.where("o_custkey % 3 <> 1"), f.where("o_custkey % 3 <> 0"))


@query()
def cache_tiers(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("store"), F.col("event_id").alias("seq"), F.concat(F.lit("f:"), (F.col("user_id") % 97 + 1).cast("string")).alias("ref"), F.col("event_type").alias("description"), F.col("event_id").alias("at"))
    return cache.replay(e)


@query("SELECT user_id::VARCHAR AS path, arg_max(props, event_id) AS content FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def upsert_state(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("props").alias("content"))
    return changes.latest(e).select("path", "content")


@query("SELECT user_id::VARCHAR AS path, arg_max(props, event_id) AS content FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def stream_upserts(spark, sf):
    """The same state as ``upsert_state``, by a stream in bursts."""
    root = f"{shared_dir(spark)}/feldspar/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    e = s.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("props").alias("content"))
    changes.run_upserts(e, f"{root}/state", f"{root}/checkpoint")
    return changes.newest(spark, f"{root}/state").select("path", "content")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return changes.windows(table(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# names, files and scalars ---------------------------------------------------------------------------------------------

_SIGN_STOP = "'of','for','with','within','to','from','the','a','an','in','on','at','and','or','as','into','per','its','their','that','this','other','between'"
_STEM = """CASE WHEN length(t) <= 4 THEN t WHEN t LIKE '%ies' THEN left(t, length(t) - 3)||'y' WHEN t LIKE '%sses' THEN left(t, length(t) - 2)
 WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ({_SIGN_STOP})) AS w FROM documents)
 SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(w, lambda t: {_STEM}))), ' ') AS signature FROM w"""
)
def name_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.name_signature(F.col("text")).alias("signature"))


_EXTENSIONS = "md pdf csv ods docx doc rtf htm json ipynb png bmp mp4 m4v mp3 aac txt".split()
_MODALITY = """CASE WHEN e = 'md' THEN 'markdown' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('csv', 'ods') THEN 'spreadsheet' WHEN e IN ('docx', 'doc', 'rtf') THEN 'docs' WHEN e = 'htm' THEN 'html' WHEN e = 'json' THEN 'json'
 WHEN e = 'ipynb' THEN 'notebook' WHEN e IN ('png', 'bmp') THEN 'image' WHEN e IN ('mp4', 'm4v') THEN 'video' WHEN e IN ('mp3', 'aac') THEN 'audio' ELSE 'generic' END"""


@query(f"SELECT o_orderkey, {_MODALITY} AS modality FROM (SELECT o_orderkey, ({_EXTENSIONS!r})[(o_orderkey % {len(_EXTENSIONS)} + 1)::INT] AS e FROM orders)")
def modality(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("o_orderkey") % len(_EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("in/"), F.col("o_orderkey").cast("string"), F.lit("."), F.upper(ext))
    return table(spark, sf, "orders").select("o_orderkey", text.modality(path).alias("modality"))


@query("SELECT page_id, CASE WHEN html LIKE '<!DOCTYPE%' OR contains(left(html, 16), '<!DOCTYPE') OR html LIKE '<html%' OR contains(left(html, 16), '<html') THEN 'html' END AS signature, true AS is_text FROM pages")
def detect(spark, sf):
    d = documents.detect(F.encode("html", "utf-8"))
    return table(spark, sf, "pages").select("page_id", d["signature"].alias("signature"), d["is_text"].alias("is_text"))


_FORMS = [(0, "Definite", "Article", "the "), (1, "Ending", "Suffix", "TION"), (2, "Ending", "Suffix", "ment"), (3, "Umlaut", "Letter", "ü")]


@query("SELECT 'f:'||doc_id AS fact_id, CASE WHEN contains(lower(text), 'the ') THEN 'Article' WHEN contains(lower(text), 'tion') OR contains(lower(text), 'ment') THEN 'Suffix' WHEN contains(lower(text), 'ü') THEN 'Letter' ELSE 'Topic' END AS type FROM documents")
def glossary_match(spark, sf):
    facts = table(spark, sf, "documents").select(F.concat(F.lit("f:"), F.col("doc_id").cast("string")).alias("fact_id"), "text")
    return build.glossary_match(facts, spark.createDataFrame(_FORMS, "pos int, term string, type string, form string")).select("fact_id", "type")


@query("SELECT event_id, printf('%02d:%02d:%02d', (floor(value)::BIGINT // 3600), (floor(value)::BIGINT // 60) % 60, floor(value)::BIGINT % 60) AS clock, CASE WHEN value / 100 - 0.5 >= 0.05 THEN 'positive' WHEN value / 100 - 0.5 <= -0.05 THEN 'negative' ELSE 'neutral' END AS mood FROM events WHERE value >= 0")
def scalars(spark, sf):
    return table(spark, sf, "events").where("value >= 0").select("event_id", text.clock(F.col("value")).alias("clock"), text.sentiment_label(F.col("value") / 100 - 0.5).alias("mood"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000)||chr(10)||'[truncated]' ELSE text END AS cut, array_to_string(regexp_extract_all(text, '[\\x20-\\x7e]{4,}'), '|') AS runs FROM documents")
def text_views(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.truncate(t, 2000).alias("cut"), F.array_join(text.printable_runs(t), "|").alias("runs"))


# JSON, all nodes ------------------------------------------------------------------------------------------------------


@query("SELECT count(*) + sum(len(json_keys(props))) AS n_nodes, 1 AS max_depth FROM events")
def json_totals(spark, sf):
    n = tabular.json_nodes(table(spark, sf, "events"), "event_id", "props")
    return tabular.json_stats(n).select("n_nodes", "max_depth")


@query("SELECT 'object' AS type, count(*) AS n FROM events UNION ALL SELECT 'number', sum(len(json_keys(props)))::BIGINT FROM events")
def json_types(spark, sf):
    return tabular.json_types(tabular.json_nodes(table(spark, sf, "events"), "event_id", "props"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS name FROM events) GROUP BY 1 ORDER BY n DESC, name LIMIT 40")
def json_keys(spark, sf):
    return tabular.json_keys(tabular.json_nodes(table(spark, sf, "events"), "event_id", "props"))


# gates on graphs with planted faults ----------------------------------------------------------------------------------


@query("SELECT 'schema' AS code, 'schema' AS location UNION ALL SELECT 'extensions', 'extensions.plain'")
def gate_header(spark, sf):
    version = spark.createDataFrame([("ontology.v0", ["a.b", "plain"])], "schema string, extension_keys array<string>")
    return gates.header(business_graph(spark, sf).with_(version=version)).select("code", "location")


@query("SELECT 'entities.key:'||p_partkey AS location, 'holds part:'||p_partkey AS message FROM part WHERE p_partkey % 3 = 0")
def gate_identity(spark, sf):
    g = business_graph(spark, sf)
    number = F.split_part("entity_id", F.lit(":"), F.lit(2)).cast("long")
    wrong = (F.col("type_id") == "part") & (number % 3 == 0)
    keys = F.when(wrong, F.concat(F.lit("key:"), number.cast("string"))).otherwise(F.col("entity_id"))
    e = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("part").alias("type_id")).withColumn("map_key", keys)
    return gates.identity(g.with_(entities=e)).select("location", "message")


@query("""SELECT 'resolutions.r:'||doc_id AS location, 'not reversible' AS message FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT 'resolutions.r:'||doc_id, 'no evidence' FROM documents WHERE doc_id % 30 = 0
 UNION ALL SELECT 'resolutions.r:'||d.doc_id, 'member d:'||(d.doc_id + k)||' is unknown' FROM documents d, (VALUES (1), (2)) v(k) WHERE d.doc_id % 10 = 0 AND d.doc_id + k NOT IN (SELECT doc_id FROM documents)""")
def gate_resolution(spark, sf):
    g = document_graph(spark, sf)
    n = F.split_part("resolution_id", F.lit(":"), F.lit(2)).cast("long")
    r = g.resolutions.withColumn("evidence", F.when(n % 30 != 0, F.col("evidence"))).withColumn("reversible", n % 20 != 0)
    return gates.resolution(g.with_(resolutions=r)).select("location", "message")


@query("""SELECT 'entities.supplier:'||s_suppkey||'.s_acctbal' AS location, 'a required property is missing' AS message FROM supplier WHERE s_suppkey % 4 = 0
 UNION ALL SELECT 'entities.supplier:'||s_suppkey||'.s_acctbal', 'not a number' FROM supplier WHERE s_suppkey % 4 = 1
 UNION ALL SELECT 'entities.supplier:'||s_suppkey||'.colour', 'the type has no such property' FROM supplier WHERE s_suppkey % 4 = 2
 UNION ALL SELECT 'entities.supplier:'||s_suppkey||'.s_acctbal', 'more than one value' FROM supplier WHERE s_suppkey % 4 = 3""")
def gate_conformance(spark, sf):
    g = business_graph(spark, sf)
    entity = F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("entity_id")
    s = table(spark, sf, "supplier").select(entity, (F.col("s_suppkey") % 4).alias("k"), F.col("s_acctbal").cast("string").alias("value"))
    row = lambda d, prop, pos, value: d.select("entity_id", F.lit(prop).alias("prop"), F.lit(pos).alias("pos"), value.alias("value"))
    value = F.col("value")
    props = row(s.where("k = 1"), "s_acctbal", 0, F.lit('"much"')).unionByName(row(s.where("k >= 2"), "s_acctbal", 0, value))
    props = props.unionByName(row(s.where("k = 2"), "colour", 0, F.lit('"red"'))).unionByName(row(s.where("k = 3"), "s_acctbal", 1, value))
    schemas = g.prop_schemas.where("owner_id = 'supplier'").withColumn("required", F.lit(True))
    e = s.select("entity_id", F.lit("supplier").alias("type_id"))
    return gates.conformance(g.with_(entities=e, entity_props=props, prop_schemas=schemas)).select("location", "message")


@query("""SELECT 'f:'||o_custkey AS id, 'lt_placed' AS link_type_id, 'e_'||sha256('node|'||'c'||o_custkey)[1:12] AS to_id, count(*) AS n FROM orders GROUP BY ALL""")
def migrate(spark, sf):
    """An older graph of customers and orders, each order linked to its customer."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("o"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"), F.concat(F.lit("f:"), F.col("o_custkey").cast("string")).alias("f"))
    node = lambda d, kind: d.select("id", F.lit(kind).alias("kind"), F.col("id").alias("label"), F.array("f").alias("fact_ids"))
    nodes = node(o.select(F.col("o").alias("id"), "f"), "order").unionByName(node(o.select(F.col("c").alias("id"), "f").distinct(), "customer"))
    edges = o.select(F.col("o").alias("source"), F.col("c").alias("target"), F.lit("placed").alias("kind"), F.lit("confirmed").alias("fidelity"), F.array("f").alias("fact_ids"))
    links = build.migrate(nodes, edges)["links"].where("fidelity = 'claimed'")
    return links.groupBy(F.get("fact_ids", F.lit(0)).alias("id"), "link_type_id", "to_id").agg(F.count("*").alias("n"))
