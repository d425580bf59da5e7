"""The test tables as a graph: entities, links, facts, events. All projections; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspar.model import OntologyFrames

#: type, table, key, label column, a numeric property.
KINDS = (("region", "region", "r_regionkey", "r_name", None), ("nation", "nation", "n_nationkey", "n_name", None), ("customer", "customer", "c_custkey", "c_name", "c_acctbal"), ("supplier", "supplier", "s_suppkey", "s_name", "s_acctbal"), ("part", "part", "p_partkey", "p_name", "p_retailprice"), ("orders", "orders", "o_orderkey", "o_orderkey", "o_totalprice"))
#: The baseline and the current period of the events, unless given: this part of their time span, at either end.
PERIOD = 1 / 360


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def business_graph(spark: SparkSession, sf_dir: str) -> OntologyFrames:
    """Regions to orders as entities, foreign keys as links."""
    t = lambda n: table(spark, sf_dir, n)
    entities = _union(t(n).select(_id(k, key).alias("entity_id"), F.lit(k).alias("type_id"), F.col(label).cast("string").alias("label"), F.lit("active").alias("status"), F.array(F.struct(F.col(label).cast("string").alias("text"), F.lit(n).alias("source_id"))).alias("aliases")) for k, n, key, label, _ in KINDS)
    values = _union(t(n).select(_id(k, key).alias("entity_id"), F.lit(value).alias("prop"), F.lit(0).alias("pos"), F.col(value).cast("string").alias("value")) for k, n, key, _, value in KINDS if value)
    edge = lambda n, kind, a, b: t(n).select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("link_type_id"))
    links = _union(
        [
            edge("nation", "located_in", _id("nation", "n_nationkey"), _id("region", "n_regionkey")),
            edge("customer", "located_in", _id("customer", "c_custkey"), _id("nation", "c_nationkey")),
            edge("supplier", "located_in", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
            edge("orders", "placed_by", _id("orders", "o_orderkey"), _id("customer", "o_custkey")),
        ]
    ).withColumn("link_id", F.concat_ws("|", "link_type_id", "from_id", "to_id"))
    types = spark.createDataFrame([(k, k.title(), "active", ["Thing"] if not v else ["Valued"]) for k, *_, v in KINDS], "type_id string, name string, status string, extends array<string>")
    faces = spark.createDataFrame([("Thing", "Thing", []), ("Valued", "Valued", ["Thing"]), ("Traded", "Traded", [])], "interface_id string, name string, extends array<string>")
    none = (None, None, None, None)
    rows = [(k, "type", v, "number", *none, None) for k, *_, v in KINDS if v]
    rows += [("customer", "type", "order_count", "number", "placed_by", "in", "count", None, None), ("customer", "type", "order_total", "number", "placed_by", "in", "sum", "o_totalprice", None), ("nation", "type", "balances", "number", "located_in", "in", "collect_list", "c_acctbal", None), ("orders", "type", "o_totalprice_max", "number", *none, "max"), ("Thing", "interface", "label", "string", *none, None)]
    raw = spark.createDataFrame(rows, "owner_id string, owner_kind string, prop string, value_kind string, lt string, direction string, aggregation string, of string, rule string")
    derived = F.when(F.col("lt").isNotNull(), F.struct(F.col("lt").alias("link_type"), "direction", "aggregation", "of"))
    props = raw.withColumn("derived", derived).withColumn("reducer", F.when(F.col("rule").isNotNull(), F.struct("rule", F.lit(None).cast("string").alias("by")))).withColumn("cardinality", F.lit("one"))
    kinds = spark.createDataFrame([("located_in", "located in"), ("placed_by", "placed by")], "link_type_id string, name string")
    sources = spark.createDataFrame([(n, "table") for _, n, *_ in KINDS], "source_id string, kind string")
    return OntologyFrames.of(spark, entities=entities, entity_props=values, entity_types=types, prop_schemas=props, interfaces=faces, links=links, link_types=kinds, sources=sources)


def document_graph(spark: SparkSession, sf_dir: str) -> OntologyFrames:
    """Documents as facts and entities; labels give fidelity (none: orphan) and security (toxic)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fidelity = F.when(F.col("quality") == 1, "claimed").when(F.col("quality") == 0, "guessed").otherwise("absent")
    fact, entity = _id("f", "doc_id"), _id("d", "doc_id")
    span = "array<struct<source_id:string,span:struct<kind:string,label:string>>>"
    refs = F.array(F.struct(F.col("source").alias("source_id"), F.struct(F.lit("doc").alias("kind"), F.col("lang").alias("label")).alias("span"))).cast(span)
    empty = OntologyFrames.of(spark)
    full = F.from_json(F.to_json(refs), empty.facts.schema["source_refs"].dataType)
    security = F.when(F.col("toxic") == 1, "sec:toxic")
    facts = d.select(fact.alias("fact_id"), F.lit("knowledge").alias("kind"), "text", F.lit(0.7).alias("confidence"), fidelity.alias("fidelity"), full.alias("source_refs"))
    into = F.when((F.col("doc_id") % 10).isin(1, 2), F.concat(F.lit("d:"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string")))
    members = F.when(F.col("doc_id") % 10 == 0, F.array(F.concat(F.lit("d:"), (F.col("doc_id") + 1).cast("string")), F.concat(F.lit("d:"), (F.col("doc_id") + 2).cast("string"))))
    entities = d.select(entity.alias("entity_id"), F.concat(F.lit("doc_"), "lang").alias("type_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("label"), F.when(F.col("quality").isNull(), "orphan").otherwise("active").alias("status"), security.alias("security_id"), members.alias("resolved_from"), into.alias("merged_into"), F.array(fact).alias("fact_ids"), F.array("source").alias("source_ids"))
    values = d.select(entity.alias("entity_id"), F.lit("n_chars").alias("prop"), F.lit(0).alias("pos"), F.col("n_chars").cast("string").alias("value"), F.array(fact).alias("fact_ids"), fidelity.alias("fidelity"), F.lit(None).cast("string").alias("security_id"))
    types = d.select("lang").distinct().select(F.concat(F.lit("doc_"), "lang").alias("type_id"), F.concat(F.lit("Document "), "lang").alias("name"), F.lit("active").alias("status"))
    props = types.select(F.col("type_id").alias("owner_id"), F.lit("type").alias("owner_kind"), F.lit("n_chars").alias("prop"), F.lit("number").alias("value_kind"), F.struct(F.lit("max").alias("rule"), F.lit(None).cast("string").alias("by")).alias("reducer"))
    heads = d.where("doc_id % 10 = 0").select(F.concat(F.lit("r:"), F.col("doc_id").cast("string")).alias("resolution_id"), entity.alias("canonical"), members.alias("members"), F.lit(1.0).alias("confidence"), F.lit("agent+verified").alias("method"), F.lit(True).alias("reversible"), F.array(fact).alias("evidence"))
    sources = d.where("source <> 'src3'").select(F.col("source").alias("source_id"), F.lit("file").alias("kind")).distinct()
    return OntologyFrames.of(spark, facts=facts, entities=entities, entity_props=values, entity_types=types, prop_schemas=props, resolutions=heads, sources=sources, security=spark.createDataFrame([("sec:other",)], "security_id string"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("lu_"), (F.col("user_id") % 10).cast("string")).alias("logic_unit_id"), F.col("event_type").alias("step_id"), "ts", "value")


def _periods(e: DataFrame) -> DataFrame:
    """The events, each with the end of the first PERIOD of all (__early) and the start of the last (__late)."""
    part = (F.max("ts") - F.min("ts")) * PERIOD
    ends = e.agg((F.min("ts") + part).alias("__early"), (F.max("ts") - part).alias("__late"))  # one row
    return e.join(F.broadcast(ends), how="cross")


def current_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the last PERIOD, which drift compares with the baseline."""
    return _periods(_events(spark, sf_dir)).where("ts >= __late").drop("__early", "__late")


def process_graph(spark: SparkSession, sf_dir: str, *, baseline_end: str | None = None, since: str | None = None) -> OntologyFrames:
    """Events by user as logic units whose steps are the event types; the baseline is the first PERIOD's steps, or those before ``baseline_end``.

    The graph holds all events, or those from ``since`` on.
    """
    e = _events(spark, sf_dir)
    units = e.select("logic_unit_id").distinct().select("logic_unit_id", F.col("logic_unit_id").alias("name"), F.when(F.col("logic_unit_id") < "lu_7", "executable").otherwise("observed").alias("state"), F.when(F.col("logic_unit_id") < "lu_3", "judged").otherwise("measured").alias("trust_class"))
    pairs = e.select("logic_unit_id", "step_id").distinct()
    from pyspark.sql import Window

    steps = pairs.withColumn("pos", F.row_number().over(Window.partitionBy("logic_unit_id").orderBy("step_id")) - 1)
    evidence = e.groupBy("logic_unit_id", "step_id").agg(F.max("value").alias("m"), F.count("*").alias("n")).select("logic_unit_id", "step_id", F.lit(0).alias("pos"), F.when(F.col("n") % 2 == 0, "de_jure").otherwise("espoused").alias("class"), (F.col("n") % 7 == 0).alias("contradicts"))
    early = _periods(e).where("ts <= __early") if baseline_end is None else e.where(F.col("ts") < F.lit(baseline_end).cast("timestamp_ntz"))
    base = early.groupBy("logic_unit_id").agg(F.array_sort(F.collect_set("step_id")).alias("baseline_steps"))
    contracts = units.join(base, "logic_unit_id").select("logic_unit_id", F.when(F.col("logic_unit_id") < "lu_5", "reversible").otherwise("irreversible").alias("reversibility"), F.when(F.col("logic_unit_id") < "lu_2", 60).otherwise(10).alias("blast_entities"), F.lit("L2").alias("effective"), "baseline_steps")
    held = e if since is None else e.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    seq = F.row_number().over(Window.partitionBy("logic_unit_id").orderBy("ts", "event_id"))
    return OntologyFrames.of(spark, logic_units=units, lu_steps=steps, lu_evidence=evidence, lu_contracts=contracts, events=held.withColumn("seq", seq))
