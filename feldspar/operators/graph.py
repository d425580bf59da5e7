"""Queries over the graph's frames. Results are flat; order them with the columns named in each docstring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from feldspar.errors import NotFound
from feldspar.model import WITHHELD, OntologyFrames
from feldspar.session import checkpointed


def number(value: Column) -> Column:
    """The number that a JSON text is; null if it is none."""
    return F.try_variant_get(F.try_parse_json(value), "$", "double")


def _shown(e: DataFrame, types: DataFrame) -> DataFrame:
    names = types.select("type_id", F.col("name").alias("type_name"))
    return e.join(names, "type_id", "left").select("entity_id", "type_id", "type_name", "label", "status", F.coalesce(F.greatest(F.size("aliases"), F.lit(0)), F.lit(0)).cast("long").alias("alias_count"), F.col("security_id").isNotNull().alias("restricted"), "merged_into")


def types(g: OntologyFrames) -> DataFrame:
    """type_id, name, status, property_count, entity_count; merged members and orphans count."""
    props = g.prop_schemas.where("owner_kind = 'type'").groupBy(F.col("owner_id").alias("type_id")).agg(F.count("*").alias("property_count"))
    n = g.entities.groupBy("type_id").agg(F.count("*").alias("entity_count"))
    return g.entity_types.join(props, "type_id", "left").join(n, "type_id", "left").select("type_id", "name", "status", F.coalesce("property_count", F.lit(0)).alias("property_count"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


def closure(g: OntologyFrames) -> DataFrame:
    """type_id, interface_id: all interfaces of each type, through ``extends``; cycles end by themselves, unknown ids stay.

    Each level is saved, so that the plan doesn't grow with the depth.
    """
    edges = checkpointed(g.interfaces.select("interface_id", F.explode("extends").alias("parent")))
    seen = fresh = checkpointed(g.entity_types.select("type_id", F.explode("extends").alias("interface_id")).distinct())
    while True:
        step = fresh.join(edges, "interface_id").select("type_id", F.col("parent").alias("interface_id")).distinct()
        fresh = checkpointed(step.join(seen, ["type_id", "interface_id"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)


def interfaces(g: OntologyFrames) -> DataFrame:
    """interface_id, name, property_count, implemented_by (sorted type ids)."""
    by = closure(g).groupBy("interface_id").agg(F.array_sort(F.collect_set("type_id")).alias("implemented_by"))
    props = g.prop_schemas.where("owner_kind = 'interface'").groupBy(F.col("owner_id").alias("interface_id")).agg(F.count("*").alias("property_count"))
    return g.interfaces.join(by, "interface_id", "left").join(props, "interface_id", "left").select("interface_id", "name", F.coalesce("property_count", F.lit(0)).alias("property_count"), F.coalesce("implemented_by", F.array().cast("array<string>")).alias("implemented_by"))


def entities(g: OntologyFrames, type: str | None = None, interface: str | None = None) -> DataFrame:
    """Summaries, of a type (id or name) and of an interface (id or name) if given; by entity_id."""
    kinds = g.entity_types
    if type is not None:
        kinds = kinds.where((F.col("type_id") == type) | (F.col("name") == type))
    if interface is not None:
        named = g.interfaces.where(F.col("name") == interface).select("interface_id")
        has = closure(g)
        has = has.where(F.col("interface_id") == interface).select("type_id").unionByName(has.join(named, "interface_id", "left_semi").select("type_id"))
        kinds = kinds.join(has, "type_id", "left_semi")
    e = g.entities if type is None and interface is None else g.entities.join(kinds.select("type_id"), "type_id", "left_semi")
    return _shown(e, g.entity_types)


def search(g: OntologyFrames, term: str) -> DataFrame:
    """Summaries whose label or an alias holds the term, whatever the case."""
    t = F.lower(F.lit(term))
    return _shown(g.entities.where(F.contains(F.lower("label"), t) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a["text"]), t)), F.lit(False))), g.entity_types)


def gaps(g: OntologyFrames) -> DataFrame:
    """kind, entity_id, text, ord: orphans by id, then notes in order."""
    orphans = g.entities.where("status = 'orphan'").select(F.lit("orphan_entity").alias("kind"), "entity_id", F.col("label").alias("text"), F.lit(0).alias("ord"))
    return orphans.unionByName(g.notes.select(F.lit("note").alias("kind"), F.lit(None).cast("string").alias("entity_id"), "text", (F.col("pos") + 1).alias("ord")))


def receipts(g: OntologyFrames, cited: DataFrame, by: list[str]) -> DataFrame:
    """``cited`` has fact_ids and the columns ``by``: a row for each source reference of each known cited fact, in order."""
    facts = cited.select(*by, F.posexplode("fact_ids").alias("ord", "fact_id")).join(g.facts.select("fact_id", "source_refs"), "fact_id")
    refs = facts.select(*by, "ord", "fact_id", F.posexplode("source_refs").alias("pos", "ref")).select(*by, "ord", "fact_id", "pos", "ref.source_id", "ref.span")
    known = g.sources.select("source_id", F.col("kind").alias("source_kind"), F.lit(True).alias("known"))
    return refs.join(known, "source_id", "left").select(*by, "ord", "fact_id", "pos", "source_id", F.coalesce("known", F.lit(False)).alias("resolved"), "source_kind", "span")


def contributors(g: OntologyFrames) -> DataFrame:
    """entity_id, ord, from_entity: each entity first, then the known members it was resolved from, in order."""
    own = g.entities.select("entity_id", F.lit(-1).alias("ord"), F.col("entity_id").alias("from_entity"))
    members = g.entities.select("entity_id", F.posexplode("resolved_from").alias("ord", "from_entity"))
    return own.unionByName(members.join(g.entities.select(F.col("entity_id").alias("from_entity")), "from_entity", "left_semi").select(own.columns))


def facts(g: OntologyFrames) -> DataFrame:
    """entity_id with fact_id, kind, text, confidence, fidelity: facts of each entity and its members, each once."""
    ids = contributors(g).join(g.entities.select(F.col("entity_id").alias("from_entity"), "fact_ids"), "from_entity").select("entity_id", F.explode("fact_ids").alias("fact_id")).distinct()
    return ids.join(g.facts.select("fact_id", "kind", "text", "confidence", "fidelity"), "fact_id").select("entity_id", "fact_id", "kind", "text", "confidence", "fidelity")


def aliases(g: OntologyFrames) -> DataFrame:
    """entity_id, text, source_id, from_entity: aliases of each entity and its members; repeats stay."""
    a = g.entities.select(F.col("entity_id").alias("from_entity"), F.explode("aliases").alias("a")).select("from_entity", "a.text", "a.source_id")
    return contributors(g).join(a, "from_entity").select("entity_id", "text", "source_id", "from_entity")


def properties(g: OntologyFrames, *, reveal: bool = False) -> DataFrame:
    """entity_id, prop, ord, pos, value, fidelity, withheld, from_entity, fact_ids: values of an entity and its members.

    A value is withheld if it or its owner has a security id, unless revealed; its receipts stay.
    """
    owner = g.entities.select(F.col("entity_id").alias("from_entity"), F.col("security_id").alias("owner_security"))
    v = contributors(g).join(owner, "from_entity").join(g.entity_props.withColumnRenamed("entity_id", "from_entity"), "from_entity")
    hidden = (F.col("security_id").isNotNull() | F.col("owner_security").isNotNull()) & F.lit(not reveal)
    return v.select("entity_id", "prop", "ord", "pos", F.when(hidden, F.lit(WITHHELD)).otherwise(F.col("value")).alias("value"), "fidelity", hidden.alias("withheld"), "from_entity", "fact_ids")


def heads(g: OntologyFrames, *, reveal: bool = False) -> DataFrame:
    """entity_id, prop, head, withheld: the reduced value of each declared property that has values.

    A struct's main field of the first value comes before a reducer; ``most_recent`` equals ``last``, as the document
    format defines it; ``max`` and ``min`` take numbers only. A head is withheld if any value is.
    """
    shown = properties(g, reveal=True).withColumn("at", F.struct("ord", "pos"))
    hidden = properties(g, reveal=reveal).groupBy("entity_id", "prop").agg(F.bool_or("withheld").alias("withheld"))
    declared = g.prop_schemas.where("owner_kind = 'type'").select(F.col("owner_id").alias("type_id"), "prop", F.col("reducer.rule").alias("rule"), "struct_main").where("rule IS NOT NULL OR struct_main IS NOT NULL")
    of = g.entities.select("entity_id", "type_id").join(declared, "type_id")
    n = number(F.col("value"))
    got = shown.join(of, ["entity_id", "prop"]).groupBy("entity_id", "prop", "rule", "struct_main").agg(F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"), F.max(F.when(n.isNotNull(), F.struct(n.alias("n"), F.col("at"), F.col("value")))).alias("max"), F.min(F.when(n.isNotNull(), F.struct(n.alias("n"), F.col("at"), F.col("value")))).alias("min"))
    fields = F.from_json("first", "map<string,string>")
    head = F.when(F.col("struct_main").isNotNull(), F.element_at(fields, F.col("struct_main"))).when(F.col("rule").isin("last", "most_recent"), F.col("last")).when(F.col("rule") == "max", F.col("max.value")).when(F.col("rule") == "min", F.col("min.value")).when(F.col("rule") == "first", F.col("first"))
    return got.withColumn("head", head).join(hidden, ["entity_id", "prop"]).select("entity_id", "prop", F.when(F.col("withheld"), F.lit(WITHHELD)).otherwise(F.col("head")).alias("head"), "withheld")


def views(g: OntologyFrames, *, reveal: bool = False) -> DataFrame:
    """One row for each entity with all that its own and its members' records say.

    entity_id, type_id, type_name, label, status, security_id, resolved_from, merged_into, restricted; aliases by text
    and source; properties: values by property, the entity's own first; receipts: its and its members' facts by id; heads
    and derived: value by property. Collections without rows are empty. Every part is grouped by entity, so a filter on
    entity_id reaches all of them.
    """
    listed = lambda df, name, *c: df.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    by_prop = lambda df, name, c: df.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", c)))).alias(name))
    value = F.struct("ord", "pos", "value", "fidelity", "withheld", "from_entity", "fact_ids")
    values = properties(g, reveal=reveal).groupBy("entity_id", "prop").agg(F.array_sort(F.collect_list(value)).alias("v"))
    parts = (
        listed(aliases(g), "aliases", "text", "source_id", "from_entity"),
        by_prop(values, "properties", F.transform("v", lambda v: v.dropFields("ord", "pos"))),
        listed(facts(g), "receipts", "fact_id", "kind", "text", "confidence", "fidelity"),
        by_prop(heads(g, reveal=reveal), "heads", F.col("head")),
        by_prop(derived(g, strict_security=not reveal), "derived", F.col("value")),
    )
    names = g.entity_types.select("type_id", F.col("name").alias("type_name"))
    own = g.entities.select("entity_id", "type_id", "label", "status", "security_id", "resolved_from", "merged_into")
    out = reduce(lambda a, b: a.join(b, "entity_id", "left"), parts, own.join(names, "type_id", "left"))
    empty = lambda df, c: F.coalesce(F.col(c), F.from_json(F.lit("{}" if c in ("properties", "heads", "derived") else "[]"), df.schema[c].dataType))
    full = {c: empty(out, c) for c in ("aliases", "properties", "receipts", "heads", "derived", "resolved_from")}
    return out.withColumns(full | {"restricted": F.col("security_id").isNotNull()})


def entity(g: OntologyFrames, entity_id: str, *, reveal: bool = False) -> Row:
    """The view of one entity; NotFound if there is none of that id."""
    row = views(g, reveal=reveal).where(F.col("entity_id") == entity_id).first()
    if row is None:
        raise NotFound(f"entity {entity_id}")
    return row


def counts(g: OntologyFrames) -> DataFrame:
    """collection, n: the sizes a manifest states."""
    names = ("entities", "links", "facts", "entity_types", "link_types", "resolutions")
    return reduce(DataFrame.unionByName, (getattr(g, n).agg(F.lit(n).alias("collection"), F.count("*").alias("n")) for n in names))


def incidence(g: OntologyFrames) -> DataFrame:
    """entity_id, link_id, neighbor, direction: each link once for each end; a self-loop once, as ``both``."""
    out = g.links.where("from_id <> to_id").select(F.col("from_id").alias("entity_id"), "link_id", "link_type_id", F.col("to_id").alias("neighbor"), F.lit("out").alias("direction"))
    into = g.links.where("from_id <> to_id").select(F.col("to_id").alias("entity_id"), "link_id", "link_type_id", F.col("from_id").alias("neighbor"), F.lit("in").alias("direction"))
    loop = g.links.where("from_id = to_id").select(F.col("from_id").alias("entity_id"), "link_id", "link_type_id", F.col("to_id").alias("neighbor"), F.lit("both").alias("direction"))
    return reduce(DataFrame.unionByName, (out, into, loop))


def links(g: OntologyFrames) -> DataFrame:
    """For each entity at either end: link_id, type, ends, fidelity, neighbor and its label."""
    names = g.link_types.select("link_type_id", F.col("name").alias("link_type_name"))
    labels = g.entities.select(F.col("entity_id").alias("neighbor"), F.col("label").alias("neighbor_label"))
    ends = g.links.select("link_id", "from_id", "to_id", "fidelity")
    return incidence(g).join(ends, "link_id").join(names, "link_type_id", "left").join(labels, "neighbor", "left").select("entity_id", "link_id", "link_type_id", "link_type_name", "from_id", "to_id", "fidelity", "neighbor", "neighbor_label")


def derived(g: OntologyFrames, *, strict_security: bool = True) -> DataFrame:
    """entity_id, prop, aggregation, value (JSON text): declared count, sum or collect_list over distinct neighbours.

    Neighbours that are no entities count. ``strict_security`` leaves restricted neighbour values out.
    """
    declared = g.prop_schemas.where("owner_kind = 'type' AND derived IS NOT NULL").select(F.col("owner_id").alias("type_id"), "prop", "derived.*")
    of = g.entities.select("entity_id", "type_id").join(declared, "type_id")
    side = (F.col("i.direction") == F.col("d.direction")) | (F.col("d.direction") == "both") | (F.col("i.direction") == "both")
    near = of.alias("d").join(incidence(g).alias("i"), (F.col("d.entity_id") == F.col("i.entity_id")) & (F.col("d.link_type") == F.col("i.link_type_id")) & side, "left")
    near = near.select("d.entity_id", "prop", "aggregation", F.col("of"), "neighbor").distinct()
    values = g.entity_props
    if strict_security:
        values = values.where("security_id IS NULL").join(g.entities.where("security_id IS NOT NULL").select("entity_id"), "entity_id", "left_anti")
    firsts = values.groupBy(F.col("entity_id").alias("neighbor"), F.col("prop").alias("of")).agg(F.min_by("value", "pos").alias("v"))
    got = near.join(firsts, ["neighbor", "of"], "left").groupBy("entity_id", "prop", "aggregation")
    pairs = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("neighbor", "v"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: p["v"]), ","), F.lit("]"))
    count, total = F.count("neighbor"), F.coalesce(F.sum(number(F.col("v"))), F.lit(0.0))
    return got.agg(F.when(F.col("aggregation") == "count", count.cast("string")).when(F.col("aggregation") == "sum", total.cast("string")).when(F.col("aggregation") == "collect_list", listed).alias("value"))


#: Up to this many nodes are sent whole to each task, so that the links they are looked up in needn't be dealt and sorted.
SENT_NODES = 100_000


def _nodes(df: DataFrame, n: int) -> DataFrame:
    """The ids of ``df``, which has ``n`` rows, for the right side of a join."""
    ids = df.select("entity_id")
    return F.broadcast(ids) if n <= SENT_NODES else ids


def traverse(g: OntologyFrames, start: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """reached (entity_id, label, depth) and path (depth, entity_id, link_id): a bounded undirected search.

    Nodes at the last depth aren't expanded; a link between two expanded nodes is listed for each of them. Levels that
    are expanded are saved and counted: small ones meet the links as they are read. The last level isn't saved, as only
    ``reached`` needs it.
    """
    spark, inc = g.entities.sparkSession, incidence(g).select("entity_id", "link_id", "neighbor")
    seen = front = spark.createDataFrame([(start, 0)], "entity_id string, depth int")
    n = n_seen = 1
    path = None
    for d in range(depth):
        step = inc.join(_nodes(front, n), "entity_id").select(F.lit(d).alias("depth"), "entity_id", "link_id", "neighbor")  # links on the left: a hub's aren't held
        path = step if path is None else path.unionByName(step)
        front = step.select(F.col("neighbor").alias("entity_id")).distinct().join(_nodes(seen, n_seen), "entity_id", "left_anti").withColumn("depth", F.lit(d + 1))
        if d + 1 < depth:
            front = checkpointed(front)  # the next level's plan starts from its rows
            n = front.count()
            n_seen += n
        seen = seen.unionByName(front)
    reached = seen.join(g.entities.select("entity_id", "label"), "entity_id").select("entity_id", "label", "depth")
    empty = spark.createDataFrame([], "depth int, entity_id string, link_id string")
    return reached, empty if path is None else path.drop("neighbor")


def resolve(g: OntologyFrames) -> DataFrame:
    """entity_id, role, canonical, members, resolution_id, confidence, method: merged, canonical or independent."""
    r = g.resolutions.select("resolution_id", "canonical", "members", "confidence", F.lower(F.regexp_replace("method", r"\+", "")).alias("method"))
    of_member = r.select(F.explode("members").alias("entity_id"), F.struct(*r.columns).alias("r")).groupBy("entity_id").agg(F.min_by("r", "r.resolution_id").alias("m"))
    of_canonical = r.groupBy(F.col("canonical").alias("entity_id")).agg(F.min_by(F.struct(*r.columns), "resolution_id").alias("c"))
    e = g.entities.join(of_member, "entity_id", "left").join(of_canonical, "entity_id", "left")
    merged, canon = F.col("merged_into").isNotNull(), F.coalesce(F.size("resolved_from"), F.lit(-1)) > 0
    pick = lambda f: F.when(merged, F.col(f"m.{f}")).when(canon, F.col(f"c.{f}"))
    members = F.when(canon & ~merged, F.col("resolved_from")).otherwise(F.coalesce(pick("members"), F.array().cast("array<string>")))
    return e.select("entity_id", F.when(merged, "member").when(canon, "canonical").otherwise("independent").alias("role"), F.when(merged, F.col("merged_into")).when(canon, F.col("entity_id")).alias("canonical"), members.alias("members"), pick("resolution_id").alias("resolution_id"), pick("confidence").alias("confidence"), pick("method").alias("method"))


def show(g: OntologyFrames) -> DataFrame:
    """One row: the document's ids and the size of each main collection."""
    out = g.version.select("ontology_id", "profile", "version_id").limit(1)
    for name in ("entities", "entity_types", "links", "resolutions", "facts", "sources"):
        out = out.join(getattr(g, name).agg(F.count("*").alias(name)), how="cross")  # one row each
    return out


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``ord``, its place by ``by``: for results small enough to show."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*by)) - 1)
