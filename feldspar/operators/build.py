"""Steps of a build: files to sources, texts to facts, facts to a graph; incremental against the prior build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feldspar.functions.text import action_verb, content_hash, first_sentence, glob_regex, modality, normalize, redact, sha12, slug
from feldspar.model import OntologyFrames
from feldspar.operators.documents import blocks


@dataclass(frozen=True)
class Config:
    """Thresholds of a build, with their defaults."""

    merge: float = 0.8
    verify: float = 0.9
    close_after: int = 3
    support: float = 0.7
    blast: int = 50
    penalty: int = 1
    alert: float = 0.15
    demote: float = 0.35


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore line matches the path or its last part; a trailing slash makes a prefix."""
    name, out = F.regexp_extract(path, r"([^/]*)$", 1), F.lit(False)
    for p in (x.strip() for x in patterns):
        if p and not p.startswith("#"):
            out |= path.startswith(p) if p.endswith("/") else path.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
    return out


def ingest(spark: SparkSession, folder: str, ignore: list[str] = ()) -> DataFrame:
    """source_id, path, kind, hash, content of each file below ``folder``; hidden and ignored ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/*", "/")
    rel = F.expr("substring(p, length(b) + 2)")
    f = files.withColumn("p", F.regexp_replace("path", "^file:/*", "/")).withColumn("b", base).withColumn("rel", rel)
    f = f.where(~F.col("rel").rlike(r"(^|/)\.") & ~ignored(F.col("rel"), list(ignore)))
    return mint_ids(f.select(F.col("rel").alias("path"), modality(F.col("rel")).alias("kind"), content_hash(F.col("content")).alias("hash"), "content"))


def mint_ids(files: DataFrame) -> DataFrame:
    """``files`` (path) with source_id: src- and the path's slug; of equal slugs all but the first get 8 hex digits more."""
    s = files.withColumn("__base", F.concat(F.lit("src-"), slug(F.col("path"), "-")))
    n = F.row_number().over(Window.partitionBy("__base").orderBy("path"))
    return s.withColumn("source_id", F.when(n == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.left(F.sha2("path", 256), F.lit(8))))).drop("__base")


def describe(texts: DataFrame) -> DataFrame:
    """Facts of texts (source_id, text): for each block its first sentence (knowledge, 0.7), and its action if any (0.6)."""
    seg = texts.select("source_id", F.posexplode(blocks(F.col("text"))).alias("seg", "b")).select("source_id", "seg", "b.label", "b.text")
    said, verb = first_sentence(F.col("text")), action_verb(F.col("text"))
    fact = lambda kind, c, n: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"), F.lit(n).alias("n"))
    rows = seg.withColumn("f", F.explode(F.array_compact(F.array(fact("knowledge", 0.7, 1), F.when(verb.isNotNull(), fact("action", 0.6, 2))))))
    return rows.select(F.concat(F.col("source_id"), F.lit("-s"), (F.col("seg") + 1).cast("string"), F.lit("-f"), F.col("f.n").cast("string")).alias("fact_id"), "f.kind", said.alias("text"), "f.confidence", F.lit("claimed").alias("fidelity"), "source_id", "label")


def materialize_facts(extracted: DataFrame, patterns: tuple[str, ...] = ()) -> DataFrame:
    """Facts of extractions (source_id, facts array<struct<kind,text,confidence,fidelity,locator>>), redacted; off-list values become defaults."""
    e = extracted.select("source_id", F.posexplode("facts").alias("n", "f"))
    kinds = ("knowledge", "action", "requirement", "decision", "metric", "definition")
    c = F.col("f.confidence")
    return e.select(F.concat("source_id", F.lit("-f"), (F.col("n") + 1).cast("string")).alias("fact_id"), F.when(F.col("f.kind").isin(*kinds), F.col("f.kind")).otherwise("knowledge").alias("kind"), redact(F.col("f.text"), patterns).alias("text"), F.when((c >= 0) & (c <= 1), c).otherwise(0.5).alias("confidence"), F.when(F.col("f.fidelity") == "guessed", "guessed").otherwise("claimed").alias("fidelity"), "source_id", F.coalesce("f.locator", F.lit("document")).alias("label"))


def classify(prior: DataFrame, current: DataFrame) -> DataFrame:
    """source_id, change: new, changed (another hash), unchanged or deleted."""
    p, c = prior.select("source_id", F.col("hash").alias("p")), current.select("source_id", F.col("hash").alias("c"))
    how = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "deleted").when(F.col("p") != F.col("c"), "changed").otherwise("unchanged")
    return p.join(c, "source_id", "full_outer").select("source_id", how.alias("change"))


def carried(prior_facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Prior facts whose first source is unchanged."""
    kept = changes.where("change = 'unchanged'").select(F.col("source_id").alias("__s"))
    return prior_facts.withColumn("__s", F.get("source_refs", F.lit(0))["source_id"]).join(kept, "__s", "left_semi").drop("__s")


def retired(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Operations that deprecate prior entities which are gone."""
    return prior.select("entity_id").join(current.select("entity_id"), "entity_id", "left_anti").select(F.lit("deprecate_entity").alias("op"), F.col("entity_id").alias("target"))


def stability(prior: DataFrame, types: DataFrame, close_after: int = 3) -> DataFrame:
    """type_id, builds, closed: prior builds plus one; closed once it was, or at ``close_after`` builds."""
    j = types.select("type_id").join(prior, "type_id", "left")
    n = F.coalesce("builds", F.lit(0)) + 1
    return j.select("type_id", n.alias("builds"), (F.coalesce("closed", F.lit(False)) | (n >= close_after)).alias("closed"))


def glossary_match(facts: DataFrame, forms: DataFrame) -> DataFrame:
    """fact_id, type, term: the first glossary group (pos, term, type, form) a form of which the text holds, whatever the case; else Topic.

    A form may lie anywhere in the text, within words too. The forms are a glossary, so they are broadcast; each text is
    compared with each form.
    """
    texts = facts.select("fact_id", F.lower("text").alias("t"))
    f = forms.select("pos", "term", "type", F.lower("form").alias("form")).where("form <> ''")
    hit = texts.join(F.broadcast(f), F.contains("t", "form")).groupBy("fact_id").agg(F.min_by(F.struct("term", "type"), "pos").alias("g"))
    return facts.select("fact_id").join(hit, "fact_id", "left").select("fact_id", F.coalesce("g.type", F.lit("Topic")).alias("type"), F.col("g.term").alias("term"))


def model(facts: DataFrame, forms: DataFrame) -> dict[str, DataFrame]:
    """Types and entities of facts: one entity for each natural key, with the labels of its facts as sourced aliases."""
    m = facts.join(glossary_match(facts, forms), "fact_id").withColumn("label", first_sentence(F.col("text")))
    m = m.withColumn("type_id", F.concat(F.lit("et_"), slug(F.col("type")))).withColumn("key", F.concat_ws("|", "type_id", F.coalesce("term", normalize(F.col("label")))))
    ids = lambda c: F.array_sort(F.collect_set(c))
    e = m.groupBy("key", "type_id").agg(F.coalesce(F.max("term"), F.min("label")).alias("label"), F.array_sort(F.collect_set(F.struct(F.col("label").alias("text"), "source_id"))).alias("aliases"), ids("fact_id").alias("fact_ids"), ids("source_id").alias("source_ids"))
    e = e.select(F.concat(F.lit("e_"), sha12(F.col("key"))).alias("entity_id"), "type_id", "label", F.lit("active").alias("status"), "aliases", "fact_ids", "source_ids")
    t = m.groupBy("type_id").agg(F.min("type").alias("name"), ids("fact_id").alias("fact_ids"), ids("source_id").alias("source_ids")).withColumn("status", F.lit("active"))
    p = t.select(F.col("type_id").alias("owner_id"), F.lit("type").alias("owner_kind"), F.lit("name").alias("prop"), F.lit("string").alias("value_kind"), F.lit("one").alias("cardinality"), F.lit(True).alias("required"), F.lit(True).alias("identity"))
    v = e.select("entity_id", F.lit("name").alias("prop"), F.lit(0).alias("pos"), F.concat(F.lit('"'), F.replace(F.col("label"), F.lit('"'), F.lit('\\"')), F.lit('"')).alias("value"), "fact_ids", F.lit("claimed").alias("fidelity"))
    return {"entities": e, "entity_types": t, "prop_schemas": p, "entity_props": v}


def build(texts: DataFrame, forms: DataFrame, prior: OntologyFrames | None = None, config: Config | None = None) -> OntologyFrames:
    """The graph of texts (source_id, kind, hash, text); with a prior graph only new and changed texts are read again."""
    from feldspar.operators.resolution import resolve_entities

    config = config or Config()
    spark, fresh, kept = texts.sparkSession, texts, None
    if prior is not None:
        changes = classify(prior.sources, texts)
        fresh = texts.join(changes.where("change IN ('new', 'changed')"), "source_id", "left_semi")
        old = carried(prior.facts, changes)
        kept = old.select("fact_id", "kind", "text", "confidence", "fidelity", F.get("source_refs", F.lit(0))["source_id"].alias("source_id"), F.get("source_refs", F.lit(0))["span"]["label"].alias("label"))
    facts = describe(fresh)
    facts = facts if kept is None else facts.unionByName(kept)
    m = model(facts, forms)
    span = F.struct(F.lit("doc").alias("kind"), F.col("label").alias("label"))
    full = F.from_json(F.to_json(F.array(F.struct("source_id", span.alias("span")))), OntologyFrames.of(spark).facts.schema["source_refs"].dataType)
    rows = facts.withColumn("source_refs", full)
    sources = texts.select("source_id", "kind", "hash", F.col("source_id").alias("map_key"))
    hashes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "hash"))))
    version = texts.agg(hashes.alias("source_hashes")).select(F.lit("ontology.v1").alias("schema"), F.concat(F.lit("ont-"), sha12(F.array_join(F.array_sort(F.map_values("source_hashes")), ","))).alias("ontology_id"), F.lit("default").alias("profile"), F.concat(F.lit("v-"), sha12(F.to_json("source_hashes"))).alias("version_id"), "source_hashes")
    g = OntologyFrames.of(spark, sources=sources, facts=rows.withColumn("map_key", F.col("fact_id")), version=version, **m)
    g = resolve_entities(g, config.merge, config.verify)
    if prior is not None:
        ops = retired(prior.entities, g.entities).withColumn("pos", F.row_number().over(Window.orderBy("target")) - 1)
        g = g.with_(operations=OntologyFrames.of(spark, operations=ops).operations)
    return g


def apply_feedback(g: OntologyFrames, feedback: DataFrame) -> tuple[OntologyFrames, DataFrame]:
    """The graph with the pending feedback (feedback_id, kind, targets, link_type, fact_ids, detail, status) applied, and the log.

    add_link needs both ends and at least one known cited fact; else it becomes a note with the reason, ends first.
    """
    todo = feedback.where("status = 'pending'")
    known = todo.select("feedback_id", F.explode("fact_ids").alias("fact_id")).join(g.facts.select("fact_id"), "fact_id").groupBy("feedback_id").agg(F.array_sort(F.collect_set("fact_id")).alias("cited"))
    ends = todo.select("feedback_id", F.explode(F.array_distinct("targets")).alias("entity_id")).join(g.entities.select("entity_id"), "entity_id").groupBy("feedback_id").agg(F.count("*").alias("n"))
    j = todo.join(known, "feedback_id", "left").join(ends, "feedback_id", "left")
    why = F.when(F.col("kind") != "add_link", "recorded").when((F.size("targets") != 2) | (F.coalesce("n", F.lit(0)) < F.size(F.array_distinct("targets"))), "unknown endpoint").when(F.coalesce(F.size("cited"), F.lit(0)) <= 0, "no known fact")
    j = j.withColumn("why", why)
    good = j.where("why IS NULL").select(F.concat(F.lit("l_fb_"), sha12(F.col("feedback_id"))).alias("link_id"), F.concat(F.lit("lt_"), slug(F.col("link_type"))).alias("link_type_id"), F.col("link_type").alias("name"), F.get("targets", F.lit(0)).alias("from_id"), F.get("targets", F.lit(1)).alias("to_id"), F.lit("guessed").alias("fidelity"), F.col("cited").alias("fact_ids"))
    spark = feedback.sparkSession
    kinds = good.groupBy("link_type_id").agg(F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fact_ids")))).alias("fact_ids")).join(g.link_types.select("link_type_id"), "link_type_id", "left_anti")
    kinds = kinds.select("*", F.col("link_type_id").alias("map_key"), F.lit("*").alias("from_type_id"), F.lit("*").alias("to_type_id"))
    new = OntologyFrames.of(spark, links=good.withColumn("map_key", F.col("link_id")), link_types=kinds)
    start = g.notes.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("start"))  # one row
    notes = j.where("why IS NOT NULL").join(start, how="cross").select((F.row_number().over(Window.orderBy("feedback_id")) - 1 + F.col("start")).cast("int").alias("pos"), F.concat_ws(": ", "kind", "why", "detail").alias("text"))
    status = F.when(F.col("why").isNull(), "applied").when(F.col("why") == "recorded", "recorded").otherwise("quarantined")
    log = feedback.join(j.select("feedback_id", status.alias("__new")), "feedback_id", "left").withColumn("status", F.coalesce("__new", "status")).select(feedback.columns)
    return g.with_(links=g.links.unionByName(new.links), link_types=g.link_types.unionByName(new.link_types), notes=g.notes.unionByName(notes)), log


def migrate(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Entities, types, links and link types of an older graph: nodes (id, kind, label, fact_ids), edges (source, target, kind, fidelity, fact_ids)."""
    e = nodes.where(F.size("fact_ids") > 0).select(F.col("id").alias("node"), F.concat(F.lit("e_"), sha12(F.concat(F.lit("node|"), "id"))).alias("entity_id"), F.concat(F.lit("et_"), slug(F.initcap("kind"))).alias("type_id"), F.initcap("kind").alias("name"), "label", "fact_ids")
    ends = e.select("node", "entity_id")
    joined = edges.join(ends.withColumnsRenamed({"node": "source", "entity_id": "from_id"}), "source").join(ends.withColumnsRenamed({"node": "target", "entity_id": "to_id"}), "target")
    kind = F.concat(F.lit("lt_"), slug(F.col("kind")))
    links = joined.select(F.concat(F.lit("l_"), sha12(F.concat_ws("|", kind, "from_id", "to_id"))).alias("link_id"), kind.alias("link_type_id"), F.col("kind").alias("name"), "from_id", "to_id", F.when(F.col("fidelity") == "confirmed", "claimed").otherwise(F.col("fidelity")).alias("fidelity"), "fact_ids").dropDuplicates(["link_id"])
    first = lambda d, k: d.groupBy(k).agg(F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fact_ids")))).alias("fact_ids"))
    kinds = first(links, "link_type_id").select("*", F.lit("*").alias("from_type_id"), F.lit("*").alias("to_type_id"))
    return {"entities": e.drop("node", "name").withColumn("status", F.lit("active")), "entity_types": first(e, "type_id"), "links": links.drop("name"), "link_types": kinds}
