"""Entity resolution by surface forms: blocking without loss, scoring, reversible merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feldspar.functions.text import normalize, sha12, surface_sim, tokens
from feldspar.model import OntologyFrames
from feldspar.session import checkpointed


def surfaces(g: OntologyFrames) -> DataFrame:
    """entity_id, type_id, surface: labels and aliases, each once."""
    all_ = F.array_distinct(F.concat(F.array("label"), F.coalesce(F.transform("aliases", lambda a: a["text"]), F.array().cast("array<string>"))))
    return g.entities.select("entity_id", "type_id", F.explode(all_).alias("surface")).where("surface IS NOT NULL")


def candidates(s: DataFrame) -> DataFrame:
    """a, b (a < b) of one type with a similarity above 0, and the best.

    Forms whose normal form is the same or that share a token meet on it; a form that lies within another's characters
    has its first two characters there, so it meets the other's character pairs. Forms are grouped first, so that many
    entities with one form are compared once.
    """
    forms = s.select("type_id", "surface").distinct().withColumn("n", normalize(F.col("surface"))).where("n <> ''")
    token = forms.select("type_id", "surface", F.explode(F.array_distinct(tokens(F.col("surface")))).alias("k"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("n") - 1), lambda i: F.substring(F.col("n"), i, F.lit(2)))
    grams = forms.select("type_id", "surface", "n", F.explode(F.array_distinct(pairs)).alias("k"))
    first = forms.select("type_id", F.col("surface").alias("short"), F.left("n", F.lit(2)).alias("k"), F.col("n").alias("m"))
    within = grams.join(first, ["type_id", "k"]).where("surface <> short AND contains(n, m)").select("type_id", F.least("surface", "short").alias("x"), F.greatest("surface", "short").alias("y"))
    shared = token.alias("p").join(token.alias("q"), ["type_id", "k"]).where("p.surface < q.surface").select("type_id", F.col("p.surface").alias("x"), F.col("q.surface").alias("y"))
    same = forms.select("type_id", F.col("surface").alias("x"), F.col("surface").alias("y"))
    scored = within.unionByName(shared).distinct().unionByName(same).withColumn("score", surface_sim(F.col("x"), F.col("y")))
    of = s.select("type_id", "surface", "entity_id")
    both = scored.join(of.withColumnsRenamed({"surface": "x", "entity_id": "e"}), ["type_id", "x"]).join(of.withColumnsRenamed({"surface": "y", "entity_id": "f"}), ["type_id", "y"]).where("e <> f")
    return both.groupBy(F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")).agg(F.max("score").alias("confidence")).where("confidence > 0")


def decide(pairs: DataFrame, merge: float = 0.8, verify: float = 0.9) -> DataFrame:
    """``pairs`` with decision and method: rejected below ``merge``; accepted at 1; else the judge (at least 0.5), and below ``verify`` the verifier too (at least 0.9, so it refuses)."""
    c = F.col("confidence")
    method = F.when(c == 1, "deterministic").when(c >= verify, "agent").otherwise("agent+verified")
    return pairs.withColumn("accepted", (c == 1) | ((c >= merge) & (c >= 0.5) & ((c >= verify) | (c >= 0.9)))).withColumn("method", F.when(c >= merge, method))


def components(edges: DataFrame) -> DataFrame:
    """entity_id, root: the smallest id among those that ``edges`` (a, b) connect; by least neighbours and shortcuts."""
    both = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    label = both.select(F.col("u").alias("entity_id")).distinct().withColumn("root", F.col("entity_id"))
    while True:
        near = both.join(label.withColumnRenamed("entity_id", "v"), "v").groupBy(F.col("u").alias("entity_id")).agg(F.min("root").alias("m"))
        step = label.join(near, "entity_id").select("entity_id", F.least("root", "m").alias("root"))
        jump = step.select(F.col("entity_id").alias("root"), F.col("root").alias("next"))
        new = checkpointed(step.join(jump, "root").select("entity_id", F.col("next").alias("root")))
        if not new.join(label.withColumnRenamed("root", "old"), "entity_id").where("root <> old").limit(1).count():
            return new
        label = new


def resolve_entities(g: OntologyFrames, merge: float = 0.8, verify: float = 0.9) -> OntologyFrames:
    """The graph with a reversible resolution for each cluster of accepted pairs.

    The canonical entity has the most facts, ties to the smallest id. Confidence is the least of the cluster's edges.
    """
    edges = checkpointed(decide(candidates(surfaces(g)), merge, verify).where("accepted"))
    roots = components(edges)
    info = roots.join(g.entities.select("entity_id", "fact_ids"), "entity_id").withColumn("n", F.greatest(F.size("fact_ids"), F.lit(0)))
    clusters = info.groupBy("root").agg(F.array_sort(F.collect_list("entity_id")).alias("all"), F.min_by("entity_id", F.struct(-F.col("n"), "entity_id")).alias("canonical"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fact_ids")))).alias("evidence"))
    conf = edges.join(roots.withColumnRenamed("entity_id", "a"), "a").groupBy("root").agg(F.round(F.min("confidence"), 4).alias("confidence"), F.max("method").alias("method"))
    made = clusters.join(conf, "root").select(F.concat(F.lit("r_"), sha12(F.array_join("all", ","))).alias("resolution_id"), "canonical", F.filter("all", lambda m: m != F.col("canonical")).alias("members"), "evidence", "confidence", "method", F.lit(True).alias("reversible"))
    made = checkpointed(made).withColumn("map_key", F.col("resolution_id")).select(g.resolutions.columns)
    canon = made.select(F.col("canonical").alias("entity_id"), F.col("members").alias("from"))
    into = made.select(F.explode("members").alias("entity_id"), F.col("canonical").alias("into"))
    e = g.entities.join(canon, "entity_id", "left").join(into, "entity_id", "left")
    e = e.withColumn("resolved_from", F.coalesce("from", "resolved_from")).withColumn("merged_into", F.coalesce("into", "merged_into")).select(g.entities.columns)
    return g.with_(entities=e, resolutions=g.resolutions.unionByName(made))


def unresolve(g: OntologyFrames, ids: list[str]) -> OntologyFrames:
    """The graph without these resolutions, as it was before them."""
    gone = g.resolutions.where(F.col("resolution_id").isin(ids))
    canon = gone.groupBy(F.col("canonical").alias("entity_id")).agg(F.flatten(F.collect_list("members")).alias("out"))
    into = gone.select(F.explode("members").alias("entity_id"), F.col("canonical").alias("was")).distinct()
    e = g.entities.join(canon, "entity_id", "left").join(into, ["entity_id"], "left")
    left = F.filter("resolved_from", lambda m: ~F.coalesce(F.array_contains("out", m), F.lit(False)))
    e = e.withColumn("resolved_from", F.when(F.size(left) > 0, left)).withColumn("merged_into", F.when(F.col("merged_into").eqNullSafe(F.col("was")), None).otherwise(F.col("merged_into")))
    return g.with_(entities=e.select(g.entities.columns), resolutions=g.resolutions.where(~F.col("resolution_id").isin(ids)))


def fold_names(names: DataFrame) -> DataFrame:
    """name, canonical: for each signature the most frequent name, then the shortest, then the first. ``names``: name, n."""
    from pyspark.sql import Window

    from feldspar.functions.text import name_signature

    s = names.groupBy("name").agg(F.sum("n").alias("n")).withColumn("sig", name_signature(F.col("name")))
    best = F.first("name").over(Window.partitionBy("sig").orderBy(F.desc("n"), F.length("name"), "name"))
    return s.select("name", F.when(F.col("sig") == "", F.col("name")).otherwise(best).alias("canonical"))


def ends_of_chains(steps: dict[str, str]) -> dict[str, str]:
    """The last name of the chain that starts at each key; a chain that turns into a ring ends where it enters the ring."""
    out = {}
    for name in steps:
        met, at = set(), name
        while at in steps and at not in met:
            met.add(at)
            at = steps[at]
        out[name] = at
    return out


def canonical_names(names: DataFrame, proposals: list[tuple[str, str]] = ()) -> DataFrame:
    """name, canonical: names folded by signature, then by a model's ``proposals`` (from, to), a later one in place of an earlier.

    A proposal counts only if both names were observed and differ. Only observed names among the proposals come to the
    driver, so what is collected is bounded by the proposals' number.
    """
    spark, folded = names.sparkSession, fold_names(names)
    if not proposals:
        return folded
    named = spark.createDataFrame([(x,) for x in sorted({x for p in proposals for x in p})], "name string")
    known = {r["name"] for r in named.join(names.select("name"), "name", "left_semi").collect()}
    ends = ends_of_chains({a: b for a, b in proposals if a in known and b in known and a != b})
    to = spark.createDataFrame(list(ends.items()), "canonical string, end string")
    return folded.join(F.broadcast(to), "canonical", "left").select("name", F.coalesce("end", "canonical").alias("canonical"))
