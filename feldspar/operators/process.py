"""Process conformance: what is claimed of a logic unit's steps against what events show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feldspar.model import OntologyFrames


def logic_units(g: OntologyFrames) -> DataFrame:
    """logic_unit_id, name, state, trust_class, step_count, event_count."""
    s = g.lu_steps.groupBy("logic_unit_id").agg(F.count("*").alias("s"))
    e = g.events.groupBy("logic_unit_id").agg(F.count("*").alias("e"))
    return g.logic_units.join(s, "logic_unit_id", "left").join(e, "logic_unit_id", "left").select("logic_unit_id", "name", "state", "trust_class", F.coalesce("s", F.lit(0)).alias("step_count"), F.coalesce("e", F.lit(0)).alias("event_count"))


def steps(g: OntologyFrames) -> DataFrame:
    """A row a step: de_jure, de_facto, espoused, conflict and the status they make, in declared order (pos)."""
    has = lambda c: F.coalesce(F.bool_or(F.col("class") == c), F.lit(False))
    ev = g.lu_evidence.groupBy("logic_unit_id", "step_id").agg(has("de_jure").alias("de_jure"), has("de_facto").alias("seen"), has("espoused").alias("espoused"), F.coalesce(F.bool_or("contradicts"), F.lit(False)).alias("conflict"))
    happened = g.events.select("logic_unit_id", "step_id").distinct().withColumn("happened", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    s = g.lu_steps.join(ev, ["logic_unit_id", "step_id"], "left").join(happened, ["logic_unit_id", "step_id"], "left").join(g.logic_units.select("logic_unit_id", "name", "state", "trust_class"), "logic_unit_id")
    s = s.select("logic_unit_id", "name", "state", "trust_class", "pos", "step_id", "text", no("de_jure"), F.coalesce(F.col("seen") | F.col("happened"), F.col("happened"), F.col("seen"), F.lit(False)).alias("de_facto"), no("espoused"), no("conflict"))
    status = F.when(F.col("conflict"), "conflict").when(F.col("de_jure") & F.col("de_facto"), "confirmed").when(F.col("de_jure"), "de_jure_only").when(F.col("de_facto"), "de_facto_only").when(F.col("espoused"), "espoused_only").otherwise("unsupported")
    return s.withColumn("status", status)


STATUSES = ("confirmed", "de_jure_only", "de_facto_only", "espoused_only", "conflict", "unsupported")


def conformance_summary(g: OntologyFrames) -> DataFrame:
    return steps(g).groupBy("logic_unit_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def distance(a: Column, b: Column) -> Column:
    """1 less the Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def drift(g: OntologyFrames, current: DataFrame | None = None) -> DataFrame:
    """Executable units with a contract: baseline_steps, current_steps (sorted; of ``current`` events, or all of the graph's) and their distance."""
    seen = (g.events if current is None else current).groupBy("logic_unit_id").agg(F.array_sort(F.collect_set("step_id")).alias("current_steps"))
    none = F.array().cast("array<string>")
    c = g.lu_contracts.join(g.logic_units.where("state = 'executable'").select("logic_unit_id", "name"), "logic_unit_id").join(seen, "logic_unit_id", "left")
    c = c.select("logic_unit_id", "name", F.coalesce("baseline_steps", none).alias("baseline_steps"), F.coalesce("current_steps", none).alias("current_steps"))
    return c.withColumn("drift", distance(F.col("baseline_steps"), F.col("current_steps")))


def drift_action(d: Column, alert: float = 0.15, demote: float = 0.35) -> Column:
    return F.when(d >= demote, "demote").when(d >= alert, "alert").otherwise("none")


def run_conformance(g: OntologyFrames, current: DataFrame | None = None, alert: float = 0.15, demote_at: float = 0.35) -> tuple[OntologyFrames, DataFrame]:
    """Demotes units that drifted too far: the graph after that, and logic_unit_id, drift, action of those with an action.

    A demoted unit is observed again, without contract, with an operation by ``system``; each action leaves a note.
    """
    acted = drift(g, current).select("logic_unit_id", "drift", drift_action(F.col("drift"), alert, demote_at).alias("action")).where("action <> 'none'")
    gone = acted.where("action = 'demote'").select("logic_unit_id", "drift")
    units = g.logic_units.join(gone.withColumnRenamed("drift", "far"), "logic_unit_id", "left")
    units = units.withColumn("state", F.when(F.col("far").isNotNull(), "observed").otherwise(F.col("state"))).select(g.logic_units.columns)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("logic_unit_id"))  # executable units that drifted: few
    last = lambda df: df.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    pos = (F.col("last") + F.col("k")).cast("int").alias("pos")
    why = F.format_string("drift %.2f", "drift")
    ops = gone.withColumn("k", place).crossJoin(last(g.operations))
    ops = ops.select(pos, F.lit("demote").alias("op"), F.col("logic_unit_id").alias("target"), F.lit("system").alias("author"), why.alias("detail"))
    note = F.to_json(F.struct(F.concat(F.lit("conformance_"), "action").alias("kind"), "logic_unit_id", "drift", why.alias("text")))
    notes = acted.withColumn("k", place).crossJoin(last(g.notes)).select(pos, note.alias("text"))
    contracts = g.lu_contracts.join(gone, "logic_unit_id", "left_anti")
    out = g.with_(logic_units=units, lu_contracts=contracts, operations=g.operations.unionByName(ops), notes=g.notes.unionByName(notes))
    return out, acted


def floor_level(reversibility: Column, blast: Column, trust: Column, large: int = 50, penalty: int = 1) -> Column:
    """The highest level of autonomy: 3 or 2 if reversible, 1 or 0 if not, by blast radius; less a penalty if judged."""
    base = F.when(reversibility == "reversible", F.when(blast > large, 2).otherwise(3)).otherwise(F.when(blast > large, 0).otherwise(1))
    return F.greatest(F.lit(0), base - F.when(trust == "judged", penalty).otherwise(0))


def eligible(g: OntologyFrames, least: float = 0.7) -> DataFrame:
    """logic_unit_id, ratio of attested steps, reasons against promotion (none: eligible)."""
    s = steps(g).groupBy("logic_unit_id").agg(F.avg(F.col("de_facto").cast("int")).alias("r"), F.count_if("conflict").alias("conflicts"), F.count_if(F.col("espoused") & ~F.col("de_facto") & ~F.col("de_jure")).alias("fiction"))
    u = g.logic_units.join(s, "logic_unit_id", "left").withColumn("ratio", F.coalesce("r", F.lit(0.0)))
    why = F.array_compact(F.array(F.when(F.col("state") == "executable", "already executable"), F.when(F.col("conflicts") > 0, "conflicting evidence"), F.when(F.col("fiction") > 0, "espoused steps only"), F.when(F.col("ratio") < least, "too few attested steps")))
    return u.select("logic_unit_id", "ratio", why.alias("reasons"), (F.size(why) == 0).alias("eligible"))


def promote(g: OntologyFrames, unit: str, *, requested: int = 0, reversibility: str = "unknown", blast: int = 0, author: str = "user") -> OntologyFrames:
    """The unit executable at the lower of the requested level and its floor, with its attested steps as baseline."""
    low = floor_level(F.lit(reversibility), F.lit(blast), F.col("trust_class"))
    base = steps(g).where((F.col("logic_unit_id") == unit) & F.col("de_facto")).groupBy("logic_unit_id").agg(F.array_sort(F.collect_set("step_id")).alias("baseline_steps"))
    made = g.logic_units.where(F.col("logic_unit_id") == unit).join(base, "logic_unit_id", "left")
    level = lambda c: F.concat(F.lit("L"), c.cast("string"))
    none = F.array().cast("array<string>")
    row = made.select("logic_unit_id", F.lit(reversibility).alias("reversibility"), F.lit(blast).cast("bigint").alias("blast_entities"), F.lit(f"L{requested}").alias("requested"), level(low).alias("floor"), level(F.least(F.lit(requested), low)).alias("effective"), F.coalesce("baseline_steps", none).alias("baseline_steps"), none.alias("allowed_writes"), none.alias("output_writes"))
    units = g.logic_units.withColumn("state", F.when(F.col("logic_unit_id") == unit, "executable").otherwise(F.col("state")))
    return g.with_(logic_units=units, lu_contracts=g.lu_contracts.where(F.col("logic_unit_id") != unit).unionByName(row), operations=_logged(g, "promote", unit, author))


def demote(g: OntologyFrames, unit: str, *, author: str = "user") -> OntologyFrames:
    units = g.logic_units.withColumn("state", F.when(F.col("logic_unit_id") == unit, "observed").otherwise(F.col("state")))
    return g.with_(logic_units=units, lu_contracts=g.lu_contracts.where(F.col("logic_unit_id") != unit), operations=_logged(g, "demote", unit, author))


def _logged(g: OntologyFrames, op: str, target: str, author: str) -> DataFrame:
    n = g.operations.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("int").alias("pos"))
    return g.operations.unionByName(n.select("pos", F.lit(op).alias("op"), F.lit(target).alias("target"), F.lit(author).alias("author"), F.lit(None).cast("string").alias("detail")))
