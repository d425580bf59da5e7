"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens, then by its first DEPTH tokens; at that leaf, lines of MIN_HALVED
tokens or more have further nodes: by the first half of their tokens, by the first three quarters, and by the second half.
Tokens with a digit are
variable fields from the start, unless they are over half of the line: then all count as they are, so that unrelated
rows of figures differ.

A node that several documents reach learns as many templates as its lines need. Its lines come in order of document (by
id) and place: each takes the first template, started by another document, that it agrees with in MIN_SIMILAR of their
constant fields, and starts one if there is none. Where any line that takes the template differs from it, it has a
variable field. A template that keeps MIN_CONSTANT of its fields is boilerplate or a copied passage: its lines are dropped from all documents but the first, so one copy of a passage stays.
Templates of lines under MIN_HALVED tokens count only if lines of two documents besides the first take them, and lines under MIN_LEARNED tokens are compared as wholes only: in short lines of prose a word or two differ by chance.
Equal lines (digits aside) are the same template whatever else the tree holds, and are dropped likewise. A line under
MIN_TOKENS tokens says little: its template is the line itself, digits included, and recurs if SHORT_DOCUMENTS documents
hold it. Lines repeated within one document only stay. A passage that lies within a longer line, or that is broken into
lines at other places, is missed (README: recall).

Lines are compared by FIELDS fields of equal numbers of tokens (but for one) and eight bits a field, one word in all;
whole lines by 128 bits. Lines are parsed and compared by built-in functions without lambdas, so that this
is compiled. Only hashes, row keys and fields are shuffled; texts once, to drop their lines. A node's first line and its
counts are aggregated before the shuffle, and each join is an equi-join whose large side may be split, so a very common
line is no hot task. Most lines of a node take its first template, which needs one join. The others are grouped by equal
fields, and the groups dealt to keys that two of them share if and only if they are alike; by these keys the further
templates are found in rounds, without comparing pairs, until no line is left.

Edge cases: null texts stay null; lines are split at \\n and kept ones rejoined unchanged; rows with equal id and text
are one document; rows with equal id and different texts are not; a text that loses all its lines becomes empty (or its
row is dropped, if asked); blank lines, and short ones without a letter (rules, brackets, bare numbers), are layout and
stay; extra columns are passed on, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feldspar.llm.common import SPACE, new_dir, scratch, written

DEPTH, MIN_TOKENS, MIN_LEARNED, MIN_HALVED, SHORT_DOCUMENTS = 3, 5, 8, 14, 10
MIN_SIMILAR, MIN_CONSTANT, FIELDS = 0.7, 0.5, 8
VARIABLE = "<*>"
#: Pairs of these blocks of fields: lines that differ in at most two fields have one pair in common.
BLOCKS = ((0, 4), (1, 5), (2, 6), (3, 7))


def _byte(tokens: Column, f: int) -> Column:
    return F.shiftleft(F.pmod(F.xxhash64(tokens), F.lit(256)), 8 * f)


def _word(of: Callable[[int], Column]) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), map(of, range(FIELDS)))


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (i, row, line, body) as i, row, line, n, short, w1 and w2 (hashes of the whole), leaf, left, most and
    right (hashes of the nodes; null where a line has none) and s (its fields); w1 of layout lines is null."""
    body = F.col("body")
    flat = F.trim(F.when(body.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(body, f"[{SPACE}]+", " ")).otherwise(body))
    masked = F.when(F.col("flat").rlike("[0-9]"), F.regexp_replace("flat", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(F.col("flat"))
    gaps = lambda c, mark: F.octet_length(c) - F.octet_length(F.replace(c, F.lit(mark), F.lit("")))
    n_variable = F.floor(gaps(F.col("masked"), VARIABLE) / len(VARIABLE))
    # one projection a step, and no filter, which would be pushed below them, so that nothing is computed twice
    a = lines.select("i", "row", "line", flat.alias("flat"))
    b = a.select("*", masked.alias("masked"), (gaps(F.col("flat"), " ") + 1).alias("n"))
    short = F.col("n") < MIN_TOKENS
    shape = F.when(short, F.when(F.col("flat").rlike(r"\p{L}"), F.col("flat"))).when(2 * n_variable > F.col("n"), F.col("flat")).otherwise(F.col("masked"))
    c = b.select("i", "row", "line", "n", short.alias("short"), shape.alias("shape"))
    d = c.select("*", F.split("shape", " ").alias("t"), F.shiftright(F.col("n") + DEPTH, 1).alias("half"))
    t, n, half = F.col("t"), F.col("n"), F.col("half")

    def field(f: int) -> Column:
        start = F.shiftright(n * f, 3)
        return _byte(F.slice(t, start + 1, F.shiftright(n * (f + 1), 3) - start), f)

    first, head, tail = F.slice(t, F.lit(1), F.lit(DEPTH)), F.slice(t, F.lit(1), half), F.slice(t, half + 1, n - half)
    long_ = n >= MIN_HALVED
    return d.select(
        "i", "row", "line", "n", "short", F.when(F.col("shape") != "", F.xxhash64("short", "shape")).alias("w1"), F.xxhash64(F.lit(2), "short", "shape").alias("w2"),
        F.when(n >= MIN_LEARNED, F.xxhash64(n, first)).alias("leaf"), F.when(long_, F.xxhash64(n, F.lit("<"), head)).alias("left"),
        F.when(long_, F.xxhash64(n, F.lit("<<"), F.slice(t, F.lit(1), F.shiftright(3 * n, 2)))).alias("most"), F.when(long_, F.xxhash64(n, F.lit(">"), first, tail)).alias("right"), _word(field).alias("s"),
    )


def _filled(x: Column) -> Column:
    """The lowest bit of each byte of a word that isn't 0."""
    for by, within in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3F3F3F3F3F3F3F3F), (1, 0x7F7F7F7F7F7F7F7F)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by).bitwiseAND(F.lit(within)))
    return x.bitwiseAND(F.lit(0x0101010101010101))


def constant(s: Column, o: Column) -> Column:
    """The fields, as bits, that aren't one variable token in both of two lines."""
    variable = _word(lambda f: _byte(F.array(F.lit(VARIABLE)), f))
    return _filled(s.bitwiseXOR(variable).bitwiseOR(o.bitwiseXOR(variable)))


def agreed(s: Column, o: Column) -> Column:
    """The constant fields, as bits, that are the same in two lines."""
    return constant(s, o).bitwiseAND(F.bitwise_not(_filled(s.bitwiseXOR(o))))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("i"), _row(id_col, text_col).alias("row"), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    return written(parsed(rows), new_dir(docs.sparkSession, "lines")).where("w1 IS NOT NULL")  # read again below; parsing costs more


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def _taken(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that take a template (row, line, node: a hash of the template), and the templates that count (node, seed, n, mask, n_lines)."""
    each = F.explode(F.array_compact(F.array("leaf", "left", "most", "right"))).alias("node")
    nodes = lines.where(F.col("leaf").isNotNull()).select("i", "row", "line", "n", "s", each)
    seed = F.min(F.struct("i", "row", "line", "s")).alias("seed")
    shared = nodes.groupBy("node").agg(seed, F.max(F.struct("i", "row")).alias("last")).where("seed.row <> last.row").select("node", "seed")
    hits = nodes.join(shared, "node")
    pair = F.col("s"), F.col("seed.s")
    alike = F.bit_count(agreed(*pair)) >= MIN_SIMILAR * F.bit_count(constant(*pair))
    first = alike & (F.col("row") != F.col("seed.row"))
    rest = F.when(~first, F.struct("i", "s")).alias("rest")
    hits = hits.where(first | (F.col("s") != F.col("seed.s"))).select("row", "line", "n", "node", "seed", agreed(*pair).alias("mask"), rest)
    hits = written(hits, new_dir(lines.sparkSession, "line-templates"))
    taken = hits.where("rest IS NULL").drop("rest")
    rest = hits.where("rest IS NOT NULL").select("rest.*", "row", "line", "n", "node")
    if not rest.isEmpty():
        taken = taken.unionByName(written(_further(rest), new_dir(lines.sparkSession, "line-templates")))
    learned = taken.groupBy("node").agg(F.min("seed").alias("seed"), F.min("n").alias("n"), F.bit_and("mask").alias("mask"), F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n_lines"))
    enough = (F.col("n") >= MIN_HALVED) | (F.col("low") != F.col("high"))
    return taken, learned.where(enough & (F.bit_count("mask") >= MIN_CONSTANT * F.least("n", F.lit(FIELDS))))


def _key(fields: tuple[int, ...], number: int) -> Column:
    """The given fields of s, and which they are."""
    bits = sum(0xFF << 8 * f for f in fields)
    return F.struct(F.lit(number).alias("which"), F.col("s").bitwiseAND(F.lit(bits - (bits >> 63 << 64))).alias("held"))


def _rough() -> Column:
    """Keys of which lines that are alike share one."""
    return F.array(*(_key(x + y, k) for k, (x, y) in enumerate(combinations(BLOCKS, 2))))


def _exact() -> Column:
    """Keys, by s and its constant fields (bits), of which lines of different fields share one if and only if they are alike.

    Of c constant fields, 0.3 c may differ: two if at most one of the eight is variable in both, one if at most four are.
    """
    keys = []
    for size, least, most in ((6, 0, 1), (7, 2, 4)):
        for fields in combinations(range(FIELDS), size):
            n_variable = size - F.bit_count(F.col("bits").bitwiseAND(F.lit(sum(1 << 8 * f for f in fields))))
            keys.append(F.when(n_variable.between(least, most), _key(fields, len(keys))))
    return F.array_compact(F.array(*keys))


def _dealt(groups: DataFrame, keys: Column) -> DataFrame:
    """``groups`` by those of their keys (key) that several documents hold."""
    held = groups.select("*", F.explode(keys).alias("key"))
    live = held.groupBy("node", "key").agg(F.min(F.struct("i", "row")).alias("first"), F.max("last").alias("last")).where("first.row <> last.row")
    return held.join(live.select("node", "key"), ["node", "key"], "left_semi")


def _seeds(dealt: DataFrame) -> DataFrame:
    """Of groups by key, those that start a template: no earlier one of another document that they share a key with does.

    A round settles each group that has no unsettled one before it, and those that share a key with it; at least the
    first group of each node. Groups of one key have at most 65,536 different fields.
    """
    spark, left, paths = dealt.sparkSession, dealt.drop("last"), []
    by_key, by_group = Window.partitionBy("node", "key"), Window.partitionBy("node", "s")
    while not left.isEmpty():
        paths.append(new_dir(spark, "line-seeds"))
        headed = left.withColumn("head", F.min(F.struct("i", "row")).over(by_key)["row"])
        seeds = headed.withColumn("seed", F.min(F.col("head") == F.col("row")).over(by_group))
        led = seeds.withColumn("led", F.max("seed").over(by_key) & (F.col("head") != F.col("row")))
        settled = written(led.withColumn("taken", F.max("led").over(by_group)).drop("head", "led"), paths[-1])
        left = settled.where("NOT seed AND NOT taken").drop("seed", "taken")
    return spark.read.schema(settled.schema).parquet(*paths).where("seed").drop("seed", "taken") if paths else left


def _further(rest: DataFrame) -> DataFrame:
    """Lines (i, row, line, n, node, s) that don't take the first template of their node, with the further one they take."""
    spark, place = rest.sparkSession, F.struct("i", "row", "line", "s")
    groups = rest.groupBy("node", "s").agg(F.min(F.struct("i", "row", "line")).alias("first"), F.max(F.struct("i", "row")).alias("last")).select("node", "s", "first.*", "last")
    near = _dealt(groups, _rough()).drop("key").distinct().select("*", constant(F.col("s"), F.col("s")).alias("bits"))
    dealt = written(_dealt(near, _exact()).drop("bits"), new_dir(spark, "line-keys"))
    seeds = _seeds(dealt).groupBy("node", "key").agg(F.min(place).alias("seed"))
    found = dealt.join(seeds, ["node", "key"]).where(F.col("seed") <= place).groupBy("node", "s").agg(F.min("seed").alias("seed"))
    taken = rest.join(found, ["node", "s"]).where("row <> seed.row")
    return taken.select("row", "line", "n", F.xxhash64("node", "seed.s").alias("node"), "seed", agreed(F.col("s"), F.col("seed.s")).alias("mask"))


def templates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The learned templates: doc_id and line of the first line, its number of tokens, of its constant fields, and n_lines of other documents."""
    path = new_dir(docs.sparkSession, "templates")
    with scratch(docs.sparkSession):
        return written(_templates(_lines(docs, id_col, text_col)), path)


def _templates(lines: DataFrame) -> DataFrame:
    learned = _taken(lines)[1].select(F.col("seed.i").alias("doc_id"), "seed.line", "n", "n_lines", F.bit_count("mask").alias("constant"))
    return learned.groupBy("doc_id", "line").agg(F.first("n").cast("long").alias("n_tokens"), F.min("constant").cast("long").alias("n_constant"), F.max("n_lines").alias("n_lines"))


def recurring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a hash of id and text) and gone (the numbers of its lines that recur), for each document that has any."""
    path = new_dir(docs.sparkSession, "gone")
    with scratch(docs.sparkSession):
        return written(_recurring(_lines(docs, id_col, text_col)), path)


def _recurring(lines: DataFrame) -> DataFrame:
    owner = F.struct("i", "row")
    wholes = lines.where("NOT short").groupBy("w1", "w2").agg(F.min(owner).alias("first"), F.max(owner).alias("last")).where("first.row <> last.row")
    holders = lines.where("short").select("i", "row", "w1", "w2").distinct()
    common = holders.groupBy("w1", "w2").agg(F.min(owner).alias("first"), F.count("*").alias("n")).where(F.col("n") >= SHORT_DOCUMENTS)
    shared = wholes.select("w1", "w2", F.col("first.row").alias("keeper")).unionByName(common.select("w1", "w2", F.col("first.row").alias("keeper")))
    equal = lines.select("row", "line", "w1", "w2").join(shared, ["w1", "w2"]).where("row <> keeper").select("row", "line")
    taken, learned = _taken(lines)
    alike = taken.join(learned.select("node"), "node").select("row", "line")
    return equal.unionByName(alike).groupBy("row").agg(F.collect_set("line").alias("gone"))


def drop_recurring(docs: DataFrame, *, drop_emptied: bool = False, counts: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without lines of recurring templates; ``counts`` names two more columns, for the lines and the dropped
    lines of a text (long; null texts: 0), which must not be columns of ``docs``."""
    if clash := set(counts or ()) & set(docs.columns):
        raise ValueError(f"columns of the table: {sorted(clash)}")
    gone = recurring(docs, id_col=id_col, text_col=text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _row(id_col, text_col).alias("row"))
    body = F.col(f"doc.`{text_col}`")
    split = whole.join(gone, "row", "left").select("doc", "gone", F.split(body.cast("string"), "\n").alias("lines"))
    n_lines = F.coalesce(F.greatest(F.size("lines"), F.lit(0)), F.lit(0)).cast("long")
    n_gone = F.coalesce(F.greatest(F.size("gone"), F.lit(0)), F.lit(0)).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    out = split.select("doc", F.when(F.col("gone").isNotNull(), kept).otherwise(body).alias("text"), n_lines.alias("lines"), n_gone.alias("gone"))
    if drop_emptied:
        out = out.where((F.col("gone") == 0) | F.col("text").rlike(f"[^{SPACE}]"))
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, *(F.col(x).alias(c) for x, c in zip(("lines", "gone"), counts or (), strict=False)))
