"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

All in DataFrame functions over the whole text, without a shuffle. A kind's matches come from one pass with
``regexp_extract_all`` and their places from the lengths of the pieces between them, so places count code points. The
expressions are written so that Java's engine needs no backtracking stack: repeats are possessive where nothing can
follow, and a run is tried only at its start or where the last match ended.

A span's score is its kind's own, plus a bonus if a context word stands in the 40 characters before it; spans below
THRESHOLD are left out. The four base kinds score 1 by format and checksum alone; others need more.

Edge cases: a null text counts as empty; ids are passed on as they are; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feldspar.llm.common import let

THRESHOLD, WINDOW, STEP = 0.5, 40, 256
SPAN = "array<struct<start:bigint,end:bigint,score:double>>"


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum of a string of digits is 0."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod_97(code: Column) -> Column:
    """The checksum of an IBAN: its characters from the fifth on, then the first four, as a number leave 1 by 97."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its expression, its checks, its score without and with a context word before it."""

    name: str
    pattern: str
    check: Callable[[Column], Column]
    base: bool = False
    score: float = 1.0
    bonus: float = 0.0
    context: str = ""
    alone: bool = False  # no letter or digit next to it


def _in(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


LOCAL = "A-Za-z0-9._%+-"
#: The countries of each length of an IBAN, as its public registry has them.
IBAN_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: What may stand between an IBAN's groups of four.
GAP = r"[\x20\xA0-]"


def _iban() -> str:
    """An IBAN as one run, or in groups of four, whose number its country gives, so that no word after it is taken along."""

    def grouped(length: int, countries: str) -> str:
        fours, rest = divmod(length - 4, 4)
        last = f"{GAP}[A-Z0-9]{{{rest}}}" if rest else ""
        return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:{GAP}[A-Z0-9]{{4}}){{{fours}}}{last}"

    run = "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([run, *(grouped(n, c) for n, c in IBAN_COUNTRIES.items())])})"


KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")), base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: _in(digits(m), 16, 19) & luhn(digits(m)), base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _in(digits(m), 8, 15), base=True),
    Kind("iban", _iban(), lambda m: mod_97(F.regexp_replace(m, GAP, "")), alone=True),
    Kind("short_card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: _in(digits(m), 13, 15) & luhn(digits(m)), score=0.3, bonus=0.4, context="card|carte|karte|tarjeta|visa|amex", alone=True),
    Kind("tax_id", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), score=0.3, bonus=0.4, context="ssn|social security|tax", alone=True),
)


def _running(values: Column, base: Column) -> Column:
    """Sums before each of ``values``, plus ``base``."""
    empty = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, empty, lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _sums_before(values: Column) -> Column:
    """Sums before each of ``values``, in runs of STEP so that long arrays aren't copied for each element."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda g: F.slice(values, g * STEP + 1, F.lit(STEP)))

    def joined(c: Column) -> Column:
        sums = F.transform(c, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, v: a + v))
        return F.flatten(F.zip_with(c, _running(sums, F.lit(0).cast("bigint")), _running))

    return let(runs, joined)


def spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, by start: array of start, end (exclusive; code points) and score."""

    def placed(found: Column) -> Column:
        def of(pieces: Column) -> Column:
            steps = F.zip_with(pieces, found, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
            starts = _sums_before(steps)
            rows = F.zip_with(F.zip_with(found, starts, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), pieces, lambda x, p: F.struct(x["m"].alias("m"), (x["s"] + F.length(p)).alias("start")))
            good = F.filter(rows, lambda r: r["m"].isNotNull() & F.coalesce(kind.check(r["m"]), F.lit(False)) & near(r))
            return F.filter(F.transform(good, lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(r["m"])).alias("end"), score(r).alias("score"))), lambda r: r["score"] >= THRESHOLD)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, kind.pattern, -1), of))

    def near(r: Column) -> Column:
        if not kind.alone:
            return F.lit(True)
        before = F.when(r["start"] == 0, "").otherwise(F.substring(text, r["start"].cast("int"), F.lit(1)))
        after = F.substring(text, (r["start"] + F.length(r["m"]) + 1).cast("int"), F.lit(1))
        return ~F.concat(before, after).rlike("[A-Za-z0-9]")

    def score(r: Column) -> Column:
        if not kind.context:
            return F.lit(kind.score)
        first = F.greatest(F.lit(0), r["start"] - WINDOW)
        before = F.lower(F.substring(text, (first + 1).cast("int"), (r["start"] - first).cast("int")))
        return F.lit(kind.score) + F.when(before.rlike(kind.context), kind.bonus).otherwise(0.0)

    return let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, a column with its spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *(spans(text, k).alias(k.name) for k in kinds))


def joined(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of the found spans, by kind as listed, then start, comma-joined."""
    one = lambda k: F.transform(F.col(k.name), lambda s: F.concat_ws(":", F.lit(k.name), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.concat(*map(one, kinds)), ",")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with each found span replaced by its kind in angle brackets; where spans overlap, the first wins."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"), *(spans(text, k).alias(k.name) for k in kinds))
    marks = lambda name: F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"<{name}>").alias("mark")))
    marked = F.concat(*(marks(k.name) for k in kinds))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        kept = F.substring(F.col("body"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).alias("at"), F.concat(a["out"], kept, s["mark"]).alias("out")))

    end = lambda a: F.concat(a["out"], F.substring(F.col("body"), (a["at"] + 1).cast("int"), F.length("body")))
    return found.select("doc_id", F.aggregate(F.sort_array(marked), start, put, end).alias("text"))
