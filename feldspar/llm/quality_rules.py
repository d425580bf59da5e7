"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Figures of a text are computed with array functions on its words; repeated 3-word windows are found by sorting the
windows' 64-bit hashes within the text, and only in texts that have any. Nothing is shuffled.

Edge cases: a null text has no words, symbols or lines; ratios of a text without words are 0; ids are passed on as they
are, null or repeated; other columns may have any name, as only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feldspar.llm.common import SPACE, let, words_of

#: Frequent words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "a al als an and are as at au auf aus be bei by con da das de del dem den der des die du e ein eine el elle en er es et for from für "
    "ha he her his ich il im in is ist it la las le les lo los mit nicht no not of on or ou par pas per por pour que qui se sich sie sont "
    "su sur that the this to un una und une von was with y zu".split()
)
#: How a stop word may stand in a text: as listed, with a capital, or in capitals.
STOP_FORMS = tuple(sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())}))


@dataclass(frozen=True)
class Rule:
    """A figure's least and largest allowed value; None: no limit."""

    figure: str
    least: float | None = None
    most: float | None = None


#: The production table.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
)


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(hashes: Column) -> Column:
        def union(s: Column) -> Column:
            same = lambda e, i, step: F.coalesce(F.get(s, i + step)["h"] == e["h"], F.lit(False))
            again = F.filter(s, lambda e, i: same(e, i, -1) | same(e, i, 1))
            places = F.sort_array(F.transform(again, lambda e: e["p"]))
            none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(places, none, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])

        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, union))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(windows, covered))


def _of_words(words: Column) -> Column:
    stop = F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS)))
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return F.struct(F.size(words).cast("long").alias("n_words"), chars.alias("word_chars"), stop.cast("long").alias("n_stop"), _repeated(words).alias("n_repeat_words"))


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def figures(text: Column) -> list[Column]:
    """The figures that rules may name, as aliased columns."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    w, at = let(words_of(text), _of_words), "w"
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")), _of_lines)
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    return [w.alias(at), lines.alias("l"), symbols.alias("n_symbols")]


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True if all rules hold."""
    out = F.lit(True)
    for r in rules:
        for limit, holds in ((r.least, lambda c, x: c >= x), (r.most, lambda c, x: c <= x)):
            if limit is not None:
                out &= holds(F.col(r.figure), F.lit(limit))
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, its figures, base_failed and kept."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    flat = docs.select(F.col(id_col).alias("doc_id"), *figures(F.col(text_col))).select("doc_id", "w.*", "l.*", "n_symbols")
    full = flat.withColumns(
        {
            "mean_word": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "stop_ratio": ratio("n_stop", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    return full.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose text passes: one narrow pass."""
    row = F.struct(*docs.columns)
    judged = apply_rules(docs.select(row.alias("row"), F.col(text_col).alias("body")), rules, id_col="row", text_col="body")
    return judged.where("kept").select("doc_id.*")
