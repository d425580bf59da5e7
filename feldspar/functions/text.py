"""Names, tokens, sentences, secrets and other text functions, as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name tokens leave out.
NAME_STOP_WORDS = ("the", "and", "of", "for", "a", "an")
#: Words that signatures leave out.
SIGNATURE_STOP_WORDS = (
    "of", "for", "with", "within", "to", "from", "the", "a", "an", "in", "on", "at",
    "and", "or", "as", "into", "per", "its", "their", "that", "this", "other", "between",
)
#: The phrases of actions, in order of precedence.
ACTIONS = (
    ("goto", ("go to", "navigate", "open the", "visit")),
    ("click", ("click", "press the", "tap", "select the .*button")),
    ("fill", ("enter", "type", "fill")),
    ("select", ("choose", "select")),
)
#: Shapes of secrets.
SECRETS = (
    r"\bsk-[A-Za-z0-9_-]{16,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\bghp_[A-Za-z0-9]{20,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"\b(?i:bearer)\s+[A-Za-z0-9._-]{12,}\b", r"-----BEGIN[ A-Z]*PRIVATE KEY-----",
)
#: Shapes that this library adds: other GitHub tokens and JSON web tokens.
MORE_SECRETS = (r"\bgh[ours]_[A-Za-z0-9]{20,}\b", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\b")
REDACTED = "[REDACTED]"
#: Modality by file extension.
MODALITIES = {
    "markdown": "md markdown", "pdf": "pdf", "spreadsheet": "csv xlsx xls ods", "docs": "docx doc odt rtf", "html": "html htm", "json": "json", "notebook": "ipynb",
    "image": "png jpg jpeg gif webp bmp", "video": "mp4 mov mkv webm avi m4v", "audio": "mp3 wav m4a flac ogg aac",
}


def tokens(s: Column) -> Column:
    """Lower-case runs of a-z0-9 of two characters or more, less the stop words; repeats stay."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*NAME_STOP_WORDS))


def normalize(s: Column) -> Column:
    return F.array_join(tokens(s), " ")


def surface_sim(a: Column, b: Column) -> Column:
    """0 if either has no tokens; 1 if equal; 0.9 if one holds the other; else the overlap coefficient of the token sets."""
    x, y, nx, ny = F.array_distinct(tokens(a)), F.array_distinct(tokens(b)), normalize(a), normalize(b)
    overlap = F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))
    return F.when((nx == "") | (ny == ""), 0.0).when(nx == ny, 1.0).when(F.contains(nx, ny) | F.contains(ny, nx), 0.9).otherwise(overlap)


def similarity(a: Column, b: Column) -> Column:
    """The best surface similarity between two arrays of surfaces."""
    return F.coalesce(F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: surface_sim(x, y))))), F.lit(0.0))


def stem(t: Column) -> Column:
    """The first rule that fits a token of over four characters: ies, sses, ing (over five), ed, s."""
    n = F.length(t)
    cut = lambda k, end="": F.concat(F.substring(t, F.lit(1), n - k), F.lit(end))
    return (
        F.when(n <= 4, t).when(t.endswith("ies"), cut(3, "y")).when(t.endswith("sses"), cut(2)).when(t.endswith("ing") & (n > 5), cut(3)).when(t.endswith("ed"), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss"), cut(1)).otherwise(t)
    )


def name_signature(s: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), " "), lambda t: (t != "") & ~t.isin(*SIGNATURE_STOP_WORDS))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(parts, stem))), " ")


def slug(s: Column, mark: str = "_") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")
    return F.when(out == "", "x").otherwise(out)


def sha12(s: Column) -> Column:
    return F.left(F.sha2(s, 256), F.lit(12))


def content_hash(s: Column) -> Column:
    return F.left(F.sha2(s, 256), F.lit(16))


def first_sentence(s: Column) -> Column:
    """Heading marks off, white space folded: the shortest start of up to 200 characters that ends a sentence, else a cut."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(s, r"^[ \t\r\n]*#+", ""), r"[ \t\r\n\x0b\f]+", " "))
    return F.coalesce(F.nullif(F.regexp_extract(flat, r"^(.{1,200}?[.!?])(?: |$)", 1), F.lit("")), F.left(flat, F.lit(200)))


def action_verb(s: Column) -> Column:
    """The first action whose verbs occur; null if none does."""
    said = lambda verbs: s.rlike("(?i)" + "|".join(rf"\b{v}\b" for v in verbs))
    return reduce(lambda c, a: c.when(said(a[1]), a[0]), ACTIONS[1:], F.when(said(ACTIONS[0][1]), ACTIONS[0][0]))


def redact(s: Column, patterns: tuple[str, ...] = (), mark: str = REDACTED) -> Column:
    """Secrets replaced by ``mark``; a configured pattern that isn't a regular expression counts literally."""
    out = s
    for p in (*SECRETS, *MORE_SECRETS, *patterns):
        try:
            re.compile(p)
        except re.error:
            p = re.escape(p)
        out = F.regexp_replace(out, p, mark.replace("\\", r"\\").replace("$", r"\$"))
    return out


def redact_literals(s: Column, secrets: list[str], patterns: list[str] = (), mark: str = "‹redacted›") -> Column:
    """Literal secrets, the longest first, then patterns as literals."""
    for x in [*sorted(filter(None, secrets), key=lambda x: (-len(x), x)), *patterns]:
        s = F.replace(s, F.lit(x), F.lit(mark))
    return s


def extract_json_object(s: Column) -> Column:
    """The outermost braces of a noisy text."""
    return F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))


def truncate(s: Column, limit: int = 30_000) -> Column:
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit)), F.lit("\n[truncated]"))).otherwise(s)


def glob_regex(glob: str) -> str:
    """** is any run, * any run without a slash; anchored."""
    return "^" + re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*") + "$"


def uri_matches(uri: Column, pattern: str) -> Column:
    return uri.rlike(glob_regex(pattern)) if "*" in pattern else uri.startswith(pattern)


def modality(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(reduce(lambda c, m: c.when(ext.isin(*m[1].split()), m[0]), list(MODALITIES.items())[1:], F.when(ext.isin(*MODALITIES["markdown"].split()), "markdown")), F.lit("generic"))


def parse_clock(s: Column) -> Column:
    """[[H:]M:]S to seconds."""
    return F.aggregate(F.split(s, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


def clock(seconds: Column) -> Column:
    n = F.floor(seconds).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(n / 3600)), two(F.floor(n / 60) % 60), two(n % 60))


def sentiment_label(score: Column, t: float = 0.05) -> Column:
    return F.when(score >= t, "positive").when(score <= -t, "negative").otherwise("neutral")


def gps_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    return F.round((d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1), 6)


def rational(s: Column) -> Column:
    """n/d rounded to 3 places; null by a zero denominator."""
    return F.round(F.try_divide(F.split_part(s, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(F.concat(s, F.lit("/1")), F.lit("/"), F.lit(2)).try_cast("double")), 3)


def page_numbers(s: Column) -> Column:
    """1-based pages of a list such as 2,5,9 or 1-3,7, in order, each once; parts that are no pages are left out."""
    parts = F.filter(F.split(F.regexp_replace(s, r"\s", ""), ","), lambda p: p.rlike("^[0-9]{1,9}(-[0-9]{1,9})?$"))
    ends = F.transform(parts, lambda p: F.split(p, "-"))
    return F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e[0].cast("int"), F.element_at(e, -1).cast("int")))))


def printable_runs(s: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(s, F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0))
