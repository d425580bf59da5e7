"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java/RE2 class body.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and U+0009..U+000D."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local session, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="feldspar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet; the scratch scopes that are open delete it at their end."""
    path = f"{shared_dir(spark)}/feldspar/{name}-{uuid.uuid4().hex}"
    for paths in _scopes.get():
        paths.append(path)
    return path


#: Spark's setting that drops a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _open = threading.Lock(), [0, "false"]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within the block, ``new_dir`` gives folders that go at its end, and a query's shuffle files go when the query ends.

    So an operator's disk holds the shuffles of one step, and of its tables only what it allotted before the block.
    """
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    with _lock:
        if not _open[0]:
            _open[1] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _open[0] += 1
    try:
        yield
    finally:
        _scopes.reset(token)
        with _lock:
            _open[0] -= 1
            if not _open[0]:
                spark.conf.set(CLEANUP, _open[1])
        remove(spark, *paths)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_encoders: dict[int, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokenisation never joins text across ASCII white space.

    Such a tokenizer gives a text the ids of its white-space separated chunks in order, so each distinct chunk is
    encoded once and remembered. Holds for tokenizers that drop white space (``word_bpe_49k.json``), not for those
    that make it part of a token.
    """

    MAX_KEPT, MAX_CHUNK = 700_000, 64
    #: Punctuation that ends a chunk is a token of its own after an ASCII letter or digit.
    ENDS = re.compile(rb"(?<=[a-z0-9])[.,;:!?#$%&*]+(?![^ \t-\r])")
    MARKS = re.compile(rb"[!?#$%&*]")
    #: A full stop or comma elsewhere than after such a letter or digit, or a letter of U+00C0..U+00FF.
    JOINED = re.compile(rb"[.,][ \n](?:(?<=[^a-z0-9 \t-\r\x80-\xBF][.,][ \n])|(?<=[^\xC3][\x80-\xBF][.,][ \n])|(?<=\xC3[\x97\xB7][.,][ \n]))")

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.kept = _Kept(self.tokenizer, self.MAX_CHUNK)

    @classmethod
    def of(cls, spec: str) -> "WordEncoder":
        """One encoder for each Python worker."""
        key = hash(spec)
        if key not in _encoders:
            _encoders[key] = cls(spec)
        return _encoders[key]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text as unsigned 32-bit integers of this machine's order; a null text has none."""
        kept, get, out = self.kept, self.kept.__getitem__, []
        if len(kept) > self.MAX_KEPT:
            kept.clear()
        for t in texts:
            t = t or b""
            if b"<|" in t:  # special tokens are found before the case is folded, across chunks
                out.append(self.whole(t))
                continue
            t = t.lower()  # bytes: only ASCII case and white space
            if self.MARKS.search(t) or self.JOINED.search(t):
                t = self.ENDS.sub(rb" \g<0>", t)
            else:
                t = t.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")
            out.append(b"".join(map(get, t.split())))
        return out

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()


class _Kept(dict):
    """Ids by chunk; looks up what it doesn't have.

    A chunk of lower-case letters of ASCII and U+00DF..U+00FF is one word that normalising leaves as it is, so the model
    gets it at once, without the steps before it. That is tried on all these letters first, and left out for a
    tokenizer where it doesn't hold.
    """

    LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")

    def __init__(self, tokenizer, longest: int):
        super().__init__()
        self.tokenizer, self.longest, self.model, self.bytes = tokenizer, longest, tokenizer.model, _byte_letters()
        letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if c != 0xF7]
        tries = ["".join(letters).encode(), *(x.encode() for c in letters for x in (c, f"th{c}", f"{c}{c}n"))]
        self.direct = all(self.one_word(x) == self.any(x) for x in tries)

    def any(self, chunk: bytes) -> bytes:
        return array("I", self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def one_word(self, chunk: bytes) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(chunk.decode("latin-1").translate(self.bytes))]).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.one_word(chunk) if self.direct and self.LETTERS.fullmatch(chunk) else self.any(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = ids
        return ids


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for a byte: itself if it is printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in plain)}


def read_text(path: str) -> str:
    """A tokenizer's file (a few MB, whatever the data), read once on the driver and shipped to the workers."""
    with open(path, encoding="utf-8") as f:
        return f.read()
