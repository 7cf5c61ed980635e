"""Token counts as delta-maintained rollups.

A change says that a document entered, left or was counted anew. Changes become signed deltas
(documents, tokens) by source, language and tokenizer version; a batch stores only the sums of its
deltas, and totals are the sums over batches. A batch is written aside and then moved to its name in
one step, so a batch that comes again, or is tried again after a lost driver, counts once.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from operator import mul

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back, path_exists, rename

KEYS = ("source", "lang", "tokenizer_version")
#: Characters and pieces that are encoded at a time.
PART, PART_PIECES = 1 << 16, 2000
#: Pieces that a task remembers, and their greatest length.
KNOWN, KNOWN_CHARS = 1 << 19, 40
#: Bits of a tokenizer's count in a number that holds those of all.
DIGITS = 48
#: Whether white space follows white space, and the cut before each blank between two other characters.
SPACES, CUT = re.compile(r"\s\s").search, re.compile(r"(?<=\S)(?= \S)").split
DELTA = "source string, lang string, tokenizer_version string, docs long, tokens long"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    spaces = " \t\n\x0b\x0c\r"
    flat = F.translate(F.coalesce(text, F.lit("")), spaces[1:], " " * 5)
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: The pattern that cuts a text before byte-level merges, which files of ranks do not hold.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def file_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by a tokenizers file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def ranks_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts by a file of byte-level ranks (base64 token and rank on each line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


class PieceCounter:
    """Counts texts' tokens by every tokenizers or ranks file, exactly, from the counts of pieces.

    A text is cut before each blank between two other characters, and what lies between is cut at single
    line feeds and before a mark that ends it after a letter. The files' tokenizers cut there themselves,
    so counts add up (tests compare with whole texts; a tokenizer whose tokens cross such places must not
    be used). What a piece has is remembered, up to KNOWN pieces of up to KNOWN_CHARS characters; all
    others are counted each time. One thread, one tokenizer at a time.
    """

    def __init__(self, paths: Sequence[str]):
        self.counters = [ranks_counter(path) if path.endswith(".tiktoken") else file_counter(path) for path in paths]
        self.known: dict[str, int] = {}  # the counts by all tokenizers as digits of one number

    @staticmethod
    def pieces(text: str) -> Counter:
        if SPACES(text) or text[:1].isspace() or text[-1:].isspace():
            return Counter(CUT(text))
        first, *rest = text.split(" ")
        many = Counter({f" {p}": n for p, n in Counter(rest).items()})
        many[first] += 1
        return many

    @staticmethod
    def parts(piece: str) -> list[str]:
        """Smaller pieces whose counts add up to the piece's."""
        if piece[-1].isalpha() and "\n" not in piece:
            return [piece]
        if SPACES(piece) or piece[-1].isspace() or piece[0] == "\n":
            return [piece]
        out = []
        for line in piece.split("\n"):
            if out:
                out.append("\n")
            if len(line) > 1 and line[-1] in ".,;:!?" and line[-2].isalpha():
                out += [line[:-1], line[-1]]
            else:
                out.append(line)
        return out

    def encoded(self, pieces: list[str]) -> Iterator[int]:
        """Counts of the pieces; encodings are far larger than texts, so a part at a time."""
        first = 0
        while first < len(pieces):
            last, chars = first, 0
            while last < len(pieces) and last - first < PART_PIECES and (chars < PART or last == first):
                chars += len(pieces[last])
                last += 1
            part = pieces[first:last]
            counts = [0] * len(part)
            for i, counted in enumerate(self.counters):
                counts = [n + (more << DIGITS * i) for n, more in zip(counts, counted(part), strict=True)]
            yield from counts
            first = last

    def __call__(self, texts: Sequence[str]) -> list[tuple[int, ...]]:
        known, count_of = self.known, self.known.__getitem__
        counted = [self.pieces(t) if t else Counter() for t in texts]
        new = {p: self.parts(p) for many in counted for p in many if p not in known}
        wanted = list({q for parts in new.values() for q in parts if q not in known})
        known.update(zip(wanted, self.encoded(wanted), strict=True))
        for piece, parts in new.items():
            if len(parts) > 1:
                known[piece] = sum(map(count_of, parts))
        totals = [sum(map(mul, map(count_of, many), many.values())) for many in counted]
        full = len(known) > KNOWN
        for piece in (*new, *wanted):
            if full or len(piece) > KNOWN_CHARS:
                known.pop(piece, None)
        return [tuple(n >> DIGITS * i & (1 << DIGITS) - 1 for i in range(len(self.counters))) for n in totals]


def tokenizer_counts(docs: DataFrame, paths: Mapping[str, str], text: str = "text") -> DataFrame:
    """docs without its text column and with a long column for each name of paths: tokens by that tokenizers (or .tiktoken ranks) file.

    Null and empty texts have none. paths must be readable by every executor. Columns of docs named
    like a new one are replaced. One Python worker for each task counts by all tokenizers.
    """
    kept = [c for c in docs.columns if c not in (text, *paths)]
    files = list(paths.values())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(files)
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                part = batch.slice(lo, 50)
                counts = count([t or "" for t in part.column(text).to_pylist()])
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(files))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *paths])
        give_back()

    fields = [docs.schema[c] for c in kept] + [T.StructField(name, T.LongType()) for name in paths]
    return docs.select(*kept, text).mapInArrow(rows, T.StructType(fields))


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas of changes (op, source, lang, tokenizer_version, old_tokens, new_tokens).

    insert adds one document and new_tokens, delete takes one document and old_tokens away, revise
    adds new_tokens - old_tokens. Null counts are 0, null keys are a group of their own. A row with
    another op, or with none, changes nothing. Repeated rows are repeated changes. Other columns
    are ignored. Sums are formed before the exchange, so a hot source is one row for each task.
    """
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = (
        F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old)
        .when(F.col("op") == "revise", new - old).otherwise(0)
    )
    return (
        changes.where(F.col("op").isin("insert", "delete", "revise"))
        .groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))
    )


def commit(spark: SparkSession, store: str, batch_id: str, changes: DataFrame) -> bool:
    """Adds a batch to the rollup; False, and no effect, if that batch is in it already."""
    target = f"{store}/batches/batch_id={batch_id}"
    if path_exists(spark, target):
        return False
    aside = f"{store}/aside/{uuid.uuid4().hex}"
    signed_deltas(changes).write.parquet(aside)
    return rename(spark, aside, target)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, tokenizer_version, docs, tokens) over all batches; groups without documents are left out."""
    if not path_exists(spark, f"{store}/batches"):
        return spark.createDataFrame([], DELTA)
    return (
        spark.read.schema(DELTA).parquet(f"{store}/batches/*")
        .groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
    )
