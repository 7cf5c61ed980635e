"""SentencePiece encoding and decoding by Viterbi search over a trie of marked words.

A text is marked (a leading marker, and a marker for every space) and cut before each marker. The
distinct marked words of a batch are sorted, which is the depth-first order of their trie: a word
keeps the forward scores of the prefix it shares with the word before, and only what follows is
searched. Every word's pieces are looked up by the texts' word numbers, so a text costs no search.

Pieces and scores come from a model file. The best segmentation has the greatest sum of scores;
among equal ones the one whose last piece is longest,
and so on to the front. Characters that no piece covers become byte pieces;
so does the marker where a text has it itself. Decoding joins pieces, so it returns the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back
from tidemark.llm.packed import ranges

MARK = "▁"
#: What a byte piece costs on top of the least score of the vocabulary.
BYTE_COST = 10.0
BATCH_BYTES = 1 << 20
#: A task stops remembering words beyond so many; they are then searched again in each batch. Longer words are not remembered.
KNOWN_WORDS, KNOWN_CHARS = 100_000, 40


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    #: (score, id) of every piece, and None for every other tail of a piece: if a word's tail is neither, longer ones are not.
    tails: dict[str, tuple[float, int] | None]
    bytes_at: tuple[int, ...]
    byte_score: float


def load_vocabulary(path: str) -> Vocabulary:
    """Reads a model file: normal pieces by score, and the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids = {}, {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], scores[piece] = i, model.get_score(i)
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces, so it cannot encode every text")
    least = min(scores.values(), default=0.0)
    tails: dict[str, tuple[float, int] | None] = {piece[k:]: None for piece in ids for k in range(len(piece))}
    tails.update({piece: (score, ids[piece]) for piece, score in scores.items()})
    return Vocabulary(ids, tails, tuple(byte_ids[b] for b in range(256)), least - BYTE_COST)


def piece_bytes(path: str) -> dict[int, bytes]:
    """What each piece stands for: all that decoding needs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    text = {i: model.id_to_piece(i) for i in ids}
    return {i: bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace(MARK, " ").encode() for i, t in text.items()}


def encode_sorted(words: list[str], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Piece ids of each word: a depth-first walk of the trie, as words come in order.

    best[i] is the greatest score of the current word's first i characters, back[i] its last piece
    (where it starts, its id). What the next word shares with this one stays.
    """
    tail_of, bytes_at, byte_score = vocabulary.tails.get, vocabulary.bytes_at, vocabulary.byte_score
    best, back, last = [0.0], [(0, 0)], ""
    for word in words:
        same, most = 0, min(len(word), len(last))
        while same < most and word[same] == last[same]:
            same += 1
        del best[same + 1 :], back[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            begin = end - 1
            c = word[begin]
            top, piece = best[begin] + (byte_score if c < "\x80" else byte_score * len(c.encode())), (begin, -1)
            while begin >= 0:
                found = tail_of(word[begin:end], 0)
                if found:
                    score = best[begin] + found[0]
                    if score >= top:
                        top, piece = score, (begin, found[1])
                elif found == 0:
                    break
                begin -= 1
            best.append(top)
            back.append(piece)
        last, out, end = word, [], len(word)
        while end:
            start, piece_id = back[end]
            if piece_id < 0:
                out.extend(bytes_at[b] for b in reversed(word[start:end].encode()))
            else:
                out.append(piece_id)
            end = start
        out.reverse()
        yield out


def encode_words(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of distinct words between spaces, each marked in front; a marker inside a word becomes bytes."""
    parts = [w.split(MARK) if MARK in w else (w,) for w in words]
    marked = sorted({MARK + p[0] for p in parts} | {x for p in parts for x in p[1:] if x})
    ids = dict(zip(marked, encode_sorted(marked, vocabulary), strict=True))
    inner = [vocabulary.bytes_at[b] for b in MARK.encode()]
    out = []
    for p in parts:
        mine = ids[MARK + p[0]]
        for x in p[1:]:
            mine = [*mine, *inner, *(ids[x] if x else ())]
        out.append(mine)
    return out


def _encoded(path: str, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(path)
        known: dict[str, bytes] = {}  # words of earlier batches of the task
        for batch in batches:
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges, held = [0], 0
            for i, n in enumerate(size.tolist()):
                if held and held + n > BATCH_BYTES:
                    edges.append(i)
                    held = 0
                held += n
            edges.append(len(size))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                mine = part.column("text")
                split = pc.split_pattern(pc.fill_null(mine, "").cast(pa.large_string()), " ")
                coded = split.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                new = [w for w in words if w not in known]
                coded_new = {w: np.array(ids, np.int32).tobytes() for w, ids in zip(new, encode_words(new, vocabulary), strict=True)}
                ids = [known.get(w) or coded_new[w] for w in words]
                if len(known) < KNOWN_WORDS:
                    known.update((w, ids) for w, ids in coded_new.items() if len(w) <= KNOWN_CHARS)
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), np.int32)
                word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(lengths) - lengths
                count = lengths[word]
                at = ranges(first[word], count)
                words_in = np.asarray(pc.list_value_length(split).to_numpy(zero_copy_only=False), np.int64)
                total = np.concatenate([[0], np.cumsum(count)])
                bounds = total[np.concatenate([[0], np.cumsum(words_in)])]
                nothing = mine.is_null().to_numpy(zero_copy_only=False) | (size[lo:hi] == 0)
                keep = np.repeat(~nothing, np.diff(bounds))  # an empty text has no pieces, though its split has one empty word
                lens = np.where(nothing, 0, np.diff(bounds))
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at][keep]))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], names=[*names, "piece_ids"])

    return rows


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Every row of docs with all its columns (but one named piece_ids) and piece_ids, an array of ints.

    Whole texts are encoded as they are, without normalising. Null and empty texts have no pieces.
    model_path must be readable by every executor. Repeated rows and repeated words cost one search
    in a batch. Column text must be there.
    """
    docs = docs.drop("piece_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encoded(model_path, docs.columns), schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Every row with all its columns (but one named decoded) and decoded, the text of piece_ids; null ids are an empty text."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decoded(model_path, encoded.columns), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """encode and then decode, by one Python worker for each task; the decoded text is compared, not returned.

    Every row of docs with all its columns but text and those named like the new ones, piece_ids, and
    same: whether decoding them gives the text (null: empty) back.
    """
    docs = docs.drop("piece_ids", "decoded", "same")
    names = docs.columns
    kept = [c for c in names if c != "text"]
    encoded, decoded = _encoded(model_path, names), _decoded(model_path, [*names, "piece_ids"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in decoded(encoded(_slices(batches))):
            same = pc.equal(part.column("decoded"), pc.fill_null(part.column("text"), ""))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), part.column("piece_ids"), same], names=[*kept, "piece_ids", "same"])
        give_back()

    fields = [docs.schema[c] for c in kept] + [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())]
    return docs.mapInArrow(rows, T.StructType(fields))


def _decoded(model_path: str, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(model_path)
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        data = np.frombuffer(b"".join(table), np.uint8)
        size = np.array([len(x) for x in table], np.int64)
        first = np.cumsum(size) - size
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = part.column("piece_ids")
                count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                length = size[flat]
                total = np.concatenate([[0], np.cumsum(length)])
                text = data[ranges(first[flat], length)].tobytes()
                edges = total[np.concatenate([[0], np.cumsum(count)])].tolist()
                # without the leading marker
                texts = [text[i + 1 : j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
                column = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], names=[*names, "decoded"])

    return rows


def piece_count(ids: str = "piece_ids"):
    return F.size(F.coalesce(F.col(ids), F.array().cast("array<int>"))).cast("long")
