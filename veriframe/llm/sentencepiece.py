"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each character it follows output links through all pieces that end there, longest
first, and each relaxes the best score of its end from that of its start, so when the text has been read the best
segmentation is known: the one of the greatest sum of piece scores, ties to the longer last piece. A character that no
piece consists of costs UNKNOWN below the least score and is written as the pieces of its UTF-8 bytes.

No piece has the space mark behind another character, or a line feed, so a best segmentation is one of each word and
its leading spaces; those are kept in a bounded table. That property is checked when a vocabulary is loaded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, has_columns, in_arrow

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: How far below the least piece score an unknown character counts.
UNKNOWN = 10.0
CACHE_WORDS, CACHE_CHARS = 300_000, 48


class Codec:
    """Encoder and decoder for the pieces and scores of a SentencePiece model, given as the file's bytes.

    For models with a dummy prefix, escaped spaces and no other normalisation, and with byte pieces; others raise ValueError.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.byte)):
            raise ValueError("the model has no byte pieces")
        if sp.decode(sp.encode(" Å  ﬁ a\n")) != " Å  ﬁ a\n":
            raise ValueError("the model normalises texts")
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("a piece goes on beyond a space or line feed")
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (score, len(piece), i))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.floor = min(s for _, s in self.pieces.values()) - UNKNOWN
        self.raw = [b""] * len(ids)
        for piece, (i, _) in self.pieces.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.cache: dict[str, tuple[int, ...]] = {}
        self.feed = (self.byte[10],)

    def _bytes(self, ch: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in ch.encode("utf-8", "surrogatepass"))

    def viterbi(self, word: str) -> tuple[int, ...]:
        """Ids of the best segmentation of escaped characters. best[k] is for the text up to k inclusive, best[-1] for none."""
        if not self.single.issuperset(word):
            return self._viterbi_unknown(word)
        n = len(word)
        best = [-np.inf] * n
        best.append(0.0)
        back = [None] * n
        for end, match in self.automaton.iter(word):
            score, length, _ = match
            x = best[end - length] + score
            if x > best[end]:
                best[end] = x
                back[end] = match
        out, at = [], n - 1
        while at >= 0:
            _, length, i = back[at]
            out.append(i)
            at -= length
        return tuple(out[::-1])

    def _viterbi_unknown(self, word: str) -> tuple[int, ...]:
        """The same where characters are no pieces: their own edge of the score `floor` is relaxed after the pieces' edges."""
        n = len(word)
        best, back = [*[-np.inf] * n, 0.0], [None] * n
        ending: list[list] = [[] for _ in word]
        for end, match in self.automaton.iter(word):
            ending[end].append(match)
        for end, ch in enumerate(word):
            own = [] if ch in self.single else [(self.floor, 1, -1)]
            for match in ending[end] + own:
                x = best[end - match[1]] + match[0]
                if x > best[end]:
                    best[end], back[end] = x, match
        out, at = [], n - 1
        while at >= 0:
            _, length, i = back[at]
            out.append((i,) if i >= 0 else self._bytes(word[at]))
            at -= length
        return tuple(chain.from_iterable(reversed(out)))

    def score(self, ids: Iterable[int], text: str) -> float:
        """Sum of scores of an encoding of text; for tests."""
        by_id = {i: s for i, s in self.pieces.values()}
        return sum(by_id.get(i, 0.0) for i in ids) + self.floor * sum(c not in self.single for c in text.replace(" ", SPACE))

    def _words(self, text: str) -> list[str]:
        """The text, spaces escaped, cut before each run of spaces that follows something else, and around line feeds."""
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            parts = line.split(" ")
            if "" not in parts[1:]:
                if parts[0]:
                    out.append(parts[0])
                out += [SPACE + p for p in parts[1:]]
                continue
            run = ""
            if parts[0]:
                out.append(parts[0])
            for p in parts[1:]:
                run += SPACE
                if p:
                    out.append(run + p)
                    run = ""
            if run:
                out.append(run)
        return out

    def _encode_word(self, word: str) -> tuple[int, ...]:
        if word == "\n":
            return self.feed
        ids = self.viterbi(word)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for the empty one."""
        if not text:
            return np.zeros(0, np.int32)
        head, *rest = (" " + text).split(SPACE)
        parts = [self._encode_words(self._words(head))]
        for tail in rest:  # a literal space mark would come back as a space, so it is written as bytes
            parts += [self._bytes(SPACE), self._encode_words(self._words(tail))]
        return np.fromiter(chain.from_iterable(parts), np.int32)

    def _encode_words(self, words: list[str]) -> Iterator[int]:
        got = list(map(self.cache.get, words))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    word = words[k]
                    got[k] = self.cache.get(word) or self._encode_word(word)
        return chain.from_iterable(got)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces are joined before they are read as UTF-8; the dummy prefix goes."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(send) -> Codec:
    """One codec a worker process, whatever number of tasks it runs."""
    if send.id not in _codecs:
        _codecs.clear()
        _codecs[send.id] = Codec(send.value)
    return _codecs[send.id]


class _Model:
    def __init__(self, df: DataFrame, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.sent = df.sparkSession.sparkContext.broadcast(data)  # a vocabulary file, read on the driver alone
        self.id = hash(data)

    @property
    def value(self) -> bytes:
        return self.sent.value


def _encode(model: _Model, verify: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in blocks(texts):
                ids = [None if t is None else codec.encode(t) for t in texts[i:j]]
                columns = [batch.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))]
                if verify:
                    columns.append(pa.array([x is None or codec.decode(x.tolist()) == t for x, t in zip(ids, texts[i:j])]))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "round_trip"][: len(columns)])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """One row per row of docs: <id_col>, ids (array of int) and, with verify, round_trip: whether decoding gives the text.

    A null text has null ids (and round_trip true), an empty one none. Whole texts are encoded, however long. Other
    columns are not read. Rows that repeat are each encoded.
    """
    has_columns(docs, (id_col, text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, ids array<int>" + ", round_trip boolean" * verify
    return src.transform(in_arrow(_encode(_Model(docs, model), verify), schema)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row: <id_col>, text. Null ids give a null text."""
    has_columns(encoded, (id_col, ids_col))
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    send = _Model(encoded, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(send)
        for batch in batches:
            texts = [None if not x.is_valid else codec.decode(x.values.to_pylist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return src.transform(in_arrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string")).withColumnRenamed("id", id_col)
