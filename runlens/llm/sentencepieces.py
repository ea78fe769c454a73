"""SentencePiece encoding and decoding by streaming Viterbi.

The encoder finds the segmentation with the highest sum of piece scores. It reads a text as a stream and keeps a window of
positions no wider than the longest piece: no arc reaches further back. Once all paths that can still win come together on
one boundary, following their backpointers, the ids up to there are committed and the window moves on, so memory does not
grow with the text. Characters without a piece become byte pieces.

Scores are the model's own, as in the library's unigram mode; a text's ids decode to the text exactly.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import common

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Bytes(dict):
    """Bytes by id; of an id that has none, none."""

    def __missing__(self, key: int) -> bytes:
        return b""


class Vocabulary:
    """Pieces with ids and scores; what a character without a piece costs; the bytes' ids."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], unknown: int = 0):
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        usable = [s for _, s in pieces.values() if s > -1e8]
        self.penalty = min(usable, default=0.0) - 10.0
        self.longest = max(map(len, pieces), default=1)
        self.reach: dict[str, int] = {}
        for p in pieces:
            self.reach[p[0]] = max(self.reach.get(p[0], 1), len(p))
        #: By every beginning of a piece: the piece that it is, or ().
        self.begins: dict[str, tuple] = {p[:n]: () for p in pieces for n in range(1, len(p))}
        self.begins.update(pieces)
        #: Whether a boundary before a space mark stands in every path, as no piece has the mark after another character.
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.bytes_of = _Bytes({i: p.replace(SPACE, " ").encode("utf-8") for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)})

    @classmethod
    def of_model(cls, file: str) -> "Vocabulary":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = range(sp.get_piece_size())
        plain = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        return cls(plain, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.unk_id())

    def bytes_for(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


def stream(chars: Iterable[str], vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of a stream of characters, in the order they become certain. At most about two windows of characters are held."""
    pieces, longest, reach, penalty = vocabulary.pieces, vocabulary.longest, vocabulary.reach, vocabulary.penalty
    source = iter(chars)
    held, done = "", False  # characters from the last committed boundary on; scores and backpointers of their positions
    score: list[float] = [0.0]
    back: list[tuple[int, int]] = [(0, -1)]  # (position before, id; -1 for a character without piece)
    filled = 0  # positions whose arcs have all been followed
    while True:
        while not done and len(held) < filled + 2 * longest:
            c = next(source, None)
            done = c is None
            held += c or ""
            if not done:
                score.append(float("-inf"))
                back.append((0, -1))
        stop = len(held) if done else len(held) - longest
        for i in range(filled, stop):
            at, first = score[i], held[i]
            single = False
            for n in range(1, min(reach.get(first, 1), len(held) - i) + 1):
                found = pieces.get(held[i:i + n])
                if found:
                    single |= n == 1
                    if at + found[1] > score[i + n]:
                        score[i + n], back[i + n] = at + found[1], (i, found[0])
            if not single and at + penalty > score[i + 1]:
                score[i + 1], back[i + 1] = at + penalty, (i, -1)
        filled = max(filled, stop)
        # Paths that can still win end in a filled position's reach: bring their ends together.
        ends = {len(held)} if done else {i for i in range(filled, len(held) + 1) if score[i] > float("-inf")}
        while len(ends) > 1:
            last = max(ends)
            ends = (ends - {last}) | {back[last][0]}
        boundary = ends.pop() if ends else 0
        if boundary:
            ids, i = [], boundary
            while i:
                before, found = back[i]
                ids.append([found] if found >= 0 else vocabulary.bytes_for(held[before:i]))
                i = before
            yield [x for part in reversed(ids) for x in part]
            base = score[boundary]
            held, score = held[boundary:], [s - base for s in score[boundary:]]
            back = [(0, -1)] + [(b - boundary, f) for b, f in back[boundary + 1:]]
            filled = max(0, filled - boundary)
        if done and not held:
            return


def window(s: str, vocabulary: Vocabulary) -> list[int]:
    """Ids of a string that fits one window: the same paths as the stream's, all committed at the end."""
    begins, penalty = vocabulary.begins.get, vocabulary.penalty
    size = len(s)
    score, back, ids = [0.0] + [float("-inf")] * size, [0] * (size + 1), [-1] * (size + 1)
    for i in range(size):
        at, found = score[i], begins(s[i])
        if not found:  # no piece of this one character
            if at + penalty > score[i + 1]:
                score[i + 1], back[i + 1], ids[i + 1] = at + penalty, i, -1
        j = i + 1
        while found is not None:
            if found:
                total = at + found[1]
                if total > score[j]:
                    score[j], back[j], ids[j] = total, i, found[0]
            if j == size:
                break
            j += 1
            found = begins(s[i:j])
    out, i = [], size
    while i:
        if ids[i] >= 0:
            out.append(ids[i])
        else:
            out += reversed(vocabulary.bytes_for(s[back[i]:i]))
        i = back[i]
    out.reverse()
    return out


class Codec:
    """Whole texts to ids and back. Segments that every path separates are remembered, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 200_000):
        self.v, self.remember, self.known = vocabulary, remember, {}

    def _ids(self, s: str) -> bytes:
        if len(s) <= 2 * self.v.longest:
            return array("I", window(s, self.v)).tobytes()
        return b"".join([np.array(ids, "<u4").tobytes() for ids in stream(s, self.v)])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; the empty text has none. A space mark is put before a text, and spaces become marks."""
        if not text:
            return b""
        words = text.split(" ")
        if not self.v.splits:
            parts = [SPACE + text.replace(" ", SPACE)]
        elif SPACE in text or "" in words:
            parts = _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        else:  # single spaces only: each word is a segment, kept without its mark
            parts = words
        known = self.known
        if len(known) >= self.remember:
            known.clear()
        new = set(parts).difference(known)
        for s in new:
            known[s] = self._ids(s if s[0] == SPACE else SPACE + s)
        out = b"".join(map(known.__getitem__, parts))
        for s in new:
            if len(s) > 64:
                del known[s]
        return out

    def decode(self, data: bytes) -> str:
        """The text of ids, without the space put before it."""
        text = b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(data, "<u4").tolist()))
        return text[1:].decode("utf-8", "surrogatepass")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32 (of the little-endian ids), n_chars of the decoded text, same_text (whether it
    equals the text, space marks in it read as spaces).

    Null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; extra columns are left
    behind; an empty table gives no rows.
    """
    def run(batches):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        codec = common.held(("codec", model), lambda: Codec(Vocabulary.of_model(model)))
        for b in batches:
            rows = []
            for doc, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                data = codec.encode(t or "")
                back = codec.decode(data)
                rows.append((doc, len(data) // 4, zlib.crc32(data), len(back), back == (t or "").replace(SPACE, " ")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "n_chars", "same_text"]).astype({"doc_id": "Int64"})
    return common.texts(docs).mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, same_text boolean")


def encode_table(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    def run(batches):
        codec = common.held(("codec", model), lambda: Codec(Vocabulary.of_model(model)))
        for b in batches:
            ids = [np.frombuffer(codec.encode(t or ""), "<u4").astype(np.int32) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": ids})
    return common.texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows of ids; null ids are none."""
    def run(batches):
        codec = common.held(("codec", model), lambda: Codec(Vocabulary.of_model(model)))
        for b in batches:
            texts = [codec.decode(np.asarray([] if i is None else i, "<u4").tobytes()) for i in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": texts})
    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInPandas(run, "doc_id long, text string")
