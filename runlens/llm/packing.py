"""Best-fit packing of tokenised documents into sequences, with a bounded number of open bins.

A document's ids come from a public tokenizer and end with id 0. Only longer documents are cut; a whole piece of the
sequence length is a sequence of its own. Every other piece (one per document at most) is a small row of numbers, dealt
evenly to packing tasks. A task keeps a fixed number of open bins in a bitset with one bit per amount of free space: the
lowest set bit at or above a piece's length is the best fit, found by one shift. With all bins open and none fitting, the
fullest bin (the lowest set bit) closes.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections import defaultdict
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"

#: Beyond printable ASCII and white space, the letters and signs that any Unicode version lower-cases and splits alike.
_ODD = re.compile("[^\t\n\x0b\x0c\r -~\xa0-įı-ɏ]")
_PLAIN = bytes([*b"\t\n\x0b\x0c\r", *range(0x20, 0x7F), *range(0xA0, 0x100)])
#: Stands between words that are encoded together. Its UTF-8 bytes begin as none of a word's can.
_BETWEEN = "\ue000"
_SIGNS = string.punctuation


def plain(text: str) -> bool:
    """Whether a text can be cut at white space before it is tokenized: no unusual characters, no name of a special token."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return not _ODD.search(text)


class Memory(dict):
    """Remembers the ids of short texts in two halves, of which the older goes when the newer is full. One look-up a word: a new
    word stands for itself until all new words of a call are encoded together."""

    def __init__(self, make, remember: int, longest: int):
        super().__init__()
        self.make, self.half, self.longest, self.older, self.new, self.long = make, max(1, remember // 2), longest, {}, [], []

    def __missing__(self, text: str):
        made = self.older.get(text)
        if made is None:
            self.new.append(text)
            made = text
        self[text] = made
        return made

    def encoded(self, rows: list[list[str]]) -> list[list[bytes]]:
        for text in self.long:
            del self[text]
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        get = self.__getitem__
        found = [list(map(get, row)) for row in rows]
        new, self.new = self.new, []
        self.long = [text for text in new if len(text) > self.longest]
        if new:
            self.update(zip(new, self.make(new)))
            found = [[get(x) if x.__class__ is str else x for x in row] for row in found]
        return found


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes. The tokenizer never joins over white space, so a text's ids are
    those of its words in turn. Arrow cuts the texts of a call and numbers their different words, each of which is looked up
    once a call; its parts are encoded once and remembered, up to a bound. Unusual texts are encoded whole."""

    def __init__(self, file: str, remember: int = 320_000, longest: int = 200):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(file)
        # words of lower-case letters need no normalizing and are one pre-token each: the same model, cut at spaces, gives their ids
        self.letters = Tokenizer.from_file(file)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts = Memory(self._parts, remember, longest)
        self.parts.older[""] = b""
        self.between = np.array(self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids, "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _marked(self, lines: list[list[str]]) -> list[bytes]:
        out = []
        for e in self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(line) for line in lines], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            at, data, gap = np.flatnonzero(ids == self.between[0]) * 4, ids.tobytes(), 4 * len(self.between)
            out += [data[a:b] for a, b in zip([0, *(at + gap).tolist()], [*at.tolist(), len(data)])]
        return out

    def _parts(self, new: list[str], together: int = 100) -> list[bytes]:
        """A part of letters only is one pre-token, and its last id is one that ends words; others are told apart by a mark."""
        letters = [w for w in new if w.isalpha()]
        lines = [letters[i:i + together] for i in range(0, len(letters), together)]
        out = {}
        for line, e in zip(lines, self.letters.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out.update(zip(line, [data[a:b] for a, b in zip([0, *at], at)] if len(at) == len(line) else self._marked([line])))
        rest = [w for w in new if w not in out]
        out.update(zip(rest, self._marked([rest[i:i + together] for i in range(0, len(rest), together)])))
        return [out[w] for w in new]

    def _words(self, words: list[str]) -> list[bytes]:
        """The tokenizer always cuts between a letter or digit and the signs that end a word."""
        cores = [w.rstrip(_SIGNS) for w in words]
        cores = [c if c and c[-1].isalnum() else w for c, w in zip(cores, words)]
        ends = [w[len(c):] for c, w in zip(cores, words)]
        cores, ends = self.parts.encoded([cores, ends])
        return list(map(bytes.__add__, cores, ends))

    def __call__(self, texts: list[str]) -> list[bytes]:
        easy = list(map(plain, texts))
        cut = pc.utf8_split_whitespace(pa.array([t.lower() for t in compress(texts, easy)], pa.large_string()))
        words = pc.dictionary_encode(cut.flatten())
        ids = pa.array(self._words(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        found = iter(pc.binary_join(pa.ListArray.from_arrays(cut.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist())
        return [next(found) if e else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                for t, e in zip(texts, easy)]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row; a null text counts as empty."""
    def run(batches):
        encode = common.held_latest("words", ("packing", tokenizer), lambda: Encoder(tokenizer))
        for batch in batches:
            texts, ids, rows = batch["text"].fillna("").tolist(), batch["doc_id"].tolist(), []
            for a, b in common.groups(texts, most=10_000, chars=1 << 22):
                for doc, data in zip(ids[a:b], encode(texts[a:b])):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    if n <= size:
                        rows.append((doc, 0, 0, n, zlib.crc32(data)))
                    else:
                        data = memoryview(data)
                        rows += [(doc, k, at, min(size, n - at), zlib.crc32(data[4 * at:4 * (at + size)])) for k, at in enumerate(range(0, n, size))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})
    return common.texts(docs).mapInPandas(run, PIECES)


class Bins:
    """Open bins of one task. place() tells a piece's sequence and offset."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.open, self.next = size, most, 0, 0, 0
        self.by_space = defaultdict(list)

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        bin_ = held.pop()
        self.open -= 1
        if not held:
            self.free &= ~(1 << space)
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, bin_ = self.size, self.next
            self.next += 1
        left = space - length
        if left:
            self.by_space[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.size - space


def pack(cut: DataFrame, size: int = 2048, open_bins: int = 4096, per_task: int = 200_000) -> DataFrame:
    """Pieces with sequence_id and offset. Ids of sequences are unique; those of whole pieces are negative.

    per_task pieces on average go to one packing task; a task's rows are met in a random but fixed order.
    """
    whole = cut.filter(F.col("length") == size)
    rest = cut.filter(F.col("length") < size)
    tasks = -(-max(rest.count(), 1) // per_task)

    def run(batches):
        from pyspark import TaskContext
        bins, first = Bins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = np.array([first + p[0] for p in placed], np.int64)
            batch["offset"] = np.array([p[1] for p in placed], np.int64)
            yield batch.drop(columns="order").astype({"doc_id": "Int64"})

    dealt = rest.withColumn("order", F.xxhash64("doc_id", "ids_crc32")).repartition(tasks).sortWithinPartitions("order", "doc_id", "ids_crc32")
    packed = common.cut(dealt.mapInPandas(run, PLACED))
    alone = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, open_bins: int = 4096, per_task: int = 200_000) -> DataFrame:
    """Every piece of every document with its place. Null and empty texts are the single id 0; repeated rows are packed
    each; a null doc_id is kept; extra columns are left behind; an empty table gives no rows."""
    return pack(common.cut(pieces(docs, tokenizer, size)), size, open_bins, per_task)
