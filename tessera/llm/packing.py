"""Packing: concatenate and cut.

Texts are tokenised once into a checkpoint, whose partitions and their order are fixed.  Pass one sums the tokens of each
partition; the prefix sums of those totals (a number per partition) give every partition its global offset.  Pass two walks
each partition from its offset and cuts the documents at the multiples of the window; a document that crosses a boundary
leaves a record on either side.  No row moves between partitions, so one hot source or long text is nothing special.

Every sequence but the last is full, so only the last may be padded, and it isn't where its length is a power of two.

Defined results: a null or empty text is its end token alone; every row is a document, repeated rows too; a null ``doc_id``
stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, strings

WINDOW, END_ID = 4096, 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long"


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCache(dict):
    """Text between blanks -> its ids as little-endian 32-bit bytes, with a bounded memory in two generations.

    Where the tokenizer is known to drop white space and to treat runs of letters alone (``by_word``), a word is encoded once
    for many texts, and words of plain letters go straight to the merge model.  Any other tokenizer gets whole texts.
    """

    most = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = self._drops_blanks(json.loads(self.tokenizer.to_str()))
        self.letters = {i: c for i, c in enumerate(_byte_letters())}

    @staticmethod
    def _drops_blanks(spec: dict) -> bool:
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in before] != ["Split", "ByteLevel"] or spec.get("post_processor"):
            return False
        pattern = str(before[0].get("pattern", {}).get("Regex", ""))
        return pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and bool(before[0].get("invert")) and not before[1].get("add_prefix_space") and not any(x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", []))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _encode(self, chunk: str) -> bytes:
        if len(chunk) > 1 and chunk[-1] in ".," and chunk[-2].isalpha() and chunk[-2] < "\u0250" and chunk[-2] != "\u0130":  # after a letter the mark is a token of its own
            return self[chunk[:-1]] + self[chunk[-1]]
        if chunk.isalpha() and max(chunk) < "\u0250" and "\u0130" not in chunk:  # here lower() and NFC keep the number of characters
            low = chunk.lower()
            if low != chunk:
                return self[low]
            plain = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes() if chunk else b""

    def ids(self, text: str) -> bytes:
        """Only blanks that every reading of white space includes are cut at."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    """One for all the tasks of a worker."""
    return WordCache(path)


def tokenise(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (two bytes each where the vocabulary allows it, else four), n."""
    from tokenizers import Tokenizer

    wide = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    end = np.array([end_id], wide).tobytes()

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer_path)
        for b in parts:
            ids = [np.frombuffer(cache.ids(x), "<u4").astype(wide).tobytes() + end for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // len(end) for x in ids], pa.int64())], ["doc_id", "ids", "n"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), f, "doc_id long, ids binary, n long").withColumn("wide", F.lit(wide))


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row per piece, as in ``SCHEMA``."""
    tokens = cut(tokenise(documents, tokenizer_path, end_id))
    totals = {r[0]: r[1] for r in tokens.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()}
    first, at = {}, 0
    for k in sorted(totals):
        first[k] = at
        at += totals[k]
    whole = at
    last_length = whole % window or window
    last_padded = last_length if last_length & (last_length - 1) == 0 else window

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = None
        for b in parts:
            if pos is None:
                pos = first[TaskContext.get().partitionId()]
            out: list[tuple] = []
            for doc, raw, n, wide in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids, start = np.frombuffer(raw, wide).astype("<u4"), 0
                while start < n:
                    seq, off = divmod(pos, window)
                    length = min(n - start, window - off)
                    final = seq == (whole - 1) // window
                    out.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, seq, off, last_length if final else window, last_padded if final else window))
                    start += length
                    pos += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "padded_length"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 9)], names)

    return map_arrow(tokens.select("doc_id", "ids", "n", "wide"), f, SCHEMA)
