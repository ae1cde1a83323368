"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document's token ids, with the end id, are cut into as many pieces of ``MAX_LENGTH`` as fit
and then into pieces by the binary digits of the rest, longest first. Each piece is a sequence
of its own whose length is a power of two; ``bucket`` is that power, so batches of one shape
are drawn from one bucket.

Token ids come from a public tokenizer file whose path is a parameter. Its rules never look
across white space and lower-case everything but special tokens, so each distinct word of a
stretch of text is encoded once and its ids are looked up for every other place, by a 64-bit hash
in which A-Z count as a-z: words of up to eight bytes never share one, and among n longer words two
do with a chance of n * n / 2**65. Words that contain "<|" go by a digest of their very bytes. A
bounded memory of words is kept from stretch to stretch, and those used most outlive it when it is
full. A text longer than a stretch is encoded in parts that end at white space.

Defined results: a null or empty text is the end id alone; texts of any length are cut the same
way; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellpath.llm import spark
from dwellpath.llm.text import slices, utf8, words_at

_U = np.uint64
MAX_LENGTH = 4096
END_ID = 2
#: Text that is split into words at a time.
STRETCH_BYTES = 1 << 20
#: What a worker remembers at most: distinct words and their ids in sorted arrays, and the letters or marks that words are made of.
MEMORY_WORDS, MEMORY_IDS, MEMORY_PARTS = 1 << 20, 5_000_000, 100_000
#: Of a full memory, the words used most that stay: one in so many, of at most so many ids each.
_STAY, _STAY_IDS = 4, 8
#: Words in one text that the tokenizer is given, and texts in one call.
_JOINED, _CALL = 400, 16
#: Lower-case words that go straight to the tokenizer's model, where that gives what its rules give for some such words.
_MARKS, _ACCENTED = ".,;:!?#*$%&", "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_LOWER = "".join(c for c in _ACCENTED if c == c.lower())
PLAIN = re.compile(rf"([a-z{_LOWER}]{{1,64}})([{_MARKS}]{{0,8}})")
_PROBES = ("a", "Zebra", "unbelievablenesses,", "THE", "qzxjv.", "s", "ll", "don", "I;", "tvre:", "Well!", "EMDASH?", "Été,", "garçon", "odd&&&", "line.###", "a..!?", "x%$*;:", *_ACCENTED)
_SPACE = re.compile(rb"[\x09-\x0D\x20]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of words by their bytes; unknown words are encoded, many in one call."""

    _held: dict[str, WordIds] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tok.token_to_id(self.mark)
        self.tokenize = self.tok.model.tokenize
        self.bytes_as_letters = {c: "".join(x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)) for c in _LOWER} if self.tok.pre_tokenizer else {}
        self.parts: dict[str, bytes] = {"": b""}
        # the letters are put in place one after the other, so none may stand for a byte of another
        self.plain = not set("".join(self.bytes_as_letters.values())) & set(_LOWER) and all(list(array("I", self._plain([m.groups()])[0])) == self.tok.encode(w, add_special_tokens=False).ids for w in _PROBES if (m := PLAIN.fullmatch(w.lower())))
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def _make_room(self) -> None:
        """Forget all but the words that were used most, more than once each."""
        often = np.flatnonzero((self.used > 1) & (self.count <= _STAY_IDS))
        kept = np.sort(often[np.argsort(-self.used[often], kind="stable")[: MEMORY_WORDS // _STAY]])
        self.ids, self.at = self._gathered(kept)
        self.hash, self.count, self.used = self.hash[kept], self.count[kept], self.used[kept] // 2

    def rest(self) -> None:
        """Between tasks a worker, which may go on to other work, remembers the words used most alone."""
        self._make_room()
        self.parts = {"": b""}
        spark.rest()

    def _gathered(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at places ``k``, one after the other, and where each begins."""
        count = self.count[k]
        start = np.cumsum(count) - count
        return self.ids[np.repeat(self.at[k] - start, count) + np.arange(int(count.sum()))], start

    def _plain(self, words: list[tuple[str, str]]) -> list[bytes]:
        """Ids, as bytes, of words that match PLAIN: the rules leave their letters and their marks whole."""
        if len(self.parts) > MEMORY_PARTS:
            self.parts = {"": b""}
        parts = self.parts
        new = [x for x in dict.fromkeys(x for w in words for x in w) if x not in parts]
        if new:
            joined = "\n".join(new)
            for c, letters in self.bytes_as_letters.items():
                joined = joined.replace(c, letters)
            for x, letters in zip(new, joined.split("\n"), strict=True):
                parts[x] = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        return [parts[letters] + parts[marks] for letters, marks in words]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        found: list[bytes] = [b""] * len(words)
        at, plain, rest = [], [], []
        for i, (w, low) in enumerate(zip(words, "\n".join(words).lower().split("\n"), strict=True)):
            if self.plain and (m := PLAIN.fullmatch(low)):
                at.append(i)
                plain.append(m.groups())
            elif "<|" in w:
                found[i] = array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(at, self._plain(plain), strict=True):
            found[i] = ids
        groups = [rest[k : k + _JOINED] for k in range(0, len(rest), _JOINED)]
        for k in range(0, len(groups), _CALL):
            some = groups[k : k + _CALL]
            joined = self.tok.encode_batch_fast([self.mark.join([words[i] for i in g]) for g in some], add_special_tokens=False)
            for g, e in zip(some, joined, strict=True):
                ids = np.array(e.ids, dtype=np.uint32)
                data, marks = ids.tobytes(), np.flatnonzero(ids == self.mark_id).tolist()
                for i, a, b in zip(g, [0, *(m + 1 for m in marks)], [*marks, len(ids)], strict=True):
                    found[i] = data[4 * a : 4 * b]
        return np.frombuffer(b"".join(found), dtype=np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of texts, one after the other, and how many come before each text (one entry more)."""
        if len(self.hash) > MEMORY_WORDS or len(self.ids) > MEMORY_IDS:
            self._make_room()
        data = raw.tobytes()
        h, start, end = words_at(raw, offsets)
        if b"<|" in data:
            marked = np.unique(np.searchsorted(start, [m.start() for m in re.finditer(rb"<\|", data)], side="right") - 1)
            h[marked] = [int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little") for i in marked.tolist()]
        own, first, where = np.unique(h, return_index=True, return_inverse=True)
        k = np.searchsorted(self.hash, own)
        new = np.flatnonzero(np.append(self.hash, _U(0))[k] != own) if len(self.hash) else np.arange(len(own))
        # a hash of 0 that isn't held lies before all others, so the value put at the end never passes for one
        if len(new):
            words = b"\n".join([data[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            ids, count = self._encode(words.decode("utf-8", "replace").split("\n"))
            self.at = np.insert(self.at, k[new], len(self.ids) + np.cumsum(count) - count)
            self.hash, self.count, self.used = np.insert(self.hash, k[new], own[new]), np.insert(self.count, k[new], count), np.insert(self.used, k[new], 0)
            self.ids = np.concatenate([self.ids, ids])
            k = np.searchsorted(self.hash, own)
        self.used[k] += np.bincount(where, minlength=len(own))
        rows = k[where]
        total = np.concatenate([[0], np.cumsum(self.count[rows])])
        return self._gathered(rows)[0], total[np.searchsorted(start, offsets)]


def _chunks(data: bytes, a: int, b: int) -> Iterator[bytes]:
    """``data[a:b]`` in parts of about STRETCH_BYTES that end at white space."""
    while a < b:
        gap = _SPACE.search(data, a + STRETCH_BYTES, b) if b - a > STRETCH_BYTES else None
        end = gap.start() if gap else b
        yield data[a:end]
        a = end


def encode(texts: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges (a, b): their ids one after the other, each text's end id included, and bounds."""
    book = WordIds.of(path)
    raw, off = utf8(texts)
    for a, b in slices(off, STRETCH_BYTES):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo > STRETCH_BYTES:  # one long text
            chunks = _chunks(raw[lo:hi].tobytes(), 0, hi - lo)
            ids = np.concatenate([*(book.encode(np.frombuffer(c, dtype=np.uint8), np.array([0, len(c)]))[0] for c in chunks), [END_ID]]).astype(np.uint32)
            yield a, b, ids, np.array([0, len(ids)])
            continue
        ids, bounds = book.encode(raw[lo:hi], off[a : b + 1] - lo)
        yield a, b, np.insert(ids, bounds[1:], END_ID), bounds + np.arange(b - a + 1)


def pieces(length: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of a document's pieces: whole ones, then the binary digits of the rest."""
    rest = length % longest
    return [longest] * (length // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (, ids)."""
    path = path or tokenizer_path()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, bounds in encode(batch.column(1), path):
                rows: list[list] = [[] for _ in schema]
                data = memoryview(ids.astype("<u4").tobytes())
                for i, lo, hi in zip(range(a, b), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    at = lo
                    for n in pieces(hi - lo):
                        values = (doc_ids[i], at - lo, n, zlib.crc32(data[4 * at : 4 * (at + n)]), hi - lo, n.bit_length() - 1)
                        for column, v in zip(rows, values, strict=False):
                            column.append(v)
                        if with_ids:
                            rows[-1].append(ids[at : at + n].astype(np.int32))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
        WordIds.of(path).rest()

    out = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + (", ids array<int>" if with_ids else ""))
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
