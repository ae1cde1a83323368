"""Fill-in-middle: texts cut into prefix, middle and suffix at drawn units, and rebuilt from the output.

A unit is a run of A-Z and a-z or any other single code point. The bytes of many texts are viewed
as 64-bit words; arithmetic on whole words marks each byte that ends a unit, and each that begins a
code point. ``bitwise_count`` and running sums give the number of marks before any byte (rank); the
byte of the k-th mark (select) is found by a search in the running sums and then inside one word,
by dropping its lowest marks. So no text is cut into a list of units.

Defined results: a null text is empty; an empty text, or one that holds a sentinel, stays plain; a
row without an id draws from no digits; repeated rows give repeated results; an empty table gives
no rows. Other columns are passed on; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.llm.text import slices, utf8

#: The sentinels, the draws' salt, and the percentages of cut texts and of suffix-first ones among them.
SENTINELS = (b"<P>", b"<S>", b"<M>")
SALT = "1:"
CUT_PERCENT, SPM_PERCENT = 90, 20
FIELDS = {"fim_n": "long", "fim_form": "string", "fim_prefix_chars": "long", "fim_middle_chars": "long", "fim_text": "string"}

_U = np.uint64


def _each(byte: int) -> np.uint64:
    """A word with this byte in all eight places."""
    return _U(byte * 0x0101010101010101)


_HIGH = _each(0x80)


class Marks:
    """One mark bit a byte, in the high bit of the byte's place in its word, with the marks before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks in the bytes before each position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = self.words[word] & ((_U(1) << (byte * _U(8))) - _U(1))
        return self.before[word] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position after the k-th mark of all, k from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left, w = k - self.before[word], self.words[word]
        for _ in range(7):
            more = left > 1
            w = np.where(more, w & (w - _U(1)), w)
            left = left - more
        lowest = w & (~w + _U(1))
        return word * 8 + (np.bitwise_count(lowest - _U(1)).astype(np.int64) >> 3) + 1


def marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """(ends of units, beginnings of code points) of texts that lie one after the other."""
    padded = np.zeros((len(raw) // 8 + 1) * 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    w = padded.view("<u8")
    folded = (w & ~_HIGH) | _each(0x20)
    letter = (folded + _each(0x80 - ord("a"))) & ~(folded + _each(0x80 - ord("z") - 1)) & ~w & _HIGH
    inner = w & ~(w << _U(1)) & _HIGH  # bytes 10xxxxxx, inside a code point
    following = lambda m: (m >> _U(8)) | (np.append(m[1:], _U(0)) << _U(56))
    ends = _HIGH & ~((letter & following(letter)) | following(inner))
    last = offsets[1:][np.diff(offsets) > 0] - 1  # a text's last byte ends a unit whatever comes next
    np.bitwise_or.at(ends, last >> 3, _U(0x80) << ((last & 7).astype(np.uint64) * _U(8)))
    return Marks(ends), Marks(_HIGH & ~inner)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[k : k + 4]) for k in (0, 4, 8, 12))


def cut_batch(ids: list, raw: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    ends, starts = marks(raw, off)
    first = ends.rank(off[:-1])
    n = ends.rank(off[1:]) - first
    h = np.array([draws(x) for x in ids], dtype=np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    at = [np.where(k > 0, ends.select(np.maximum(first + k, 1)), off[:-1]) if len(raw) else off[:-1] for k in (np.minimum(a, b), np.maximum(a, b))]
    chars = starts.rank(np.array([off[:-1], *at]).T.reshape(-1)).reshape(-1, 3)
    data = raw.tobytes()
    forms, outputs = [], []
    for (lo, x, y, hi), draw in zip(np.array([off[:-1], *at, off[1:]]).T.tolist(), h.tolist(), strict=True):
        text = data[lo:hi]
        if not text or any(s in text for s in SENTINELS) or draw[2] % 100 >= CUT_PERCENT:
            forms.append("plain")
            outputs.append(text)
            continue
        p, m, s = data[lo:x], data[x:y], data[y:hi]
        spm = draw[3] % 100 < SPM_PERCENT
        forms.append("spm" if spm else "psm")
        outputs.append(b"".join((SENTINELS[1], s, SENTINELS[0], p, SENTINELS[2], m) if spm else (SENTINELS[0], p, SENTINELS[1], s, SENTINELS[2], m)))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    count = lambda k: pa.array(chars[:, k + 1] - chars[:, k], pa.int64(), mask=plain)
    return [pa.array(n, pa.int64()), pa.array(forms, pa.string()), count(0), count(1), pa.array(outputs, pa.binary()).cast(pa.string())]


def fill_in_middle(documents: DataFrame) -> DataFrame:
    """``documents`` with the columns of FIELDS: units, form, code points of prefix and middle, and the output text."""
    kept = documents.drop(*FIELDS)
    names = kept.columns
    key, text = names.index("doc_id"), names.index("text")
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, {"long": T.LongType(), "string": T.StringType()}[t]) for c, t in FIELDS.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(text))
            for lo, hi in slices(off):
                part = batch.slice(lo, hi - lo)
                new = cut_batch(part.column(key).to_pylist(), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *FIELDS])

    return kept.mapInArrow(run, schema)


def restored(output: str | Column = "fim_text", form: str | Column = "fim_form") -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "<[PSM]>", -1)
    whole = lambda *order: F.concat(*[F.get(part, k) for k in order])
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(documents.select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """The same in SQL, with each text cut into a list of units."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS units, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM t),
k AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, x, n, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= {CUT_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p"""
