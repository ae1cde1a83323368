"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters over lower-cased letters (anything else is a
gap). A text's weight of a feature is its share of the text's n-grams times the inverse document
frequency, which is counted over every training document. Weights are learned by follow-the-
regularised-leader with L1 and L2 penalties on at most ``PER_LANG`` documents a language and
``MAX_ROWS`` in all, but one of each language at least (documented bounds; the choice is by hash of
doc_id and text, equal rows are chosen once), and a temperature is then calibrated on a fifth of
those documents that the weights haven't seen. Every language is learned: where there are so many
that a weight for each feature and language would pass ``MAX_WEIGHTS``, features share weights.

Training rows have a text, a lang and a doc_id whose crc32 modulo 4 is not 2. Predictions look
at the text alone.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with
score 0; without any training row every text is ``und``; rows of one doc_id are each learned
from under their own lang, and predicted by their own text; ties between languages go to the
first by code point; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.llm.spark import stored
from dwellpath.llm.text import slices, utf8

ORDERS = 3
BUCKETS = 1 << 14
FEATURES = ORDERS * BUCKETS
#: Bounds of the sample of labelled rows that weights are fitted on: a language, and in all.
PER_LANG, MAX_ROWS = 500, 20_000
#: Weights at most, where not even one feature of each order needs more.
MAX_WEIGHTS = 1 << 22
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = 10.0
_U = np.uint32
_LUT_END = 0x3000


def _letters() -> np.ndarray:
    """Lower-cased letter, a mark that stands on one, or 32 for anything else, of the code points below _LUT_END."""
    t = np.full(_LUT_END, 32, dtype=np.uint32)
    for c in range(_LUT_END):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            t[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(x) == "Mn":
            t[c] = c
    return t


_LETTER = _letters()
_IS_LETTER = np.array([chr(c).isalpha() for c in range(_LUT_END)])


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of the texts, their bounds, and whether each text has a letter."""
    lead = (raw & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[offsets]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    high = cp >= _LUT_END
    low = np.where(high, 0, cp)
    folded, is_letter = _LETTER[low], _IS_LETTER[low]
    if high.any():
        some, at = np.unique(cp[high], return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in some.tolist()])[at]
        folded[high], is_letter[high] = np.where(alpha, cp[high], 32), alpha
    count = np.concatenate([[0], np.cumsum(is_letter)])
    return folded, bounds, count[bounds[1:]] > count[bounds[:-1]]


def features(folded: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: text index and feature of every n-gram that has a letter."""
    n = len(folded)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gap = folded == 32
    h = np.zeros(n, dtype=_U)
    blank = np.ones(n, dtype=bool)
    for k in range(1, ORDERS + 1):
        m = n - k + 1
        if m <= 0:
            return
        h = (h[:m] * _U(0x9E3779B1)) ^ (folded[k - 1 :] * _U(0x85EBCA6B))
        blank = blank[:m] & gap[k - 1 :]
        ok = ~blank & (row[:m] == row[k - 1 :])
        x = h[ok] * _U(0xC2B2AE35)
        x ^= x >> _U(15)
        yield row[:m][ok], ((x * _U(0x27D4EB2F)) >> _U(18)).astype(np.int64) + (k - 1) * BUCKETS


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        raw, off = utf8(batch.column(0))
        for lo, hi in slices(off, 1 << 20):
            for a in range(lo, hi, 512):
                b = min(hi, a + 512)
                folded, bounds, _ = code_points(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                seen = np.zeros((b - a, FEATURES), dtype=bool)
                for row, f in features(folded, bounds):
                    seen[row, f] = True
                df += seen.sum(axis=0)
                docs += b - a
    some = np.flatnonzero(df)
    feature = np.concatenate([[-1], some])
    yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int64()), pa.array(np.concatenate([[docs], df[some]]), pa.int64())], names=["feature", "df"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch.column(1))
        fs, ws = [], []
        for a in range(batch.num_rows):
            folded, bounds, _ = code_points(raw[off[a] : off[a + 1]], np.array([0, off[a + 1] - off[a]]))
            parts = [f for _, f in features(folded, bounds)]
            f, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            fs.append(f.astype(np.int32)), ws.append((c / max(1, c.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fs, pa.list_(pa.int32())), pa.array(ws, pa.list_(pa.float32())), batch.column(2)], names=["lang", "f", "w", "place"])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # features x langs
    bias: np.ndarray
    temperature: float
    idf: np.ndarray  # of each of FEATURES
    buckets: int


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(bags: list, n_langs: int, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after EPOCHS passes of per-coordinate follow-the-regularised-leader."""
    z, n = np.zeros((n_features + 1, n_langs)), np.zeros((n_features + 1, n_langs))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    g = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for i in g.permutation(len(bags)).tolist():
            f, x, y = bags[i]
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            grad = x[:, None] * p[None, :]
            step = (np.sqrt(ni + grad * grad) - np.sqrt(ni)) / ALPHA
            z[f] = zi + grad - step * w
            n[f] = ni + grad * grad
    w = weights(z, n)
    return w[:n_features], w[n_features]


def sample(training: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS) -> DataFrame:
    """(lang, text, place) of the rows to fit on: of each language those first by the hash of doc_id.

    Texts stay where they are until the rows are chosen; their digests stand for them.
    """
    digest = F.xxhash64("doc_id", "text")
    ids = stored(training.select("lang", digest.alias("row")).distinct())
    each = max(1, min(per_lang, max_rows // max(1, ids.select("lang").distinct().count())))
    by_hash = Window.partitionBy("lang").orderBy("row")
    chosen = ids.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= each)
    # at most max_rows rows, or one a language, are broadcast
    rows = training.withColumn("row", digest).join(F.broadcast(chosen), ["lang", "row"])
    return rows.groupBy("lang", "place").agg(F.first("text").alias("text"))  # equal rows once


def shared_buckets(n_langs: int, most: int = MAX_WEIGHTS) -> int:
    """Buckets of an order: all of them, or the largest power of two that keeps the weights within the bound."""
    b = BUCKETS
    while b > 1 and ORDERS * b * n_langs > most:
        b //= 2
    return b


def shared_feature(f: np.ndarray, buckets: int) -> np.ndarray:
    """Feature numbers where an order has so many buckets."""
    return f if buckets == BUCKETS else f // BUCKETS * buckets + f % buckets


def fit(training: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from ``training`` (doc_id, text, lang)."""
    rows = training.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    counts = {r["feature"]: r["df"] for r in rows}  # at most FEATURES + 1
    total = counts.pop(-1, 0)
    if not total:
        return None
    idf = np.zeros(FEATURES)
    at = np.array(list(counts), dtype=np.int64)
    idf[at] = np.log((1 + total) / (1 + np.array([counts[k] for k in at.tolist()]))) + 1.0
    bags = sample(training, per_lang).select("lang", "text", "place").mapInArrow(_bags, "lang string, f array<int>, w array<float>, place int").toPandas()
    if bags.empty:
        return None
    langs = sorted(bags["lang"].unique())
    index = {x: k for k, x in enumerate(langs)}
    buckets = shared_buckets(len(langs))
    n_features = ORDERS * buckets
    made, test = [], []
    order = bags.sort_values(["lang", "place"], kind="stable")
    for lang, f, w, place in zip(order["lang"], order["f"], order["w"], order["place"], strict=True):
        f = np.asarray(f, dtype=np.int64)
        x = np.asarray(w, dtype=np.float64) * idf[f] * SCALE
        if buckets != BUCKETS:
            f, at = np.unique(shared_feature(f, buckets), return_inverse=True)
            x = np.bincount(at, x, len(f))
        bag = (np.append(f, n_features), np.append(x, 1.0), index[lang])
        (test if place % 5 == 0 else made).append(bag)
    w, bias = ftrl(made, len(langs), n_features)
    logits = np.array([x[:-1] @ w[f[:-1]] + bias for f, x, _ in test or made])
    truth = np.array([y for _, _, y in test or made])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    scaled = (w * idf[:, None] * SCALE if buckets == BUCKETS else w).astype(np.float32)
    return Model(langs, scaled, bias, float(grid[int(np.argmin(loss))]), idf * SCALE, buckets)


def predict(documents: DataFrame, model: Model | None, held_out) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # MAX_WEIGHTS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, off = utf8(batch.column(2))
            best, score = [], []
            for a, b in slices(off):
                folded, bounds, some = code_points(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                if m is None:
                    best += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                total, count = np.zeros((b - a, len(m.langs))), np.zeros(b - a)
                for row, f in features(folded, bounds):
                    c = np.bincount(row, minlength=b - a)
                    count += c
                    rows = np.flatnonzero(c)
                    if len(rows):
                        starts = np.concatenate([[0], np.cumsum(c[rows])[:-1]])
                        w = m.table[f] if m.buckets == BUCKETS else m.table[shared_feature(f, m.buckets)] * m.idf[f][:, None].astype(np.float32)
                        total[rows] += np.add.reduceat(w, starts, axis=0, dtype=np.float64)
                p = _softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                k = p.argmax(axis=1)
                best += [m.langs[j] if s else "und" for j, s in zip(k.tolist(), some.tolist(), strict=True)]
                score += np.where(some, p[np.arange(b - a), k], 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Train on the rows that may be learned from and predict every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    training = documents.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    return predict(documents, fit(training, per_lang), held)
