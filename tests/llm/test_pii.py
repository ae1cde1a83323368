"""Personal data: base spans against the plain patterns, the trees, and spans that the model adds."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from dwellpath.llm import boosting, pii
from tests.llm.test_operators import EDGES, SCHEMA

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def plain_spans(x):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, x):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and plain_luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def odd(g):
    parts = ["4465758382889437", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (743) 555-3824", "+49.30.1234567", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "007.08.1.0", "a.b@c.d", "é@x.yz", "x@y", "@@a@b.c", "-._%+@a.b-.c", "0", "12", " ", "-", ".", "+", "(", ")", "é", "中", "\n", "a", "@", "1", "9999"]
    return "".join(g.choice(parts) for _ in range(g.randrange(1, 14)))


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_plain_patterns(seed):
    g = random.Random(seed)
    texts = [odd(g) for _ in range(2000)]
    got = [",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in s) for s in pii.scan_batch(pa.array(texts), None)]
    for x, s in zip(texts, got, strict=True):
        assert s == plain_spans(x), x


def prose(g, n):
    return " ".join("".join(g.choice("abcdefghinorst") for _ in range(g.randrange(2, 9))) for _ in range(n))


def card(g):
    d = "4" + "".join(g.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if plain_luhn(d + c))


def personal(n=400, seed=1):
    """Texts with base spans in their midst, and texts with other numbers."""
    g, rows = random.Random(seed), []
    for k in range(n):
        phone = f"+1 ({g.randrange(200, 999)}) 555-{g.randrange(10000):04}"
        own = (f"{prose(g, 1)}.{k}@mail{k % 9}.example.com", card(g), phone, f"{k % 250}.1.2.3", f"in {1900 + k % 120}")[k % 5]
        rows.append((k, f"{prose(g, 12)} {own} {prose(g, 12)}", "en", "s", 0, "x", 1))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.createDataFrame(personal(), SCHEMA))


def added(model, text):
    data = text.encode()
    return {(pii.KINDS[k], data[a:b].decode()) for k, a, b in pii.likely_spans([data], [pii.base_spans(data)], model)[0]}


def test_the_model_adds_other_forms(model):
    for text, want in (
        ("please call 555-123-4567 soon", ("likely_phone", "555-123-4567")),
        ("my card is 4465.7583.8288.9437 ok", ("likely_card", "4465.7583.8288.9437")),
        ("write to anna.berg (at) example (dot) com please", ("likely_email", "anna.berg (at) example (dot) com")),
    ):
        assert want in added(model, text), text


@pytest.mark.parametrize(
    "text", ["He was at home.Then he left", "on 2021-03-17 and 17.03.2021", "version 10.0.19041.1415", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "hash 908038b7daaf91e730d2f64001c52934d43d9336", "from 1914-1918 to 1939-1945", "nothing at all", ""]
)
def test_the_model_leaves_other_numbers_alone(model, text):
    assert not added(model, text)


def test_added_spans_overlap_neither_base_spans_nor_each_other(model):
    g = random.Random(9)
    texts = [" ".join(odd(g) for _ in range(3)) for _ in range(500)]
    for spans in pii.scan_batch(pa.array(texts), model):
        base = [(a, b) for k, a, b in spans if k < 4]
        more = sorted((a, b) for k, a, b in spans if k > 3)
        assert all(b <= c for (_, b), (c, _) in zip(more, more[1:]))
        assert not any(a < y and x < b for a, b in more for x, y in base)


def test_scan_and_redact(spark, model):
    rows = [*EDGES, (60, "Mail a.b@c.de or +1 (743) 555-3824", "en", "s", 0, "x", 1), (61, "é 10.0.0.1", "en", None, 0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in pii.scan(df, model).collect()}
    for r in rows:
        base = plain_spans(r[1] or "")
        assert got[r[0]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in got[r[0]]["spans"].split(",") if not s.startswith("likely")) == base
    assert {r["doc_id"]: r["text"] for r in pii.redact(df, model).filter("doc_id >= 60").collect()} == {60: "Mail <email> or <phone>", 61: "é <ip>"}
    assert pii.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pii.scan(df.filter("doc_id < 10")).filter("spans <> ''").count() == 0  # nothing to learn from


def test_reruns_and_row_order_agree(spark):
    rows = personal(200, 5)
    runs = [pii.scan(spark.createDataFrame(r, SCHEMA).repartition(n)).collect() for r, n in ((rows, 1), (rows[::-1], 5))]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))


@pytest.mark.parametrize("text", ["a" * 400_000 + "@", "1" * 400_000, "a@" * 100_000, "+(" * 150_000, "1.1.1 " * 60_000, "@a.b" * 80_000, "555-1234 " * 20_000])
def test_long_texts_take_linear_time(model, text):
    began = time.time()
    pii.scan_batch(pa.array([text]), model)
    assert time.time() - began < 30


# ------------------------------------------------------------------ trees

def test_trees_learn_what_no_line_separates():
    g = np.random.default_rng(2)
    x = g.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) != (x[:, 2] > 0.2)).astype(int)
    trees = boosting.boost(x[:2000], y[:2000])
    assert ((trees.raw(x[2000:]) > 0) == (y[2000:] == 1)).mean() > 0.95


def test_calibration_and_threshold():
    g = np.random.default_rng(3)
    z = g.normal(0, 3, 20_000)
    y = (g.uniform(size=len(z)) < boosting.sigmoid(0.5 * z + 1)).astype(int)
    a, b = boosting.calibrate(z, y)
    assert abs(a - 0.5) < 0.05 and abs(b - 1) < 0.1
    p = boosting.sigmoid(a * z + b)
    limit = boosting.threshold(p, y, 0.95)
    assert y[p >= limit].mean() >= 0.95 and boosting.threshold(p, np.zeros(len(p)), 0.9) > 1


def test_proposals_are_judged_in_parts(model, monkeypatch):
    g = random.Random(5)
    texts = [" ".join(str(g.randrange(10 ** g.randrange(3, 9))) for _ in range(300)).encode(), b"", b"write to jane at mail dot org or call (555) 123-4567"]
    taken = [pii.base_spans(t) for t in texts]
    whole = pii.likely_spans(texts, taken, model)
    monkeypatch.setattr(pii, "AT_ONCE", 7)
    assert pii.likely_spans(texts, taken, model) == whole and any(whole)
