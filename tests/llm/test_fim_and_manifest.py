"""Fill-in-middle and the Merkle manifest against plain versions and on edge rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dwellpath.llm import fim, merkle, text
from tests.llm.test_operators import EDGES, SCHEMA

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------------ fill-in-middle

def plain_cut(doc_id, x):
    x = x or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", x, re.DOTALL)
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not x or any(t in x for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, x
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def odd_texts(seed, n=400):
    g = random.Random(seed)
    letters = ["a", "Z", "z", "A", "@", "[", "`", "{", " ", "\n", "\0", "é", "ß", "中", "😀", "́", "<", ">", "<P", "0"]
    return ["".join(g.choice(letters) for _ in range(g.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cuts_equal_plain_ones(seed):
    texts = [*odd_texts(seed), "", None, "é", "a" * 100_000, "é" * 50_000 + "ab", "x<M>y"]
    ids = [None, *range(-3, len(texts) - 4)]
    raw, off = text.utf8(pa.array(texts))
    got = list(zip(*(c.to_pylist() for c in fim.cut_batch(ids, raw, off)), strict=True))
    assert got == [plain_cut(i, t) for i, t in zip(ids, texts, strict=True)]


def test_rank_and_select_are_inverse():
    raw, off = text.utf8(pa.array(odd_texts(4)))
    ends, _ = fim.marks(raw, off)
    k = np.arange(1, int(ends.before[-1]) + 1)
    k = k[ends.select(k) <= len(raw)]
    assert (ends.rank(ends.select(k)) == k).all()


def test_texts_come_back_and_other_columns_stay(spark):
    rows = [*EDGES, *[(100 + k, t, None, "s", 0, "x", k) for k, t in enumerate(odd_texts(5, 100))]]
    df = spark.createDataFrame(rows, SCHEMA)
    out = fim.fill_in_middle(df).withColumn("back", fim.restored()).collect()
    assert sorted((r["text"] or "", r["back"]) for r in out) == sorted((r[1] or "", r[1] or "") for r in rows)
    assert set(df.columns) < set(out[0].asDict()) and fim.fill_in_middle(fim.fill_in_middle(df)).count() == len(rows)
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ manifest

def plain_tree(leaves):
    """(root, for each leaf its (left, right) siblings from the lowest level up)."""
    paths = [[] for _ in leaves]
    level, at = list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            a = p // 16 * 16
            paths[k].append(("".join(level[a:p]), "".join(level[p + 1 : a + 16])))
        level, at = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [p // 16 for p in at]
    return level[0], paths


def plain_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars, ...)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(low)) if hit else leaf(r, r[1]), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s])]) for s in sources]
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), more in zip(sources, trees, upper, strict=True):
        for (*_, own, offered, doc_id), path in zip(sorted(by[s]), paths, strict=True):
            folded = offered
            for a, z in path + more:
                folded = sha(a + folded + z)
            out.append((doc_id, own, subroot, root, sha("".join(a + z for a, z in path + more)), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, rows):
    df = merkle.tampered(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("kind", ["edges", "one row", "one source", "many sources", "over a block", "equal rows"])
def test_manifest_equals_plain_one(spark, kind):
    row = lambda k, s, t="Some Text": (k, t, "en", s, k, "x", 1)
    rows = {
        "edges": EDGES, "one row": [row(5, None)], "one source": [row(k, "s") for k in range(300)], "many sources": [row(k, f"é{k % 290}" if k % 7 else None) for k in range(900)],
        "over a block": [row(-k, "hot", f"Text {k}") for k in range(merkle.BLOCK + 20)] + [row(k, f"s{k % 20}") for k in range(merkle.BLOCK // 2)],
        "equal rows": [row(7, "s")] * 200 + [row(None, "s")] * 20 + [row(8, "s", None), row(8, "s", "")],
    }[kind]
    assert found(spark, rows) == plain_manifest(rows)


def test_manifest_of_nothing_and_its_siblings(spark):
    assert merkle.tampered(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "T", "en", f"s{k % 3}", k, "x", 1) for k in range(100)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), siblings=True).collect():
        assert r["verified"] and sha("".join(r["siblings"])) == r["proof_sha256"]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4097, 5000])
def test_sweeps_over_several_rounds(n, monkeypatch):
    """Blocks of one level, so that a few thousand leaves take up to four rounds up and down."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    leaves = [sha(str(k)) for k in range(n)]
    rounds = [leaves]
    while len(rounds[-1]) > 1:
        tops = []
        for b in range(0, len(rounds[-1]), 16):
            sweep = merkle.Rising(b == 0)
            for d in rounds[-1][b : b + 16]:
                sweep.leaf(d)
            tops.append(sweep.top())
        rounds.append(tops)
    root, paths = plain_tree(leaves)
    assert rounds[-1] == [root]
    endings = {0: ()}
    for low in reversed(rounds[:-1]):
        endings = {b * 16 + k: e for b, top in endings.items() for k, e in merkle.falling(low[b * 16 : b * 16 + 16], b == 0, top)}
    assert [list(merkle._levels(endings[k])) for k in range(n)] == paths
