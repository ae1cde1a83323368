"""The training-data operators against plain versions and on edge rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwellpath.llm import chat, fingerprints, graph, jaccard, langid, licenses, mixing, packing, quality, queries, secret_scan, sharding, text
from tests.conftest import DATA, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, size long"
EDGES = [
    (1, "a", None, None, 1, "x", 1), (2, None, "en", "s1", 0, "x", 1), (3, "", "fr", None, 0, "x", 1), (4, "x " * 3000, "en", "s1", 6000, "x", 1),
    (5, "one two three four five six seven", "en", "s2", 5, "x", 1), (5, "one two three four five six seven", "en", "s2", 5, "x", 1), (None, "one two three four five six seven", None, "s2", 5, "x", 1),
    (6, "One two three four five six seven eight", "en", "s2", 5, "x", 1), (7, " \n\t ", None, "s1", 1, "x", 1), (8, "1234 5678 !!!", None, "s1", 1, "x", 1), (9, "A", None, "s1", 1, "x", 1),
]


def shingles(t):
    ws = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


OPERATORS = {
    "fingerprints": fingerprints.fingerprints, "secrets": secret_scan.scan, "mix": mixing.mix, "pack": packing.pack, "jaccard": jaccard.join_components,
    "quality": quality.score, "licenses": licenses.scan, "sharding": sharding.place, "language": langid.identify, "redact": secret_scan.redact,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_table(spark, edges, name):
    out = OPERATORS[name](edges)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert collections.Counter(set(ids)) == collections.Counter({r[0] for r in EDGES})
    if name != "pack":
        assert len(ids) == len(EDGES)
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_shingle_sets(rows):
    texts = [r["text"] for r in rows] + ["", None, "a B c", "A b C", "a b c d e f g"]
    raw, off = text.utf8(pa.array(texts))
    h, b = text.shingle_sets(raw, off)
    assert np.diff(b).tolist() == [len(shingles(t)) for t in texts]
    assert h[b[-4] : b[-3]].tolist() == h[b[-3] : b[-2]].tolist()


def test_fingerprints(spark, rows):
    got = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, DATA).collect()}
    order = sorted(rows, key=lambda r: -r["doc_id"])
    miss = []
    for r, n in zip(order, [*order[1:], order[0]], strict=True):
        k = len(r["text"]) // 3
        e = r["text"][: len(r["text"]) - k] + n["text"][:k]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(r["text"]) and g["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        for a, b, near in ((r["text"], e, g["near_edited"]), (r["text"], n["text"], g["near_next"])):
            x, y = shingles(a), shingles(b)
            miss.append(near - (len(x & y) / len(x | y) if x | y else 1.0))
    assert abs(np.mean(miss)) < 0.02 and np.std(miss) < 0.05 and np.abs(miss).max() < 0.2


def test_secrets(rows):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    texts = [r["text"] for r in rows] + ["é secret: token: abcdef AKIA" + "A1" * 9, "key aB3dE5gH7jK9mN1pQ3sT5vW7 end", "550e8400-e29b-41d4-a716-446655440000", "averylongwordwithoutanydigits"]
    for t, spans in zip(texts, secret_scan.scan_batch(pa.array(texts)), strict=True):
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(a, k, b) for k, a, b in spans if k < 3] == sorted(want)
    last = secret_scan.scan_batch(pa.array(texts[-3:]))
    assert [k for k, _, _ in last[0]] == [3] and last[1] == [] and last[2] == []
    assert secret_scan.redact_text("a password=abcdefg b", [(0, 2, 18)]) == "a <assign> b"


def test_mixing(spark):
    got = queries.op5_mixing(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op5_mixing(spark, DATA).collect()))
    src = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        s = src[r["doc_id"]][0]
        assert r["size"] == src[r["doc_id"]][1] and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)


def test_apportionment_is_by_highest_quotients(spark):
    g = random.Random(4)
    votes = [(k, float(g.randrange(1, 500))) for k in range(9)]
    df = spark.createDataFrame(votes, "k long, votes double").withColumn("seats", F.lit(57).cast("long"))
    got = {r["k"]: r["quota"] for r in mixing.apportion(df, [], [F.col("k")], "votes", "seats").collect()}
    want = collections.Counter()
    for _ in range(57):
        want[max(votes, key=lambda v: (v[1] / (2 * want[v[0]] + 1), -v[0]))[0]] += 1
    assert got == {k: want[k] for k, _ in votes}


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = collections.defaultdict(list)
    out = packing.pack(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + [(-1, "x <|endoftext|> y z"), (-2, None)], "doc_id long, text string"), with_ids=True).collect()
    for r in out:
        got[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    for d, t in [(r["doc_id"], r["text"]) for r in rows] + [(-1, "x <|endoftext|> y z"), (-2, "")]:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(got[d], key=lambda r: r["start"]):
            assert p["start"] == at and p["length"] & (p["length"] - 1) == 0 and p["length"] <= 4096 and p["doc_tokens"] == len(ids)
            assert list(p["ids"]) == ids[at : at + p["length"]] and p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def brute_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 4 * len(x & y) >= 3 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {k: root(k) for k in sets}, {k: len(s) for k, s in sets.items()}


def planted(seed):
    """Copies at all distances round the threshold, in small and large groups, and a shared passage in short texts."""
    g = random.Random(seed)
    word = lambda: f"w{g.randrange(4000)}"
    out, passage = {}, [word() for _ in range(40)]

    def add(ws):
        out[len(out) * 3 + 1] = " ".join(ws)

    for _ in range(25):
        base = [word() for _ in range(g.choice([6, 12, 30, 80, 200]))]
        add(base)
        for _ in range(g.randrange(1, 5)):
            copy = list(base)
            for _ in range(g.randrange(0, max(2, len(base) // 12))):
                copy[g.randrange(len(copy))] = word()
            add(copy[: len(copy) - g.randrange(0, max(1, len(copy) // 8))])
    base = [word() for _ in range(90)]
    for _ in range(60):
        copy = list(base)
        for _ in range(g.randrange(0, 4)):
            copy[g.randrange(90)] = word()
        add(copy)
    for _ in range(60):
        add(passage + [word() for _ in range(g.randrange(2, 25))])
    for n in range(40):
        add(["a", "b", "c", "d", "e", "f", "g", "h"][: 1 + n % 8])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    texts = planted(seed)
    want, sizes = brute_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = jaccard.join_components(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes


def test_components(spark):
    g = random.Random(3)
    pairs = [(g.randrange(300), g.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(500, 560)]
    up = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: y for x, y in up.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_quality(spark, rows):
    for r in quality.score(spark.read.parquet(f"{DATA}/documents.parquet"), keep=("doc_id", "text")).collect():
        ws = WORD.findall(r["text"])
        windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        n = collections.Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(8)}
        lines = [x for x in r["text"].split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r["text"])))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = [r for r in queries.op10_language(spark, DATA).collect() if r["held_out"]]
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95


def test_licenses_equal_sql(spark, duck):
    df = queries.op9_licenses(spark, DATA)
    c = sorted(df.columns)
    assert plain(df.select(*c).collect()) == plain(duck.sql(f"SELECT {', '.join(c)} FROM ({queries.oracle_sql()['op9_licenses']})").fetchall())
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    got = licenses.scan(spark.createDataFrame([(1, full), (2, "\n".join(full.split("\n")[::-1]))], "doc_id long, text string"))
    assert {r["doc_id"]: r["licenses"] for r in got.collect()} == {1: "MIT", 2: ""}


def test_sharding():
    names = [f"n{k}" for k in range(5)]
    t = sharding.lookup_table(names, 101)
    want, walks = [-1] * 101, [[(o + k * s) % 101 for k in range(101)] for o, s in (sharding.preference(n, 101) for n in names)]
    turn = 0
    while -1 in want:
        w = walks[turn % 5]
        want[next(x for x in w if want[x] == -1)] = turn % 5
        turn += 1
    assert t.tolist() == want and sorted(collections.Counter(want).values()) == [20, 20, 20, 20, 21]
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def cheapest(roles):
    import heapq

    queue, seen = [(0, 0, 0)], set()
    while queue:
        c, i, s = heapq.heappop(queue)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and (s == 3 or not roles):
            return c
        for q in chat.NEXT[s]:
            heapq.heappush(queue, (c + chat.INSERT, i, q))
            if i < len(roles):
                heapq.heappush(queue, (c + (0 if roles[i] == q else chat.RELABEL if roles[i] else chat.GUESS), i + 1, q))
        if s and i < len(roles):
            heapq.heappush(queue, (c + chat.MERGE + (0 if roles[i] == s else chat.RELABEL if roles[i] else chat.GUESS), i + 1, s))


def test_chat_repair_is_cheapest():
    g = random.Random(3)
    for _ in range(400):
        roles = [g.randrange(4) for _ in range(g.randrange(1, 9))]
        way = chat.repair(roles, 0, None)
        assert sum(w[1][0] for w in way) + chat._CLOSE[way[-1][0]][0] == cheapest(roles)


def test_chat_across_ranges(spark):
    """One conversation over all partitions, others inside; rendering equals that of the whole."""
    g = random.Random(8)
    rows = [(7, k, g.choice(["user", "Assistant", "system", None, "bot"]), f"t{k}") for k in range(300)] + [(c, k, "user", f"u{c}-{k}") for c in (1, 2, 9) for k in range(3)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for c in (1, 2, 7, 9):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        roles = [chat.role_of(r[2]) for r in own]
        made = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["turn"])
        text_ = "".join(r["piece"] for r in made)
        opened = re.findall(r"<\|im_start\|>(\w+)", text_)
        assert len(opened) == text_.count("<|im_end|>") and opened[-1] == "assistant"
        body = opened[1:] if opened[0] == "system" else opened
        assert body == ["user", "assistant"] * (len(body) // 2)
        assert sum(1 for _ in made) == len(roles)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from dwellpath.llm.spark import stored

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = d
        d = stored(stage(spark, d, DATA))
        counts.append(d.count())
        if k < 4:
            assert d.columns == list(corpus_pipeline.COLUMNS)
        if k == 1:
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            want, _ = brute_components(texts)
            assert sorted(r["doc_id"] for r in d.collect()) == sorted(set(want.values()))
        if k == 2:
            assert not any(any(x[0] < 3 for x in s) for s in secret_scan.scan_batch(pa.array([r["text"] for r in d.collect()])))
    assert counts[0] >= counts[1] == counts[2] and counts[4] >= counts[3] > 0


GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version."
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "GPL-3.0": GPL.format(":", ",", 3),
    "GPL-2.0": GPL.format(";", ";", 2),
    "All-Rights-Reserved,BSD-2-Clause": BSD,
    "All-Rights-Reserved,BSD-2-Clause,BSD-3-Clause": BSD + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Copyright (c) 2020, Some One\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial\n4.0 International License.",
    "CC0-1.0": "To the extent possible under law, Some One has waived all copyright and\nrelated or neighboring rights to This Work.",
}


def test_licenses_of_standard_notices(spark):
    """Each notice wrapped, in a comment, on one line and with its first blank lines gone."""
    forms = [lambda t: t, lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint x;", lambda t: " ".join(t.split()), lambda t: "words before.\n" + t.replace("\n\n", "\n", 2) + "\n\nwords after"]
    rows = [(10 * k + j, form(t)) for k, t in enumerate(NOTICES.values()) for j, form in enumerate(forms)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * k + j: name for k, name in enumerate(NOTICES) for j in range(len(forms))}


def test_words_beside_a_secret_suppress_only_themselves():
    s = "9fKq3LzT7vB2xW8mR4nY6cD1"
    for before, after in (("sample", "_id=" + s), ("example", "/" + s), ("", s + "/example"), ("", s + "xXxx" + s + "ab"), ("0123456789", "-" + s), ("my-dummy", "/" + s)):
        spans = secret_scan.scan_batch(pa.array([f"see {before}{after} there"]))[0]
        held = [f"see {before}{after} there"[a:b] for _, a, b in spans]
        assert "".join(held).count(s) == after.count(s) and len(held) == 1 and (not before or before not in held[0])
    harmless = ["AKIAIOSFODNN7EXAMPL", "sk-" + "x" * 24 + "1234", "example/some-long-words-joined-here", "abcdefghijklmnopqrstuvwxyz0123456789", "example_550e8400-e29b-41d4-a716-446655440000"]
    assert not any(secret_scan.scan_batch(pa.array(harmless)))


def test_jaccard_null_id_before_its_copy(spark):
    g = random.Random(5)
    ws = [f"w{g.randrange(4000)}" for _ in range(60)]
    near = " ".join([*ws[:-1], "changed"])
    rows = [(None, " ".join(ws)), (4, " ".join(ws)), (None, " ".join(ws[:3])), (2, near), (9, " ".join(ws[:3]))]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {4: 2, 2: 2, 9: 9}


def test_components_raise_when_rounds_run_out(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(edges, max_rounds=1)


@pytest.mark.parametrize("order", [1, -1])
def test_packing_of_special_tokens_in_any_case(order):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["<|endoftext|> a", "<|ENDOFTEXT|> a"][::order]
    packing.WordIds.of(packing.tokenizer_path()).forget()
    got = [out[b[k] : b[k + 1]].tolist() for t in texts for _, _, out, b in packing.encode(pa.array([t]), packing.tokenizer_path()) for k in range(len(b) - 1)]
    assert got == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_stored_tables_are_made_from_small_batches(spark):
    from dwellpath.llm.spark import BATCH_KEY, BATCH_ROWS, stored

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    before = spark.conf.get(BATCH_KEY)
    n = [r["n"] for r in stored(spark.range(0, 9_000, 1, 1).mapInArrow(sizes, "n long")).collect()]
    assert sum(n) == 9_000 and max(n) <= BATCH_ROWS and spark.conf.get(BATCH_KEY) == before


def test_packing_encodes_letters_once_and_keeps_common_words(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok, book = Tokenizer.from_file(path), packing.WordIds.of(path)
    seen, tokenize = collections.Counter(), book.tokenize
    monkeypatch.setattr(book, "tokenize", lambda w: seen.update([w]) or tokenize(w))
    book.forget()
    monkeypatch.setattr(book, "parts", {"": b""}, raising=False)
    monkeypatch.setattr(packing, "MEMORY_WORDS", 60)
    g = random.Random(5)
    made = lambda: "".join(g.choices("abcdeé", k=9))
    texts = ["zebra Zebra, zebra### ZEBRA!", None, " ", *(f"zebra zebra {made()} <|endoftext|> <|EndOfText|> {made()}. it's {made()}&&& 12 x{made()}" for _ in range(100))]
    got = [out[b[k] : b[k + 1]].tolist() for t in texts for _, _, out, b in packing.encode(pa.array([t], pa.string()), path) for k in range(len(b) - 1)]
    assert got == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert seen["zebra"] == 1
    assert len(book.hash) < 120


def test_jaccard_sends_few_bytes_a_signature():
    g = random.Random(7)
    texts = [" ".join(g.choices("abcdefghijklmnop", k=g.randrange(5, 900))) for _ in range(60)] + ["one two three", "x " * 40_000 + "y", " ".join(map(str, range(20_000)))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    sent = [(k, b) for out in jaccard._sign(50)(iter([batch])) for k, b in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]
    raw, off = text.utf8(pa.array(texts))
    h, bounds = text.shingle_sets(raw, off)
    n = 0
    for band, m, used in jaccard.schemes(np.maximum(np.diff(bounds), 1)):
        row, seg, _, _ = jaccard._subsets(h, bounds, m)
        n += int(((seg < used[row]) & (band[row] >= 0)).sum())
    assert sum(len(b) for k, b in sent if k == 1) < 9 * n


def test_jaccard_signatures_equal_by_chance_count_as_empty_segments(monkeypatch):
    plain_signature = jaccard._signature
    monkeypatch.setattr(jaccard, "_signature", lambda *a: plain_signature(*a) % np.uint64(64))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([" ".join(map(str, range(300)))])], names=["doc_id", "text"])
    bodies: dict = {}
    for out in jaccard._sign(1)(iter([batch])):
        bodies |= dict(zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True))
    doc = np.frombuffer(bodies[2], dtype=jaccard._DOC)[0]
    t = int(np.frombuffer(bodies[1], np.int64, 1)[0])
    table = np.frombuffer(bodies[1], dtype=jaccard._ENTRY, count=t, offset=8)
    sig = jaccard._wide(np.frombuffer(bodies[1], dtype=np.uint8, offset=8 + t * jaccard._ENTRY.itemsize))
    assert int(table["own"].sum()) + int(table["low"].sum()) == len(sig)
    assert doc["own_filled"] <= 64 and doc["low_filled"] <= 64
    assert jaccard._repeated(np.array([5, 5, 6, 5], np.uint64), np.array([0, 0, 0, 1]), 3).tolist() == [2, 0, 0]
