"""The operators against plain versions, DuckDB and edge rows, where tests/llm/test_operators.py doesn't."""

import collections
import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwellpath.llm import chat, fingerprints, jaccard, langid, mixing, packing, quality, queries, secret_scan, text
from tests.conftest import DATA, plain
from tests.llm.test_operators import EDGES, SCHEMA, brute_components, cheapest, shingles


def turning(n, a="a", b="b"):
    """A word over two letters, by the parity of binary digits: all its polynomials modulo 2**64 are alike."""
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


ALIKE = (turning(1024), turning(1024, "b", "a"), turning(2048), turning(2048, "b", "a"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", ["op5_mixing", "op8_quality"])
def test_sql_on_edge_rows(spark, duck, name):
    """Null sources and texts, rows without words, repeated rows and rows without an id."""
    rows = [(d, t, s, n) for d, t, n, s, *_ in EDGES] + [(50, "the same words " * 9, "s1", None)] * 40 + [(None, f"words number {k} " * 5, None, "en") for k in range(40)]
    rows += [(60 + k, " ".join(f"sana{j}" for j in range(30)), "s1", n) for k, n in enumerate(("fi", "FI", "en", "EN", None))]
    made = {"op5_mixing": lambda df: mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken"), "op8_quality": lambda df: quality.score(df).select("doc_id", *quality.COUNTS, "base_failed", "kept")}[name]
    df = made(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    if name == "op8_quality":  # the stop words of some languages say nothing of another
        assert {r["doc_id"] for r in df.filter("kept and doc_id >= 60").collect()} == {60, 61}
    import duckdb

    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] for r in rows], pa.string()), "lang": pa.array([r[3] for r in rows], pa.string())})  # noqa: F841
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


# ------------------------------------------------------------------ words that hashes could confuse

def test_words_of_alike_structure_are_told_apart():
    raw, off = text.utf8(pa.array([*ALIKE, "ab\0", "ab", "abcdefgh", "abcdefghi", "ABCDEFGHi"]))
    h, _ = text.word_hashes(raw, off)
    assert len(set(h.tolist())) == 8 and h[-1] == h[-2]


def test_packing_of_alike_and_of_long_words():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    texts = [" ".join(ALIKE), "x" * (1 << 20) + " y", None, "", "é" * 5000 + " Été, ÇA! " + "İ Å ΣαΣ", " ".join(ALIKE[::-1])]
    got = [out[b[k] : b[k + 1]].tolist() for _, _, out, b in packing.encode(pa.array(texts), packing.tokenizer_path()) for k in range(len(b) - 1)]
    assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_packing_of_a_text_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH_BYTES", 700)
    from tokenizers import Tokenizer

    tok, g = Tokenizer.from_file(packing.tokenizer_path()), random.Random(3)
    texts = [" \n".join("".join(g.choice("abcdé1,.'") for _ in range(g.randrange(1, 30))) for _ in range(n)) for n in (3, 400, 1, 90)] + ["y" * 3000, "<|endoftext|> " * 200]
    got = [out[b[k] : b[k + 1]].tolist() for _, _, out, b in packing.encode(pa.array(texts), packing.tokenizer_path()) for k in range(len(b) - 1)]
    assert got == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_links_and_fingerprints_of_alike_words(spark):
    rest = " ".join(f"w{k}" for k in range(4))
    rows = {1: ALIKE[0], 2: ALIKE[1], 3: f"{ALIKE[2]} {rest}", 4: f"{ALIKE[3]} {rest}", 5: ALIKE[0].upper()}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join_components(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert len(set(prints.values())) == 4 and prints[1] == prints[5]


def test_exact_sets_count_what_words_share():
    g = random.Random(6)
    texts = [" ".join(g.choice(["a", "b", "É", "longer-than-eight", "X"]) for _ in range(g.randrange(0, 14))) for _ in range(120)] + ["", None, "A b c d e", "a b c d"]
    raw, off = text.utf8(pa.array(texts))
    for sets in (text.shingle_sets, text.exact_sets):
        h, b = sets(raw, off)
        found = [set(h[x:y].tolist()) for x, y in zip(b[:-1], b[1:], strict=True)]
        for _ in range(3000):
            i, j = g.randrange(len(texts)), g.randrange(len(texts))
            assert len(found[i]) == len(shingles(texts[i])) and len(found[i] & found[j]) == len(shingles(texts[i]) & shingles(texts[j]))


# ------------------------------------------------------------------ op7: sizes at which its ways part

@pytest.mark.parametrize("members,outsiders", [(31, 7), (32, 8), (33, 9), (34, 10), (60, 40)])
def test_jaccard_round_its_bucket_sizes(spark, members, outsiders):
    """Short texts round one passage, so that buckets of just these sizes form, with near copies among the outsiders."""
    g = random.Random(members)
    word = lambda: f"w{g.randrange(5000)}"
    passage, texts = [word() for _ in range(30)], {}
    for k in range(members):
        texts[10 * k + 3] = " ".join([*passage, word()] if k % 2 else [word(), *passage])
    for k in range(outsiders):
        own = [word() for _ in range(g.randrange(6, 16))]
        texts[10 * k + 5] = " ".join(passage + own)
        texts[10 * k + 7] = " ".join(passage + own[:-1] + [word()])
    want, sizes = brute_components(texts)
    got = jaccard.join_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and {r["doc_id"]: r["n_shingles"] for r in got} == sizes


def test_jaccard_of_many_short_texts_round_one_passage(spark):
    """Far more texts than a small bucket holds share two thirds of their shingles without being linked."""
    g = random.Random(77)
    word = lambda: f"w{g.randrange(20000)}"
    passage, texts = [word() for _ in range(44)], {}
    for k in range(300):
        own = [word() for _ in range(g.randrange(8, 30))]
        texts[2 * k] = " ".join(passage + own)
        if k % 10 == 0:
            texts[2 * k + 1] = " ".join(passage + own[: len(own) - 2])
    want, _ = brute_components(texts)
    got = jaccard.join_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


# ------------------------------------------------------------------ op4: entropy

def plain_entropy(run: bytes) -> list[tuple[int, int]]:
    """High windows of one stretch, each counted anew."""
    spans = []
    for a in range(len(run) - secret_scan.WINDOW + 1):
        w = run[a : a + secret_scan.WINDOW]
        h = -sum(c / len(w) * math.log2(c / len(w)) for c in collections.Counter(w).values())
        least = next((t for _, chars, t in secret_scan.CLASSES if set(w) <= set(chars.encode())), math.inf)
        if h >= least - 1e-9:
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], a + len(w))
            else:
                spans.append((a, a + len(w)))
    return spans


def test_high_windows_equal_counting_anew(monkeypatch):
    g = random.Random(12)
    pools = ["0123456789abcdef", "abcd", "ABCDEFGHIJ0123456789", secret_scan.CLASSES[-1][1], "aab"]
    for step in (1 << 14, 7):
        monkeypatch.setattr(secret_scan, "_AT_ONCE", step)
        for _ in range(150):
            run = "".join(g.choice(g.choice(pools)) if g.random() < 0.2 else g.choice(pools[g.randrange(5)]) for _ in range(g.randrange(1, 90))).encode()
            assert secret_scan.high_windows(run) == plain_entropy(run)


def test_secrets_of_a_text_full_of_spans_take_linear_time():
    import time

    g = random.Random(2)
    chars = secret_scan.CLASSES[-1][1]
    make = lambda n: " ".join(f"secret={''.join(g.choice(chars) for _ in range(8))}" if k % 2 else "".join(g.choice(chars) for _ in range(30)) for k in range(n))
    took = []
    for n in (2000, 16000):
        t, began = pa.array([make(n)]), time.process_time()
        secret_scan.scan_batch(t)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


# ------------------------------------------------------------------ op1

def test_chat_is_rendered_as_the_whole_conversation_would_be(spark):
    """Over ranges, on ties, nulls and empty texts: by pos the pieces are those of one repair of all turns."""
    g = random.Random(4)
    role = lambda: g.choice(["user", "Assistant", "system", None, "bot", "tool"])
    rows = [(7, g.randrange(90) if g.random() < 0.9 else None, role(), g.choice([f"t{k}", None, "", "<|im_end|>"])) for k in range(300)]
    rows += [(c, k // 2, role(), f"u{c}-{k}") for c in (1, 2, 9, None) for k in range(5)] + [(3, 1, "user", "same")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x")).withColumn("piece", F.lit(1))
    order = [F.col("turn").asc_nulls_first(), F.xxhash64("role", "text"), F.col("role"), F.col("text")]
    got = chat.format_conversations(df).collect()
    assert len(got) == len(rows)
    for c in (1, 2, 3, 7, 9, None):
        own = df.filter(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy(*order).collect()
        roles, texts = [chat.role_of(r["role"]) for r in own], [r["text"] or "" for r in own]
        way = chat.repair(roles, 0, None)
        made = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["pos"])
        assert [r["pos"] for r in made] == list(range(len(own))) and [r["turn"] for r in made] == [r["turn"] for r in own]
        whole = "".join(chat.pieces(texts, way, 0, True))
        assert "".join(r["piece"] for r in made) == whole
        cost = chat._CLOSE[way[-1][0]][0] + sum(w[1][0] for w in way)
        rendered = "".join(r["piece"] for r in made)
        assert rendered.count("<|im_start|>") == rendered.count("<|im_end|>") and cost <= cheapest(roles)
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_joined_matrices_find_the_way_of_the_whole(seed):
    """However a conversation is cut, the ways between the borders are parts of the whole's way."""
    g = random.Random(seed)
    for _ in range(150):
        roles = [g.randrange(4) for _ in range(g.randrange(1, 40))]
        cuts = sorted(g.randrange(len(roles) + 1) for _ in range(g.randrange(0, 6)))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        states = chat.border_states([(1, k, 1, chat.product(p), len(p)) for k, p in enumerate(parts)])
        way = [x for k, p in enumerate(parts) for x in chat.repair(p, *states[k, 1][1:3])]
        assert [t for t, _ in way] == [t for t, _ in chat.repair(roles, 0, None)]


def test_chat_does_not_depend_on_the_layout(spark):
    g = random.Random(11)
    rows = [(7, k, g.choice(["user", "assistant", "system", None, "bot", "tool"]), f"t{k}") for k in range(400)] + [(8, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    was, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 7, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        made.append(sorted((r["conv_id"], r["pos"], r["action"], r["piece"]) for r in chat.format_conversations(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert made[0] == made[1] == made[2] and len(made[0]) == 401


def test_chat_query_keeps_every_turn(spark):
    got = queries.op1_chat(spark, DATA)
    have = spark.read.parquet(f"{DATA}/conversations.parquet")
    count = lambda df: {(r["conv_id"], r["turn"]): r["count"] for r in df.groupBy("conv_id", "turn").count().collect()}
    assert count(got) == count(have)
    assert got.groupBy("conv_id").agg(F.min("pos").alias("a"), (F.max("pos") - F.count("pos")).alias("b"), F.countDistinct("pos").alias("n"), F.count("pos").alias("m")).filter("a <> 0 or b <> -1 or n <> m").count() == 0


# ------------------------------------------------------------------ op10

def plain_grams(t):
    """Features of a text with their shares, one n-gram at a time."""
    u32 = lambda x: x & 0xFFFFFFFF
    folded = []
    for ch in t:
        low = ch.lower()
        if ch.isalpha():
            folded.append(ord(low) if len(low) == 1 and ord(ch) < 0x3000 else ord(ch))
        else:
            folded.append(ord(ch) if ord(ch) < 0x3000 and unicodedata.category(ch) == "Mn" else 32)
    found = collections.Counter()
    for k in range(1, langid.ORDERS + 1):
        for i in range(len(folded) - k + 1):
            g = folded[i : i + k]
            if all(c == 32 for c in g):
                continue
            h = 0
            for c in g:
                h = u32(h * 0x9E3779B1) ^ u32(c * 0x85EBCA6B)
            x = u32(h * 0xC2B2AE35)
            x ^= x >> 15
            found[(u32(x * 0x27D4EB2F) >> 18) + (k - 1) * langid.BUCKETS] += 1
    total = sum(found.values())
    return {f: n / total for f, n in found.items()}


def test_language_features_and_predictions_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).filter("lang is not null and text is not null").select("doc_id", "text", "lang"))
    df = collections.Counter(f for r in learned for f in plain_grams(r["text"]))
    idf = {f: math.log((1 + len(learned)) / (1 + n)) + 1 for f, n in df.items()}
    # the table holds weight * idf * scale: a feature that no training text has weighs nothing
    assert not np.delete(np.abs(model.table).sum(axis=1), list(df)).any()
    got = {r["doc_id"]: r for r in queries.op10_language(spark, DATA).collect()}
    some = random.Random(1).sample(rows, 25)
    for r in some:
        grams = plain_grams(r["text"])
        z = np.array([sum(p * float(model.table[f, k]) for f, p in grams.items()) for k in range(len(model.langs))]) + model.bias
        p = np.exp((z - z.max()) / model.temperature)
        p /= p.sum()
        assert got[r["doc_id"]]["lang_pred"] == model.langs[int(p.argmax())] and got[r["doc_id"]]["score"] == pytest.approx(float(p.max()), abs=1e-4)
    assert idf and model.table.dtype == np.float32


def test_ftrl_equals_a_plain_loop():
    g = random.Random(5)
    bags = []
    for _ in range(30):
        f = sorted(g.sample(range(40), 6))
        bags.append((np.array([*f, langid.FEATURES]), np.array([g.random() for _ in f] + [1.0]), g.randrange(3)))
    w, bias = langid.ftrl(bags, 3, langid.FEATURES)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return -(z[i, c] - math.copysign(langid.L1, z[i, c])) / ((langid.BETA + math.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(bags)).tolist():
            f, x, y = bags[i]
            have = {(j, c): weight(j, c) for j in f.tolist() for c in range(3)}
            s = [sum(have[j, c] * v for j, v in zip(f.tolist(), x.tolist(), strict=True)) for c in range(3)]
            e = [math.exp(v - max(s)) for v in s]
            for c in range(3):
                for j, v in zip(f.tolist(), x.tolist(), strict=True):
                    grad = v * (e[c] / sum(e) - (c == y))
                    step = (math.sqrt(n[j, c] + grad * grad) - math.sqrt(n[j, c])) / langid.ALPHA
                    z[j, c] += grad - step * have[j, c]
                    n[j, c] += grad * grad
    assert np.allclose(w[:40], [[weight(j, c) for c in range(3)] for j in range(40)]) and np.allclose(bias, [weight(langid.FEATURES, c) for c in range(3)])
    assert not w[40:].any()


def test_language_of_texts_without_letters(spark):
    rows = [(k, t, "en") for k, t in enumerate(["the cat sat on the mat and the dog"] * 8)] + [(k, t, "fr") for k, t in enumerate(["le chat est sur la table et le chien"] * 8, 20)]
    odd = {100: "́́", 101: "123 ̀", 102: None, 103: "", 104: "!?", 105: "é", 106: "あ", 107: "゙"}
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows + [(k, t, None) for k, t in odd.items()], "doc_id long, text string, lang string")).collect()}
    for k, t in odd.items():
        letters = any(unicodedata.category(c).startswith("L") for c in t or "")
        assert (got[k]["lang_pred"] != "und") == letters and (letters or got[k]["score"] == 0)


def test_language_learns_from_labelled_rows_alone(spark):
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 4 == 2)
    free = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    one, two, three = free[:3]
    rows = [(one, "labelled", "a"), (one, "not labelled", None), (two, "as a", "a"), (two, "as b", "b"), (held, "held out", "a"), (three, None, "a"), (None, "no id", "a")] + [(free[5], "same text", "b")] * 100
    training = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).filter("lang is not null and text is not null and doc_id is not null")
    got = sorted((r["lang"], r["text"]) for r in langid.sample(training.select("doc_id", "text", "lang")).collect())
    assert got == [("a", "as a"), ("a", "labelled"), ("b", "as b"), ("b", "same text")]
    many = spark.range(400).select("id", F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("l"), (F.col("id") % 10).cast("string")).alias("lang")).withColumnRenamed("id", "doc_id")
    n = many.select("lang").distinct().count()
    assert langid.sample(many, per_lang=50, max_rows=30).select("lang").distinct().count() == n
    assert langid.sample(many, per_lang=50, max_rows=1).count() == n  # none is left out
    assert langid.shared_buckets(4) == langid.BUCKETS and langid.ORDERS * langid.shared_buckets(5000) * 5000 <= langid.MAX_WEIGHTS


def test_many_languages_share_features(spark, monkeypatch):
    """So many languages that features share weights: held-out rows still get their own language."""
    g, rows = random.Random(6), []
    for lang in range(40):
        letters = g.sample("abcdefghijklmnopqrstuvwxyz", 6)
        rows += [(k * 40 + lang, " ".join("".join(g.choice(letters) for _ in range(5)) for _ in range(40)), f"l{lang:02}") for k in range(12)]
    monkeypatch.setattr(langid, "shared_buckets", lambda n: 1 << 10)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 60 and sum(r["lang"] == r["lang_pred"] for r in out) > 0.9 * len(out)
    assert langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == len(rows)


# ------------------------------------------------------------------ op2

def test_densification_fills_a_bin_from_the_first_filled_one_in_its_order():
    g = np.random.Generator(np.random.PCG64(3))
    sets = [np.sort(g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (0, 1, 2, 7, 60, 400, 5000)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = fingerprints.sketch(np.concatenate(sets), bounds)
    for s, row in zip(sets, got, strict=True):
        smallest = {}
        for h in s.tolist():
            slot = h >> (64 - 9)
            smallest[slot] = min(smallest.get(slot, h), h)
        if not smallest:
            assert not row.any()
            continue
        for b in range(fingerprints.BINS):
            source = b if b in smallest else next(j for j in fingerprints._ORDER[b].tolist() if j in smallest)
            value = text.scramble(np.array([smallest[source]], np.uint64) + fingerprints._SALT[b])
            assert row[b] == int(value[0]) & 3


# ------------------------------------------------------------------ op5, pipeline

def test_mixing_replaces_columns_of_its_own_names_and_spreads_rows_without_id(spark):
    rows = [(None, f"word {k} " * 30, "s") for k in range(300)] + [(7, "same text here", "s")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("taken", F.lit("y")).withColumn("_id", F.lit(3)).withColumn("place", F.lit(1)).withColumn("n", F.lit(2))
    out = mixing.mix_rows(df, shard_words=1000)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == len(rows)
    assert all(r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 2 * r["size"] for r in out.collect())
    got = mixing.mix(df, shard_words=1000)
    assert got.filter("doc_id is null").select("shard").distinct().count() > 5
    assert got.filter("doc_id = 7").count() == 50 and got.agg(F.sum("taken")).first()[0] == pytest.approx(got.first()["target"], abs=16)


def test_equal_rows_in_great_number_are_written_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "AT_ONCE", 7)
    df = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d e", "s")] * 7 + [(3, "f", "t")], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {1: 50, 2: 7, 3: 1} and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got if r["source"] == "s") == pytest.approx(next(r["target"] for r in got if r["source"] == "s"), abs=16)


PROSE = "the quick brown fox jumps over the lazy dog and then it runs to the river where all of the other animals wait for it to come home with the news of the day"


def test_pipeline_on_edge_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [*EDGES, (20, PROSE, "en", "s1", len(PROSE), "x", 1), (20, PROSE, "en", "s1", len(PROSE), "x", 1), (21, PROSE.upper(), "en", "s2", len(PROSE), "x", 1), (None, PROSE, "en", None, len(PROSE), "x", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/some/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r["doc_id"] for r in out} <= {20, None} and out


def test_duplicate_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    other = " ".join(f"word{k}" for k in range(40))
    near = PROSE + " again"
    rows = [(3, PROSE), (5, near), (5, other), (5, ""), (5, ""), (8, other.upper()), (3, PROSE.upper()), (None, PROSE), (9, None)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], (r["text"] or "").lower()) for r in corpus_pipeline.duplicate_stage(spark, df, "").collect())
    assert got == collections.Counter([(3, PROSE), (5, other), (5, ""), (None, PROSE), (9, "")])


def test_edited_digest_of_edge_texts(spark):
    rows = [(5, "é" * 7), (4, None), (3, ""), (2, "abc"), (1, "xy" * 40)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t or "" for _, t in rows]
    for (d, _), t, n in zip(rows, texts, [*texts[1:], texts[0]], strict=True):
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
