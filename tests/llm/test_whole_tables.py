"""The near-duplicate join over a whole table, every operator on texts of several megabytes, and the pipeline's stages against plain versions."""

import collections
import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

from dwellpath.llm import fim, fingerprints, jaccard, langid, licenses, merkle, mixing, packing, pii, quality, secret_scan
from tests.conftest import DATA
from tests.llm.test_operators import WORD, shingles

SF001 = "/root/testdata/sf0.01"


def linked_components(sets):
    """The smallest id reachable by links, by counting what sets share through an index of all shingles."""
    index, up = collections.defaultdict(list), {k: k for k in sets}
    for k in sorted(sets):
        for s in sets[k]:
            index[s].append(k)
    shared = collections.Counter()
    for ids in index.values():
        shared.update((a, b) for j, b in enumerate(ids) for a in ids[:j])

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, b), n in shared.items():
        if 4 * n >= 3 * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {k: root(k) for k in sets}


def test_jaccard_of_a_whole_table_equals_brute_force(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in d.collect()}
    got = jaccard.join_components(d).collect()
    assert len(got) == len(sets) and {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(s) for k, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == linked_components(sets)


def prose(seed, n):
    g = random.Random(seed)
    own = "the of and to in is that it for with as was on be by this are from or not".split() + ["".join(g.choice("etaoinshrdlu") for _ in range(g.randrange(3, 9))) for _ in range(4000)]
    return " ".join(g.choice(own) + (".\n" if g.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def long_rows():
    long = prose(1, 400_000)
    ws = long.split(" ")
    near = " ".join("changed" if k % 200 == 7 else w for k, w in enumerate(ws))
    end = "\n\nWrite to jane.roe@example.org or see the key password = hunter2hunter2 now.\nReleased under the MIT License."
    return [(1, long), (2, near), (3, prose(2, 400_000) + end), (4, long), (5, prose(3, 200)), (6, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in long_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_very_long_texts_in_searches_for_copies(long_docs, long_rows):
    got, sizes = by_id(jaccard.join_components(long_docs)), {d: len(shingles(t)) for d, t in long_rows}
    assert {d: r["n_shingles"] for d, r in got.items()} == sizes
    assert {d: r["component_id"] for d, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}
    marks = by_id(fingerprints.fingerprints(long_docs))
    assert marks[1]["fingerprint"] == marks[4]["fingerprint"] != marks[3]["fingerprint"]
    assert marks[2]["near_next"] > 0.85 > 0.2 > marks[3]["near_next"]


def test_very_long_texts_in_scans(long_docs, long_rows):
    texts = {d: t or "" for d, t in long_rows}
    scored = by_id(quality.score(long_docs))
    for d, t in texts.items():
        ws = WORD.findall(t)
        assert (scored[d]["n_words"], scored[d]["word_chars"], scored[d]["n_repeat_words"]) == (len(ws), sum(map(len, ws)), 0)
    assert {d: r["licenses"] for d, r in by_id(licenses.scan(long_docs)).items()} == {d: "MIT" if d == 3 else "" for d in texts}
    assert {d: r["n_assign"] for d, r in by_id(secret_scan.scan(long_docs)).items()} == {d: int(d == 3) for d in texts}
    at = texts[3].index("jane.roe")
    assert f"email:{at}:{at + 20}" in by_id(pii.scan(long_docs))[3]["spans"].split(",")
    assert {d: r["lang_pred"] for d, r in by_id(langid.identify(long_docs)).items()} == {d: "en" if t else "und" for d, t in texts.items()}


def test_very_long_texts_are_cut_and_proved(long_docs, long_rows):
    texts = {d: t or "" for d, t in long_rows}
    got = by_id(fim.digests(long_docs))
    assert {d: r["n"] for d, r in got.items()} == {d: sum(1 for _ in re.finditer(r"[A-Za-z]+|[^A-Za-z]", t)) for d, t in texts.items()}
    proved = by_id(merkle.tampered(long_docs))
    changed = {d for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 == 0 and re.search("[A-Z]", t)}
    assert len({r["root"] for r in proved.values()}) == 1 and {d for d, r in proved.items() if not r["verified"]} == changed
    tokens = collections.Counter()
    for r in packing.pack(long_docs).collect():
        tokens[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] >= r["start"] + r["length"] and r["length"] <= 4096
    assert tokens[1] == tokens[4] and tokens[6] == 1


def test_pipeline_stages_against_plain_ones(spark, duck):
    import corpus_pipeline
    from dwellpath.llm.spark import stored

    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = stored(stages["quality rules"](spark, d, DATA))
    want = duck.sql(f"SELECT doc_id FROM ({quality.oracle()}) WHERE kept ORDER BY 1").fetchall()
    assert sorted((r["doc_id"],) for r in kept.select("doc_id").collect()) == want
    own = {r["doc_id"]: r["text"] for r in d.collect()}
    assert all(r["text"] == own[r["doc_id"]] for r in kept.collect())
    secret = stored(stages["secret scan"](spark, kept, DATA))
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(kept).collect()}
    for r in secret.collect():
        # what lies outside the spans stays, in its order
        found = [tuple(map(int, s.split(":")[1:])) for s in spans[r["doc_id"]].split(",") if s]
        outside, at = [], 0
        for a, b in sorted(found):
            outside.append(own[r["doc_id"]][at : max(a, at)])
            at = max(at, b)
        outside.append(own[r["doc_id"]][at:])
        assert re.fullmatch("(?s)" + "(?:<[^>]*>)*".join(map(re.escape, outside)), r["text"]), r["doc_id"]
    mixed = stored(stages["mixing"](spark, secret, DATA))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(secret).collect() if r["taken"]}
    words = collections.Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == taken
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    have = collections.Counter()
    for r in mixed.collect():
        have[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in stages["packing"](spark, mixed, DATA).collect():
        packed[r["doc_id"]] += r["length"]
        assert r["length"] & (r["length"] - 1) == 0
    assert packed == have
