"""Quality rules: one threshold table, compiled into Spark projections without user functions.

Words are runs of anything but space and the control characters 9 to 13. The base counts are
n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; the rules are ratios over them.

The rule on stop words asks only texts in the languages whose stop words are listed, and texts of
unknown language; a text in another language is judged by the other rules.

Defined results: a null or empty text has no words, so it fails; ties and repeated rows are
judged one by one; an empty table gives no rows; columns of the input that clash with a
measure's name are left alone, as measures are built from the text column only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8

#: Languages with stop words below, and the rules that ask for them.
STOP_LANGS, ASK_STOP_WORDS = ("en", "fr", "de", "es"), ("stop_ratio",)
#: Frequent function words of these languages.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for with as was on be by this are from or not have at which you "
            "le la de et les des en un une que qui dans pour est du au avec sur pas "
            "der die das und ist von zu mit den ein eine nicht im für sich auf dem "
            "el los las y que se del por con una no es como su al lo".split()
        )
    )
)

#: Fixed values: (measure, lowest, highest); None leaves a side open.
RULES = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.3),
    ("mean_word_chars", 2.5, 12.0),
    ("symbol_ratio", None, 0.1),
    ("dup_line_ratio", None, 0.5),
    ("stutter_ratio", None, 0.2),
    ("stop_ratio", 0.05, None),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by a window of eight that is found twice or more."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            found = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)))
            return F.array_sort(F.transform(found, lambda x: x["i"]))

        def length(s: Column) -> Column:
            gaps = F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return _let(_let(pairs, starts), length)

    repeats = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(n >= WINDOW, repeats).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The base counts and the counts that only the rules use, as columns of ``_words`` and ``text``."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    stop = sorted({y for x in STOP_WORDS for y in (x, x.capitalize())})

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words"),
            _let(w, lambda v: F.size(F.filter(v, lambda x, i: x == F.get(v, i - 1)))).cast("long").alias("n_stutter"),
            F.size(F.filter(w, lambda x: x.isin(*stop))).cast("long").alias("n_stop"),
        )

    return {
        "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "_lines": _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))),
        "_of_words": _let(words, of_words),
    }


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean over the ratio columns, and over ``_other``: whether the language has no stop words here."""
    tests = [F.lit(True)]
    for name, low, high in rules:
        own = [F.col(name) >= low] if low is not None else []
        own += [F.col(name) <= high] if high is not None else []
        tests += [F.col("_other") | t for t in own] if name in ASK_STOP_WORDS else own
    return reduce(and_, tests)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(documents: DataFrame, rules=RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the five counts, base_failed, kept, and the ratios the rules look at."""
    other = F.coalesce(~F.lower("lang").isin(*STOP_LANGS), F.lit(False)) if "lang" in documents.columns else F.lit(False)
    m = documents.select(*keep, other.alias("_other"), *[c.alias(f"_m{k}") for k, c in measures(F.col("text")).items()])
    counts = m.select(
        *keep,
        "_other",
        F.col("_m_of_words.n_words").alias("n_words"),
        F.col("_mword_chars").alias("word_chars"),
        F.col("_mn_symbols").alias("n_symbols"),
        (F.col("_m_lines.n") - F.col("_m_lines.d")).alias("n_dup_lines"),
        F.col("_m_of_words.n_repeat_words").alias("n_repeat_words"),
        F.col("_m_lines.n").alias("n_lines"),
        F.col("_m_of_words.n_stutter").alias("n_stutter"),
        F.col("_m_of_words.n_stop").alias("n_stop"),
    )
    per = lambda c, n="n_words": F.col(c) / F.greatest(F.col(n), F.lit(1))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ratios = counts.select(
        *keep,
        "_other",
        *COUNTS,
        failed.alias("base_failed"),
        per("n_repeat_words").alias("repeat_ratio"),
        per("word_chars").alias("mean_word_chars"),
        per("n_symbols").alias("symbol_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_stutter").alias("stutter_ratio"),
        per("n_stop").alias("stop_ratio"),
    )
    return ratios.withColumn("kept", ~F.col("base_failed") & compiled(rules)).drop("_other")


def oracle() -> str:
    """DuckDB SQL of the counts and the verdict, from a row a word."""
    quoted = ", ".join(f"'{y}'" for y in sorted({y for x in STOP_WORDS for y in (x, x.capitalize())}))
    other = f"coalesce(lower(lang) NOT IN ({', '.join(repr(x) for x in STOP_LANGS)}), false)"
    limits = " AND ".join(f"({other} OR {name} {op} {bound})" if name in ASK_STOP_WORDS else f"{name} {op} {bound}" for name, low, high in RULES for op, bound in ((">=", low), ("<=", high)) if bound is not None)
    window = "concat_ws(' ', " + ", ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, WINDOW)]]) + ")"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t)),
windows AS (SELECT r, i, w, coalesce(w = lag(w) OVER o, false) AS again, CASE WHEN lead(w, {WINDOW - 1}) OVER o IS NOT NULL THEN {window} END AS k FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
repeated AS (SELECT r, i, w, again, k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1 AS starts FROM windows),
marked AS (SELECT r, w, again, max(CASE WHEN starts THEN i END) OVER (PARTITION BY r ORDER BY i ROWS {WINDOW - 1} PRECEDING) IS NOT NULL AS covered FROM repeated),
of_words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (covered) AS n_repeat_words, count(*) FILTER (again) AS n_stutter, count(*) FILTER (w IN ({quoted})) AS n_stop FROM marked GROUP BY r),
of_lines AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_own FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (SELECT t.doc_id, t.lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines - n_own, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stutter, 0) AS n_stutter, coalesce(n_stop, 0) AS n_stop FROM t LEFT JOIN of_words USING (r) LEFT JOIN of_lines USING (r)),
ratios AS (SELECT *, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
  n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_stutter / greatest(n_words, 1) AS stutter_ratio, n_stop / greatest(n_words, 1) AS stop_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {limits} AS kept FROM ratios"""
