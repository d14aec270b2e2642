"""Quality rules (operator 8): a threshold table compiled into one Spark projection, without user functions.

``RULES`` lists (measure, lowest, highest). :func:`apply_rules` computes every measure of a text with built-in
functions and compiles the table into a boolean column. Long arrays are bound by one-element ``transform`` calls, so
each is computed once however often it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Frequent words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be this by from at or "
    "le la les de des du et en un une que qui dans est pour par sur avec "
    "der die das und ist nicht ein eine zu mit auf von im den "
    "el los las y del se con su al una no"
).split()

#: Measure, lowest and highest value allowed (None: no bound). Documents outside any of them are not kept.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.01, None),
    ("upper_ratio", None, 0.45),
    ("dup_line_ratio", None, 0.70),
    ("bullet_line_ratio", None, 0.90),
    ("ellipsis_line_ratio", None, 0.30),
    ("shout_word_ratio", None, 0.20),
    ("bar_word_ratio", None, 0.20),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, C.SPACE_CLASS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes of their words; a text would need billions of windows for a collision.
    """

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(
            placed,
            lambda p: F.filter(
                F.transform(
                    p,
                    lambda e, k: F.when(
                        (F.coalesce(F.get(p, k - 1)["h"], F.bitwise_not(e["h"])) == e["h"]) | (F.coalesce(F.get(p, k + 1)["h"], F.bitwise_not(e["h"])) == e["h"]),
                        e["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        covered = let(marked, lambda m: F.size(F.array_distinct(F.flatten(F.transform(m, lambda i: F.array(i, i + 1, i + 2))))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        )

    return let(let(words, windows), count)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and ratios of its text under a struct column ``m``; null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)

    def of_words(w: Column) -> Column:
        joined = F.array_join(w, "")
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: F.ltrim(y).rlike(r"^[-*•]"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            )).alias("l"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_shout_words"),
            F.size(F.filter(w, lambda x: x == "|")).cast("long").alias("n_bar_words"),
            F.length(F.regexp_replace(joined, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        )

    return docs.withColumn("m", let(words_of(text), of_words))


def apply_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ratios and the verdict ``kept`` for each row.

    A null or blank text has no words and fails the base rules. Rows are independent, so repeated rows and ties give
    equal results; further columns are ignored. An empty table gives an empty result.
    """
    m = measures(C.id_and_text(docs, id_col, text_col)).select("doc_id", "m.*")
    m = m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_repeat_words", "l.*", "n_stop_words", "n_shout_words", "n_bar_words", "n_upper")
    n = F.col("n_words")
    ratios = {
        "mean_word_chars": _share(F.col("word_chars"), n),
        "symbol_ratio": _share(F.col("n_symbols"), F.col("word_chars")),
        "stop_word_ratio": _share(F.col("n_stop_words"), n),
        "upper_ratio": _share(F.col("n_upper"), F.col("word_chars")),
        "dup_line_ratio": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": _share(F.col("n_bullet_lines"), F.col("n_lines")),
        "ellipsis_line_ratio": _share(F.col("n_ellipsis_lines"), F.col("n_lines")),
        "shout_word_ratio": _share(F.col("n_shout_words"), n),
        "bar_word_ratio": _share(F.col("n_bar_words"), n),
    }
    out = m.select(*[c for c in m.columns if c != "l"], *[v.alias(k) for k, v in ratios.items()])
    verdict = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            verdict = verdict & (F.col(name) >= low)
        if high is not None:
            verdict = verdict & (F.col(name) <= high)
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & verdict)


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The digest columns of the registered query."""
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(rules=RULES) -> str:
    """The same result in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = " AND ".join(
        [f"{c} >= {low}" for c, low, _ in rules if low is not None] + [f"{c} <= {high}" for c, _, high in rules if high is not None]
    )
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS l
  FROM t),
g AS (SELECT r, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM a WHERE len(w) >= 3),
k AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS x FROM g),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM k),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n >= 2) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
    len(list_filter(w, lambda x: x LIKE '%!!')) AS n_shout_words,
    len(list_filter(w, lambda x: x = '|')) AS n_bar_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipsis_lines,
    length(regexp_replace(array_to_string(w, ''), '[^A-Z]', '', 'g')) AS n_upper
  FROM a LEFT JOIN c USING (r)),
q AS (
  SELECT *,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
    CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END AS bullet_line_ratio,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END AS ellipsis_line_ratio,
    CASE WHEN n_words > 0 THEN n_shout_words / n_words ELSE 0 END AS shout_word_ratio,
    CASE WHEN n_words > 0 THEN n_bar_words / n_words ELSE 0 END AS bar_word_ratio
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {checks} AS kept
FROM q"""
