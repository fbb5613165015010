"""Quality rules as a short-circuit cascade.

Rules are native conditions on features of a text. On a sample of bounded size each rule is
run by itself, with only the features it needs: its time beyond that of a run without any rule is
its cost, the share it rejects its selectivity. The rules are then chained in order of rejections
per cost, so that a cheap rule that rejects much spares the dear ones behind it: a feature is
computed where the first rule that needs it is reached, and only for texts that no rule before it
has rejected. The order changes no verdict, only the work. Costs are the least of a few runs and
are compared in powers of two, so that noise between runs does not turn the order round.

All is one scan without a shuffle. A text's windows are hashes of word hashes; only where two
are alike are they put in order to find their places. Null and empty texts have no words and fail.
Each row is judged by its text alone, whatever its id: repeated rows get the same verdict, and a
text that ties with a limit is on the side that the condition says. Very long texts are judged
whole in their row. Other columns stay; those named like a feature or ``kept`` are replaced. An
empty table gives an empty one, and its cascade the rules in the order given.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that costs and selectivities are estimated on, at most about.
SAMPLE_BYTES = 32 << 20
SAMPLE_ROWS = 1000
#: Runs of each rule, and the seconds that one is taken to cost at least.
RUNS, LEAST_COST = 3, 1e-3
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Reject a text for which ``condition`` is true: SQL on the columns of ``measured``."""

    name: str
    condition: str

    @property
    def rejects(self) -> Column:
        return F.expr(self.condition)

    @property
    def needs(self) -> list[str]:
        return [f for f in FEATURES if re.search(rf"\b{f}\b", self.condition)]


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, "")).cast("long")


def _windows(hashes: Column) -> Column:
    """The hash of each window, by its first word."""
    last = F.size(hashes) - WINDOW
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _repeated(windows: Column) -> Column:
    """Places of windows that occur twice: those whose neighbour in hash order is the same. Most texts have none and are not sorted."""
    placed = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("i")))
    order = F.transform(F.array(placed), lambda o: F.filter(o, lambda w, k: (F.get(o, k - 1)["h"] == w["h"]) | (F.get(o, k + 1)["h"] == w["h"])))
    places = F.sort_array(F.transform(F.get(order, F.lit(0)), lambda w: w["i"]))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), places).otherwise(F.array().cast("array<int>"))


def _covered(places: Column) -> Column:
    """Words in the windows at ``places``: each adds those that the one before it in the text does not cover."""
    gain = F.transform(places, lambda a, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), a - F.get(places, k - 1))))
    return F.aggregate(gain, F.lit(0), lambda total, x: total + x).cast("long")


#: Features, and the arrays they are counted on: what each is computed from, and how.
_ARRAYS: dict[str, tuple[str | None, Callable[[Column], Column]]] = {
    "_td_words": (None, lambda text: F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")),
    "_td_lines": (None, lambda text: F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")),
    "_td_hashes": ("_td_words", lambda words: F.transform(words, lambda w: F.xxhash64(w))),
    "_td_windows": ("_td_hashes", _windows),
    "_td_places": ("_td_windows", _repeated),
}
FEATURES: dict[str, tuple[str | None, Callable[[Column], Column]]] = {
    "n_words": ("_td_words", lambda words: F.size(words).cast("long")),
    "word_chars": (None, lambda text: _without(text, _SPACES)),
    "n_symbols": (None, lambda text: F.char_length(text) - _without(text, _SYMBOLS)),
    "n_lines": ("_td_lines", lambda lines: F.size(lines).cast("long")),
    "n_dup_lines": ("_td_lines", lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")),
    "n_repeat_words": ("_td_places", _covered),
    "n_upper": (None, lambda text: F.char_length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    "n_bangs": (None, lambda text: F.char_length(text) - _without(text, "!?")),
}


def _with_features(frame: DataFrame, wanted: Iterable[str], where: Column | None = None) -> DataFrame:
    """``frame`` (with _td_text) with features it lacks, one projection for each step; null where ``where`` is false."""
    todo = [f for f in wanted if f not in frame.columns]
    sources = {s for f in todo if (s := (FEATURES | _ARRAYS)[f][0]) is not None}
    if sources - set(frame.columns):
        frame = _with_features(frame, sorted(sources), where)
    made = {f: compute(F.col(source or "_td_text")) for f in todo for source, compute in [(FEATURES | _ARRAYS)[f]]}
    return frame.withColumns(made if where is None else {f: F.when(where, c) for f, c in made.items()}) if made else frame


def _prepared(docs: DataFrame, text_col: str) -> tuple[list[str], DataFrame]:
    """The columns to keep, and ``docs`` without those whose names are made here."""
    keep = [c for c in docs.columns if c not in FEATURES and c != "kept"]
    return keep, docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_td_text"))


def measured(docs: DataFrame, text_col: str = "text", features: Iterable[str] = tuple(FEATURES)) -> DataFrame:
    """``docs`` with the features; columns of their names are replaced."""
    keep, frame = _prepared(docs, text_col)
    wanted = list(features)
    return _with_features(frame, wanted).select(*keep, *wanted)


BASE_RULES = (
    Rule("few words", "n_words < 10"),
    Rule("repeated windows", "100 * n_repeat_words > 20 * n_words"),
)
RULES = (
    *BASE_RULES,
    Rule("word length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("exclamations", "2 * n_bangs > n_words"),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second of cost on a sample of about ``sample_rows`` rows and at most about ``SAMPLE_BYTES``."""
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    share = min(1.0, sample_rows / max(1, total), SAMPLE_BYTES / max(1, size))
    sample = docs.select(text_col).sample(share, seed=17).persist()

    def run(features: Iterable[str], rejects: Column) -> tuple[float, int]:
        job = measured(sample, text_col, features).agg(F.count_if(rejects))
        seconds, rejected = [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = job.first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), rejected

    try:
        rows = max(1, sample.count())
        idle, _ = run((), F.lit(False))
        scores = []
        for rule in rules:
            seconds, rejected = run(rule.needs, rule.rejects)
            scores.append(rejected / rows / 2 ** round(math.log2(max(LEAST_COST, seconds - idle))))
    finally:
        sample.unpersist()
    return [rule for _, _, rule in sorted(zip((-s for s in scores), range(len(rules)), rules), key=lambda x: x[:2])]


def judge(docs: DataFrame, order: list[Rule], text_col: str = "text", always: Iterable[str] = ()) -> DataFrame:
    """``docs`` with the features of ``always`` and ``kept``: true for rows that no rule rejects.

    Features that are not asked for in every row are computed only for rows that reach a rule
    which needs them.
    """
    keep, frame = _prepared(docs, text_col)
    always = list(always)
    frame = _with_features(frame, always).withColumn("kept", F.lit(True))
    for rule in order:
        frame = _with_features(frame, rule.needs, F.col("kept"))
        frame = frame.withColumn("kept", F.when(F.col("kept"), ~rule.rejects).otherwise(False))
    # not deterministic to Catalyst, so that a filter on kept stays above and does not copy the cascade into itself
    return frame.select(*keep, *always, (F.col("kept") & (F.spark_partition_id() >= 0)).alias("kept"))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    own = docs.withColumns({"_td_row": F.struct(*docs.columns)}).select("_td_row", F.col(text_col).alias("_td_source"))
    return judge(own, cascade_order(docs, rules, text_col), "_td_source").where("kept").select("_td_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = BASE_RULES[0].rejects | BASE_RULES[1].rejects
    return judge(docs, cascade_order(docs), always=asked).select("doc_id", *asked, failed.alias("base_failed"), "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
u AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, array_to_string([word, lead(word, 1) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s], ' ') AS win,
             lead(word, 4) OVER s IS NOT NULL AS whole FROM u WINDOW s AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g WHERE whole) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS o(k) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'gs'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'gs')) AS n_upper, length(regexp_replace(t, '[^!?]', '', 'gs')) AS n_bangs
  FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars OR 2 * n_bangs > n_words) AS kept
FROM f
"""
