"""Quality rules whose cutoffs are certified on labelled documents: limited false rejection in each stratum."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import ByteHashes, cut, table, unused, worker_of
from spreadloom.llm.tokens import _same_bytes, slices, texts

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper"]


def _bytes_of(values: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*values.encode()] if isinstance(values, str) else values] = True
    return out


SPACE, SYMBOL, MARK, UPPER = _bytes_of([32, *range(9, 14)]), _bytes_of("#*$%&|<>"), _bytes_of("!"), _bytes_of([*range(65, 91)])
LEADS = ~_bytes_of([*range(128, 192)])  # bytes that begin a character


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of marked bytes; runs end at the offsets `at` of the texts too."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins, ends = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
    before[begins], after[ends - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def identities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each byte string, the same for equal strings alone: found by a hash, decided by the bytes."""
    if not len(start):
        return np.zeros(0, np.int64)
    _, first, which = np.unique(ByteHashes(data).of(start, end), return_index=True, return_inverse=True)
    size = end - start
    wrong = np.flatnonzero(~_same_bytes(data, start, size, data, start[first][which], size[first][which]))
    seen: dict[bytes, int] = {}
    for i in wrong.tolist():
        which[i] = seen.setdefault(data[start[i] : end[i]].tobytes(), len(first) + len(seen))
    return which


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a


def counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COUNTS of the texts data[at[i]:at[i + 1]], a row each."""
    data, at = data[int(at[0]) : int(at[-1])], np.asarray(at, np.int64) - int(at[0])
    n, size = len(at) - 1, np.diff(at)
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[at])
    of = lambda start: np.searchsorted(at, start, "right") - 1
    word = ~SPACE[data]
    start, end = spans(word, at)
    text = of(start)
    ids = identities(data, start, end)
    out[:, 0], out[:, 1] = np.bincount(text, minlength=n), total(word & LEADS[data])
    out[:, 2], out[:, 6], out[:, 7] = (total(m[data]) for m in (SYMBOL, MARK, UPPER))
    if len(ids) > 2:
        three = np.flatnonzero(text[:-2] == text[2:])
        triple = _numbered(_numbered(ids[three], ids[three + 1]), ids[three + 2])
        own = _numbered(triple, text[three])
        again = np.zeros(len(ids), bool)
        again[three] = (np.bincount(own, minlength=1)[own] > 1) if len(own) else False
        covered = again.copy()
        covered[1:] |= again[:-1]
        covered[2:] |= again[:-2]
        out[:, 4] = np.bincount(text[covered], minlength=n)
    line, stop = spans(data != 10, at)
    holds = np.append(0, np.cumsum(word))
    some = holds[stop] > holds[line]
    line, stop = line[some], stop[some]
    text = of(line)
    out[:, 5] = np.bincount(text, minlength=n)
    pair = _numbered(identities(data, line, stop), text)
    first = np.unique(pair, return_index=True)[1] if len(pair) else pair
    out[:, 3] = out[:, 5] - np.bincount(text[first], minlength=n)
    return out


@dataclass(frozen=True)
class Rule:
    """Rejects where `statistic`, a whole number made of COUNTS, is above a cutoff. `ladder` holds the cutoffs that may be
    chosen, from the mildest on; it is set beforehand, without looking at any label."""

    name: str
    statistic: str  # SQL over COUNTS; null never rejects
    ladder: tuple[int, ...]


def _mille(a: str, b: str) -> str:
    return f"(1000 * {a}) div nullif({b}, 0)"


RULES = (
    Rule("symbols", _mille("n_symbols", "n_words"), (2000, 1000, 500, 300, 200, 100)),
    Rule("marks", _mille("n_marks", "n_words"), (1500, 1000, 700, 400, 200)),
    Rule("upper", _mille("n_upper", "word_chars"), (900, 800, 600, 400)),
    Rule("dup_lines", _mille("n_dup_lines", "n_lines"), (900, 700, 500)),
    Rule("repeats", _mille("n_repeat_words", "n_words"), (450, 400)),
    Rule("long_words", _mille("word_chars", "n_words"), (12000, 10000, 8000, 7000)),
    Rule("short_words", "-" + _mille("word_chars", "n_words"), (-2000, -2500, -3000, -3500)),
)
MOST_STRATA = 10_000


def _base_failed(words: int, percent: int) -> Column:
    return (F.col("n_words") < words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def no_more_than(k: int, n: int, share: float) -> float:
    """Exact probability of at most k among n, each with probability `share`: the binomial lower tail."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i.tolist()]) + i * math.log(share) + (n - i) * math.log1p(-share)
    return float(np.exp(logs).sum())


def certified(good: int, rejected: list[int], share: float, risk: float) -> int:
    """How many rungs of a ladder are certified, from the mildest on: a rung is, if so few of `good` documents would be
    rejected by it with probability `risk` at most were its true false rejection `share` or more (that is, if the exact
    upper binomial bound at `risk` is at most `share`). The first rung that fails ends the walk, so that a ladder spends
    its `risk` once (fixed-sequence testing)."""
    n = 0
    while n < len(rejected) and good and no_more_than(rejected[n], good, share) <= risk:
        n += 1
    return n


def fit_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, most: float = 0.05, risk: float = 0.05) -> dict:
    """Cutoffs by stratum and rule, from a table with doc_id, the stratum column, base_failed and COUNTS, and labels
    (doc_id, quality). {stratum: (labelled good documents, {rule: cutoff})}; a rule that is not certified has no cutoff.

    The holdout of a stratum are its documents that are labelled good and pass the base rules. With probability 1 - `risk`,
    in no stratum does a rule reject more than `most` / number of rules of such documents, so all together reject at most
    `most`: each (stratum, rule) ladder gets `risk` / (strata * rules) (Bonferroni). Strata of few labels certify nothing and reject
    nothing. Counts are added up in Spark; a row of numbers for each stratum comes to the driver, MOST_STRATA at most.
    A label that is null is none; of repeated ones the smallest counts.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    over = [F.count_if(F.expr(r.statistic) > c).alias(f"{r.name}_{k}") for r in rules for k, c in enumerate(r.ladder)]
    holdout = counted.filter("not base_failed").join(good, "doc_id", "left_semi").groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_good"), *over)
    strata = counted.select(stratum).distinct().limit(MOST_STRATA + 1).count()
    if strata > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    out = {}
    for row in holdout.collect():
        cutoffs = {}
        for r in rules:
            n = certified(row["_good"], [row[f"{r.name}_{k}"] for k in range(len(r.ladder))], most / len(rules), risk / (strata * len(rules)))
            if n:
                cutoffs[r.name] = r.ladder[n - 1]
        out[row["_stratum"]] = row["_good"], cutoffs
    return out


def count_texts(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without text, and COUNTS (columns of `docs` with these names are replaced). Long texts are
    counted alone; memory is some 60 bytes for each of the longest text, or of 1 MB."""
    others = [c for c in docs.columns if c.lower() not in {"text", *COUNTS}]
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("quality rules")
        for b in batches:
            if not b.num_rows:
                continue
            data, at = texts(b.column(len(others)))
            x = np.concatenate([counts(data, at[i : j + 1]) for i, j in slices(at)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=[*others, *COUNTS])

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, most: float = 0.05, risk: float = 0.05, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """The rows of `docs` (doc_id, text, the stratum column; other columns stay but for clashing names) without text, with
    COUNTS, base_failed, failed (names of the rules that reject it, comma-joined; null where the base already does) and kept.

    Words are maximal runs of characters other than ASCII white space. base_failed: under `least_words` words, or more than
    `most_repeats` per cent of them in 3-word windows found twice or more. A rule rejects above the cutoff that fit_cutoffs()
    certified for the document's stratum (null is a stratum of its own). The text is read once; counts are written out, and
    cutoffs and verdicts come from them. A null or empty text has zeros and fails the base rules; rows that repeat a doc_id
    are judged one by one and each counts in the holdout; ties do not arise. An empty table gives no rows.
    """
    mine = {"base_failed", "failed", "kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine or c == stratum])
    counted = cut(count_texts(docs).withColumn("base_failed", _base_failed(least_words, most_repeats)), "rule-counts")
    cutoffs = fit_cutoffs(counted, labels, stratum, rules, most, risk)
    own, *names = unused(counted, "_stratum", *[f"_{r.name}" for r in rules])
    schema = f"{own} {counted.schema[stratum].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    limits = counted.sparkSession.createDataFrame([(s, *[c.get(r.name) for r in rules]) for s, (_, c) in cutoffs.items()], schema)
    # A row of numbers for each stratum, MOST_STRATA at most.
    j = counted.join(F.broadcast(limits), counted[stratum].eqNullSafe(limits[own]), "left")
    failed = F.concat_ws(",", *[F.when(F.expr(r.statistic) > F.col(n), r.name) for r, n in zip(rules, names, strict=True)])
    j = j.withColumn("failed", F.when(~F.col("base_failed"), failed)).withColumn("kept", F.coalesce(F.col("failed") == "", F.lit(False)))
    return j.drop(own, *names)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return apply_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS[:5], "base_failed", "failed", "kept")


def _sql() -> str:
    """The same in DuckDB: counts by lists of words and lines, the exact binomial tail by log-gamma."""
    rungs = ", ".join(f"('{r.name}', {i}, {k}, {c})" for i, r in enumerate(RULES) for k, c in enumerate(r.ladder))
    stats = "\n    UNION ALL ".join(f"SELECT doc_id, row, lang, base_failed, '{r.name}' AS rule, {r.statistic.replace(' div ', ' // ')} AS x FROM judged" for r in RULES)
    return rf"""
WITH docs AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row),
judged AS (
  SELECT doc_id, s.row, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
  FROM split s LEFT JOIN covered c ON s.row = c.row),
stats AS (
    {stats}),
rungs(rule, r, k, cutoff) AS (VALUES {rungs}),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM stats WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
tests AS (
  SELECT lang, g.rule, r, g.k, cutoff, CAST(count(*) AS BIGINT) AS n, CAST(count_if(x > cutoff) AS BIGINT) AS m FROM held h JOIN rungs g ON h.rule = g.rule GROUP BY ALL),
passed AS (
  SELECT lang, rule, k, cutoff, CASE WHEN m >= n THEN false ELSE
    list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln(0.05 / {len(RULES)}) + (n - i) * ln(1 - 0.05 / {len(RULES)}))))
    <= 0.05 / ({len(RULES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents))) END AS ok
  FROM tests),
chosen AS (SELECT lang, rule, arg_max(cutoff, k) AS cutoff FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY k) AS fine FROM passed) WHERE fine GROUP BY lang, rule),
fails AS (
  SELECT s.row, string_agg(s.rule, ',' ORDER BY r) AS failed FROM stats s JOIN chosen c ON s.lang IS NOT DISTINCT FROM c.lang AND s.rule = c.rule AND s.x > c.cutoff
  JOIN (SELECT DISTINCT rule, r FROM rungs) o ON s.rule = o.rule GROUP BY s.row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN NULL ELSE coalesce(failed, '') END AS failed, NOT base_failed AND failed IS NULL AS kept
FROM judged LEFT JOIN fails ON judged.row = fails.row"""


OP11_SQL = _sql()
