"""Quality rules with risk-controlled cut-offs.

Each rule is a number per document that is large for bad texts.  Labelled good documents of a stratum
are split in two by id: one half proposes, the other, the holdout, certifies.  The proposing half gives each rule a cut-off, and with it one nested
sequence of joint cut-offs: at stage k of STAGES every rule has gone k / STAGES of the way from turning nothing away to its own
proposal, and a document is turned away if any rule turns it away.  A stage is certified if an exact binomial test on the holdout
rejects "together they turn away more than `risk` of the good documents"; stages are tested from lax to strict until the first failure
(fixed-sequence testing), and the level is shared over the strata (Bonferroni), so with probability 1 - `level` no stratum loses more.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_sized, forget_tables, fresh_name, staged

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
WINDOW = 8
#: Most good documents of a stratum that the rules together may turn away, and the chance of being wrong.
RISK, LEVEL = 0.03, 0.05
#: Rule values are counted in steps of 1/STEPS; the last step holds everything from 1 on.
STEPS = 512
#: Joint cut-offs of a stratum, from lax to strict.
STAGES = 512
RULES = ("symbols_per_word", "marks_per_word", "capital_share", "dup_line_share", "repeat_share", "digit_share")

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of eight words that the text holds at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    width, names = 1, len(number)
    while width < WINDOW:  # names of windows twice as wide from pairs of names: exact, no hashing
        pairs = ids[:-width] * names + ids[width:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        width, names = 2 * width, len(found)
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(counts[ids] > 1)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def measure(text: str | None) -> tuple:
    """The five base counts and the rule values of one whole text (null: as empty)."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * 5 + (0.0,) * len(RULES)
    solid = raw.translate(None, SPACE)
    chars = len(solid.decode())
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    marks = solid.count(b"!") + solid.count(b"?")
    digits = len(solid) - len(solid.translate(None, b"0123456789"))
    capitals = len(solid) - len(solid.translate(None, bytes(range(65, 91))))
    small = len(solid) - len(solid.translate(None, bytes(range(97, 123))))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    rules = (symbols / n / 4, marks / n / 4, capitals / max(1, capitals + small), dup_lines / len(lines), repeats / n, digits / chars)
    return (n, chars, symbols, dup_lines, repeats, *(min(x, 1.0) for x in rules))


@F.arrow_udf(T.StructType([*(T.StructField(c, T.LongType()) for c in BASE_FIELDS), *(T.StructField(c, T.IntegerType()) for c in RULES)]))
def measured_text(texts: pa.Array) -> pa.Array:
    """The base counts and each rule's step."""
    forget_tables()
    cols = list(zip(*(measure(t.as_py()) for t in texts))) or [()] * (len(BASE_FIELDS) + len(RULES))
    base = [pa.array(c, pa.int64()) for c in cols[: len(BASE_FIELDS)]]
    steps = [pa.array(np.minimum(np.array(c, float) * STEPS, STEPS).astype(np.int32)) for c in cols[len(BASE_FIELDS) :]]
    return pa.StructArray.from_arrays([*base, *steps], names=[*BASE_FIELDS, *RULES])


def stratum_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """id, stratum, base counts, and each rule's step, written to the shared folder."""
    read = arrow_sized(docs).select(F.col(id_col).alias("id"), stratum_of(stratum_col).alias("stratum"), measured_text(text_col).alias("m"))
    return staged(read, "measures").select("id", "stratum", "m.*")


def binomial_tail(rejected: int, n: int, risk: float) -> float:
    """P(Binomial(n, risk) <= rejected): the exact p-value of "more than `risk` are turned away".

    The terms are summed downwards from the largest, each from the one before by their ratio, until what is left
    cannot change the sum, so the cost does not grow with n.
    """
    if rejected >= n:
        return 1.0
    top = min(rejected, int((n + 1) * risk))

    def log_term(k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk)

    total = term = 1.0
    for k in range(top, 0, -1):
        term *= k * (1 - risk) / ((n - k + 1) * risk)
        total += term
        if term < 1e-17 * total:
            break
    term = 1.0
    for k in range(top, rejected):
        term *= (n - k) * risk / ((k + 1) * (1 - risk))
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, total * math.exp(log_term(top)))


def proposed_step(good: np.ndarray, bad: np.ndarray, risk: float) -> int | None:
    """The laxest step with the most bad documents turned away net of good ones, in shares; None if none gains."""
    good_away = good[::-1].cumsum()[::-1] / max(1, good.sum())
    bad_away = bad[::-1].cumsum()[::-1] / max(1, bad.sum())
    gain = np.where(good_away <= risk, bad_away - good_away, -1.0)
    gain[0] = -1.0
    step = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return step if gain[step] > 0 else None


def stage_of(step: int, target: int) -> int:
    """The first stage at which a rule on its way to `target` turns this step away."""
    return -(-STAGES * (STEPS + 1 - step) // (STEPS + 1 - target))


def step_at(stage: int, target: int) -> int:
    """The step from which a rule on its way to `target` turns documents away at this stage."""
    return STEPS + 1 - stage * (STEPS + 1 - target) // STAGES


def certified_stage(good: np.ndarray, holdout: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The last stage that the holdout certifies on the way to the one that gains most on the proposing half; counts by each document's first stage.

    The last entry counts documents that no stage turns away.
    """
    good_away, bad_away = good.cumsum()[:-1] / max(1, good.sum()), bad.cumsum()[:-1] / max(1, bad.sum())
    gain = np.where(good_away <= risk, bad_away - good_away, -1.0)
    target, n, away, best = int(np.argmax(gain)), int(holdout.sum()), holdout.cumsum(), None
    if gain[target] <= 0:
        return None
    for stage in range(target + 1):
        if binomial_tail(int(away[stage]), n, risk) > level:
            break
        best = stage
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, good: str, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """stratum and, for each rule, the step from which documents are turned away (null: never).

    The counts cover every labelled document that passes the base; the driver sees STEPS numbers for
    each rule, half and stratum, and STAGES for each half and stratum. Bad documents only help to propose, the guarantee is on good ones.
    """
    spark = measured.sparkSession
    label = labels.select(F.col(id_col).alias("id"), F.expr(good).alias("good")).where("id is not null and good is not null")
    kind = F.when(~F.col("good"), 2).otherwise(F.pmod(F.xxhash64(F.lit("holdout"), "id"), F.lit(2))).cast("int")
    told = staged(measured.where(~base_failed()).join(label.groupBy("id").agg(F.max("good").alias("good")), "id").select("stratum", kind.alias("kind"), *RULES), "labelled")
    steps = told.select("stratum", "kind", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES))))
    seen: dict[tuple[str, str], np.ndarray] = {}
    for r in steps.groupBy("stratum", "kind", "rule", "step").count().collect():
        seen.setdefault((r["stratum"], r["rule"]), np.zeros((3, STEPS + 1), np.int64))[r["kind"], r["step"]] += r["count"]
    strata = sorted({s for s, _ in seen})
    targets = {s: [proposed_step(seen[s, r][0], seen[s, r][2], risk / len(RULES)) for r in RULES] for s in strata}
    schema = "stratum string, " + ", ".join(f"cut_{r} int" for r in RULES)
    aims = spark.createDataFrame([(s, *t) for s, t in targets.items()], schema)

    def first_stage(rule: str) -> Column:
        way = STEPS + 1 - F.col(f"cut_{rule}")
        return F.floor((STAGES * (STEPS + 1 - F.col(rule)) + way - 1) / way)

    own = F.least(F.lit(STAGES + 1), *(F.coalesce(first_stage(r), F.lit(STAGES + 1)) for r in RULES)).cast("int")
    stages: dict[str, np.ndarray] = {}
    for r in told.join(aims, "stratum").groupBy("stratum", "kind", own.alias("stage")).count().collect():
        stages.setdefault(r["stratum"], np.zeros((3, STAGES + 1), np.int64))[r["kind"], r["stage"] - 1] += r["count"]
    rows = []
    for s in strata:
        stage = certified_stage(*stages[s], risk, level / len(strata))
        rows.append((s, *(None if t is None or stage is None else step_at(stage + 1, t) for t in targets[s])))
    return spark.createDataFrame([(s, *(c if c is not None and c <= STEPS else None for c in cuts)) for s, *cuts in rows], schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    good: str = "quality = 1", risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """Base counts, base_failed, kept and the rules that turned each document away.

    A document fails the base below 20 words or with over 30 % repeated words; it is kept if it passes
    and no certified cut-off of its stratum is reached.  A stratum without enough labelled good documents
    certifies nothing and turns nothing away; a null stratum is a stratum of its own.  Null texts count as
    empty; repeated rows are judged alike; labels with null ids or values are not used; an empty table
    gives no rows; other columns are not read.
    """
    measured = measures(docs, id_col, text_col, stratum_col)
    cuts = cutoffs(measured, labels, id_col, good, risk, level)
    failed = F.filter(F.array(*(F.when(F.col(r) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    # strata come from one aggregate over the corpus and are few; Spark broadcasts the table only while it is small
    return (
        measured.join(cuts, "stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .select("id", *BASE_FIELDS, "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    good: str = "quality = 1", risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """The rows of `docs` that `judge` keeps, all columns kept; no text is shuffled.

    The rows are written once (zstandard) with their measures beside them, so every row is judged by itself, rows with null or
    repeated ids too.  Null texts, strata and labels, an empty table and columns that go by the same names as the
    measures are treated as by `judge`.
    """
    own = fresh_name(docs, "measured")
    rows = staged(arrow_sized(docs).withColumn(own, measured_text(text_col)), "measured-rows", compression="zstd")
    measured = rows.select(F.col(id_col).alias("id"), stratum_of(stratum_col).alias("stratum"), f"{own}.*")
    # a row for each stratum that has a cut-off, on the driver already
    cuts = {r["stratum"]: r for r in cutoffs(measured, labels, id_col, good, risk, level).collect()}
    m, away = F.col(own), F.lit(False)
    for stratum, r in cuts.items():
        over = [m[x] >= r[f"cut_{x}"] for x in RULES if r[f"cut_{x}"] is not None]
        if over:
            away = away | ((stratum_of(stratum_col) == stratum) & functools.reduce(operator.or_, over))
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    return rows.where(~base & ~away).select(docs.columns)
