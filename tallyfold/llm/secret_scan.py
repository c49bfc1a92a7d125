"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are all values of a word that hold a digit, mix cases inside, or are assigned to the name of a secret.
Features are length, character transitions, how much a dictionary of the corpus covers, the path and the
neighbouring words; a random forest trained on labelled findings tells secrets from look-alikes.
Where no table has labelled findings, values assigned to a secret's name are the labelled positives; the forest then
sees neither the names nor the words that those labels are read from.  Values without a name may be secrets too, so
scores are divided by the mean score of the labelled positives (Elkan and Noto, learning from positive and unlabelled data).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Shortest value.
SHORTEST = 8
#: A dictionary word has this many letters at least and occurs so often at least.
LETTERS, OCCURS = 3, 5
#: Labelled findings that the forest is trained on, at most, half of them of each class; trees, depth, seed; probability of a secret.
TRAIN, TREES, DEPTH, SEED, CUT = 20_000, 20, 6, 11, 0.5

#: Words that announce a secret, and values that stand in for one.
KEYS = "pass|passwd|password|pwd|secret|token|key|apikey|auth|credential|private"
STAND_INS = "example|changeme|placeholder|xxxx|dummy|your"

#: Marks that end a value, and a value with the name before it, if it has one.
_ENDS = "\\s\"'`,;:=?&<>()\\[\\]{}|"
VALUE = f"(?:([A-Za-z_][A-Za-z0-9_\\-.]*)[\"'`]?[=:][\"'`]?)?([^{_ENDS}]{{{SHORTEST},}}={{0,2}})"
#: Sentence ends and repeated marks after a value.
_TRAIL = "(?:[.!]|([#$%*!])\\1+)$"
#: Buckets of neighbouring words.
NEAR = 8

SHAPE = ["length", "digit_share", "upper_share", "other_share", "distinct_share", "transitions", "hex_only", "longest_run", "covered", "sample_path", "path_depth", "path_bucket"]
AROUND = [f"near_{k}" for k in range(NEAR)]
#: What weak labels are read from; only a forest with labelled findings sees these.
NAMED = ["key_word", "assigned", "quoted", *(f"beside_{k}" for k in range(NEAR))]
FEATURES = [*SHAPE, *AROUND, *NAMED]


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """id, path, at (word number from 0), part (value number in the word), before, near and name, value.

    before holds the two words before, near the two words before these and the two after; name is what the value
    is assigned to within its word.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    words = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+").alias("words"))

    def beside(at: Column, *steps: int) -> Column:
        return F.concat_ws(" ", *(F.get("words", at + k) for k in steps))

    def candidate(word: Column, at: Column) -> Column:
        wanted = word.rlike("[0-9]|[a-z][A-Z]") | word.rlike(f"(?i)({KEYS})[^=:]*[=:]") | beside(at, -2, -1).rlike(f"(?i)({KEYS})\\W*[=:]$")
        return F.when((F.length(word) >= SHORTEST) & wanted, F.struct(at.alias("at"), beside(at, -2, -1).alias("before"), word.alias("word"), beside(at, -4, -3, 1, 2).alias("near")))

    found = words.select("id", "path", F.explode(F.filter(F.transform("words", candidate), lambda x: x.isNotNull())).alias("c")).select("id", "path", "c.*")
    names, values = (F.regexp_extract_all("word", F.lit(VALUE), F.lit(k)) for k in (1, 2))
    split = found.select("id", "path", "at", "before", "near", "word", F.posexplode(F.arrays_zip(names.alias("name"), values.alias("value"))).alias("part", "v"))
    named = split.select("id", "path", "at", "part", "before", "near", F.lower("v.name").alias("name"), F.col("word").rlike("[\"'`]").cast("double").alias("quoted"), F.regexp_replace("v.value", _TRAIL, "").alias("value"))
    secret_name = F.col("name").rlike(f"({KEYS})") | ((F.col("name") == "") & F.lower("before").rlike(f"({KEYS})\\W*[=:]$"))
    return named.where((F.length("value") >= SHORTEST) & (F.col("value").rlike("[0-9]|[a-z][A-Z]") | secret_name))


def dictionary(docs: DataFrame, text_col: str) -> DataFrame:
    """Lower-cased words of letters alone that occur often enough, over all rows of `docs`."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}]+"))
    return docs.select(word.alias("word")).where(F.length("word") >= LETTERS).groupBy("word").count().where(F.col("count") >= OCCURS).select("word")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` with the columns of FEATURES."""
    value, n = F.col("value"), F.length("value")
    runs = found.select("value").distinct().select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("word")).where(F.length("word") >= LETTERS)
    covered = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    lower_before = F.lower("before")

    def buckets(text: str, name: str) -> dict[str, Column]:
        seen = F.transform(F.split(F.lower(text), "[^\\p{L}]+"), lambda w: F.pmod(F.xxhash64(w), F.lit(NEAR)))
        return {f"{name}_{k}": F.array_contains(seen, k).cast("double") for k in range(NEAR)}

    return (
        found.join(covered, "value", "left")
        .withColumns({
            "length": F.least(n, F.lit(200)).cast("double"),
            "digit_share": _count(value, "[0-9]") / n,
            "upper_share": _count(value, "[A-Z]") / n,
            "other_share": _count(value, "[^A-Za-z0-9]") / n,
            "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
            "transitions": (F.length(F.regexp_replace(shape, "(.)\\1+", "$1")) - 1) / n,
            "hex_only": value.rlike("^[0-9a-f]+$").cast("double"),
            "longest_run": F.array_max(F.transform(F.split(shape, "[^a]+"), lambda x: F.length(x))).cast("double"),
            "covered": F.coalesce(F.col("letters"), F.lit(0)) / n,
            "key_word": (lower_before.rlike(f"({KEYS})") | F.col("name").rlike(f"({KEYS})")).cast("double"),
            "assigned": ((F.col("name") != "") | lower_before.rlike("[=:]$")).cast("double"),
            "sample_path": F.lower("path").rlike("test|sample|example|doc").cast("double"),
            "path_depth": F.size(F.split("path", "/")).cast("double"),
            "path_bucket": F.pmod(F.xxhash64("path"), F.lit(64)).cast("double"),
            **buckets("near", "near"),
            **buckets("before", "beside"),
        })
        .drop("letters")
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels for tables without labelled findings: 1 if the value is assigned to a secret's name and is no stand-in, else 0."""
    named = F.concat_ws(" ", F.lower("before"), "name").rlike(f"\\b({KEYS})\\b") & ((F.col("name") != "") | F.col("before").rlike("[=:]$"))
    return found.withColumn("label", (named & ~F.lower("value").rlike(STAND_INS)).cast("int"))


def train(labelled: DataFrame, features: list[str] = FEATURES):
    """A forest from featured rows with a label 0/1, of each class TRAIN / 2 by hash at most; None without both classes."""
    half = [labelled.where(F.col("label") == k).orderBy(F.xxhash64("value", "before", "id")).limit(TRAIN // 2) for k in (0, 1)]
    drawn = staged(half[0].unionByName(half[1]).select("label", *features), "labelled-findings")
    if drawn.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(drawn.withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assembled)


def scored(rows: DataFrame, model, features: list[str] = FEATURES) -> DataFrame:
    """`rows` with score, the forest's probability of a secret (null without a model)."""
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    out = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """id, at, part, name, value_sha256, length, score, is_secret for every candidate in every row of `docs`.

    `findings` holds labelled findings (id, at, label, and part if a word may hold several values); without it
    weak labels are used, and the forest sees neither names nor the two words before.  Without labels of both
    kinds nothing is scored and every candidate stays a secret.  Values are returned as hashes only.
    Null texts have no candidates; null paths are empty paths; repeated rows give repeated findings; rows
    with null ids are scanned like any other; an empty table gives no rows; other columns are not read.
    """
    found = staged(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    words = staged(dictionary(docs, text_col), "dictionary")
    rows = staged(featured(found, words), "secret-features")
    if findings is None:
        labelled, features = weak_labels(rows), [*SHAPE, *AROUND]
    else:
        keys = [c for c in ("id", "at", "part") if c in findings.columns]
        labelled, features = rows.join(findings.select(*keys, "label").dropDuplicates(keys), keys), FEATURES
    out = scored(rows, model := train(labelled, features), features)
    if findings is None and model is not None:
        known = scored(labelled.where("label = 1"), model, features).agg(F.avg("score").alias("mean"))
        out = out.join(F.broadcast(known)).withColumn("score", F.least(F.col("score") / F.col("mean"), F.lit(1.0)))  # one row
    return out.select("id", "at", "part", "name", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), F.round("score", 6).alias("score"), F.coalesce(F.col("score") >= CUT, F.lit(True)).alias("is_secret"))
