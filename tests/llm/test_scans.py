"""Decontamination, license scans, secret scans and mixing against brute force, planted cases and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, licenses, mixing, queries, secret_scan

from .conftest import ODD_TEXTS, SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


# --- license scans ---


def plain_base(t):
    words = WORD.findall(lower(t or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check_scan(rows, docs):
    got = Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)
    assert got == Counter((i, *plain_base(t)) for i, t in docs)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op8(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    per_doc, _ = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))
    check_scan(per_doc.collect(), docs)
    assert queries.op8_license_scan(spark, SF).count() == len(docs)


def test_op8_equals_its_sql(spark):
    from tests.oracle import compare, connection

    df = queries.op8_license_scan(spark, SF)
    assert compare(df.collect(), df.columns, connection(SF), queries.oracle_sql()["op8_license_scan"]) is None


def test_license_spans(spark, odd, empty):
    notice = licenses.NOTICES[0][1]
    words = notice.split()
    docs = [
        (1, "start " + notice + " end"), (2, " ".join(words[:10] + ["inserted"] + words[10:])), (3, "the MIT license and MIT-License, cc by cc by"),
        (4, "mit"), (5, "the gnu general license public"), (6, notice + "\n" + notice),
    ]
    per_doc, spans = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.id: r for r in per_doc.collect()}
    check_scan(rows.values(), docs)
    assert "gpl" in rows[2].labels and rows[5].labels == "" and rows[3].n_base == 4
    assert sum(not s.base and s.label == "gpl" for s in spans.collect() if s.id == 6) == 2
    check_scan(licenses.scan(odd)[0].collect(), [(i, t) for i, t, _, _ in ODD_TEXTS])
    assert licenses.scan(empty)[0].count() == 0


# --- decontamination ---

ITEM = "A train leaves Boston at 60 miles per hour and another leaves Chicago at 45 miles per hour; after 3 hours how far apart are they"


def test_reparameterised_questions(spark, odd, empty):
    bench = spark.createDataFrame([(1, ITEM), (2, "what is two plus two then"), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    changed = ITEM.replace("60", "72").replace("45", "38").replace("Boston", "Paris").replace("Chicago", "Lyon").replace("3 hours", "5 minutes")
    clash = ITEM.replace("60", "72").replace("45", "72")
    docs = [
        (1, "before it " + ITEM + " and after"), (2, "some words " + changed + "."), (3, clash), (4, "nothing of the kind here at all in this text"),
        (5, "so, what is two plus two then?"), (6, ITEM[:40]), (1, "before it " + ITEM + " and after"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.id, r.item_id): r.kind for r in decontaminate.contaminated(df, bench).collect()}
    assert found == {(1, 1): "exact", (2, 1): "reparameterised", (5, 2): "exact"}
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()) == [3, 4, 6]
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.where("false")).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.remove_contaminated(odd, bench).count() == len(ODD_TEXTS)


def test_op4_finds_verbatim_items(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(i, k) for i, t in docs for k, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op4_benchmark_decontamination(spark, SF).collect()}
    assert want <= got
    shingles = lambda t: {tuple(w[i : i + 8]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 7)}
    by_item = {k: shingles(x) for k, x in items}
    by_doc = {i: shingles(t) for i, t in docs}
    assert all(by_doc[i] & by_item[k] for i, k in got)


# --- secret scans ---


KEYS = "pass|passwd|password|pwd|secret|token|key|apikey|auth|credential|private"


def plain_candidates(t):
    """Values of 8 characters or more with a digit, cases that change inside, or a secret's name before them."""
    words, out = re.split("[\x20\x09-\x0d]+", t or ""), 0
    for k, w in enumerate(words):
        before = " ".join(words[max(0, k - 2) : k])
        announced = re.search(f"(?i)({KEYS})\\W*[=:]$", before)
        if len(w) < 8 or not (re.search("[0-9]|[a-z][A-Z]", w) or re.search(f"(?i)({KEYS})[^=:]*[=:]", w) or announced):
            continue
        for m in re.finditer(r"""(?:([A-Za-z_][A-Za-z0-9_\-.]*)["'`]?[=:]["'`]?)?([^\s"'`,;:=?&<>()\[\]{}|]{8,}={0,2})""", w):
            value, name = re.sub(r"(?:[.!]|([#$%*!])\1+)$", "", m[2]), m[1] or ""
            out += len(value) >= 8 and bool(re.search("[0-9]|[a-z][A-Z]", value) or re.search(f"(?i)({KEYS})", name) or not name and announced)
    return out


def test_secret_candidates(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Counter(r.id for r in secret_scan.candidates(docs, "doc_id", "text", "source").collect())
    assert rows == Counter({r.doc_id: n for r in docs.collect() if (n := plain_candidates(r.text))})
    assert secret_scan.scan(odd).count() == sum(plain_candidates(t) for _, t, _, _ in ODD_TEXTS)
    assert secret_scan.scan(empty).count() == 0


def test_every_value_of_a_word_is_a_candidate(spark):
    texts = {
        0: '{"api_key":"AKIA1234567890ABCD","secret":"zz99yy88xx77"}', 1: "https://h/x?token=abcd1234efgh5678&x=1", 2: "A=abcd1234efgh;B=9876wxyz5432;done",
        3: 'pw="S3cr!tPa$$w0rd#"', 4: "password=correcthorsebattery", 5: "api_key=AbCdEfGhIjKlMnOp", 6: "plain words alone, nothing else here",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("source", F.lit("a/b"))
    found = defaultdict(list)
    for r in secret_scan.candidates(docs, "doc_id", "text", "source").orderBy("id", "at", "part").collect():
        found[r.id].append((r.name, r.value))
    assert dict(found) == {
        0: [("api_key", "AKIA1234567890ABCD"), ("secret", "zz99yy88xx77")], 1: [("token", "abcd1234efgh5678")], 2: [("a", "abcd1234efgh"), ("b", "9876wxyz5432")],
        3: [("pw", "S3cr!tPa$$w0rd#")], 4: [("password", "correcthorsebattery")], 5: [("api_key", "AbCdEfGhIjKlMnOp")],
    }


def test_weakly_trained_forest_finds_planted_secrets_without_a_name(spark):
    """Held-out recall and precision: secrets that no name announces, among look-alikes, with rare positives to learn from."""

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]

    def text(i):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        some = lambda: " ".join(rng.choice(words) for _ in range(5))
        if i % 10 == 1:
            return f'{some()} token = "{h[:40]}" {some()}'
        if i % 10 == 2:
            return f"{some()} {h[:40]} {some()}"
        return f"{some()} number{i}word {some()} room2{i}floor {some()} 2024-01-{i % 28 + 10} {some()} {i * 7919 + 10**9} {some()}"

    docs = spark.createDataFrame([(i, text(i), "src/app") for i in range(3000)], "doc_id long, text string, source string").repartition(4)
    rows = secret_scan.scan(docs).collect()
    told = {hashlib.sha256(hashlib.sha256(str(i).encode()).hexdigest()[:40].encode()).hexdigest() for i in range(3000) if i % 10 == 2}
    hit = [r for r in rows if r.is_secret]
    assert len({r.value_sha256 for r in hit} & told) >= 0.95 * len(told)
    assert sum(r.id % 10 in (1, 2) for r in hit) >= 0.95 * len(hit)


def test_forest_on_held_out_findings(spark):
    def text(i):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        return f'the value is token = "{h[:40]}" here' if i % 2 else f"see page number{i}word and room2{i}floor for more on it"

    docs = spark.createDataFrame([(i, text(i), "src/app") for i in range(1200)], "doc_id long, text string, source string").repartition(3)
    found = secret_scan.candidates(docs, "doc_id", "text", "source").select("id", "at", "value").collect()
    labels = spark.createDataFrame([(r.id, r.at, int(r.id % 2)) for r in found if r.id < 800], "id long, at int, label int")
    rows = [r for r in secret_scan.scan(docs, findings=labels).collect() if r.id >= 800]
    assert rows and sum(r.is_secret == bool(r.id % 2) for r in rows) / len(rows) > 0.98


# --- mixing ---


def plain_edf(shares):
    period, had, out = sum(shares), [0] * len(shares), []
    for t in range(period):
        ready = [(-(-(c + 1) * period // a), k) for k, (a, c) in enumerate(zip(shares, had)) if c * period // a <= t]
        _, k = min(ready)
        had[k] += 1
        out.append(k)
    return out


def test_period_is_earliest_deadline_first_within_one_block(spark):
    for shares in ([1], [1, 1], [5, 3, 2], [37, 1, 1, 11, 50], [1] * 7 + [93]):
        rows = sorted((r.slot, r.source_index) for r in mixing.period_schedule(spark, shares).collect())
        dealt = [s for _, s in rows]
        assert dealt == plain_edf(shares)
        had = [0] * len(shares)
        for t, s in enumerate(dealt, 1):
            had[s] += 1
            assert all(abs(h - t * a / sum(shares)) < 1 for h, a in zip(had, shares))


def test_op7(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_source_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by_source = defaultdict(list)
    for r in rows:
        assert r.source == docs[r.doc_id].source and r.size == len((docs[r.doc_id].text or "").encode()) + 1
        by_source[r.source].append(r)
    totals = {s: sum(r.size for r in x) for s, x in by_source.items()}
    shares = mixing.quanta(mixing.tempered(totals))
    names = sorted(shares)
    plan, turn = {}, Counter()
    for slot, k in enumerate(plain_edf([shares[s] for s in names])):
        plan[names[k], turn[k]] = slot
        turn[k] += 1
    for r in rows:
        a = shares[r.source]
        assert r.slot == r.block // a * 1000 + plan[r.source, r.block % a]
    for s, x in by_source.items():
        blocks = Counter()
        for r in x:
            blocks[r.block] += r.size
        assert max(blocks) == len(blocks) - 1 or max(r.size for r in x) > mixing.BLOCK_BYTES


def test_mixing_odd(spark, odd, empty):
    rows = mixing.schedule(odd).collect()
    assert Counter((r.id, r.source) for r in rows) == Counter((i, s) for i, _, _, s in ODD_TEXTS)
    assert mixing.schedule(empty).count() == 0
    assert mixing.mixed(odd).count() == len(ODD_TEXTS) and mixing.mixed(odd).columns == odd.columns
    assert mixing.quanta({"a": 0.5, None: 0.5}, 10) == {"a": 5, None: 5}


@pytest.mark.parametrize("many", [10, 500, 5000])
def test_shares_follow_the_weights_for_any_number_of_sources(spark, many):
    # one source at 0.9 of the weight beside many small ones, which differ threefold; blocks of one row each
    small = {f"s{k}": 0.1 * (1 + k % 3) / sum(1 + j % 3 for j in range(many - 1)) for k in range(many - 1)}
    weights = {"hot": 0.9} | small
    least = min(small.values())
    rows = spark.createDataFrame([(s, max(3, round(4 * w / least))) for s, w in weights.items()], "source string, n int")
    docs = rows.select("source", F.explode(F.sequence(F.lit(1), "n")).alias("k")).withColumns({"doc_id": F.xxhash64("source", "k"), "text": F.lit("x" * 9)})
    slots = mixing.schedule(docs, weights=weights, block_bytes=10).where("slot is not null")
    assert slots.count() == docs.count() and slots.select("slot").distinct().count() == docs.count()
    end = int(2 / least)
    had = {r["source"]: r["count"] for r in slots.where(F.col("slot") < end).groupBy("source").count().collect()}
    assert had["hot"] == pytest.approx(0.9 * end, abs=2 + 0.0005 * end)
    rest = end - had["hot"]
    assert all(abs(had.get(s, 0) - rest * w / 0.1) <= 2 + 0.02 * rest * w / 0.1 for s, w in small.items())
