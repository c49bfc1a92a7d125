"""The registered queries of this subpackage: thin bindings of the operators to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lexical, licenses, lines, merkle, mixing, quality, secret_scan, sharding, simhash, substrings, token_store, url_filter
from .common import table

SHARDS = 16
#: File name of the public tokenizer that the token queries use.
TOKENIZER = "byte_bpe_50k.json"
#: The site's rules for urls.
RULES = [url_filter.Rule(*x) for x in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]
#: The number in a page's path names the document that the page shows, whose labels are the page's outcome.
PAGE_DOC, BAD = "^/[^/]*/([0-9]+)", "quality = 0 OR toxic = 1"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.judge(docs, labels).withColumnRenamed("id", "doc_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text", "source")).withColumnRenamed("id", "doc_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = mixing.schedule(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return dealt.select(F.col("id").alias("doc_id"), "source", "size", "block", "slot")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc, _ = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return per_doc.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_files(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    shown = pages.select("url", F.regexp_extract(url_filter.path_of(F.col("url")), PAGE_DOC, 1).try_cast("long").alias("doc_id"))
    outcomes = shown.join(labels.select("doc_id", F.expr(BAD).alias("bad")), "doc_id").select("url", "bad")
    return url_filter.judge(pages, outcomes, RULES).withColumnRenamed("id", "page_id")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_line_dedup, op3_quality_rules, op4_benchmark_decontamination, op5_suffix_dedup, op6_secret_scan, op7_source_mixing, op8_license_scan, op9_simhash_near_dedup, op10_token_output, op11_merkle_manifest, op12_url_filter, op13_lexical_search)}


def _license_sql() -> str:
    """The license scan in SQL: all word pairs joined to template pairs, voted by diagonal, merged and verified."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    told = [(label, text, True) for text, label in licenses.BASE.items()] + [(label, text, False) for label, text in licenses.NOTICES]
    values = ", ".join(f"({n}, {quote(label)}, {str(base).lower()}, {quote(text)})" for n, (label, text, base) in enumerate(told))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{licenses.WORD}')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
tp(template, label, base, text) AS (VALUES {values}),
tw AS (SELECT template, label, base, {words} AS w FROM tp),
tg AS (SELECT template, label, base, len(w) - 1 AS grams, q, w[q + 1] AS a, w[q + 2] AS b FROM (SELECT *, unnest(range(len(w) - 1)) AS q FROM tw)),
dg AS (SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT *, unnest(range(len(w) - 1)) AS p FROM d)),
v AS (SELECT DISTINCT doc_id, template, label, base, grams, p - q AS diagonal, q FROM dg JOIN tg USING (a, b)),
s AS (SELECT doc_id, template, label, base, grams, diagonal, min(diagonal + q) AS lo, max(diagonal + q + 1) AS hi, list(q) AS seen FROM v GROUP BY ALL),
c AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER o > {licenses.NEAR}, true) THEN 1 ELSE 0 END AS apart FROM s WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
n AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM c),
m AS (SELECT doc_id, template, label, base, grams, span, len(list_distinct(flatten(list(seen)))) AS n_seen, min(lo) AS first_word, max(hi) AS last_word FROM n GROUP BY ALL),
f AS (SELECT *, n_seen * 1.0 / grams AS share FROM m WHERE n_seen = grams OR (NOT base AND n_seen * 1.0 / grams >= {licenses.SHARE} AND last_word - first_word + 1 <= {licenses.STRETCH} * (grams + 1))),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score FROM d LEFT JOIN g USING (doc_id)"""


def _manifest_sql() -> str:
    """Leaves, runs of three level by level in each source and over the sources, and each leaf folded along its runs."""
    leaf = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"
    up = lambda name, key: f"SELECT {key}, l + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {key}, l, pos // 3"
    replaced = "sha256(array_to_string(list_transform(digests, lambda x, i: CASE WHEN i = f.pos % 3 + 1 THEN f.cur ELSE x END), ''))"
    beside = "f.sib || array_to_string(list_filter(digests, lambda x, i: i <> f.pos % 3 + 1), '')"
    return f"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce('s' || source, '') AS s, {leaf.replace("{text}", "text")} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf.replace("{text}", "replace(text, chr(10), '')")} END AS tampered FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM d),
lv(s, l, pos, digest, n) AS (SELECT s, 0, pos, leaf, n FROM o UNION ALL {up("lv", "s")}),
r AS (SELECT s, l, pos // 3 AS run, list(digest ORDER BY pos) AS digests FROM lv WHERE n > 1 GROUP BY ALL),
sub AS (SELECT s, l AS top, digest, row_number() OVER (ORDER BY s) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(k, l, pos, digest, n) AS (SELECT 0, 0, pos, digest, n FROM sub UNION ALL {up("tv", "k")}),
tr AS (SELECT l, pos // 3 AS run, list(digest ORDER BY pos) AS digests FROM tv WHERE n > 1 GROUP BY ALL),
f(s, id, l, pos, cur, sib) AS (SELECT s, pos, 0, pos, coalesce(tampered, leaf), '' FROM o UNION ALL SELECT f.s, f.id, f.l + 1, f.pos // 3, {replaced}, {beside} FROM f JOIN r ON r.s = f.s AND r.l = f.l AND r.run = f.pos // 3),
g(s, id, l, pos, cur, sib) AS (SELECT f.s, f.id, 0, sub.pos, f.cur, f.sib FROM f JOIN sub ON sub.s = f.s AND sub.top = f.l UNION ALL SELECT f.s, f.id, f.l + 1, f.pos // 3, {replaced}, {beside} FROM g f JOIN tr ON tr.l = f.l AND tr.run = f.pos // 3),
root AS (SELECT l AS top, digest FROM tv WHERE n = 1)
SELECT o.doc_id, o.leaf, sub.digest AS subroot, root.digest AS root, sha256(g.sib) AS proof_sha256, g.cur AS folded_root, g.cur = root.digest AS verified
FROM o JOIN sub ON sub.s = o.s JOIN root ON true JOIN g ON g.s = o.s AND g.id = o.pos AND g.l = root.top"""


def _url_sql() -> str:
    """Rules, then counts by host, domain and suffix, priors by moments from the top down, and the beta posterior's tail by Simpson's rule."""
    u, upper = url_filter, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = f"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}')"
    path = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    longest = sorted(RULES, key=lambda r: -len(r.name))
    fits = {r.name: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in longest}
    named = " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in longest)
    verdict = " ".join(f"WHEN {fits[r.name]} THEN '{r.verdict}'" for r in longest)
    labels = "string_split(regexp_replace(host, ':[0-9]*$', ''), '.')"
    second = ", ".join(f"'{x}'" for x in u.SECOND)
    suffix = f"CASE WHEN regexp_matches(host, '^[0-9.]*(:[0-9]*)?$|\\]') THEN '' WHEN length({labels}[-1]) = 2 AND {labels}[-2] IN ({second}) AND len({labels}) > 2 THEN {labels}[-2] || '.' || {labels}[-1] ELSE {labels}[-1] END"
    domain = f"CASE WHEN suffix = '' THEN host ELSE array_to_string({labels}[-(len(string_split(suffix, '.')) + 1):], '.') END"
    low, high = u.WEIGHTS

    def level(name: str, source: str) -> str:
        m = "least(greatest(mean, 1e-6), 1 - 1e-6)"
        r = f"((sum(n * pow(bad / n - {m}, 2) / ({m} * (1 - {m}))) - count(*)) / (sum(n) - count(*)))"
        weight = f"CASE WHEN sum(n) > count(*) AND {r} > {1 / (1 + high)!r} THEN greatest({low!r}, 1 / {r} - 1) ELSE {high!r} END"
        return f"{name}w AS (SELECT {weight} AS w FROM {source} WHERE n > 0), {name} AS (SELECT *, mean * w + bad AS a, (1 - mean) * w + n - bad AS b FROM {source}, {name}w)"

    def side(end: str) -> str:
        h, x = f"(({end} - cut) / {u.STEPS})", f"(cut + k * (({end}) - cut) / {u.STEPS})"
        rest = f"ln(1 + exp(-abs({x})))"
        weight = f"CASE WHEN k IN (0, {u.STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
        return f"abs({h}) / 3 * list_sum(list_transform(range({u.STEPS + 1}), lambda k: {weight} * exp(a * (-greatest(-{x}, 0) - {rest}) + b * (-greatest({x}, 0) - {rest}) - peak)))"

    return f"""WITH p AS (SELECT page_id, url, coalesce({host}, '') AS host, coalesce({path}, '') AS path FROM pages),
o AS (SELECT host, ({BAD}) AS bad FROM p JOIN labels ON try_cast(regexp_extract(path, '{PAGE_DOC}', 1) AS BIGINT) = doc_id UNION ALL SELECT host, NULL FROM p),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad::INT), 0) AS bad, {suffix} AS suffix FROM o GROUP BY host),
h AS (SELECT *, {domain} AS domain FROM h0),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM h) AS mean FROM h GROUP BY suffix), {level("s", "s0")},
d0 AS (SELECT x.*, a / (a + b) AS mean FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL) x JOIN s USING (suffix)), {level("d", "d0")},
e0 AS (SELECT h.*, a / (a + b) AS mean FROM h JOIN d USING (domain)), {level("e", "e0")},
c AS (SELECT host, a, b, ln({u.LIMIT} / (1 - {u.LIMIT})) AS cut, ln(a / b) AS mode, 8 * sqrt(1 / a + 1 / b) + 25 * (1 / a + 1 / b) AS reach, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS peak FROM e),
t AS (SELECT host, a / (a + b) AS rate, {side("greatest(mode + reach, cut + 1e-9)")} AS above, {side("least(mode - reach, cut - 1e-9)")} AS below FROM c)
SELECT page_id, host, path, CASE {named} END AS rule, CASE {verdict} WHEN above / (above + below) >= {u.CONFIDENCE} THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS bad_rate FROM p JOIN t USING (host)"""


def _search_sql() -> str:
    """All scores of all documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{lexical.TERM}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {lexical.BEST}"""


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": _license_sql(), "op11_merkle_manifest": _manifest_sql(), "op12_url_filter": _url_sql(), "op13_lexical_search": _search_sql()}
