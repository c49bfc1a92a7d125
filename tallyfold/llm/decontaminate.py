"""Benchmark decontamination by template canonicalisation.

Numbers (as digits or words), names and units become typed placeholders, so a question and its re-parameterised
copies share one template; a run of name words is one placeholder, and the words of the items' names are names in lower
case too, so that copies may have lost their capitals.  Windows of template tokens are hash-joined between documents
and benchmark items; for the pairs that match widely enough, the values behind the placeholders are aligned and
must map one to one.
"""

from __future__ import annotations

import functools
import operator
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_side, staged

#: Template tokens of a window; items with fewer are matched whole, those below LEAST tokens, which common phrases
#: would match, not at all.
WINDOW, LEAST = 8, 5
#: A document holds an item if it has this share of its windows, or a run this long.
SHARE, RUN = 0.5, 13
#: Alignments so many tokens apart at most may be one place, with words put in or left out.
NEAR = 8
#: Benchmarks with at most this many windows are broadcast (16 bytes each), larger ones are shuffled.
BROADCAST_WINDOWS = 200_000

#: Units that count as a placeholder after a number.
UNITS = [
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "pound", "pounds", "ton", "tons", "gram", "grams",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "percent", "degree", "degrees", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mph", "kmh", "watt", "watts", "volt", "volts",
]

#: Number words, words between those of a name, and words that start sentences and are no names.
ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
PARTICLES = ["al", "bin", "da", "de", "del", "della", "den", "der", "di", "el", "la", "le", "van", "von"]
STARTERS = [
    "A", "After", "All", "An", "And", "Are", "As", "At", "Before", "But", "By", "Calculate", "Can", "Compute", "Did", "Do", "Does", "Each", "Every", "Find", "For", "From",
    "Given", "Had", "Has", "Have", "He", "Her", "His", "How", "I", "If", "In", "Is", "It", "Its", "Let", "Of", "On", "Or", "She", "Since", "So", "Some", "Suppose",
    "That", "The", "Their", "Then", "There", "These", "They", "This", "Those", "To", "Was", "We", "Were", "What", "When", "Where", "Which", "While", "Who", "Why", "Will", "With", "You", "Your",
]
#: Values of number words; side by side they make one number, hundred and the larger ones multiplying what stands before them.
NUMBERS = {"zero": 0, "hundred": 100, "thousand": 1000, "million": 1_000_000} | {w: k for k, w in enumerate([*ONES, *TEENS], 1)} | {t: 10 * k for k, t in enumerate(TENS, 2)}

#: Han and kana are words by the character.
_SIGN = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
TOKEN = f"\\p{{N}}+(?:[.,:/]\\p{{N}}+)*|[\\p{{L}}\\p{{M}}&&[^{_SIGN}]]+|[{_SIGN}]"


#: Decimal digits of other scripts, and what they stand for.
_DIGITS = [chr(c) for c in range(0x80, 0x10000) if unicodedata.decimal(chr(c), None) is not None]
_PLAIN = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def tokens(text: Column) -> Column:
    """Words and numbers of the whole text; digits of other scripts become 0-9."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.when(whole.rlike("[\\p{Nd}&&[^0-9]]"), F.translate(whole, "".join(_DIGITS), _PLAIN)).otherwise(whole)
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


def _is_digits(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def _capital(token: Column, low: Column) -> Column:
    return (token != low) & ~low.isin([x.lower() for x in STARTERS])


def templated(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """`df` with tokens, flat (the kind of each token), kept (the first token of each placeholder, and every other token) and codes.

    A name is a word with a capital that does not merely start sentences, or one that is among `names` in lower case; names side by
    side, with words between them that names have, are one placeholder, and so are number words side by side.
    """

    def kind(token: Column) -> Column:
        low = F.lower(token)
        name = _capital(token, low) | low.isin(names) if names else _capital(token, low)
        return F.when(_is_digits(token) | low.isin(list(NUMBERS)), "<number>").when(name, "<name>").otherwise(low)

    def joined(token: Column, at: Column) -> Column:
        near = lambda *steps: functools.reduce(operator.or_, (F.coalesce(F.get("raw", at + k) == "<name>", F.lit(False)) for k in steps))
        unit = token.isin(UNITS) & F.coalesce(F.get("raw", at - 1) == "<number>", F.lit(False))
        return F.when(unit, "<unit>").when(token.isin(PARTICLES) & near(-1, -2) & near(1, 2), "<name>").otherwise(token)

    def starts(at: Column) -> Column:
        same = (F.get("flat", at) == F.get("flat", at - 1)) & F.get("flat", at).isin("<name>", "<number>")
        words = (F.get("flat", at) == "<name>") | ~(_is_digits(F.get("tokens", at)) | _is_digits(F.get("tokens", at - 1)))
        return (at == 0) | ~(same & words)

    out = df.withColumn("tokens", tokens(F.col(text))).withColumn("raw", F.transform("tokens", kind)).withColumn("flat", F.transform("raw", joined))
    every = F.when(F.size("flat") > 0, F.sequence(F.lit(0), F.size("flat") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("kept", F.filter(every, starts))
    return out.withColumn("codes", F.transform("kept", lambda i: F.xxhash64(F.get("flat", i))))


def values() -> Column:
    """What each kept token stands for with those that go with it: numbers in digits, the rest in lower case."""
    number = F.create_map(*(F.lit(x) for pair in NUMBERS.items() for x in (pair[0], str(pair[1]))))

    def told(x: Column) -> Column:
        plain = F.when(x.rlike("^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(F.lower(x))
        return F.coalesce(F.try_element_at(number, F.lower(x)), plain)

    def joined(a: Column, x: Column) -> Column:
        w, now = F.coalesce(x.try_cast("long"), F.lit(0)), F.greatest(a["now"], F.lit(1))
        total = F.when(w >= 1000, a["total"] + now * w).otherwise(a["total"])
        return F.struct(total.alias("total"), F.when(w >= 1000, F.lit(0).cast("long")).when(w == 100, now * 100).otherwise(a["now"] + w).alias("now"))

    def value(i: Column, k: Column) -> Column:
        n = F.coalesce(F.get("kept", k + 1), F.size("tokens")) - i
        words = F.transform(F.slice("tokens", i + 1, n), told)
        zero = F.lit(0).cast("long")
        whole = F.aggregate(words, F.struct(zero.alias("total"), zero.alias("now")), joined, lambda a: a["total"] + a["now"])
        return F.when((n > 1) & (F.get("flat", i) == "<number>"), whole.cast("string")).otherwise(F.array_join(words, " "))

    return F.transform("kept", value)


def name_words(benchmark: DataFrame, text: str) -> list[str]:
    """The words of the items' names in lower case: few, as the items are, and part of the plan like their windows."""
    words = benchmark.select(F.explode(tokens(F.col(text))).alias("w")).distinct()
    low = F.lower("w")
    names = words.where(_capital(F.col("w"), low) & ~_is_digits(F.col("w"))).select(low.alias("w")).distinct()
    # what the items also write small is an ordinary word
    return sorted(r["w"] for r in names.join(words.select("w"), "w", "left_anti").collect())


def windows(template: str, length: int) -> Column:
    """Hashes of all windows of `length` tokens of an array column of token hashes."""
    last = F.size(template) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(template, i + k) for k in range(length))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST
) -> DataFrame:
    """id, item_id, n_windows (distinct item windows found), share, at (first template token), kind: `exact`, `partial` or `reparameterised`.

    One row for each document and item it holds.  Every alignment that has the share or the run is a place to
    check, so is every group of neighbouring ones with the share together, and the fullest ones.  Pairs whose
    slots contradict each other at all places (one item value standing for two, or two for one) are left out; of the
    others `at` and `kind` tell an exact place before others, then the fullest, then the first.  A place is exact if all
    tokens of the item stand there, number words and digits being the same; partial if only its slots agree.  Null texts and
    items hold nothing; items of fewer than `least` tokens are not searched; rows that repeat id and text give one
    row; rows with null ids are compared like any other; empty tables give no rows; other columns are not read.
    """
    told = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    names = name_words(told, "text")
    items = templated(told, "text", names).where(F.size("codes") >= least)
    items = staged(items.select("item_id", values().alias("values"), F.transform("kept", lambda i: F.get("flat", i)).alias("kinds"), "codes"), "items")
    # lengths below WINDOW that occur: a few numbers
    lengths = sorted({WINDOW, *(r[0] for r in items.where(F.size("codes") < WINDOW).select(F.size("codes")).distinct().collect())})

    text = F.col(text_col)
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    coded = templated(named, "text", names).select("id", "key", "codes")
    own = F.least(F.size("codes"), F.lit(WINDOW))
    wanted = staged(
        _union(items.where(own == n).select("item_id", F.lit(n).alias("length"), (F.size("codes") - n + 1).alias("n_item"), F.posexplode(windows("codes", n)).alias("item_at", "window")) for n in lengths),
        "item-windows",
    )
    seen = _union(coded.select("id", "key", F.lit(n).alias("length"), F.posexplode(windows("codes", n)).alias("at", "window")) for n in lengths)
    small = wanted.count() <= BROADCAST_WINDOWS
    hits = seen.join(F.broadcast(wanted) if small else wanted, ["window", "length"])
    pair = ["id", "key", "item_id", "n_item", "length"]
    votes = hits.groupBy(*pair, (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set("item_at").alias("found"))
    run = RUN - F.col("length") + 1
    pairs = votes.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("diagonal", F.array_sort("found").alias("found")))).alias("votes"))
    pairs = pairs.withColumns({"n_windows": _covered(F.col("votes")), "fullest": F.array_max(F.transform("votes", lambda v: F.size(v["found"])))})
    pairs = pairs.where((F.col("n_windows") >= SHARE * F.col("n_item")) | (F.col("fullest") >= run))

    def alone(vote: Column) -> Column:
        n = F.size(vote["found"])
        return (n >= SHARE * F.col("n_item")) | (n >= run) | (n == F.col("fullest"))

    apart = lambda i: (i == 0) | (F.get("votes", i)["diagonal"] - F.get("votes", i - 1)["diagonal"] > NEAR)
    pairs = pairs.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("votes") - 1), apart))
    groups = F.transform("starts", lambda s, k: F.slice("votes", s + 1, F.coalesce(F.get("starts", k + 1), F.size("votes")) - s))
    wide = F.filter(groups, lambda g: (F.size(g) > 1) & (_covered(g) >= SHARE * F.col("n_item")))
    places = F.concat(F.transform(F.filter("votes", alone), lambda v: F.array(v)), wide)
    best = pairs.select("id", "key", "item_id", "length", "n_windows", (F.col("n_windows") / F.col("n_item")).alias("share"), places.alias("places"))
    best = staged(best, "template-matches")

    # only matching documents are read again for their words
    matching = named.join(best.select("id", "key").distinct().withColumnsRenamed({"id": "m_id", "key": "m_key"}), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left_semi")
    matching = staged(matching.dropDuplicates(["id", "key"]), "matching-texts")
    doc_values = templated(matching, "text", names).select(F.col("id").alias("d_id"), F.col("key").alias("d_key"), values().alias("doc_values"))
    aligned = best.join(doc_values, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("key") == F.col("d_key"))).join(items.select("item_id", "values", "kinds"), "item_id")

    def slots(vote: Column) -> Column:
        def slot(kind: Column, at: Column) -> Column:
            inside = F.exists(vote["found"], lambda w: (w <= at) & (at < w + F.col("length")))
            item, doc = F.get("values", at), F.get("doc_values", at + vote["diagonal"])
            # a name that runs on into a capitalised neighbour
            doc = F.when((kind == "<name>") & (doc.endswith(F.concat(F.lit(" "), item)) | doc.startswith(F.concat(item, F.lit(" ")))), item).otherwise(doc)
            return F.when(kind.startswith("<") & inside, F.struct(item.alias("item"), doc.alias("doc")))

        return F.filter(F.transform("kinds", slot), lambda x: x.isNotNull())

    def whole(vote: Column) -> Column:
        return (vote["diagonal"] >= 0) & (F.slice("doc_values", F.greatest(vote["diagonal"], F.lit(0)) + 1, F.size("values")) == F.col("values"))

    def seen_at(place: Column) -> Column:
        first = F.array_min(F.transform(place, lambda v: v["diagonal"] + F.array_min(v["found"])))
        return F.struct(F.array_distinct(F.flatten(F.transform(place, slots))).alias("slots"), F.exists(place, whole).alias("whole"), _covered(place).alias("n"), (-first).alias("before"))

    def one_to_one(place: Column) -> Column:
        n = F.size(place["slots"])
        return (F.size(F.array_distinct(place["slots"]["item"])) == n) & (F.size(F.array_distinct(place["slots"]["doc"])) == n)

    def ranked(place: Column) -> Column:
        same = F.forall(place["slots"], lambda x: x["item"] == x["doc"])
        return F.struct(place["whole"].alias("whole"), place["n"].alias("n"), place["before"].alias("before"), same.alias("same"))

    checked = aligned.withColumn("seen", F.transform("places", seen_at)).withColumn("top", F.array_max(F.transform(F.filter("seen", one_to_one), ranked))).where("top is not null")
    kind = F.when(F.col("top.whole"), "exact").when(F.col("top.same"), "partial").otherwise("reparameterised")
    return checked.select("id", "item_id", "n_windows", F.round("share", 6).alias("share"), (-F.col("top.before")).alias("at"), kind.alias("kind"))


def _covered(votes: Column) -> Column:
    """How many distinct item windows an array of (diagonal, found) has."""
    return F.size(F.array_distinct(F.flatten(F.transform(votes, lambda v: v["found"]))))


def _union(frames) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns kept; rows with a null id stay."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("id").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    return docs.join(ids_side(staged(found, "contaminated")), id_col, "left_anti").select(docs.columns)
