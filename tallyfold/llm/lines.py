"""Near-duplicate lines by a segment-partition edit join.

How many edits two lines may differ by follows from the length of the shorter (ALLOWED).  Distinct lines are cut into
one segment more than the edits that they may have.  If two lines are within these edits, one segment of the
shorter occurs unchanged in the longer, near its own place; so every line probes the segment index, for its own
length and those that many edits less, with the substrings that can hold such a segment.  Character and bigram parities thin out the pairs inside the join, and the rest is
verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_sized, staged
from .components import connected_components

#: Lines of so many characters and more may differ by so many edits, by the length of the shorter; under the first equal lines only.
ALLOWED = ((12, 1), (24, 2))
#: So many candidate lines at most are broadcast (8 bytes each) to pick their texts; more are shuffled.
BROADCAST_LINES = 500_000


def edits(length: int, allowed: tuple[tuple[int, int], ...] = ALLOWED) -> int:
    return max((n for shortest, n in allowed if length >= shortest), default=0)


def cuts(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the segments: even, the longer ones last."""
    parts = most + 1
    small, longer = divmod(length, parts)
    sizes = [small] * (parts - longer) + [small + 1] * longer
    return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


def probes(length: int, indexed: int, most: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of the substrings of a line of `length` that can hold a segment of an indexed length.

    The position filter from both ends: the k-th segment (from 0) may be shifted by k edits at most from
    the left and by most - k from the right.
    """
    gap, out = length - indexed, []
    for k, (at, n) in enumerate(cuts(indexed, most)):
        first = max(0, at - k, at + gap - (most - k))
        last = min(length - n, at + k, at + gap + (most - k))
        out += [(k, s, n) for s in range(first, last + 1)]
    return out


def parities(codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n lines 32 parities of hashed characters, then 32 of hashed bigrams; codes[i] belongs to line of[i].

    An edit changes at most 2 of the first and 4 of the second.
    """
    c = codes.astype(np.uint64)
    pair = c[:-1] * np.uint64(0x9E3779B1) + c[1:] * np.uint64(0x85EBCA77)
    one = np.bincount(of * 32 + (c * np.uint64(0x9E3779B1) >> np.uint64(7) & np.uint64(31)).astype(np.int64), minlength=32 * n)
    within = of[1:] == of[:-1]
    two = np.bincount((of[1:] * 32 + (pair >> np.uint64(11) & np.uint64(31)).astype(np.int64))[within], minlength=32 * n)
    bits = np.concatenate([one.reshape(n, 32), two.reshape(n, 32)], axis=1) & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most `most`, else None.

    Common ends are cut off; the rest runs through bit vectors over a band of diagonals that moves down
    one row with every column (Hyyro's banded form of Myers' algorithm).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    j = 0
    while j < len(b) - k and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[k : len(a) - j], b[k : len(b) - j]
    if not b:
        return len(a)
    if len(a) <= most:
        return _small(a, b, most)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    width = 2 * most + 2
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    up, down, score, row = mask ^ ((1 << (width - most - 1)) - 1), 0, most, most + 1 - width
    level = bottom >> 1
    for i, c in enumerate(b):
        same = places.get(c, 0)
        same = (same >> row if row >= 0 else same << -row) & mask
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right, left = (down | ~(diagonal | up)) & mask, diagonal & up
        if i < len(a) - most:
            score += not diagonal & bottom
        else:
            score += bool(right & level) - bool(left & level)
            level >>= 1
        up, down = (left | ~(diagonal >> 1 | right)) & mask, (diagonal >> 1) & right
        row += 1
        if score > 2 * most + 1:
            return None
    return score if score <= most else None


def _small(a: str, b: str, most: int) -> int | None:
    """The plain table, for what is left of at most `most` characters."""
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1] if above[-1] <= most else None


def _identity(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(raw, 0)).astype(np.int64))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list]]:
    """For each batch: line text -> [first (doc, number), count]; lines in order of first sight."""
    for batch in batches:
        seen: dict[str, list] = {}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for number, line in enumerate((text.as_py() or "").split("\n")):
                if line.strip():
                    if (held := seen.get(line)) is None:
                        seen[line] = [doc, number, 1]
                    else:
                        held[2] += 1
                        if (doc is None and held[0] is not None) or (doc is not None and held[0] is not None and (doc, number) < (held[0], held[1])):
                            held[0], held[1] = doc, number
        yield seen


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for seen in _distinct(batches):
        first = list(seen.values())
        yield pa.RecordBatch.from_pydict({
            "line": pa.array([_identity(x.encode()) for x in seen], pa.int64()), "doc": pa.array([f[0] for f in first], pa.int64()),
            "number": pa.array([f[1] for f in first], pa.int64()), "copies": pa.array([f[2] for f in first], pa.int64()),
        })


def _keys(allowed: tuple[tuple[int, int], ...]):
    """line, sign (its parities), own and keys of the distinct lines of each batch: `own` index keys, then the probes."""
    shortest, most = min(n for n, _ in allowed), max(m for _, m in allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        plans: dict[int, list] = {}
        for seen in _distinct(batches):
            long = [t for t in seen if len(t) >= shortest]
            for k in range(0, len(long), 512):
                some = long[k : k + 512]
                sizes = np.array([len(t) for t in some])
                wide = "".join(some).encode("utf-32-le", "surrogatepass")
                signs = parities(np.frombuffer(wide, "<u4"), np.repeat(np.arange(len(some)), sizes), len(some))
                keys, ends, base = [], [0], 0
                for n in sizes.tolist():
                    if n not in plans:
                        own = [(j, n, at, size) for j, (at, size) in enumerate(cuts(n, edits(n, allowed)))]
                        near = [n - g for g in range(most + 1) if n - g >= shortest and g <= edits(n - g, allowed)]
                        own += [(j, m, at, size) for m in near for j, at, size in probes(n, m, edits(m, allowed))]
                        plans[n] = [(4 * at, 4 * (at + size), indexed * (most + 1) + j) for j, indexed, at, size in own]
                    keys += [digest(wide[base + i : base + j], seed) for i, j, seed in plans[n]]
                    ends.append(len(keys))
                    base += 4 * n
                flat = pa.array(np.array(keys, np.uint64).view(np.int64))
                lines = pa.array([_identity(t.encode()) for t in some], pa.int64())
                owns = pa.array([edits(n, allowed) + 1 for n in sizes.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([lines, pa.array(signs), owns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["line", "sign", "own", "keys"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for seen in _distinct(batches):
        texts = list(seen)
        yield pa.RecordBatch.from_pydict({"line": pa.array([_identity(x.encode()) for x in texts], pa.int64()), "text": pa.array(texts, pa.string())})


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[tuple[int, int], ...] = ALLOWED) -> DataFrame:
    """(a, b, distance): all pairs of different lines within the allowed edits, by their 64-bit identities, each pair once."""
    most = max(m for _, m in allowed)
    named = arrow_sized(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    seen = named.mapInArrow(_keys(allowed), "line long, sign long, own int, keys array<long>")
    lines = seen.groupBy("line").agg(F.first("sign").alias("sign"), F.first("own").alias("own"), F.first("keys").alias("keys"))
    index = lines.select(F.explode(F.slice("keys", F.lit(1), F.col("own"))).alias("key"), F.col("line").alias("a"), F.col("sign").alias("sign_a"))
    probe = lines.select(F.explode(F.slice("keys", F.col("own") + 1, F.size("keys"))).alias("key"), F.col("line").alias("b"), "sign")
    apart = F.col("sign").bitwiseXOR(F.col("sign_a"))
    low = F.lit((1 << 32) - 1)
    near = (F.col("a") != F.col("b")) & (F.bit_count(apart.bitwiseAND(low)) <= 2 * most) & (F.bit_count(F.shiftrightunsigned(apart, 32)) <= 4 * most)
    met = probe.hint("merge").join(index, (probe["key"] == index["key"]) & near)
    pairs = staged(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-candidates")
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "candidate-lines")
    few = wanted.count() <= BROADCAST_LINES
    texts = named.select("doc", "text").mapInArrow(_texts, "line long, text string")
    texts = staged(texts.join(F.broadcast(wanted) if few else wanted, "line", "left_semi").dropDuplicates(["line"]), "line-texts")
    both = pairs.join(texts.withColumnsRenamed({"line": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"line": "b", "text": "text_b"}), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [edit_distance(x, y, edits(min(len(x), len(y)), allowed)) for x, y in zip(pdf["text_a"], pdf["text_b"])]
            pdf = pdf[["a", "b"]].assign(distance=pd.array(found, "Int32"))
            yield pdf[pdf["distance"].notna()]

    return both.mapInPandas(verify, "a long, b long, distance int")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[tuple[int, int], ...] = ALLOWED) -> DataFrame:
    """A row for each distinct line: where it first stands, its copies, links and class.

    doc_id and line_no (from 0) are the first occurrence by id, then number; class_doc_id and class_line_no
    are the first occurrence in the class of lines that links reach.  Lines are split at \\n and compared
    as they are; blank ones are left out, and lines under the first length of `allowed` only equal themselves.
    Ids are integers, or strings of digits.  Null texts have no lines; rows with a null id come first; rows that repeat count as copies; an empty
    table gives no rows; other columns are not read. Lines are told apart by 64-bit hashes.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    seen = named.mapInArrow(_occurrences, "line long, doc long, number long, copies long")
    lines = staged(seen.groupBy("line").agg(F.min(F.struct("doc", "number")).alias("first"), F.sum("copies").alias("n_copies")), "lines")
    links = staged(line_links(docs, id_col, text_col, allowed), "line-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("line")).groupBy("line").agg(F.count("*").alias("n_links"))
    node = connected_components(links).withColumnRenamed("node", "line")
    linked = lines.join(node, "line").select("line", "component", "first")
    classes = linked.groupBy("component").agg(F.min("first").alias("class_first"))
    of = linked.join(classes, "component").select("line", "class_first")
    out = lines.join(of, "line", "left").join(degree, "line", "left")
    home = F.coalesce("class_first", "first")
    return out.select(
        F.col("first.doc").alias("doc_id"), F.col("first.number").alias("line_no"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), home["doc"].alias("class_doc_id"), home["number"].alias("class_line_no")
    )
