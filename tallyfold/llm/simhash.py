"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints are 64-bit SimHashes of 3-word shingles.  Two fingerprints link when they differ in at
most `radius` bits.  The search follows the general pigeonhole principle: the bits are cut into m
groups, and for any thresholds t_1..t_m with sum radius - m + 1 two linked fingerprints differ in at
most t_i bits of some group i.  Correlated bits share a group, and every fingerprint gets its own
thresholds by dynamic programming over estimated candidate counts, so that crowded group values are
probed with a low threshold or (t = -1) not at all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_sized, forget_tables, staged
from .components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLE = 3
BITS = 64
RADIUS = 3


# --- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str | None) -> int:
    """64-bit SimHash; a bit is set if set in over half of the shingle hashes. Null or no words: 0."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        block = words[at : at + 8192 + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(block[k:] for k in range(SHINGLE)))) if n > 1 or len(words) >= SHINGLE else [b" ".join(words)]
        h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_sized(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, fp long")


# --- groups of bits, and thresholds by dynamic programming ------------------------------------------


def bit_pair_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints set bits i and j, over all rows: 64 x 64 numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for pdf in batches:
            h = pdf["fp"].to_numpy(np.int64, na_value=0).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(h, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel()})

    rows = fps.select("fp").mapInPandas(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(pair_counts: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Bits that go together share a group: each group starts with the least used bit's best partner."""
    p = pair_counts / max(n, 1)
    ones = np.diag(p)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    tied = np.abs((p - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, out = set(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        members = [max(sorted(left), key=lambda b: tied[b, sorted(left)].sum())]
        left.discard(members[0])
        while len(members) < size:
            best = max(sorted(left), key=lambda b: tied[b, members].sum())
            members.append(best)
            left.discard(best)
        out.append(sorted(members))
    return out


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that the chosen bits form, the first as its lowest bit."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def pieces(group: list[int]) -> list[list[int]]:
    """At most 11 bits each, so that the histograms have a fixed size."""
    count = -(-len(group) // 11)
    return [group[k::count] for k in range(count)]


def histograms(fps: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Counts of every piece's values over all fingerprints; 2,048 numbers a piece at most."""
    cuts = [(g, k, p) for g, group in enumerate(groups) for k, p in enumerate(pieces(group))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {(g, k): np.zeros(1 << len(p)) for g, k, p in cuts}
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64, na_value=0).view(np.uint64)
            for g, k, p in cuts:
                counts[g, k] += np.bincount(gather(fp, p), minlength=1 << len(p))
        for (g, k), c in counts.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"g": g, "k": k, "value": at, "n": c[at]})

    rows = fps.select("fp").mapInPandas(run, "g int, k int, value int, n double").groupBy("g", "k", "value").agg(F.sum("n").alias("n")).collect()
    out = {(g, k): np.zeros(1 << len(p)) for g, k, p in cuts}
    for r in rows:
        out[r["g"], r["k"]][r["value"]] = r["n"]
    return out


def by_distance(counts: np.ndarray, most: int) -> list[np.ndarray]:
    """For every value, how many fingerprints have a value at distance 0, 1, ... most."""
    width = int(np.log2(len(counts)))
    at = np.arange(len(counts))
    out = []
    for d in range(most + 1):
        masks = [sum(1 << b for b in c) for c in itertools.combinations(range(width), d)]
        out.append(sum((counts[at ^ m] for m in masks), np.zeros(len(counts))))
    return out


def flips(width: int, t: int) -> np.ndarray:
    """All masks of at most t of `width` bits."""
    return np.array([sum(1 << b for b in c) for d in range(t + 1) for c in itertools.combinations(range(width), d)], np.int64)


def allocate(estimates: np.ndarray, probes: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (rows x groups) of least cost that sum to `total`, by dynamic programming.

    estimates[g, t + 1] holds the candidates that each row expects of group g at threshold t, and
    probes[g, t + 1] the number of keys to look up; t = -1 costs nothing.
    """
    groups, levels, n = estimates.shape
    spare = total + groups  # every threshold counts from -1, as 0
    cost = np.full((spare + 1, n), np.inf)
    cost[0] = 0
    picked = np.zeros((groups, spare + 1, n), np.int8)
    for g in range(groups):
        fresh = np.full_like(cost, np.inf)
        for level in range(levels):
            own = estimates[g, level] + probes[g, level]
            for s in range(level, spare + 1):
                c = cost[s - level] + own
                better = c < fresh[s]
                fresh[s][better] = c[better]
                picked[g, s][better] = level
        cost = fresh
    out, s, row = np.zeros((n, groups), np.int8), np.full(n, spare), np.arange(n)
    for g in reversed(range(groups)):
        level = picked[g, s, row]
        out[:, g] = level - 1
        s = s - level
    return out


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (a, b) of different fingerprints in column fp (distinct, not null) within `radius` bits.

    Every fingerprint probes with its own thresholds against the index of all fingerprints, so each
    pair is found from both of its ends; it is returned once.  The number of groups follows from the
    row count so that chance candidates stay below the number of keys looked up.
    """
    n = fps.count()
    m = 3 if n < 1 << 23 else 2
    groups = group_bits(bit_pair_counts(fps), n, m)
    counts = histograms(fps, groups)
    total, top = radius - m + 1, min(radius, 2)
    near = {key: by_distance(c, top) for key, c in counts.items()}
    masks = [[flips(len(g), t) for t in range(top + 1)] for g in groups]

    def expected(fp: np.ndarray) -> np.ndarray:
        est = np.zeros((m, top + 2, len(fp)))
        for g, group in enumerate(groups):
            exact = np.zeros((top + 1, len(fp)))
            exact[0] = n
            for k, piece in enumerate(pieces(group)):
                value = gather(fp, piece)
                share = [d[value] / max(n, 1) for d in near[g, k]]
                exact = np.array([sum(exact[d - e] * share[e] for e in range(d + 1)) for d in range(top + 1)])
            est[g, 1:] = np.cumsum(exact, axis=0)
        return est

    looked_up = np.array([[0, *(len(x) for x in mask)] for mask in masks], float)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                signed = pdf["fp"].to_numpy(np.int64)[at : at + 4096]
                fp = signed.view(np.uint64)
                chosen = allocate(expected(fp), looked_up[:, :, None] * np.ones(len(fp)), total)
                for g, group in enumerate(groups):
                    value = gather(fp, group)
                    for t in range(top + 1):
                        rows = chosen[:, g] == t
                        if rows.any():
                            mask = masks[g][t]
                            key = (value[rows, None] ^ mask) << 2 | g
                            yield pd.DataFrame({"key": key.ravel(), "probe": np.repeat(signed[rows], len(mask))})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signed = pdf["fp"].to_numpy(np.int64)
            for g, group in enumerate(groups):
                yield pd.DataFrame({"key": gather(signed.view(np.uint64), group) << 2 | g, "fp": signed})

    probes = fps.select("fp").mapInPandas(keys, "key long, probe long")
    indexed = fps.select("fp").mapInPandas(index, "key long, fp long")
    close = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= radius
    found = probes.hint("merge").join(indexed, (probes["key"] == indexed["key"]) & close & (F.col("probe") != F.col("fp")))
    return found.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b")).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id, n_links) for every row of `docs`.

    component_id is the smallest id that links of at most `radius` bits reach; n_links counts the other
    fingerprints linked to the row's own.  Null texts and texts without words have fingerprint zero and
    link like any other; rows with a null id take part, and an all-null component has a null id;
    repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    own = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    edges = staged(links(distinct, radius), "fingerprint-links")
    node = connected_components(edges).withColumnRenamed("node", "fp")
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    linked = distinct.join(node, "fp", "left").join(degree, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of = linked.join(smallest, "component").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return own.hint("merge").join(of, "fp").select("id", "fp", "component_id", "n_links")
