"""Token ids in blocks of separately compressed documents with a shared zstandard dictionary.

A store is a folder with two Parquet tables.
- `dictionary`: one row with the zstandard dictionary (empty: none), its sha256, the tokenizer's name and
  the bytes per id.
- `blocks`: a row for each block of consecutive documents in id order: part and seq (their order), the
  documents' ids, offsets (n + 1 positions in the payload), counts (ids per document), the dictionary's
  sha256, and the payload, in which every document is a zstandard frame of its own.  The id columns'
  Parquet statistics lead to the block, the offsets to the frame, so one short document can be read
  without its neighbours.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import SLICE_BYTES, arrow_sized, forget_tables, keeps_tables, shared_dir, shuffle_width, staged, text_slices

END_ID = 0
#: The dictionary is trained on so many documents at most, each with so many bytes of ids at most.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 4096, 64 << 10
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
LEVEL = 3
#: A worker's room: entries of its cache from text chunks to id bytes, in two generations (some 220 bytes each), and bytes of
#: text that are encoded at once (the arrays of a call take some ten times as much).  SMALL is for executors whose heap other
#: stages have grown: less memory, more chunks encoded again.
ROOM, SMALL = (400_000, SLICE_BYTES), (100_000, 1 << 20)
#: The longest chunk that the cache keeps.
LONGEST = 64
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256

_BOUNDARY = re.compile(r"(?<=\S)(?= )")
#: A space after white space of any kind (the pattern library of Arrow has ASCII in \\s alone).
_SPACE_RUN = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}] "
#: Runs that are pre-tokens of byte-level BPE by themselves: Latin letters, digits, marks but apostrophes, a line end between others.
_RUN = "(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++|[0-9]++|[!-&(-/:-@[-`{-~]++)"
_PART = re.compile(f" ?{_RUN}|\n")
_PLAIN = re.compile(f" ?{_RUN}(?:{_RUN}|\n(?=\\S))*+")
_ID = attrgetter("id")
ODD, SPACE, LINE_END, LETTER = range(4)
_workers: dict[str, "Encoder"] = {}


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones of Latin-1 stand for themselves, the others for U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


def byte_classes() -> np.ndarray:
    """Classes of UTF-8 bytes: space, line end, Latin letters (of U+00C0 to U+024F both bytes), digits, marks but apostrophes; else ODD."""
    classes = np.full(256, ODD, np.uint8)
    classes[32], classes[10] = SPACE, LINE_END
    for k, kind in enumerate((rb"[A-Za-z\x80-\xbf\xc3-\xc9]", b"[0-9]", b"[!-&(-/:-@[-`{-~]")):
        classes[[b for b in range(256) if re.match(kind, bytes([b]))]] = LETTER + k
    return classes


_CLASSES = byte_classes()


def plain_parts(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Pieces per text and all pieces of texts in which no space follows white space: cut before spaces and where a run of `_RUN` or a line end ends.

    What stands between two spaces stays whole where it holds other characters than `_RUN` and single line ends between them.
    """
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, kind, len(texts) + 1, texts.offset * kind.itemsize) if len(texts) else np.zeros(1, kind)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(len(texts), np.int64), texts.slice(0, 0)
    some = np.diff(ends) > 0
    first, last = ends[:-1][some], ends[1:][some] - 1
    classes = _CLASSES[raw]
    before, after = np.roll(classes, 1), np.roll(classes, -1)
    before[first], after[last] = ODD, ODD
    odd = classes == ODD
    odd |= (classes <= LINE_END) & (after <= LINE_END)  # white space is cut off alone unless a run follows it
    for lead, follows in ((0xC3, (0x97, 0x97)), (0xC3, (0xB7, 0xB7)), (0xC9, (0x90, 0xBF))):  # signs for times and divided by, letters beyond U+024F
        k = np.flatnonzero(raw[:-1] == lead)
        odd[k[(raw[k + 1] >= follows[0]) & (raw[k + 1] <= follows[1])]] = True
    cut = (classes != before) & (before != SPACE)
    chunk = classes == SPACE
    chunk[first] = True
    cut |= chunk
    starts = np.flatnonzero(cut)
    if odd.any():
        heads = np.flatnonzero(chunk)
        whole = np.zeros(len(heads), bool)
        whole[np.searchsorted(heads, np.flatnonzero(odd), side="right") - 1] = True
        head = chunk[starts]
        starts = starts[head | ~whole[np.cumsum(head) - 1]]
    counts = np.diff(np.searchsorted(starts, ends))
    offsets = np.append(starts, len(raw)).astype(kind)
    return counts, pa.Array.from_buffers(texts.type, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


class Encoder:
    """Texts to ids, two bytes per id if the vocabulary allows, else four.

    Byte-level BPE never merges across a space that follows a non-space character, nor between letters, digits
    and marks.  So texts are cut there by their bytes' classes, the distinct pieces of a batch are found in Arrow, and
    each that is not known yet goes through the tokenizers library once; other kinds of tokenizers get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        before = self.tokenizer.pre_tokenizer
        self.cuts = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark_text = added[0] if added else None
        self.mark = self.tokenizer.token_to_id(self.mark_text) if added else None
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile("(?!)")
        self.added_texts = added
        self.model = self.tokenizer.model if isinstance(self.tokenizer.model, models.BPE) else None
        # no added token lies within a part
        self.single = not any(not x.strip() or _PART.fullmatch(x) for x in added)
        letters = byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], "<u2")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @classmethod
    def here(cls, path: str) -> "Encoder":
        if path not in _workers:
            _workers[path] = cls(path)
            keeps_tables(_workers[path].forget)
        return _workers[path]

    def _lettered(self, parts: list[str]) -> list[str]:
        """Parts in byte-level BPE's letters."""
        raw = np.frombuffer("\0".join(parts).encode(), np.uint8)
        return self.letters[raw].tobytes().decode("utf-16-le").split(chr(self.letters[0]))

    def forget(self) -> None:
        self.known, self.before = {}, {}

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces and keep them: pre-tokens by the model alone, others many at once with an added token between them."""
        known, before, dtype, rest, single = self.known, self.before, self.dtype, pieces, []
        if self.model is not None:
            part, plain, parts, added, rest = _PART.fullmatch, _PLAIN.fullmatch, _PART.findall, self.added.search, []
            several: list[tuple[str, list[str]]] = []
            for x in pieces:
                if self.single and (x.isascii() and x.removeprefix(" ").isalpha() or part(x)):
                    single.append(x)
                elif not plain(x) or added(x):
                    rest.append(x)
                else:
                    several.append((x, parts(x)))
            new = dict.fromkeys(x for _, own in several for x in own if x not in known)
            known.update((x, before[x]) for x in new if x in before)
            single += [x for x in new if x not in known]
            for k in range(0, len(single), 1024):
                some = single[k : k + 1024]
                found = list(map(self.model.tokenize, self._lettered(some)))
                raw = np.fromiter(map(_ID, chain.from_iterable(found)), dtype).tobytes()
                ends = (dtype.itemsize * np.cumsum(list(map(len, found)))).tolist()
                known.update(zip(some, (raw[i:j] for i, j in zip([0, *ends], ends))))
            for x, own in several:
                known[x] = b"".join(map(known.__getitem__, own))
        joined = [x for x in rest if self.mark is not None and not self.added.search(x)]
        for x in set(rest).difference(joined):
            known[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype).tobytes()
        for k in range(0, len(joined), 1024):
            some = joined[k : k + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark_text.join(some)], add_special_tokens=False)[0].ids, dtype)
            cut, raw = (dtype.itemsize * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
            known.update(zip(some, (raw[i:j] for i, j in zip([0, *(c + dtype.itemsize for c in cut)], [*cut, len(raw)]))))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Pieces per text, each piece's place in the list of distinct ones, and that list."""
        # texts that are only cut at spaces, as a space may follow white space or an added token be in them
        marked = [pa.compute.match_substring_regex(texts, _SPACE_RUN), *(pa.compute.match_substring(texts, x) for x in self.added_texts)]
        odd = np.any([x.to_numpy(zero_copy_only=False) for x in marked], axis=0)
        counts, parts = plain_parts(texts.filter(pa.array(~odd)) if odd.any() else texts)
        coded = parts.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if odd.any():
            place: dict[str, int] = {}
            cut = [[place.setdefault(x, len(distinct) + len(place)) for x in _BOUNDARY.split(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
            every = np.zeros(len(texts), np.int64)
            every[~odd], every[odd] = counts, [len(x) for x in cut]
            from_odd = np.repeat(odd, every)
            both = np.zeros(len(from_odd), np.int64)
            both[~from_odd], both[from_odd] = codes, [k for x in cut for k in x]
            counts, codes, distinct = every, both, [*distinct, *place]
        return counts, codes, distinct

    def encode(self, texts: pa.Array, cache: int = ROOM[0]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; `cache` is how many chunks stay known."""
        if not self.cuts:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.array(x, self.dtype) for x in ids] or [np.zeros(0, self.dtype)]), np.array([len(x) for x in ids], np.int64)
        if len(self.known) > cache // 2:  # what the last generation holds and is used again moves on
            self.before, self.known = self.known, {}
        counts, codes, distinct = self._pieces(texts)
        found = list(map(self.known.get, distinct))
        holes = [k for k, x in enumerate(found) if x is None]
        missing = [distinct[k] for k in holes]
        again = list(map(self.before.get, missing))
        self.known.update((x, ids) for x, ids in zip(missing, again) if ids is not None)
        self._learn([x for x, ids in zip(missing, again) if ids is None])
        for k, ids in zip(holes, map(self.known.__getitem__, missing)):
            found[k] = ids
        for x in missing:
            if len(x) > LONGEST:
                self.known.pop(x, None)
        # texts' ids one after another: the bytes that lie in an array of all pieces' ids
        every = pa.array(found, pa.large_binary()).take(pa.array(codes))
        _, at, raw = every.buffers()
        ends = np.frombuffer(at, np.int64, len(every) + 1) // self.dtype.itemsize
        ids = np.frombuffer(raw or b"", self.dtype, int(ends[-1]))
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def ids_width(path: str) -> int:
    return Encoder.here(path).dtype.itemsize


def document_ids(batches: Iterator[pa.RecordBatch], path: str, text_at: int, room: tuple[int, int] = ROOM) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with the ids' bytes of every whole text, the end id included."""
    encoder = Encoder.here(path)
    for batch in batches:
        for at, n in text_slices(batch.column(text_at), room[1]):
            part = batch.slice(at, n)
            ids, counts = encoder.encode(part.column(text_at).fill_null(""), room[0])
            ends = np.cumsum(counts)
            raw = np.insert(ids, ends, END_ID).tobytes()
            offsets = (np.concatenate([[0], ends + np.arange(1, n + 1)]) * encoder.dtype.itemsize).tolist()
            yield part, [raw[i:j] for i, j in zip(offsets, offsets[1:])]
    pa.default_memory_pool().release_unused()  # the worker lives on, for other stages


def train_dictionary(docs: DataFrame, path: str, room: tuple[int, int] = ROOM) -> bytes:
    """A dictionary from the ids of a bounded sample of documents; empty if there is too little to learn from."""
    drawn = docs.select("id").where("id is not null").orderBy(F.xxhash64(F.lit("dictionary"), "id")).limit(SAMPLE_DOCS).collect()
    if not drawn:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in document_ids(batches, path, 0, room):
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in ids], pa.binary())], names=["x"])

    sample = arrow_sized(docs).where(F.col("id").isin([r["id"] for r in drawn])).select("text").mapInArrow(run, "x binary")
    samples = [bytes(r["x"]) for r in sample.limit(SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # fewer or shorter samples than the trainer accepts
        return b""


def write_store(docs: DataFrame, store: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", order: Column | None = None, room: tuple[int, int] = ROOM) -> None:
    """Encode and write all rows of `docs` in ascending order of a number (default: the id), nulls first; the files do not depend on `room`."""
    spark = docs.sparkSession
    width = ids_width(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), (F.col(id_col) if order is None else order).cast("double").alias("at"), F.col(text_col).alias("text"))
    trained = train_dictionary(rows, tokenizer, room)
    digest = hashlib.sha256(trained).hexdigest()
    row = [(trained, digest, tokenizer.rpartition("/")[2], width)]
    spark.createDataFrame(row, "dictionary binary, sha256 string, tokenizer string, id_bytes int").coalesce(1).write.parquet(f"{store}/dictionary")

    kind = docs.schema[id_col].dataType.simpleString()

    buckets = max(LEAST_BUCKETS, -(-rows.select("id").count() // BUCKET_ROWS))
    # quantiles of the order: one number a bucket
    at = [k / buckets for k in range(1, buckets)]
    edges = np.array(sorted(set(rows.select(F.percentile_approx("at", at, 20 * buckets)).first()[0] or [])), np.float64)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for part, ids in document_ids(batches, tokenizer, 2, room):
            place = part.column(1).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            bucket = pa.array(np.searchsorted(edges, place, side="left").astype(np.int32))
            counts = pa.array([len(x) // width for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([bucket, *part.columns[:2], counts, pa.array(map(frames.compress, ids), pa.binary())], names=["bucket", "id", "at", "n", "frame"])

    frames = arrow_sized(rows).mapInArrow(compress, f"bucket int, id {kind}, at double, n long, frame binary")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        seq, held, size, bucket = 0, [], 0, None

        def block() -> pd.DataFrame:
            offsets = np.concatenate([[0], np.cumsum([len(f) for _, _, f in held])])
            return pd.DataFrame({
                "part": [bucket], "seq": [seq], "ids": [[i for i, _, _ in held]], "offsets": [offsets.tolist()],
                "counts": [[n for _, n, _ in held]], "dictionary": [digest], "payload": [b"".join(f for _, _, f in held)],
            })

        for pdf in batches:
            for b, i, n, f in zip(pdf["bucket"], pdf["id"], pdf["n"], pdf["frame"]):
                if held and (b != bucket or size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS):
                    yield block()
                    held, size, seq = [], 0, seq + 1 if b == bucket else 0
                bucket = int(b)
                held.append((None if pd.isna(i) else i, n, f))
                size += len(f)
        if held:
            yield block()

    dealt = frames.repartition(shuffle_width(spark), "bucket").sortWithinPartitions("bucket", F.col("at").asc_nulls_first(), "id", "n", "frame")
    fields = f"part int, seq int, ids array<{kind}>, offsets array<long>, counts array<long>, dictionary string, payload binary"
    dealt.select("bucket", "id", "n", "frame").mapInPandas(pack, fields).write.option("compression", "uncompressed").parquet(f"{store}/blocks")


def _documents(spark: SparkSession, store: str, fields: str, values) -> DataFrame:
    """id, part, seq, rank (in the block) and n of every document, and what `values` makes of its ids' bytes, read from the files."""
    head = spark.read.parquet(f"{store}/dictionary").first()
    trained, digest = bytes(head["dictionary"]), head["sha256"]
    if hashlib.sha256(trained).hexdigest() != digest:
        raise ValueError("the dictionary does not have its hash")
    blocks = arrow_sized(spark.read.parquet(f"{store}/blocks"))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row["dictionary"].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                o, n, payload, ids, counts = row["offsets"].as_py(), len(row["ids"]), memoryview(row["payload"].as_buffer()), row["ids"].values, row["counts"].values
                for at in range(0, n, 256):
                    m = min(n, at + 256) - at
                    place = [pa.array([row["part"].as_py()] * m, pa.int32()), pa.array([row["seq"].as_py()] * m, pa.int32()), pa.array(range(at, at + m), pa.int32())]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, m), *place, counts.slice(at, m), values([frames.decompress(payload[o[j] : o[j + 1]]) for j in range(at, at + m)])],
                        names=["id", "part", "seq", "rank", "n", "value"],
                    )

    return blocks.mapInArrow(run, f"id {kind}, part int, seq int, rank int, n long, value {fields}")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """id, part, seq, rank (in the block), n and the ids' bytes of every document, decompressed from the files."""
    return _documents(spark, store, "binary", lambda ids: pa.array(ids, pa.binary())).withColumnRenamed("value", "ids")


def read_document(spark: SparkSession, store: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document: one block's index is read, one frame is decompressed."""
    head = spark.read.parquet(f"{store}/dictionary").first()
    row = spark.read.parquet(f"{store}/blocks").where(F.array_contains("ids", doc_id)).limit(1).collect()
    if not row:
        return None
    k = row[0]["ids"].index(doc_id)
    frame = bytes(row[0]["payload"])[row[0]["offsets"][k] : row[0]["offsets"][k + 1]]
    trained = bytes(head["dictionary"])
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    return np.frombuffer(frames.decompress(frame), "<u2" if head["id_bytes"] == 2 else "<u4")


def token_index(spark: SparkSession, store: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and the CRC of the ids as 32-bit numbers, read from the files."""
    width = spark.read.parquet(f"{store}/dictionary").select("id_bytes").first()[0]

    def crc(ids: list[bytes]) -> pa.Array:
        return pa.array([zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in ids], pa.int64())

    read = _documents(spark, store, "long", crc).withColumnsRenamed({"n": "n_tokens", "value": "ids_crc32"})
    read = staged(read, "token-index")
    before = W.Window.partitionBy("part").orderBy("seq", "rank").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = read.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # one row for each bucket of ids, BUCKET_ROWS documents
    parts = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return inside.join(starts, "part").select("id", (F.col("_start") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", store: str | None = None, order: Column | None = None, room: tuple[int, int] = ROOM) -> DataFrame:
    """Write the store (by default a new one in the shared folder) and return `token_index` of it.

    Documents are stored by ascending id, or by `order`, a number below 2**53 for each row.  `room` is what a worker may keep (ROOM, SMALL).

    Null texts are encoded as empty: the end id alone.  Null ids come first; rows that repeat an id are
    stored one after another; an empty table gives an empty store; other columns are not read.
    """
    store = store or f"{shared_dir(docs.sparkSession)}/tallyfold/tokens-{uuid.uuid4().hex}"
    write_store(docs, store, tokenizer, id_col, text_col, order, room)
    return token_index(docs.sparkSession, store)
