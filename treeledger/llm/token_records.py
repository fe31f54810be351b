"""Token ids as length-delimited binary records, with an offset index beside them.

A file is a run of records. A record frames one serialized sequence:

    length        8 bytes, little-endian, of the payload
    check         4 bytes, masked CRC-32 of the 8 length bytes
    payload
    check         4 bytes, masked CRC-32 of the payload

A payload is the key's length (4 bytes, 2**32 - 1 for a null key), the key as UTF-8, the width of an id in bytes (2 where
the vocabulary allows it, else 4) and the ids, little-endian. A mask (rotate by 15 bits, add a constant) keeps a check
from being the CRC of data that holds checks itself.

``write_records`` deals the texts by range of key, so that every task writes a stretch of the order into files of its own
and no task or driver sees more than a stretch. A task tells of its records only in the rows of the index, which Spark
commits: what a lost or repeated attempt has written is named by no index row and is never read. ``read_records`` goes
through the index, checks both frames of every record, and reads any subset in any order (``shuffled``).

Texts are cut where the pre-tokenizer of a byte-level model cuts in any case: before white space that follows a sign which
is certainly no white space, between letters, digits and punctuation, and after a lone line feed. A batch of texts is cut in
one go, by the kinds of its bytes; of equal pieces one is looked up, and encoded where it is new; a text with one of the
tokenizer's added tokens, and every tokenizer of another kind, is encoded whole.

Cases: a null text counts as empty and yields the end id alone; a null key comes first and is read back as null; repeated
keys stay rows of their own, ordered by a hash of the text; equal rows are interchangeable; an empty table gives no
files, an empty index and no rows; texts of any length are encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, few, map_rows, materialize, shared_dir

END_ID = 0
#: A file is closed once it holds so many bytes.
FILE_BYTES = 64 << 20
#: Pieces that a process remembers, the longest that it does (in bytes), and those that are encoded as one text.
PIECES, PIECE_BYTES, JOINED = 1_000_000, 40, 2000
#: Bytes of text that are cut at once, if a text is no longer, and pieces that are looked up at once.
SLICE, AT_ONCE = 4 << 20, 1 << 20
_NULL = 0xFFFFFFFF
_MASK = 0xA282EAD8
INDEX = "file string, part int, roll int, position long, key string, offset long, length long, n_tokens long, before long"
READ = "file string, position long, start long, key string, n_tokens long, ids_crc32 long, ids binary"

#: Signs that are no white space by any version of Unicode.
_SOLID = "!-~À-ɏͰ-ԯぁ-鿿"
_IS_SOLID = re.compile(rf"[{_SOLID}]")
#: The cuts before blanks and line feeds as a pattern; a text is cut at all of them, and at others.
_PIECE = re.compile(rf"(?s).(?:[^ \n]|(?<![{_SOLID}])[ \n])*")

#: Kinds of signs. Nothing is known of OTHER; DENSE is certainly no white space.
_OTHER, _BLANK, _SPACE, _QUOTE, _SIGN, _DIGIT, _LETTER, _DENSE = range(8)


def _kinds() -> np.ndarray:
    """The kind of a sign by the first byte of its UTF-8."""
    k = np.full(256, _OTHER, np.uint8)
    k[0x21:0x7F], k[0x20], k[0x09:0x0E], k[0x27] = _SIGN, _BLANK, _SPACE, _QUOTE
    k[0x30:0x3A], k[0x41:0x5B], k[0x61:0x7B] = _DIGIT, _LETTER, _LETTER
    k[0xC3:0xF5] = _DENSE  # neither blank nor line feed by any version of Unicode, maybe punctuation
    k[[0xE1, 0xE2, 0xEF]] = _OTHER  # U+1680, U+2000 and others are white space
    k[0xC3:0xC9] = k[0xD0:0xD2] = _LETTER  # U+00C0 to U+023F (but for U+00D7 and U+00F7), U+0400 to U+047F
    return k


def _pairs() -> np.ndarray:
    """Whether the pre-tokenizer cuts between signs of two kinds, by 8 * first + second. An apostrophe and the letters
    after it may be one word."""
    cut = np.zeros((8, 8), bool)
    cut[_QUOTE:, [_BLANK, _SPACE]] = True
    cut[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = cut[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = True
    cut[_SIGN, [_LETTER, _DIGIT]] = cut[_QUOTE, _DIGIT] = True
    return cut.ravel()


_KINDS, _CUTS = _kinds(), _pairs()


def cuts(raw: np.ndarray) -> np.ndarray:
    """For every byte of a UTF-8 text, whether the pre-tokenizer certainly cuts before it."""
    kind = _KINDS[raw]
    wide = np.flatnonzero(raw >= 0x80)
    if len(wide):
        first, second = raw[wide], raw[np.minimum(wide + 1, len(raw) - 1)]
        found = kind[wide]
        found[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))] = _DENSE
        found[(first == 0xE3) & (second == 0x80)] = _OTHER
        kind[wide] = found[np.maximum.accumulate(np.where(first >= 0xC0, np.arange(len(wide)), 0))]
    cut = np.empty(len(raw), bool)
    cut[:1] = True
    cut[1:] = _CUTS[(kind[:-1] << 3) | kind[1:]]
    at = np.flatnonzero(kind[1:-1] == _SPACE) + 1
    cut[at[(kind[at - 1] >= _QUOTE) & (kind[at + 1] >= _QUOTE)] + 1] = True
    return cut


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one record; what doesn't fit its checks is an error."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked(data[:8]):
        raise ValueError("the length of a record is broken")
    (n,) = struct.unpack_from("<Q", data, 0)
    payload = data[12 : 12 + n]
    if len(data) != n + 16 or struct.unpack_from("<I", data, 12 + n)[0] != masked(payload):
        raise ValueError("the payload of a record is broken")
    return payload


def serialize(key: str | None, ids: np.ndarray, width: int) -> bytes:
    head = struct.pack("<I", _NULL) if key is None else struct.pack("<I", len(k := key.encode())) + k
    return head + bytes([width]) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> tuple[str | None, np.ndarray]:
    (n,) = struct.unpack_from("<I", payload, 0)
    at = 4 if n == _NULL else 4 + n
    key = None if n == _NULL else payload[4:at].decode()
    return key, np.frombuffer(payload, f"<u{payload[at]}", offset=at + 1)


def _solid(sign: str) -> bool:
    return "!" <= sign <= "~" or _IS_SOLID.match(sign) is not None


class Encoder:
    """Ids of whole texts by a tokenizer's file, as little-endian integers of width bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        pre = getattr(self.tok.pre_tokenizer, "__class__", type(None)).__name__
        self.cut = pre == "ByteLevel" and self.tok.normalizer is None and not self.tok.pre_tokenizer.add_prefix_space
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        size = self.tok.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        # a byte-level token has a sign for every byte
        self.bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(size)], np.int64)
        self._clear()

    def _clear(self) -> None:
        # places of the pieces, where the ids of each end, and all ids
        self.known: dict[bytes, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, f"<u{self.width}")

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], whole: bool) -> None:
        """Encode new pieces and put them behind the others. Added tokens may be in them where there are whole texts."""
        # what can stand in a text with others: pieces with a blank in front, and those that a line feed can be put before
        after, apart, rest = [], [], []
        for p in pieces:
            joins = (0x20 < p[-1] < 0x7F or _solid(p.decode()[-1])) and not (whole and any(a.encode() in p for a in self.added))
            (after if joins and p[0] == 0x20 else apart if joins and _solid(p.decode()[0]) else rest).append(p)
        found = [self._encode_apart(rest)]
        for some, feed in ((after, b""), (apart, b"\n")):
            found += [self._encode_joined(some[at : at + JOINED], feed) for at in range(0, len(some), JOINED)]
        n = len(self.known)
        self.known.update(zip(rest + after + apart, range(n, n + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([sizes for _, sizes in found]))])

    def _encode_apart(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many are in each."""
        coded = self._raw([p.decode() for p in pieces])
        return np.frombuffer(b"".join(coded), self.ids.dtype), np.array([len(x) // self.width for x in coded], np.int64)

    def _encode_joined(self, pieces: list[bytes], feed: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As _encode_apart, with the pieces in one text, each after a feed; where one ends among the ids, their bytes tell."""
        (coded,) = self._raw([(feed + feed.join(pieces)).decode()])
        ids = np.frombuffer(coded, self.ids.dtype)
        sizes = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(feed))
        ends = np.cumsum(self.bytes[ids])
        stops = np.searchsorted(ends, sizes) + 1
        if stops[-1] > len(ids) or (ends[stops - 1] != sizes).any():  # a model that drops bytes
            return self._encode_apart(pieces)
        counts = np.diff(stops, prepend=0)
        if feed:
            ids, counts = np.delete(ids, stops - counts), counts - 1
        return ids, counts

    def batch(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of an array of texts without nulls."""
        if not self.cut:
            return self._raw(texts.to_pylist())
        texts = texts.cast(pa.binary())
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        begin, end = int(bounds[0]), int(bounds[-1])
        if begin == end:
            return [b""] * len(texts)
        cut = cuts(np.frombuffer(data, np.uint8)[begin:end])
        whole = [k for a in self.added for k in np.flatnonzero(pc.match_substring(texts, a).to_numpy(zero_copy_only=False))]
        for k in whole:
            cut[bounds[k] - begin : bounds[k + 1] - begin] = False
        cut[bounds[:-1][np.diff(bounds) > 0] - begin] = True
        starts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts + begin, end).astype(np.int32)), data])
        counts, found = [], []
        for k in range(0, len(starts), AT_ONCE):
            some = pieces.slice(k, AT_ONCE).dictionary_encode()
            at = self._places(some.dictionary.to_numpy(zero_copy_only=False).tolist(), bool(whole))[some.indices.to_numpy()]
            sizes = np.diff(self.ends)[at]
            shift = self.ends[at] - np.cumsum(sizes) + sizes
            found.append(self.ids[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes())
            counts.append(sizes.astype(np.int32))
            self._forget()
        ids, stops = b"".join(found), np.cumsum(np.concatenate([[0], *counts]))
        rows = (stops[np.searchsorted(starts, bounds - begin)] * self.width).tolist()
        return list(map(ids.__getitem__, map(slice, rows, rows[1:])))

    def _places(self, pieces: list[bytes], whole: bool) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        # those that are not to be remembered come last
        self.long = [p for p in new if len(p) > PIECE_BYTES]
        self._learn([p for p in new if len(p) <= PIECE_BYTES], whole)
        self.short = len(self.known)
        self._learn(self.long, whole)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _forget(self) -> None:
        for p in self.long:
            del self.known[p]
        self.ends = self.ends[: self.short + 1]
        self.ids = self.ids[: self.ends[-1]]
        if len(self.known) > PIECES:
            self._clear()


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a process: Spark's workers live on from task to task, and with them the words they have learned."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Writer:
    """The files of one attempt of one task."""

    def __init__(self, folder: str, part: int, file_bytes: int):
        self.fs, self.folder = _filesystem(folder)
        self.part, self.file_bytes, self.roll, self.out = part, file_bytes, -1, None
        self.attempt = uuid.uuid4().hex[:12]

    def add(self, key: str | None, ids: np.ndarray, width: int) -> tuple:
        if self.out is None:
            self.roll += 1
            self.name = f"part-{self.part:06d}-{self.roll:04d}-{self.attempt}.rec"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}")
            self.offset = self.position = self.before = 0
        data = frame(serialize(key, ids, width))
        self.out.write(data)
        row = (self.name, self.part, self.roll, self.position, key, self.offset, len(data), len(ids), self.before)
        self.offset, self.position, self.before = self.offset + len(data), self.position + 1, self.before + len(ids)
        if self.offset >= self.file_bytes:
            self.close()
        return row

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_records(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of docs into folder, which all executors must see, and return their index. The index is itself
    a table in the shared folder: only what it names has been written."""
    spark = docs.sparkSession
    scheme = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    where = spark._jvm.org.apache.hadoop.fs.Path(scheme)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    rows = docs.select(F.col(id_col).alias("key"), as_text(F.col(text_col)).alias("text"))
    # a key that many rows share is split by its texts, equal rows by the part of the table that they come from
    tie = [F.xxhash64("text").alias("h"), F.spark_partition_id().alias("from")]
    rows = rows.select("key", "text", *tie).repartitionByRange("key", "h", "from").sortWithinPartitions("key", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(tokenizer), None
        names = [c.split()[0] for c in INDEX.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in INDEX.split(", ")]
        try:
            for b in batches:
                writer = writer or _Writer(folder, TaskContext.get().partitionId(), file_bytes)
                found, size = [], max(1, b.num_rows)
                step = max(1, min(size, size * SLICE // max(1, b.nbytes)))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    coded = encoder.encode(part.column(1))
                    end = np.array([end_id], f"<u{encoder.width}")
                    for key, x in zip(part.column(0).to_pylist(), coded, strict=True):
                        found.append(writer.add(key, np.frombuffer(x + end.tobytes(), end.dtype), encoder.width))
                if found:
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        finally:
            if writer is not None:
                writer.close()

    narrow = rows.select(F.col("key").cast("string").alias("key"), "text")
    return materialize(narrow.mapInArrow(run, INDEX), "token-index", keep=True)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start: ids in all records before each, in the order written. Sums a file come first; only the files
    are put in a row, not the records."""
    files = index.groupBy("part", "roll", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    rows = index.join(F.broadcast(files) if few(files) else files, "file")
    return rows.withColumn("start", F.col("_first") + F.col("before")).drop("_first")


def read_records(index: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """file, position, start (null without with_starts), key, n_tokens, ids_crc32 and (if asked for) ids (little-endian,
    4 bytes each) of the records that index names, in its order within a task. Both frames of each are checked."""

    def make():
        where, base = _filesystem(folder)
        held: list = [None, None]

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for file, position, start, offset, length in rows:
                if held[0] != file:
                    if held[1] is not None:
                        held[1].close()
                    held[:] = [file, where.open_input_file(f"{base}/{file}")]
                key, found = deserialize(unframe(held[1].read_at(length, offset)))
                raw = found.astype("<u4").tobytes()
                out.append((file, position, start, key, len(found), zlib.crc32(raw), raw if ids else None))
            return out

        return work

    start = F.col("start") if "start" in index.columns else F.lit(None).cast("long").alias("start")
    return map_rows(index.select("file", "position", start, "offset", "length"), make, READ)


def shuffled(index: DataFrame, seed: int = 0) -> DataFrame:
    """The index in another order, the same for the same seed: records dealt by a hash of their place, each task's sorted
    by it. Reading it visits the files at random, by offset."""
    h = F.xxhash64("file", "position", F.lit(seed))
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index.withColumn("_h", h).repartition(n, "_h").sortWithinPartitions("_h").drop("_h")


def digest(docs: DataFrame, tokenizer: str, key_type: str | Column = "long", folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: docs written, and read back from the files."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    found = read_records(with_starts(write_records(docs, folder, tokenizer)), folder)
    return found.select(F.col("key").cast(key_type).alias("doc_id"), "start", "n_tokens", "ids_crc32")
