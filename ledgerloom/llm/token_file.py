"""Token ids as directly addressable codes.

Format of a segment (all little-endian)
---------------------------------------
``DACT`` | version u16 = 1 | levels u16 | documents u64 | tokens u64 | for each
level: codes u64 | documents x (id i64, 0 for null) | documents x (null flag u8)
| (documents + 1) x (first token u64) | for each level: codes x u8 | bitmap,
ceil(codes / 8) bytes, lowest bit first | directory, one u64 for each 512 bits:
ones before them.

An id is cut into chunks of eight bits, lowest first.  Level 0 has one code for
each token; a set bit in its bitmap says that the id goes on in the next level,
at the place that equals the number of set bits before it.  ``Segment.token``
reads any one id from one code for each level and a count over one block;
nothing is decoded in blocks.

A shard is one task's run of segments in ascending id order, stored as rows
(part, sequence, tokens before, segment) of a Parquet table, so any file system
Spark can write will do.  Segments are stored as they are, uncompressed, and
have about ``SEGMENT_TOKENS`` ids (some hundred KB): ``tokens_at`` finds the
segments of the places asked for by their narrow columns alone and reads one
code a level of each place.  Ids of a document never cross a segment.

Defined results: null and empty text have the end id only; a null id sorts
first; rows that repeat an id follow each other in the order of their texts'
hash; an empty table makes no segments.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table
from .words import CHUNK_BYTES, Numbers, byte_names, chunks

MAGIC, VERSION = b"DACT", 1
BLOCK_BITS = 512
#: Tokens after which a segment is closed.
SEGMENT_TOKENS = 1 << 16
#: Different chunks a worker remembers before it starts afresh (some 100 MB).
MEMO = 1_000_000
#: White space but the space itself and the line's end.
WHITE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_LETTER, _STOP, _SPACE, _LINE = 1, 2, 3, 4


def pack_segment(ids: np.ndarray, doc_ids: list[int | None], first: np.ndarray) -> bytes:
    """One segment from all ids, the documents' ids and where each begins (one more than documents)."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        goes_on = left > 255
        bitmap = np.packbits(goes_on, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(goes_on, dtype=np.uint64)))[:-1:BLOCK_BITS] if len(left) else np.empty(0)
        levels.append((len(left), left.astype(np.uint8).tobytes() + bitmap.tobytes() + ones.astype("<u8").tobytes()))
        left = left[goes_on] >> 8
        if not len(left):
            break
    head = MAGIC + struct.pack("<HHQQ", VERSION, len(levels), len(doc_ids), len(ids)) + struct.pack(f"<{len(levels)}Q", *(n for n, _ in levels))
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + named + first.astype("<u8").tobytes() + b"".join(x for _, x in levels)


class Segment:
    """A segment's tokens, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        version, n_levels, n_docs, self.n_tokens = struct.unpack_from("<HHQQ", data, 4)
        if version != VERSION:
            raise ValueError(f"version {version} of the format is unknown")
        at = 4 + 20
        counts = struct.unpack_from(f"<{n_levels}Q", data, at)
        at += 8 * n_levels
        ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        null = np.frombuffer(data, np.uint8, n_docs, at)
        at += n_docs
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.first = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for n in counts:
            codes = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            blocks = -(-n // BLOCK_BITS)
            self.levels.append((codes, bitmap, np.frombuffer(data, "<u8", blocks, at)))
            at += 8 * blocks

    def token(self, i: int) -> int:
        """The id at place i of the segment, without decoding any other."""
        out, shift = 0, 0
        for codes, bitmap, ones in self.levels:
            out |= int(codes[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return out
            block = i // BLOCK_BITS
            from_byte = block * BLOCK_BITS // 8
            between = int.from_bytes(bitmap[from_byte : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK_BITS)) - 1)
            i, shift = int(ones[block]) + between.bit_count(), shift + 8
        return out

    def ids(self) -> np.ndarray:
        """All ids (uint32)."""
        left = np.zeros(0, dtype=np.uint32)
        for codes, bitmap, _ in reversed(self.levels):
            out = codes.astype(np.uint32)
            at = np.flatnonzero(np.unpackbits(bitmap, count=len(codes), bitorder="little"))
            out[at] |= left[: len(at)] << np.uint32(8)
            left = out
        return left


class ChunkEncoder:
    """Ids of texts by the tokenizers library, remembered by chunk.

    The byte-level pattern never joins characters across a space or a line's end
    that stands alone between two others that aren't white space, nor a run of
    letters with the stop after it, so such a text's ids are those of its
    chunks (each with the space before it).  A chunk of letters is one word of
    the pattern and goes straight to the library's model, its bytes written as
    the byte level writes them; other chunks go through the whole tokenizer.  A
    text with any other white space, or that holds a special token's string,
    goes to the library whole, as do all texts where the file's rules are others
    than plain byte level.

    Chunks are cut, named and looked up for many texts at once; two independent
    64-bit names, with the length in one of them, tell chunks apart.
    """

    WORD = re.compile(f" ?[{_LETTERS}]+")
    OTHER_BASE = 0xD1342543DE82EF95

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(self.tokenizer.to_str())
        level = rules["pre_tokenizer"] or {}
        self.plain = rules["normalizer"] is None and level.get("type") == "ByteLevel" and not level["add_prefix_space"] and level.get("use_regex", True)
        self.model = self.tokenizer.model
        # the byte level writes printable Latin-1 as itself and the other bytes as the characters from 256 on
        other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.written = {b: 256 + k for k, b in enumerate(other)}
        self.kind = np.zeros(256, dtype=np.uint8)
        for kind, some in ((_LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (_STOP, b".,;:!?"), (_SPACE, b" "), (_LINE, b"\n")):
            self.kind[list(some)] = kind
        self.forget()

    def forget(self) -> None:
        self.places, self.known = Numbers(), 0
        self.check, self.first, self.count = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def library(self, chunk: str) -> list[int]:
        if self.WORD.fullmatch(chunk):
            return [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.written))]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def by_chunks(self, text: str) -> bool:
        """Whether the text's ids are those of its chunks: each space and line's end stands alone between others."""
        if not self.plain or WHITE.search(text) or any(s in text for s in self.special):
            return False
        return text.strip(" \n") == text and not any(x in text for x in ("  ", "\n\n", " \n", "\n "))

    def cut(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """First byte of each chunk; ``texts`` has the first byte of each text and the end of all."""
        kind = self.kind[raw]
        lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))  # two bytes: Latin letters from U+00C0 to U+024F but for two signs
        lead = lead[(raw[lead] != 0xC3) | ((raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7))]
        kind[lead] = kind[lead + 1] = _LETTER
        start = np.zeros(len(raw) + 1, dtype=bool)
        line = np.flatnonzero(kind == _LINE)
        start[texts] = start[line] = start[line + 1] = True
        start[:-1] |= kind == _SPACE
        begin = np.flatnonzero(start[:-1])
        end = np.append(begin[1:], len(raw))
        inner = begin + (kind[begin] == _SPACE)
        odd = np.append(np.flatnonzero(kind != _LETTER), len(raw))
        stop = odd[np.searchsorted(odd, inner)]  # where the letters end
        stop = stop[(stop > inner) & (stop < end)]
        start[stop[kind[stop] == _STOP]] = True
        return np.flatnonzero(start[:-1])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole, chunked = [], []
        for i, text in enumerate(texts):
            (chunked if self.by_chunks(text) else whole).append(i)
        for i, found in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, dtype="<u4").tobytes()
        parts = [(i, part) for i in chunked for part in _parts(texts[i].encode())]
        for a, b in chunks([len(d) for _, d in parts]):
            ids, ends = self.joined([d for _, d in parts[a:b]])
            packed = ids.astype("<u4").tobytes()
            for (i, _), first, last in zip(parts[a:b], ends[:-1], ends[1:], strict=True):
                out[i] += packed[4 * first : 4 * last]
        return out

    def joined(self, data: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts one after the other, and where each begins and the last ends."""
        all_bytes = b"".join(data)
        raw = np.frombuffer(all_bytes, dtype=np.uint8)
        begin = np.cumsum([0] + [len(d) for d in data])
        starts = self.cut(raw, begin)
        ends = np.append(starts[1:], len(raw))
        name = (byte_names(raw, starts, ends) >> np.uint64(1)).view(np.int64)
        check = byte_names(raw, starts, ends, self.OTHER_BASE) + (ends - starts).astype(np.uint64)
        entry = self.places.get(name)
        entry[self.check[entry] != check] = -1
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            _, one, same = np.unique(name[unknown], return_index=True, return_inverse=True)
            at = unknown[one]
            found = [self.library(all_bytes[s:e].decode()) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            counts = np.array([len(f) for f in found])
            first = len(self.ids) + np.cumsum(counts) - counts
            new = self.known + np.arange(len(at))
            while self.known + len(at) > len(self.first):
                self.check, self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.check, self.first, self.count))
            self.check[new], self.first[new], self.count[new] = check[at], first, counts
            self.ids = np.concatenate((self.ids, np.array([i for f in found for i in f], dtype=np.uint32)))
            self.known += len(at)
            fresh = self.places.get(name[at]) < 0  # else a name that two chunks share: used now, not remembered
            self.places.put(name[at[fresh]], new[fresh])
            entry[unknown] = new[same]
            clash = unknown[self.check[entry[unknown]] != check[unknown]]
        else:
            clash = unknown
        counts = self.count[entry]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.first[entry] - total[:-1], counts) + np.arange(total[-1])]
        if len(clash):  # two chunks of one name in these texts: beyond any chance but by design
            parts = [np.array(self.library(all_bytes[s:e].decode()), dtype=np.uint32) for s, e in zip(starts, ends, strict=True)]
            ids, total = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        if self.known > MEMO:
            self.forget()
        return ids, total[np.searchsorted(starts, begin)].tolist()


def _parts(data: bytes) -> Iterator[bytes]:
    """A very long text in parts that begin with a space, so a chunk is never cut."""
    at = 0
    while len(data) - at > 2 * CHUNK_BYTES and (cut := data.find(b" ", at + CHUNK_BYTES)) >= 0:
        yield data[at:cut]
        at = cut
    yield data[at:]


_encoders: dict[str, ChunkEncoder] = {}


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write segments; returns the table (part, sequence, before, n_tokens, segment)."""
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = F.col("id").asc_nulls_first(), F.xxhash64("text")  # rows that share an id are dealt by their texts
    ranged = own.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = ChunkEncoder(tokenizer_path)
        encoder = _encoders[tokenizer_path]
        end = np.array([end_id], dtype="<u4").tobytes()
        part, sequence, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal sequence, before, ids, names
            first = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
            packed = pack_segment(np.frombuffer(b"".join(ids), dtype="<u4"), names, first)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([sequence], pa.int32()), pa.array([before], pa.int64()), pa.array([int(first[-1])], pa.int64()), pa.array([packed], pa.binary())],
                names=["part", "sequence", "before", "n_tokens", "segment"],
            )
            sequence, before, ids, names = sequence + 1, before + int(first[-1]), [], []
            return row

        held = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for name, packed in zip(some.column(0).to_pylist(), encoder.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    names.append(name)
                    ids.append(packed + end)
                    held += len(packed) // 4 + 1
                    if held >= SEGMENT_TOKENS:
                        yield close()
                        held = 0
        if names:
            yield close()

    return write_table(ranged.mapInArrow(encode, "part int, sequence int, before bigint, n_tokens bigint, segment binary"), "token-segments", compression="none")


def _bases(segments: DataFrame) -> dict[int, int]:
    """Ids before each part: a row for each task that wrote, whose number is that of shuffle partitions, not of documents."""
    totals = sorted(segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    return dict(zip([r["part"] for r in totals], np.cumsum([0] + [r["n"] for r in totals])[:-1].tolist(), strict=True))


def read_tokens(segments: DataFrame) -> DataFrame:
    """Read the segments back: (id, ``start`` over the whole corpus, ``n_tokens``, ``ids_crc32``, ``first_id``, ``last_id``).

    The first and last id of a document are read where they stand, the sum over all of its ids.
    """
    base = _bases(segments)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                segment = Segment(data.as_py())
                ids = segment.ids().astype("<u4")
                ends = segment.first.tolist()
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                first, last = [segment.token(a) for a in ends[:-1]], [segment.token(b - 1) for b in ends[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.doc_ids, pa.int64()), pa.array(segment.first[:-1] + before.as_py() + base[part.as_py()]), pa.array(np.diff(segment.first)), *(pa.array(x, pa.int64()) for x in (sums, first, last))],
                    names=["id", "start", "n_tokens", "ids_crc32", "first_id", "last_id"],
                )

    return segments.select("part", "before", "segment").mapInArrow(decode, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, first_id bigint, last_id bigint")


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """(``place``, ``token``): the ids at given places of the whole corpus, by direct access.

    ``places`` has a column ``place``; places outside the corpus and nulls give
    no row, a repeated one a single row.  Segments are found by their narrow
    columns; each one that is asked for is read once, with the places in it.
    """
    base = _bases(segments)
    starts = segments.sparkSession.createDataFrame(list(base.items()), "part int, base bigint")
    own = segments.select("part", "sequence", "before", "n_tokens").join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("before"))  # a row for each task
    stripe = lambda c: F.floor(c / SEGMENT_TOKENS).cast("bigint")
    own = own.withColumn("stripe", F.explode(F.sequence(stripe(F.col("start")), stripe(F.col("start") + F.col("n_tokens") - 1))))
    asked = places.where("place >= 0").select(F.col("place").cast("bigint").alias("place")).distinct().withColumn("stripe", stripe(F.col("place")))
    found = asked.join(own, "stripe").where("place >= start AND place < start + n_tokens")
    found = found.groupBy("part", "sequence").agg(F.first("start").alias("start"), F.collect_list("place").alias("places"))  # at most a segment's ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, places, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                segment, at = Segment(data.as_py()), places.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([segment.token(p - start.as_py()) for p in at], pa.int64())], names=["place", "token"])

    return segments.select("part", "sequence", "segment").join(found, ["part", "sequence"]).select("start", "places", "segment").mapInArrow(read, "place bigint, token bigint")
