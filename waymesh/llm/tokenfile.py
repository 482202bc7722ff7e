"""Token-ID files with plane shuffling.

File format (all numbers little-endian)::

    "BPT1"
    chunks: the planes of one block of up to ``block`` ids, each a zstandard frame (a plane of zeros has no bytes)
    footer: one zstandard frame of JSON {"mode", "block", "chunks": [[offset, ids, [plane sizes]]], "docs", "table": [offset, [plane sizes]]}
    footer size (8 bytes), "BPT1"

A block's 32-bit ids are transposed into four byte planes or thirty-two bit planes before compression. The document
table (ids and lengths, as 64-bit values with a flag for null ids) is stored as byte planes too. The chunk index in the
footer gives random access to any block.

Files are written by the executors to the shared folder under a name of their own for each attempt; only the files of
attempts that ended are in the index table that Spark commits, so retries and lost executors leave no trace in a result.

Defined cases: a null text is the empty text and has the end id alone; documents of the same id keep all their rows,
ordered by text; null doc_ids come first; very long texts are encoded whole, in bounded pieces; an empty table gives no
file and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, filesystem, qualified, resident, scratch, small_batches, strings, written

MAGIC = b"BPT1"
END_ID = 2
BLOCK = 1 << 16
LEVEL = 3
#: Rows of one file at most, about.
FILE_ROWS = 1 << 16
#: Pre-tokens a worker remembers at most, and characters it takes at a time.
CACHE = 300_000
PIECE_CHARS = 500_000

#: Fixed value: how the byte-level vocabulary cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes are settled between Unicode versions; a text with any other goes whole to the library.
SETTLED = regex.compile("[\t-\r -~\u00a1-\u0377\u0386-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
LETTER, NUMBER, WHITE, OTHER, BREAK = 1, 2, 3, 4, 5


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each character below 65,536; 0 if it isn't settled. NUL parts texts."""
    table = np.zeros(65536, np.uint8)
    for i in (*range(0xD800), *range(0xE000, 65535)):
        c = chr(i)
        if SETTLED.match(c):
            table[i] = LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else WHITE if regex.match(r"\s", c) else OTHER
    table[0] = BREAK
    return table


def pre_tokens(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches begin, for settled characters between NULs (the first and last character are NUL)."""
    begin = np.empty(len(cp), bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    word = (kind >= LETTER) & (kind <= OTHER) & (kind != WHITE)
    white = kind == WHITE
    begin[:-1] |= white[:-1] & word[1:]  # the last white space before a word stands alone ...
    begin[1:] &= ~((cp[:-1] == 32) & word[1:])  # ... or, a space, begins the word
    a = np.flatnonzero(cp[:-2] == 39) if len(cp) > 2 else np.empty(0, np.int64)
    a = a[(kind[a - 1] == LETTER) | (kind[a - 1] == NUMBER) | (kind[a - 1] == BREAK) | white[a - 1] & (cp[a - 1] != 32)]
    one, two = cp[a + 1], cp[a + 2]
    short = np.isin(one, (115, 116, 109, 100))  # s t m d
    long = (two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)  # re ve ll
    for at, n in ((a[short], 2), (a[long], 3)):
        begin[at + 1] = False
        begin[at + n] |= kind[at + n] == LETTER
    return np.flatnonzero(begin)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., of size[0] places, then those of start[1], and so on."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


class Store:
    """Rows of different lengths in one growing array."""

    def __init__(self, dtype):
        self.data, self.used, self.at, self.size = np.empty(1 << 16, dtype), 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        if self.used + len(flat) > len(self.data):
            self.data = np.concatenate((self.data[: self.used], np.empty(max(len(self.data), len(flat)), self.data.dtype)))
        self.data[self.used : self.used + len(flat)] = flat
        self.at = np.concatenate((self.at, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used += len(flat)

    def cut(self, rows: int) -> None:
        self.at, self.size = self.at[:rows], self.size[:rows]
        self.used = int(self.at[-1] + self.size[-1]) if rows else 0

    def rows(self, which: np.ndarray) -> np.ndarray:
        return self.data[runs(self.at[which], self.size[which])]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level vocabulary encodes each pre-token by itself, so a worker asks the library for each pre-token once and
    remembers its ids. Pre-tokens are found, looked up by a 64-bit hash, compared with what is remembered character by
    character, and written out in array operations. Texts with characters that aren't settled or with the literal of an
    added token (which the library cuts out before pre-tokens), and other kinds of tokenizer, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only hold memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        p = self.lib.pre_tokenizer
        self.cuts = isinstance(p, pre_tokenizers.ByteLevel) and p.use_regex and not p.add_prefix_space and self.lib.normalizer is None
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        self.kinds = classes()
        self.random = np.random.default_rng(1).integers(1, 2**63, 65536, np.uint64)
        odd, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
        self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(2 * PIECE_CHARS + 8, x, np.uint64)]) for x in (odd, inverse))
        self.forget()

    def forget(self) -> None:
        self.hashes, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.chars, self.ids = Store(np.uint16), Store(np.uint32)

    def trim(self, rows: int) -> None:
        """Forget all but the first ``rows`` pre-tokens; what came first is the most frequent."""
        old = self.entry < rows
        self.hashes, self.entry = self.hashes[old], self.entry[old]
        self.chars.cut(rows)
        self.ids.cut(rows)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, tokens: list[str], hashes: np.ndarray) -> None:
        """Remember distinct new pre-tokens, given with their hashes in rising order."""
        first = len(self.chars.at)
        for i in range(0, len(tokens), 10_000):
            part = tokens[i : i + 10_000]
            found = [e.ids for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]
            self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(part)))
            self.chars.add(np.frombuffer("".join(part).encode("utf-16-le"), np.uint16), np.fromiter(map(len, part), np.int64, len(part)))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.entry = np.insert(self.entry, at, np.arange(first, first + len(tokens)))

    def together(self, texts: list[str]) -> list[bytes]:
        """Texts of settled characters, of PIECE_CHARS altogether."""
        joined = "\0" + "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        kind = self.kinds[cp]
        at = pre_tokens(cp, kind)
        end = np.r_[at[1:], len(cp)]
        real = kind[at] != BREAK
        size = (end - at)[real]
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(self.random[cp] * self.powers[: len(cp)], out=total[1:])
        h = (total[end[real]] - total[at[real]]) * self.inverses[at[real]]
        h ^= h >> np.uint64(29)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        while True:
            where = np.searchsorted(self.hashes, distinct)
            new = where == len(self.hashes)
            new[~new] = self.hashes[where[~new]] != distinct[~new]
            if not new.any():
                break
            if len(self.entry) and len(self.entry) + int(new.sum()) > CACHE:
                self.trim(len(self.entry) // 2)
                continue
            starts, sizes = at[real][first[new]], size[first[new]]
            self.learn([joined[i : i + n] for i, n in zip(starts.tolist(), sizes.tolist())], distinct[new])
        token = self.entry[where][inverse]
        if not (np.array_equal(self.chars.size[token], size) and np.array_equal(self.chars.rows(token), cp[kind != BREAK])):
            return self.whole(texts)  # two pre-tokens of one hash
        ids, count = self.ids.rows(token), np.zeros(len(at), np.int64)
        count[real] = self.ids.size[token]
        upto = np.r_[0, np.cumsum(count)]
        breaks = np.flatnonzero(cp == 0)
        cuts = upto[np.searchsorted(at, breaks)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(texts)
        held, size = [], 0

        def flush():
            for i, ids in zip(held, self.together([texts[i] for i in held]) if held else []):
                out[i] = ids
            held.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if self.added.search(t):
                out[i] = self.whole([t])[0]
                continue
            settled = self.cuts and self.settled(t)
            if not settled or len(t) > PIECE_CHARS:
                some = lambda x: self.together(x) if settled and len(x[0]) <= 2 * PIECE_CHARS else self.whole(x)
                out[i] = b"".join(some([x])[0] for x in self.slices(t))
                continue
            if size + len(t) + 1 > PIECE_CHARS:
                flush()
                size = 0
            held.append(i)
            size += len(t) + 1
        flush()
        return out

    def settled(self, text: str) -> bool:
        if text.isascii():
            return PLAIN.fullmatch(text) is not None
        cp = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        kind = self.kinds[cp]
        return bool(kind.all()) and not (cp == 0).any()

    def slices(self, text: str):
        """A very long text in parts that begin at pre-tokens: after a letter or mark, before a space and a letter."""
        if not self.cuts:
            yield text
            return
        at = 0
        while len(text) - at > 2 * PIECE_CHARS:
            m = CUT.search(text, at + PIECE_CHARS)
            if not m or m.start() - at > 2 * PIECE_CHARS:
                break
            yield text[at : m.start() + 1]
            at = m.start() + 1
        yield text[at:]


PLAIN = re.compile("[\t-\r -~]*")
CUT = re.compile("[a-z.,](?= [A-Za-z])")


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between its tasks."""
    return resident(("encoder", path), lambda: Encoder(path))


def to_planes(values: np.ndarray, mode: str = "byte") -> list[bytes]:
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    if mode == "bit":
        planes = np.packbits(np.unpackbits(planes[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1).reshape(8 * width, -1), axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, dtype, mode: str = "byte") -> np.ndarray:
    width = np.dtype(dtype).itemsize
    size = (n + 7) // 8 if mode == "bit" else n
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(size, np.uint8) for p in planes])
    if mode == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little").reshape(width, 8, n).transpose(0, 2, 1)
        rows = np.packbits(bits, axis=2, bitorder="little")[:, :, 0]
    return np.ascontiguousarray(rows.T).reshape(-1).view(dtype)


class Writer:
    """Streams documents into one file."""

    def __init__(self, out, mode: str = "byte", block: int = BLOCK, level: int = LEVEL):
        self.out, self.mode, self.block = out, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.rest, self.chunks, self.docs, self.ids = 0, [], [], [], 0
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _planes(self, values: np.ndarray, mode: str) -> list[int]:
        packed = [self.zstd.compress(p) if p else b"" for p in to_planes(values, mode)]
        for p in packed:
            self._put(p)
        return [len(p) for p in packed]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.rest.append(ids)
        self.held += len(ids)
        self.ids += len(ids) // 4
        if self.held >= 4 * self.block:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        data = b"".join(self.rest)
        step = 4 * self.block
        end = len(data) if last else len(data) - len(data) % step
        for i in range(0, end, step):
            ids = np.frombuffer(data[i : min(i + step, end)], "<u4")
            at = self.at
            self.chunks.append([at, len(ids), self._planes(ids, self.mode)])
        self.rest = [data[end:]]
        self.held = len(data) - end

    def close(self) -> None:
        self._blocks(True)
        at = self.at
        table = self._planes(np.array(self.docs, "<i8").reshape(-1), "byte") if self.docs else []
        footer = self.zstd.compress(json.dumps({"mode": self.mode, "block": self.block, "chunks": self.chunks, "docs": len(self.docs), "table": [at, table]}).encode())
        self._put(footer + struct.pack("<Q", len(footer)) + MAGIC)


class Reader:
    """Random access to one file (anything with seek and read)."""

    def __init__(self, src):
        self.src = src
        self.zstd = zstandard.ZstdDecompressor()
        size = src.seek(0, 2) or src.tell()
        src.seek(size - 12)
        tail = src.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<Q", tail[:8])[0]
        src.seek(size - 12 - n)
        self.meta = json.loads(self.zstd.decompress(src.read(n)))

    def _planes(self, at: int, sizes: list[int], n: int, dtype, mode: str) -> np.ndarray:
        self.src.seek(at)
        return from_planes([self.zstd.decompress(self.src.read(s)) if s else b"" for s in sizes], n, dtype, mode)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.meta["chunks"][k]
        return self._planes(at, sizes, n, "<u4", self.meta["mode"])

    def table(self) -> np.ndarray:
        """(known, doc_id, ids) of each document."""
        n = self.meta["docs"]
        return self._planes(*self.meta["table"], 3 * n, "<i8", "byte").reshape(-1, 3) if n else np.zeros((0, 3), np.int64)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids from place ``start`` on."""
        b = self.meta["block"]
        parts = [self.chunk(k) for k in range(start // b, (start + n + b - 1) // b)] if n else []
        whole = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return whole[start - start // b * b :][:n]

    def documents(self):
        """(doc_id, place of the first id, ids) one after another; holds one document and one chunk."""
        rest, k, at = np.zeros(0, "<u4"), 0, 0
        for known, doc_id, n in self.table().tolist():
            parts = [rest]
            have = len(rest)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id if known else None, at, rest[:n]
            rest, at = rest[n:], at + n


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, mode: str = "byte", end_id: int = END_ID, file_rows: int = FILE_ROWS) -> DataFrame:
    """Encode and write all documents under ``path``, ascending by doc_id; returns the files: part, file, n_docs, n_ids, start."""
    spark, tokenizer = docs.sparkSession, tokenizer or tokenizer_path()
    small_batches(spark)
    path = qualified(spark, path)
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // file_rows))
    end = array("I", [end_id]).tobytes()
    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches):
        writer, encode = None, encoder(tokenizer).encode
        for b in batches:
            if b.num_rows and writer is None:
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.bpt"
                out = filesystem(path)[0].open_output_stream(f"{folder}/{name}")
                writer = Writer(out, mode)
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(strings(b.column(1)))):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield batch_of(schema, [part], [name], [len(writer.docs)], [writer.ids])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("by", F.xxhash64("text")).repartitionByRange(n, "doc_id", "by").sortWithinPartitions("doc_id", "by", "text").drop("by")
    files = written(dealt.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "token-index")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(over), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    path = qualified(spark, path)
    _, folder = filesystem(path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        fs = filesystem(path)[0]
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with fs.open_input_file(f"{folder}/{name}") as src:
                    for doc_id, at, ids in Reader(src).documents():
                        rows.append((doc_id, start + at, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                        if len(rows) == 20_000:
                            yield batch_of(schema, *zip(*rows))
                            rows = []
                if rows:
                    yield batch_of(schema, *zip(*rows))

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, mode: str = "byte") -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, path, write_tokens(docs, path, mode=mode))
