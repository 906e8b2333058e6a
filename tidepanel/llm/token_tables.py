"""Token ids as sorted-string-table shards.

Documents are dealt by ranges of their identifier, sorted, tokenized and written by each task as one shard. A shard
has blocks of prefix-compressed entries (each block ends with its crc32), a sparse index (last key, place and length
of every block), a Bloom filter of its keys and a fixed footer; see ``write_shard`` for the bytes. A lookup asks the
footer, the filter, bisects the index and reads one block.

A key is one byte (0: null, 1: otherwise) and the identifier as 8 bytes, big-endian, sign flipped, so that byte
order is numeric order. A value is the ids, two bytes each if the vocabulary fits, else four.

Shards are written under a name of the attempt and then renamed, so lost executors and repeated tasks leave whole
files. The manifest is a table of one row a shard; places of documents come from a window over it. A large table gets more
shards, not larger ones. The first of every ``TOGETHER`` texts is also encoded whole by the library; a difference stops the job.

Defined cases: null text is empty; a null identifier sorts first; rows that repeat an identifier are entries of
their own, ordered by md5 of the text; an empty text has the end id alone; an empty table gives no rows; other
columns are not stored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.llm import common

MAGIC = b"TPSST001"
BLOCK = 64 * 1024
BITS_A_KEY, HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQQB7x8s")
#: Words a worker remembers in each of two generations.
REMEMBERED = 450_000
#: Bytes of input (as the reader estimates them) a shard is made for, and texts whose words are looked up together, the first of them held whole against the library.
SHARD_BYTES, TOGETHER = 128 << 20, 500
#: Shards that an estimate of a table's size may ask for; an estimate of a join can be far too large.
MOST_SHARDS = 200_000
WORD = re.compile(r"[^ \t\n\r]+")
MARKS = ".,!?;:%$&#*"
#: What a byte is: a blank that words are cut at (0), a mark (2), an ASCII letter (3), other (1).
KINDS = np.ones(256, np.uint8)
KINDS[list(b" \t\n\r")], KINDS[list(MARKS.encode())] = 0, 2
KINDS[65:91] = KINDS[97:123] = 3
#: Fixed value: how the tokenizer's file splits a normalized word.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def key_bytes(key: int | None) -> bytes:
    return bytes(9) if key is None else b"\1" + struct.pack(">Q", (key + (1 << 63)) & (2**64 - 1))


def key_of(raw: bytes) -> int | None:
    return None if raw[0] == 0 else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(key: bytes, bits: int) -> list[int]:
    h = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def write_shard(out, entries: Iterator[tuple[bytes, bytes]], width: int) -> dict:
    """Write sorted (key, value) pairs to the binary stream out.

    entry: varint shared prefix, varint rest of the key, varint value length, rest of the key, value
    block: entries, u32 crc32 of them
    index: for each block u8 key length, its last key, u64 place, u32 length
    footer: u64 index place, index length, filter place, filter length, blocks, documents, ids; u8 width; magic
    """
    at, blocks, keys, block, last, ids = 0, [], [], bytearray(), b"", 0

    def flush() -> None:
        nonlocal at, block
        if block:
            raw = bytes(block) + struct.pack("<I", zlib.crc32(block))
            out.write(raw)
            blocks.append((last, at, len(raw)))
            at += len(raw)
            block = bytearray()

    for key, value in entries:
        shared = 0
        if block:
            shared = len(os.path.commonprefix([last, key]))
        block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        last, ids = key, ids + len(value) // width
        keys.append(key)
        if len(block) >= BLOCK:
            flush()
    flush()
    index = b"".join(bytes([len(k)]) + k + struct.pack("<QI", place, n) for k, place, n in blocks)
    bits = max(64, -(-len(keys) * BITS_A_KEY // 8) * 8)
    bloom = bytearray(bits // 8)
    for key in keys:
        for p in bloom_places(key, bits):
            bloom[p >> 3] |= 1 << (p & 7)
    out.write(index + bytes(bloom))
    out.write(FOOTER.pack(at, len(index), at + len(index), len(bloom), len(blocks), len(keys), ids, width, MAGIC))
    return {"documents": len(keys), "ids": ids, "first": keys[0] if keys else b"", "last": last}


class Shard:
    """A shard opened for reading; only footer, filter and index are held."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, where = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(where)
        self.file.seek(self.file.size() - FOOTER.size)
        ip, il, fp, fl, blocks, self.documents, self.ids, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        index, self.bloom = self._at(ip, il), self._at(fp, fl)
        self.blocks, at = [], 0
        for _ in range(blocks):
            n = index[at]
            place, length = struct.unpack_from("<QI", index, at + 1 + n)
            self.blocks.append((index[at + 1 : at + 1 + n], place, length))
            at += 13 + n

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def _entries(self, block: tuple[bytes, int, int]) -> Iterator[tuple[bytes, bytes]]:
        raw = self._at(block[1], block[2])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < len(raw) - 4:
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def values(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in self.blocks:
            for key, raw in self._entries(block):
                yield key_of(key), self.values(raw)

    def get(self, key: int | None) -> list[np.ndarray]:
        """All values of a key, by filter, bisected index and the blocks that may hold it."""
        raw = key_bytes(key)
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(raw, bits)):
            return []
        found = []
        for block in self.blocks[bisect_left([b[0] for b in self.blocks], raw) :]:
            entries = list(self._entries(block))
            found += [self.values(v) for k, v in entries if k == raw]
            if entries[-1][0] > raw:
                break
        return found


class Words:
    """The tokenizers library, asked once for each word remembered.

    The pre-tokenizer drops white space and no piece, special token or normal form reaches over a blank, so a
    text's ids are those of its words in a row. A tokenizer for which this can't hold is asked for whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.apart: dict[str, bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for piece, i in self.library.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        probe = "it's <|endoftext|> É 12\n\té ﬁ Ἀ x"
        self.by_word = self._raw([probe])[0] == b"".join(self._raw(WORD.findall(probe))) and self._raw(["a b"]) == self._raw(["a \n b"])

    def _raw(self, texts: list[str]) -> list[bytes]:
        ask = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in ask(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of each word from one call: every pre-token ends with an end piece, and the pattern says how many a word has."""
        plain = " ".join(words)
        if "<|" not in plain and plain.split() == words:  # no special token, no other white space
            counts = [len(PRE_TOKEN.findall(w)) for w in self.library.normalizer.normalize_str(plain).split(" ")]
            ids = np.frombuffer(self._raw([plain])[0], f"<u{self.width}")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(counts) == len(words) and sum(counts) == len(stops):
                at = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])] * self.width
                raw, at = ids.tobytes(), at.tolist()
                return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        return self._raw(words)

    def _parts_after(self, letter: str) -> bool:
        """Whether a mark after this letter is a pre-token of its own, as the library splits it (lower-casing may leave a
        combining mark behind, which takes the mark along)."""
        if letter not in self.apart:
            made = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(f"a{letter}!"))
            self.apart[letter] = len(made) == 2 and made[1][0] == "!"
        return self.apart[letter]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text. Words are cut and numbered by array operations; each distinct one is looked up once."""
        if not self.by_word:
            return self._raw([t.decode() for t in texts])
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        kind = KINDS[data]
        word = kind != 0
        starts = word.copy()
        starts[1:] &= ~word[:-1] | ((kind[1:] == 2) & (kind[:-1] == 3))  # a mark behind a letter begins a pre-token, always
        starts = np.flatnonzero(starts)
        if not len(starts):
            return [b""] * len(texts)
        upto = np.cumsum(word)  # places once blanks are left out
        offsets = np.append(upto[starts] - 1, upto[-1]).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
        ids = self._ids(cut.dictionary.to_pylist())
        number = cut.indices.to_numpy()
        size = np.array(list(map(len, ids)), np.int64) // self.width
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        each = size[number]
        stop = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), f"<u{self.width}")
        flat = flat[np.repeat(first[number] - (stop - each), each) + np.arange(int(stop[-1]))]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = np.concatenate([[0], stop])[np.searchsorted(starts, begin)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            new = {words[i] for i in gaps}
            again = {w: ids for w in new if (ids := older.get(w)) is not None}
            known.update(again)
            self._learn([w.decode() for w in new.difference(again)])
            for i in gaps:
                found[i] = known[words[i]]
        return found

    def _learn(self, new: list[str]) -> None:
        known, older = self.known, self.older
        # Marks at the end of a word that a letter precedes are a pre-token of their own.
        stems = {w: s for w in new if (s := w.rstrip(MARKS)) and s != w and s[-1].isalpha() and (s[-1] < "\x80" or self._parts_after(s[-1]))}
        parts = {*stems.values(), *(w[len(s) :] for w, s in stems.items()), *(w for w in new if w not in stems)}
        ids, ask = {}, []
        for p in parts:
            raw = p.encode()
            if (old := known.get(raw)) is None and (old := older.get(raw)) is None:
                ask.append(p)
            else:
                ids[p] = old
        ids.update(zip(ask, self._each(ask) if ask else [], strict=True))
        known.update((p.encode(), i) for p, i in ids.items())
        known.update((w.encode(), ids[s] + ids[w[len(s) :]]) for w, s in stems.items())

    def checked(self, texts: list[bytes]) -> list[bytes]:
        """As encode_all; the first text is held against the library's ids of the whole."""
        ids = self.encode_all(texts)
        if texts and ids[0] != self._raw([texts[0].decode()])[0]:
            raise ValueError(f"ids by word and of the whole text differ for a text of {len(texts[0])} bytes that begins {texts[0][:80]!r}")
        return ids


_LOADED: dict[str, Words] = {}


def loaded(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


MANIFEST = "path string, documents bigint, ids bigint, first binary, last binary"


def _writer(tokenizer: str, folder: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        words = loaded(tokenizer)
        tail = b"" if end is None else np.array([end], f"<u{words.width}").tobytes()

        def rows() -> Iterator[tuple[bytes, bytes]]:
            for part in common.slices(batches, TOGETHER):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield from zip(map(key_bytes, part.column("key").to_pylist()), [i + tail for i in words.checked(texts)], strict=True)

        entries = rows()
        first = next(entries, None)
        if first is None:
            return
        files, where = fs.FileSystem.from_uri(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}.sst"
        own = f"{where}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(own) as out:
            made = write_shard(out, (e for part in ([first], entries) for e in part), words.width)
        files.move(own, f"{where}/{name}")
        yield pa.RecordBatch.from_pylist(
            [{"path": f"{folder}/{name}"} | made],
            pa.schema([("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]),
        )

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end: int | None = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to folder (seen by driver and executors); the manifest, one row a shard."""
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(folder)
    files.create_dir(where, recursive=True)
    read = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The row number splits even an identifier that many rows repeat.
    read = read.withColumn("_tie", F.md5(F.col("text").cast("binary"))).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), "_tie", "_row"]
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    dealt = read.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")
    return common.saved(dealt.mapInArrow(_writer(tokenizer, folder, end), MANIFEST), "token-manifest")


ROWS = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows: tuple[list, ...] = ([], [], [], [])
            for key, ids in Shard(path):
                for column, value in zip(rows, (key, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                    column.append(value)
                start += len(ids)
                if len(rows[0]) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=names)
                    rows = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=names)


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document of the shards: key, start (ids of all before it), n_tokens, ids_crc32. The window has one row a shard."""
    before = W.orderBy("first", "last", "path").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(max(1, manifest.count())).mapInArrow(_reader, ROWS).withColumnRenamed("key", key)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_tables(spark, sf_dir: str) -> DataFrame:
    folder = common.fresh_path(spark, "token-tables")
    manifest = write(common.table(spark, sf_dir, "documents"), default_tokenizer(), folder)
    return read(manifest)
