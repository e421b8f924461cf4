"""Token ids in files of fixed-width packed integers.

File (little-endian): ``magic 4s | bits u32 | block u32 | bucket i64 | first id's place in the bucket u64 | documents u64 |
ids u64``, then per document its key (i64) and its number of ids (u64), then per block its byte offset in the payload
(u64), then the payload.  A block holds ``block`` ids (a multiple of 64) of ``bits`` bits; 64 ids fill ``bits`` 64-bit
words, so lane j of every group of 64 starts at the same bit and all groups are packed and unpacked by one numpy step
per lane.  A document is reached by its first id's place alone.

Defined cases: null text is empty and has the end id only; null keys come first and read back as null; repeated keys are
kept and ordered by a hash of their text, then text; an empty table makes no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .session import OrderedBuckets, arrow_map, fanout, new_folder, put_file

MAGIC = b"BPK1"
HEAD = struct.Struct("<4sIIqQQQ")
BLOCK = 1024
#: Packed bytes after which a bucket goes on in its next file.
FILE_BYTES = 32 << 20
#: Distinct words after which a worker remembers no more; later ones are encoded once a batch.
WORDS_KEPT = 1_000_000
NO_KEY = -(1 << 63)
#: Text bytes whose words are numbered together.
STEP_BYTES = 10 << 20
#: Words that the library encodes as one text.
CHAIN = 500


def width(vocabulary: int) -> int:
    """Bits that the ids of a vocabulary need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as ceil(n / 64) groups of ``bits`` 64-bit words."""
    groups = -(-len(ids) // 64)
    x = np.zeros((groups, 64), np.uint64)
    x.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= x[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, lane] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(packed: np.ndarray, bits: int, n: int) -> np.ndarray:
    y = packed.reshape(-1, bits)
    out = np.empty((len(y), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        v = y[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (y[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = v & mask
    return out.reshape(-1)[:n]


def file_parts(bucket: int, place: int, keys: list[int], counts: list[int], ids: np.ndarray, bits: int) -> list:
    """A file's bytes, in pieces."""
    blocks = -(-len(ids) // BLOCK)
    offsets = np.arange(blocks, dtype="<u8") * (BLOCK // 64 * bits * 8)
    return [HEAD.pack(MAGIC, bits, BLOCK, bucket, place, len(keys), len(ids)), np.array(keys, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), pack(ids, bits).astype("<u8").tobytes()]


class TokenFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, content: bytes):
        magic, self.bits, self.block, self.bucket, self.place, n, self.ids = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.keys = np.frombuffer(content, "<i8", n, at)
        self.counts = np.frombuffer(content, "<u8", n, at + 8 * n).astype(np.int64)
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(content, "<u8", blocks, at + 16 * n)
        self.base = at + 16 * n + 8 * blocks
        self.content = content
        self.starts = np.zeros(n + 1, np.int64)
        np.cumsum(self.counts, out=self.starts[1:])

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids of places start to stop; only their blocks are unpacked."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        begin = self.base + int(self.offsets[first])
        groups = min(-(-self.ids // 64), last * (self.block // 64)) - first * (self.block // 64)
        words = np.frombuffer(self.content, "<u8", groups * self.bits, begin)
        got = unpack(words, self.bits, groups * 64)
        return got[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1]))


_encoders: dict = {}


class WordEncoder:
    """Encodes texts word by word with a byte-level BPE tokenizer, whose pre-tokenizer never joins characters across a
    single space between two other characters: ids of a text are the ids of its first word and of each later word with
    its space before it.  Words are looked up among those met before; the library encodes the others.  Texts with other
    runs of white space beside a space are encoded whole.  With ``added``, added tokens (such as <|endoftext|>) in a text
    have their own ids, as by the library's default, and such texts are encoded whole; without, they are plain text."""

    def __init__(self, path: str, added: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.known: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        space = self.library.encode(" ", add_special_tokens=False).tokens[0][0]
        self.begins[[i for piece, i in vocabulary.items() if piece[0] == space]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it.  Words go to the library in chains: the ids that begin with the space's byte are the words' first ones."""
        out: list[bytes] = []
        chains = [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
        got = self.library.encode_batch_fast([" " + " ".join(c) for c in chains], add_special_tokens=False)
        for chain, x in zip(chains, got, strict=True):
            ids = np.array(x.ids, np.uint32)
            cuts = (np.flatnonzero(self.begins[ids]) * 4).tolist()
            if len(cuts) == len(chain):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
            else:
                out += self._whole([" " + w for w in chain])
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, as bytes of unsigned 32-bit integers; null is the empty text.

        A batch's words are numbered by Arrow, so that each distinct one is looked up once, and the texts' ids are gathered
        from the distinct words' ids in one numpy step.
        """
        texts = pc.fill_null((pa.array(texts, pa.string()) if isinstance(texts, list) else texts).cast(pa.large_string()), "")
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy()
        at = at - at[0]
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, words))
        new = [w for w, g in zip(words, got, strict=True) if g is None]
        inner = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        fresh = dict.fromkeys(new, False)  # False: beside other white space
        fresh.update(zip(inner, self._words(inner), strict=True))
        if len(self.known) < WORDS_KEPT:
            self.known.update(fresh)
        got = [fresh[w] if g is None else g for w, g in zip(words, got, strict=True)]
        bad = np.array([g is False for g in got], bool)
        first = at[:-1]
        heads = self._whole([words[i] for i in code[first].tolist()])
        unsafe = np.logical_or.reduceat(bad[code], first) & (np.diff(at) > 1)
        for token in self.added:
            unsafe |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # heads follow the words in the table: a text's first word has no space before it
        code[first] = len(words) + np.arange(len(first))
        table = [g or b"" for g in got] + heads
        size = np.array([len(g) // 4 for g in table], np.int64)
        flat = np.frombuffer(b"".join(table), np.uint32)
        begin = np.cumsum(size) - size
        n = size[code]
        end = np.cumsum(n)
        ids = flat[np.repeat(begin[code] - end + n, n) + np.arange(int(end[-1]))]
        ends = np.concatenate(([0], end))[at] * 4
        raw = ids.tobytes()
        out = [raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        rest = np.flatnonzero(unsafe).tolist()
        for i, x in zip(rest, self._whole([texts[i].as_py() for i in rest]), strict=True):
            out[i] = x
        return out


def steps(column: pa.Array, size: int):
    """(from, to) of consecutive rows with about ``size`` bytes."""
    _, at = kernels.flat(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def encoder(path: str, added: bool = False) -> WordEncoder:
    if (path, added) not in _encoders:
        _encoders[path, added] = WordEncoder(path, added)
    return _encoders[path, added]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text", bits: int | None = None, added: bool = False) -> list[tuple[int, int]]:
    """Encodes every text, appends end_id, writes the ids in ascending key order to files of ``folder``.  Returns (bucket, ids) of each bucket that has rows: as many entries as partitions at most.

    The texts are shuffled once, to ordered buckets; each task writes its bucket's files under names that depend on the
    bucket only, so a task that runs again replaces its own files.
    """
    bits = bits or width(vocabulary_size(tokenizer))
    parts = fanout(docs)
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    order = [F.coalesce("k", F.lit(NO_KEY)), F.xxhash64(F.coalesce("t", F.lit("")))]
    buckets = OrderedBuckets(rows, order, parts)
    rows = rows.withColumn("b", buckets.of(*order)).repartitionById(buckets.n, "b").sortWithinPartitions(*order, "t").select("k", "t", "b")

    def write(batches):
        use = encoder(tokenizer, added)
        end = np.array([end_id], np.uint32).tobytes()
        bucket = None
        place = total = seq = size = 0
        keys: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []

        def flush():
            nonlocal place, seq, size
            ids = np.frombuffer(b"".join(held), np.uint32)
            put_file(folder, f"{bucket:09d}-{seq:05d}.tok", file_parts(bucket, place, keys, counts, ids, bits))
            place += len(ids)
            seq, size = seq + 1, 0
            keys.clear(), counts.clear(), held.clear()

        for batch in batches:
            for i, j in steps(batch.column(1), STEP_BYTES):
                part = batch.slice(i, j - i)
                bucket = part.column(2)[0].as_py() if bucket is None else bucket
                for k, x in zip(part.column(0).to_pylist(), use.encode(part.column(1)), strict=True):
                    x += end
                    n = len(x) // 4
                    keys.append(NO_KEY if k is None else k)
                    counts.append(n)
                    held.append(x)
                    total += n
                    size += n * bits // 8
                    if size >= FILE_BYTES:
                        flush()
        if keys:
            flush()
        if bucket is not None:
            yield pa.RecordBatch.from_pydict({"b": pa.array([bucket], pa.int32()), "n": pa.array([total], pa.int64())})

    return sorted((r.b, r.n) for r in arrow_map(rows, write, "b int, n bigint").collect())


def read_token_files(spark, folder: str, written: list[tuple[int, int]]) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids (the unsigned 32-bit values as bigints are left packed: binary, little-endian)."""
    return _read(spark, folder, written, True)


def read_token_digests(spark, folder: str, written: list[tuple[int, int]]) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    return _read(spark, folder, written, False)


def _read(spark, folder: str, written: list[tuple[int, int]], whole: bool) -> DataFrame:
    schema = "doc_id bigint, start bigint, n_tokens bigint, " + ("ids binary" if whole else "ids_crc32 bigint")
    if not written:
        return spark.createDataFrame([], schema)
    before, at = {}, 0
    for b, n in written:
        before[b] = at
        at += n
    last = "ids" if whole else "ids_crc32"

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(content.as_py())
                base = before[f.bucket] + f.place
                step = 4096
                for i in range(0, len(f.keys), step):
                    j = min(i + step, len(f.keys))
                    ids = f.read(int(f.starts[i]), int(f.starts[j])).astype("<u4")
                    cuts = (f.starts[i : j + 1] - f.starts[i]) * 4
                    view = memoryview(ids.tobytes())
                    per = [view[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(f.keys[i:j], mask=f.keys[i:j] == NO_KEY),
                            pa.array(f.starts[i:j] + base),
                            pa.array(f.counts[i:j]),
                            pa.array([bytes(x) for x in per], pa.binary()) if whole else pa.array([zlib.crc32(x) for x in per], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", last],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("content")
    return arrow_map(files, read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, added: bool = False) -> DataFrame:
    """Writes docs' ids to ``folder`` (a new one of the shared folder by default) and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    return read_token_digests(spark, folder, write_token_files(docs, tokenizer, folder, end_id, added=added))
