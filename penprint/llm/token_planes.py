"""Operator 1: token-ID files with bit-plane shuffling.

A corpus is tokenised and written as shard files in ascending ``doc_id`` order.  Token ids
are cut into blocks of ``block_ids``; each block is transposed into byte planes (all first
bytes, then all second bytes, ...) or bit planes (all lowest bits, ...), every plane is
compressed on its own with zstandard, and a chunk index in the file's tail holds each
block's id count and each plane's place, so any block is read without the ones before it.

File: ``PBTF`` | plane bytes ... | tail (Arrow IPC: chunk index, document table, zstd) |
uint64 tail length | ``PBTF``.

Scale: one range shuffle of the text by (doc_id, text hash), so a repeated doc_id is
spread too; tasks stream documents and hold one block and one shard's document table.
Shards are cut at ``shard_ids`` tokens.  Files are written under a name of the task attempt
and then renamed, so a retried task replaces its own shards with equal ones.  A document's
corpus offset is its shard's base (a prefix sum over the small shard list) plus its local
offset.

Defined cases: a null text is empty and yields the end id alone; a null doc_id sorts first;
equal doc_ids are ordered by text hash, then text; an empty table writes no file and reads
back as no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as paipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, shared_folder

MAGIC = b"PBTF"
BLOCK_IDS = 65_536
SHARD_IDS = 4_000_000
CACHE_WORDS = 400_000     # entries kept by each cache of a task process
_LONG_WORD = 64
# White space in the sense of the Unicode property, which the tokenizer's \\s uses.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_SPACES}]+")
_ODD_CONTROL = re.compile("[\x1c-\x1f]")
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")


def _latin(*categories: str) -> str:
    """A character class of the characters below U+0250 in these Unicode categories."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in categories)


# The pre-tokenizer's pattern, restricted to characters below U+0250.
_PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_latin('L')}]+|[{_latin('N')}]|[^{_SPACES}{_latin('L', 'N')}]+")


def _byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers show for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in own}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(own)))
    return [shown[b] for b in range(256)]


_BYTE_CHARS = _byte_chars()

# The pipeline steps for which WordEncoder splits texts itself.
_WORD_PIPELINE = (
    [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)],
    [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", None)],
)


def _shape(spec: dict) -> tuple[list, list]:
    def steps(x: dict | None, key: str) -> list:
        return [(s["type"], (s.get("pattern") or {}).get("Regex")) for s in (x or {}).get(key, [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if pre[0].get("behavior") != "Removed" or not pre[0].get("invert") or pre[-1].get("add_prefix_space") \
            or pre[-1].get("use_regex"):
        return [], []
    return steps(spec.get("normalizer"), "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")


# ---- block codec -----------------------------------------------------------------------

def encode_block(ids: np.ndarray, planes: str = "byte", level: int = 3) -> list[bytes]:
    """One block of uint32 ids as compressed planes, lowest plane first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    elif planes == "byte":
        rows = np.ascontiguousarray(raw.T)
    else:
        raise ValueError(f"planes must be 'byte' or 'bit', not {planes!r}")
    z = zstandard.ZstdCompressor(level=level)
    return [z.compress(r.tobytes()) for r in rows]


def decode_block(parts: list[bytes], n_ids: int, planes: str = "byte") -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    width = (n_ids + 7) // 8 if planes == "bit" else n_ids
    rows = [np.frombuffer(z.decompress(p, max_output_size=max(width, 1)), np.uint8) for p in parts]
    m = np.stack(rows) if rows else np.zeros((4, 0), np.uint8)
    if planes == "bit":
        m = np.unpackbits(m, axis=1, count=n_ids, bitorder="little")
        m = np.packbits(m.T, axis=1, bitorder="little")
    else:
        m = m.T
    return np.ascontiguousarray(m).view("<u4").reshape(-1)


class ShardWriter:
    """Streams ids into one shard file."""

    def __init__(self, sink, planes: str, block_ids: int, level: int):
        self.sink, self.planes, self.block_ids, self.level = sink, planes, block_ids, level
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.at = sink.write(MAGIC)
        self.index: list[tuple[int, list[int], list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            self._flush(self.block_ids)

    def _flush(self, least: int) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        at = 0
        while len(flat) - at >= least and at < len(flat):
            block = flat[at:at + self.block_ids]
            at += len(block)
            starts, sizes = [], []
            for part in encode_block(block, self.planes, self.level):
                starts.append(self.at)
                sizes.append(len(part))
                self.sink.write(part)
                self.at += len(part)
            self.index.append((len(block), starts, sizes))
        self.pending, self.n_pending = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._flush(1)
        tail = io.BytesIO()
        tables = (
            pa.table({"n_ids": pa.array([x[0] for x in self.index], pa.int64()),
                      "starts": pa.array([x[1] for x in self.index], pa.list_(pa.int64())),
                      "sizes": pa.array([x[2] for x in self.index], pa.list_(pa.int64()))}),
            pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()),
                      "n_tokens": pa.array([n for _, n in self.docs], pa.int64())}),
        )
        head = json.dumps({"planes": self.planes, "n_ids": self.n_ids})
        for t in tables:
            with paipc.new_stream(tail, t.schema.with_metadata({"shard": head})) as w:
                w.write_table(t.cast(t.schema.with_metadata({"shard": head})))
        body = zstandard.ZstdCompressor(level=self.level).compress(tail.getvalue())
        self.sink.write(body + struct.pack("<Q", len(body)) + MAGIC)


class ShardReader:
    """Chunk index and document table of one shard; blocks are decoded on demand."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC or content[-4:] != MAGIC:
            raise ValueError("not a token-plane file")
        n, = struct.unpack("<Q", content[-12:-4])
        tail = io.BytesIO(zstandard.ZstdDecompressor().decompressobj().decompress(content[-12 - n:-12]))
        self.content = content
        self.index = paipc.open_stream(tail).read_all()
        self.docs = paipc.open_stream(tail).read_all()
        head = json.loads(self.index.schema.metadata[b"shard"])
        self.planes, self.n_ids = head["planes"], head["n_ids"]
        self.n_blocks = self.index.num_rows

    def block(self, k: int) -> np.ndarray:
        """The ids of one block, read through the index alone."""
        n, starts, sizes = (self.index.column(c)[k].as_py() for c in ("n_ids", "starts", "sizes"))
        return decode_block([self.content[a:a + s] for a, s in zip(starts, sizes)], n, self.planes)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, offset within the shard, ids) in file order, one block in memory at a time."""
        have, k, at = np.zeros(0, np.uint32), 0, 0
        for d, n in zip(self.docs.column("doc_id").to_pylist(), self.docs.column("n_tokens").to_pylist()):
            if len(have) < n:
                got, held = [have], len(have)
                while held < n:
                    got.append(self.block(k))
                    held += len(got[-1])
                    k += 1
                have = np.concatenate(got)
            yield d, at, have[:n]
            have, at = have[n:], at + n


# ---- tokenising ------------------------------------------------------------------------

class WordEncoder:
    """Whole-text ids of a ``tokenizers`` file, each distinct pre-token encoded once.

    Files whose normaliser is NFC, white space, lower case and whose pre-tokenizer keeps
    the matches of one pattern before a byte-level step (``_WORD_PIPELINE``) never merge
    across pre-tokens.  Texts below U+0250 (already NFC, one-to-one lower case) without an
    added token are split here by that pattern, and the library's BPE model encodes each
    pre-token the first time it is met.  Other texts go to the library word by word, since
    no token spans white space; any other tokenizer file is given whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = (_shape(spec) == _WORD_PIPELINE and not any(" " in t for t in added)
                        and not any(t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"]))
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _bpe(self, pretoken: str) -> bytes:
        shown = pretoken if pretoken.isalpha() and pretoken.isascii() else \
            "".join([_BYTE_CHARS[b] for b in pretoken.encode()])
        return np.array([t.id for t in self.tok.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one lower-cased word; its pre-tokens have a cache of their own."""
        out = []
        for p in _PRETOKEN.findall(word):
            ids = self.pretokens.get(p)
            if ids is None:
                ids = self._bpe(p)
                if len(self.pretokens) < CACHE_WORDS and len(p) <= _LONG_WORD:
                    self.pretokens[p] = ids
            out.append(ids)
        ids = out[0] if len(out) == 1 else b"".join(out)
        if len(self.words) < CACHE_WORDS and len(word) <= _LONG_WORD:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if not self.by_word:
            return self._library([text])[0]
        if _BEYOND_LATIN.search(text) or self.added.search(text):
            words = _SPACE.split(text) if _ODD_CONTROL.search(text) else text.split()
            distinct = list(dict.fromkeys(words))
            known = dict(zip(distinct, self._library(distinct)))
            return b"".join([known[w] for w in words])
        low = text.lower()
        words = _SPACE.split(low) if _ODD_CONTROL.search(low) else low.split()
        got = list(map(self.words.get, words))
        if None in got:
            word = self._word
            got = [word(w) if g is None else g for w, g in zip(words, got)]
        return b"".join(got)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---- Spark jobs ------------------------------------------------------------------------

def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", planes: str = "byte", block_ids: int = BLOCK_IDS,
                 shard_ids: int = SHARD_IDS, level: int = 3) -> DataFrame:
    """Tokenise ``docs`` and write the shard files into ``folder`` (a URI that executors
    share).  Returns the shard list (file, part, shard, n_ids, n_docs), itself written
    below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        enc, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        writer = sink = tmp = None
        shard = 0

        def finish() -> pa.RecordBatch:
            writer.close()
            sink.close()
            name = f"part-{part:06d}-{shard:05d}.pbt"
            fs.move(tmp, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({
                "file": [name], "part": pa.array([part], pa.int64()), "shard": pa.array([shard], pa.int64()),
                "n_ids": pa.array([writer.n_ids], pa.int64()), "n_docs": pa.array([len(writer.docs)], pa.int64())})

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                if writer is None:
                    tmp = f"{base}/_tmp-{part:06d}-{shard:05d}-{attempt}"
                    sink = fs.open_output_stream(tmp)
                    writer = ShardWriter(sink, planes, block_ids, level)
                ids = np.frombuffer(enc.encode(t.as_py() or "") + end, "<u4")
                writer.add(d.as_py(), ids)
                if writer.n_ids >= shard_ids:
                    yield finish()
                    writer, shard = None, shard + 1
        if writer is not None:
            yield finish()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))
    ordered = (src.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
               .select("doc_id", "text"))
    out = map_arrow(ordered, run, "file string, part long, shard long, n_ids long, n_docs long")
    out.write.parquet(f"{folder}/_shards")
    return docs.sparkSession.read.parquet(f"{folder}/_shards")


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """Documents of the files in ``folder``: doc_id, start, n_tokens, ids_crc32, file and
    the offset within the file.  Each task reads whole shards of bounded size."""
    spark = shards.sparkSession
    schema = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                ids, at, n, crc = [], [], [], []
                for d, a, tokens in ShardReader(content.as_py()).documents():
                    ids.append(d)
                    at.append(a)
                    n.append(len(tokens))
                    crc.append(zlib.crc32(np.ascontiguousarray(tokens, "<u4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(at, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pbt")
             .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
             .select("path", "content"))
    return (map_arrow(files, run, schema).join(bases, "file")
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32",
                    "file", "local_start"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Write the corpus as token-plane files and return what the files hold per document."""
    folder = folder or shared_folder(docs.sparkSession, "token-planes")
    return read_documents(write_shards(docs, folder, tokenizer, end_id, **options), folder)
