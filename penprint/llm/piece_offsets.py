"""Operator 2: SentencePiece encoding and decoding that keeps source offsets.

Normalisation follows the model's compiled character map: at each position the longest key
of its double-array trie is replaced by the mapped string, and every normalised byte
records the source byte at which its key began.  The library's ids cut the normalised text
into pieces; a piece's byte range, read through that alignment, is its span in the source
text.  Ids and decoding are the ``sentencepiece`` library's own.

Cost: the identity map is aligned with array operations.  Where no vocabulary piece joins a
character to a following space mark, or holds a line break (checked when the model is
loaded), ids of a text are those of its space-led segments, and each distinct segment goes
through the library once per cache life; other models, and texts holding the space mark
itself, are encoded whole.  Tasks stream rows and emit batches of bounded text; no shuffle.

Defined cases: a null text is empty and has no pieces; a piece inside a multi-byte character
has an empty span but for the last, which covers the character; the dummy prefix has an
empty span; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.llm.common import map_arrow, utf8

MARK = "▁".encode()
CACHE_SEGMENTS = 400_000
_LONG_SEGMENT = 64
_SEGMENT = re.compile(r"\n| *[^ \n]+| +")
_BATCH_BYTES = 2_000_000


class CharacterMap:
    """A compiled character map: a double-array trie over source keys and its strings."""

    def __init__(self, blob: bytes):
        n, = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
        self.strings = blob[4 + n:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and what it becomes."""
        units = self.units
        node = self._offset(units[0])
        best = None
        for k in range(at, len(raw)):
            byte = raw[k]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                best = k - at + 1, start
        if best is None:
            return None
        n, start = best
        return n, self.strings[start:self.strings.index(b"\0", start)]


def _char_length(raw: bytes, at: int) -> int:
    lead = raw[at]
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceEncoder:
    """Ids, source spans and decoded text of one SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = (spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                                                  spec.escape_whitespaces)
        kinds = model.SentencePiece
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), -1)
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL
                               else len(p.piece.encode()) for p in model.pieces])
        normal = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        self.user = sorted((p.piece.encode() for p in model.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.by_segment = (
            model.trainer_spec.model_type == model.trainer_spec.BPE and model.trainer_spec.byte_fallback
            and self.map is None and self.prefix and self.escape and not self.squeeze and not self.user
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any("\n" in p or " " in p or re.search("[^▁]▁", p) for p in normal))
        self.lead = len(self.sp.encode("\n")) if self.by_segment else 0
        self.cache: dict[str, bytes] = {"\n": self._ints(self.sp.encode("\n")[-1:])} if self.by_segment else {}

    @staticmethod
    def _ints(ids: list[int]) -> bytes:
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text or not self.by_segment or "▁" in text:
            return np.array(self.sp.encode(text), np.int32)
        segments = _SEGMENT.findall(" " + text)
        got = list(map(self.cache.get, segments))
        if None in got:
            new = list(dict.fromkeys(s for s, g in zip(segments, got) if g is None))
            # Led by a line break, a segment gets no dummy prefix of its own.
            ids = self.sp.encode(["\n" + s for s in new], num_threads=1)
            fresh = {s: self._ints(x[self.lead:]) for s, x in zip(new, ids)}
            got = [fresh[s] if g is None else g for s, g in zip(segments, got)]
            if len(self.cache) < CACHE_SEGMENTS:
                self.cache.update((s, b) for s, b in fresh.items() if len(s) <= _LONG_SEGMENT)
        return np.frombuffer(b"".join(got), "<i4")

    def align(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the source byte its key began at."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze and not self.user:
            src = np.frombuffer(raw, np.uint8)
            at = np.arange(len(src))
            at = np.maximum.accumulate(np.where((src & 0xC0) == 0x80, 0, at))
            if self.escape:
                at = np.repeat(at, np.where(src == 0x20, len(MARK), 1))
                raw_out = raw.replace(b" ", MARK)
            else:
                raw_out = raw
            space = MARK if self.escape else b" "
            lead = space if self.prefix else b""
            return lead + raw_out, np.concatenate([np.zeros(len(lead), np.int64), at, [len(src)]])
        return self._align_mapped(raw)

    def _next(self, raw: bytes, at: int) -> tuple[int, bytes]:
        for u in self.user:
            if raw.startswith(u, at):
                return len(u), u
        hit = self.map.longest(raw, at) if self.map else None
        if hit is None:
            n = _char_length(raw, at)
            return n, raw[at:at + n]
        return hit

    def _align_mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        space = MARK if self.escape else b" "
        at, out, back = 0, bytearray(), []
        if self.squeeze:
            while at < len(raw):
                n, to = self._next(raw, at)
                if to != b" ":
                    break
                at += n
            if at == len(raw):
                return b"", np.array([at])
        if self.prefix:
            out += space
            back += [at] * len(space)
        after_space = self.squeeze
        while at < len(raw):
            n, to = self._next(raw, at)
            if after_space:
                to = to.lstrip(b" ")
            if to:
                shown = to.replace(b" ", space)
                out += shown
                back += [at] * len(shown)
                after_space = to.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        end = at
        if self.squeeze:
            while out.endswith(space):
                end = back[len(out) - len(space)]
                del out[-len(space):], back[len(out):]
        return bytes(out), np.array(back + [end])

    def spans(self, text: str, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte range of every piece."""
        normal, back = self.align(raw)
        width = self.width[ids]
        if self.unknown in ids:
            width = np.array([1 if self.sp.is_byte(int(i)) else len(p.encode())
                              for i, p in zip(ids, self.sp.encode(text, out_type=str))])
        ends = np.cumsum(width)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return back[ends - width], back[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist()) if len(ids) else ""


_LOADED: dict[str, PieceEncoder] = {}


def loaded(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins and ends (source byte span of each piece) and the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = loaded(model)

        def emit(keys, parts, decoded) -> pa.RecordBatch:
            sizes = [len(x[0]) for x in parts]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in parts]).astype(np.int32)))
                     for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists, pa.array(decoded, pa.string())],
                                              names=["doc_id", "ids", "begins", "ends", "decoded"])

        for batch in batches:
            keys, parts, decoded, held = [], [], [], 0
            for d, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_py()
                text = raw.decode("utf-8", "replace")
                ids = enc.encode(text)
                keys.append(d.as_py())
                parts.append((ids, *enc.spans(text, raw, ids)))
                decoded.append(enc.decode(ids))
                held += len(raw)
                if held >= _BATCH_BYTES:
                    yield emit(keys, parts, decoded)
                    keys, parts, decoded, held = [], [], [], 0
            if keys:
                yield emit(keys, parts, decoded)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw"))
    return map_arrow(rows, run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def ids_text(ids: str | Column) -> Column:
    """Ids as decimal text joined by commas."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat_ws(",", c.cast("array<string>"))


def piece_digests(docs: DataFrame, model: str, **columns) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes (source bytes the spans reach)."""
    found = encode_pieces(docs, model, **columns)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"))
