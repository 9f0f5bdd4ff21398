"""SentencePiece encoding and decoding with offsets into the original bytes.

The text is normalised first: at each position the longest prefix found in the model's compiled character map is
replaced, other characters stand for themselves, spaces become U+2581 and a dummy prefix is put before, as the model's
normaliser settings say. For every normalised byte the source byte is recorded. The library segments the result into
pieces, whose lengths in normalised bytes project each piece to a span of original bytes.

As no piece of such a model has a space mark after another character, merges never cross from a word to the space
after it: the text is encoded in chunks of spaces and what follows them, each chunk once per cache (bounded in each
Python worker). A model for which this does not hold is encoded text by text.

Nulls are empty texts; an empty text has the begin and end ids only. One row out for each row in, ids kept as they are, as
are repeated rows. Whole texts are read, however long. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, slices, table

MARK = "▁"
CACHE = 300_000
_CHUNK = re.compile(" +[^ ]*")


class CharMap:
    """A compiled character map: a double-array trie of source strings, then the zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.pool = np.zeros(0, np.uint32), b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source string that starts at `at`."""
        if not len(self.units):
            return None
        units, found = self.units, None
        node = self._child(0, int(units[0]))
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != data[k]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                found = (k + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


class Normaliser:
    """The settings of a model's normaliser. normalise() gives the text with marks, and a source byte for each byte and for the end.

    What the character map replaces has the source byte at which the replaced string starts; bytes that stand for themselves
    have their own. Symbols that the model's user defined are not normalised.
    """

    def __init__(self, spec, suffix: bool = False, symbols: tuple[str, ...] = ()):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.symbols: dict[int, list[bytes]] = {}
        for symbol in sorted((s.encode() for s in symbols if s), key=len, reverse=True):
            self.symbols.setdefault(symbol[0], []).append(symbol)
        self.plain = not spec.precompiled_charsmap and not self.symbols and not self.squeeze and self.escape and self.prefix and not suffix

    def _char(self, data: bytes, at: int) -> tuple[int, bytes, bool]:
        """How many bytes are read, what they become, and whether they stand for themselves."""
        for symbol in self.symbols.get(data[at], ()):
            if data.startswith(symbol, at):
                return len(symbol), symbol, True
        if hit := self.map.longest(data, at):
            return *hit, False
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n], True

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        return self._of_spaces(data) if self.plain else self._of_all(data)

    def _of_spaces(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Where the map is empty: marks for spaces and before the text, all else as it is."""
        if not data:
            return b"", np.array([0])
        mark, raw = MARK.encode(), np.frombuffer(data, np.uint8)
        own = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(mark), 1))
        return mark + data.replace(b" ", mark), np.concatenate([[0] * len(mark), own, [len(raw)]])

    def _of_all(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, source = bytearray(), []
        at, space = 0, MARK.encode() if self.escape else b" "
        if self.squeeze:
            while at < len(data):
                n, made, _ = self._char(data, at)
                if made.strip(b" "):
                    break
                at += n
        if at == len(data):
            return b"", np.array([at])

        def put(piece: bytes, of: int, own: bool = False) -> None:
            out.extend(piece)
            source.extend(range(of, of + len(piece)) if own else [of] * len(piece))

        if self.prefix and not self.suffix:
            put(space, at)
        blank = self.squeeze
        while at < len(data):
            n, made, own = self._char(data, at)
            if self.squeeze and blank:
                made = made.lstrip(b" ")
            if made:
                put(made.replace(b" ", space), at, own and b" " not in made)
                blank = self.squeeze and made.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix:
            put(space, at)
        return bytes(out), np.array([*source, at], np.int64)


class Pieces:
    """A model, with the chunks that it has met in this worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = type(proto.pieces[0])
        symbols = tuple(p.piece for p in proto.pieces if p.type == kinds.USER_DEFINED)
        self.normaliser = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix, symbols)
        self.lengths = np.array([1 if p.type == kinds.BYTE else 0 if p.type == kinds.CONTROL else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.begin, self.end, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.chunked = self.normaliser.plain and proto.trainer_spec.byte_fallback and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.mark = self.library.piece_to_id(MARK)
        self.cache: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text, begin and end ids included."""
        if not self.chunked:
            return [np.array([self.begin, *x, self.end], np.uint32) for x in self.library.encode(texts, num_threads=1)]
        chunks = [_CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = list({c for own in chunks for c in own if c not in cache})
        for c, got in zip(new, self.library.encode([c[1:] for c in new], num_threads=1), strict=True):
            cache[c] = np.array(got if len(c) > 1 else [self.mark], np.uint32).tobytes()
        first, last = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        return [np.frombuffer(b"".join([first, *[cache[c] for c in own], last]), np.uint32) for own in chunks]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in the original bytes; the begin id lies at the start, the end id at the end."""
        source = self.normaliser.normalise(text)[1]
        lengths = self.lengths[ids]
        if (ids == self.unk).any():  # its length is that of what no piece covers
            pieces = self.library.encode(text, out_type="immutable_proto").pieces
            lengths = np.array([0, *[len(p.piece.encode()) for p in pieces], 0], np.int64)
        ends = np.minimum(np.cumsum(lengths), len(source) - 1)
        return source[np.concatenate([[0], ends[:-1]])], source[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_LOADED: dict[str, Pieces] = {}


def _model(path: str | None) -> Pieces:
    """The model of a worker; without a path the default one, found on the worker's own machine."""
    path = path or default_model()
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text, with the start and end of each piece in the original bytes."""

    def run(batches):
        m = _model(model)
        for batch in slices(batches, 64):
            texts = as_strings(batch.column(1))
            ids = m.ids(texts)
            spans = [m.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), *(pa.array([s[k].tolist() for s in spans], pa.list_(pa.int64())) for k in (0, 1))], [id_col, "ids", "starts", "ends"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, model: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The library's text for each list of ids; a null list is an empty one."""

    def run(batches):
        m = _model(model)
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.library.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, model: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number and digest of its ids, the digest of what they decode to, and that of the pieces' spans."""

    def run(batches):
        m = _model(model)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches, 64):
            texts = as_strings(batch.column(1))
            ids = m.ids(texts)
            spans = [np.stack(m.spans(t, x), 1).astype("<u4") for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids]), pa.array([sha(m.decode(x).encode()) for x in ids]), pa.array([sha(s.tobytes()) for s in spans])],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
