"""Byte-level BPE encoding and decoding through a sentencepiece model serialised straight from a rank file.

The rank file's byte strings become pieces of printable characters, one character for each byte, scored by the negative
rank.  With identity normalisation and no dummy prefix, sentencepiece then merges a pre-token's bytes in rank order.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

UNKNOWN = "<unk>"


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where printable Latin-1, else the next one from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive from 0")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited, varint or 32-bit float by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: ids are ranks, and one more id for the unknown piece that none can reach."""
    chars = byte_chars()
    out = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-rank))) for rank, t in enumerate(tokens)]
    out.append(_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2)))
    # trainer_spec: model_type BPE, vocab_size, ids of unk, bos, eos and pad (absent ones are -1 as 64-bit varints)
    absent = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    # normalizer_spec: identity, no dummy prefix, white space kept and not escaped
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encodes texts in one Python worker; each distinct pre-token is merged once while the cache holds it."""

    def __init__(self, proto: bytes, pattern: str, cache: int = 150_000):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.cache, self.char = cache, byte_chars().__getitem__
        self.whole = {self.model.id_to_piece(i): i for i in range(self.model.get_piece_size())}
        self.known: dict[str, bytes] = {}

    def learn(self, pretokens: set[str]) -> None:
        """A pre-token that is in the vocabulary as a whole is one token; the others are merged."""
        if len(self.known) > self.cache:
            self.known.clear()
        new = list(pretokens.difference(self.known))
        mapped = ["".join(map(self.char, p.encode())) for p in new]
        for p, m, ids in zip(new, mapped, self.model.encode(mapped, out_type=int, num_threads=1) if new else []):
            self.known[p] = array("i", [self.whole[m]] if m in self.whole else ids).tobytes()

    def encode(self, texts: list[str | None], chunk: int = 1 << 19) -> Iterator[bytes]:
        """The ids of each text as 32-bit integers, one after the other; learns ``chunk`` characters' words at a time."""
        held, n = [], 0
        for i, t in enumerate(texts):
            held.append(self.split(t or ""))
            n += len(t or "")
            if n >= chunk or i + 1 == len(texts):
                self.learn(set().union(*held))
                for pretokens in held:
                    yield b"".join(map(self.known.__getitem__, pretokens))
                held, n = [], 0


class Decoder:
    """Maps ids back to the bytes of their tokens."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens])
        self.start, self.content = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), "u1")

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of the runs of ``ids`` between each two of ``ends``."""
        size = self.size[ids]
        to = np.concatenate([[0], np.cumsum(size)])  # the place of each id's bytes in the output
        out = self.content[np.repeat(self.start[ids] - to[:-1], size) + np.arange(to[-1])].tobytes()
        cuts = to[ends].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _id_lists(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    parts = list(encoder.encode(texts.to_pylist()))
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def _pieces(array: pa.Array, rows: int = 256) -> Iterator[pa.Array]:
    """Slices of few rows, so that no more than a few texts' ids are held besides the batch itself."""
    for at in range(0, max(len(array), 1), rows):
        yield array[at : at + rows]


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row's whole text.

    Null and empty texts give an empty array.  Repeated rows and null keys are kept, row for row; other columns are
    ignored.  The rank file is read on the driver; its model (about 1 MB, fixed by the file) is sent with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(rank_file)))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value, pattern)
        for texts in batches:
            yield pa.concat_arrays([_id_lists(encoder, t) for t in _pieces(texts)])

    return in_small_batches(docs).select(key, ids(F.col(text)).alias("ids"))


def decode(encoded: DataFrame, rank_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) from arrays of ids; null arrays decode to the empty string of bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for arrays in batches:
            parts = []
            for a in _pieces(arrays):
                ends = np.cumsum([0, *pc.list_value_length(a).to_pylist()])
                parts += decoder.decode(a.flatten().to_numpy(), ends)
            yield pa.array(parts, pa.binary())

    return in_small_batches(encoded).select(key, decoded(F.coalesce(ids, F.array().cast("array<int>"))).alias("decoded"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode and then decode the ids, as the two functions above do, in one pass of one worker."""
    tokens = read_ranks(rank_file)
    shared = docs.sparkSession.sparkContext.broadcast((model_proto(tokens), tokens))

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(shared.value[0], pattern), Decoder(shared.value[1])
        for texts in batches:
            ids, decoded = [], []
            for t in _pieces(texts):
                ids.append(_id_lists(encoder, t))
                decoded += decoder.decode(ids[-1].values.to_numpy(), ids[-1].offsets.to_numpy())
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.array(decoded, pa.binary())], ["ids", "decoded"])

    return in_small_batches(docs).select(key, both(F.col(text)).alias("_b")).select(key, "_b.ids", "_b.decoded")


def with_digests(both: DataFrame) -> DataFrame:
    """A round trip's rows with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    return both.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.translate(F.col("ids").cast("string"), "[] ", "").cast("binary"), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    )
