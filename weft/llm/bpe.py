"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut where no match of the pre-tokenisation pattern can span (before a single space that
starts a word); every distinct chunk is encoded once per worker by the library and its ids are kept
as little-endian bytes, so a text costs one dictionary look-up a chunk.

The library's model is made from the rank file: each byte becomes its printable character, and each
token's merge is the pair that is left of its bytes after all merges of a lower rank. No other pair
can ever form the token (a merge across its borders would have removed them for good), and a match
that is a token as a whole is taken unmerged, so ids are those of the rank-order merge; tests compare
them with tiktoken, also for every code point.

Decoding looks up each id's characters in the library's vocabulary and reverses the byte table; the
table from ids to bytes is made once a worker. Offsets need no second pass: every id stands for a
fixed byte string, so byte offsets are a running sum of lengths and character offsets count the UTF-8
lead bytes before them. A token that starts or ends inside a character gets the offsets of that
character.

Defined results: null text is the empty text; the empty text has no ids; invalid id sequences decode
with U+FFFD for the broken bytes; decoding a split character across chunks of ids waits for its
remaining bytes (:meth:`ByteBpe.decode_stream`).
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import whole
from weft.runtime import ship

CACHE_ENTRIES = 500_000
LONGEST_CACHED = 64
_MADE: dict = {}


def byte_table() -> list[str]:
    """The printable stand-in character of each byte: printable bytes stand for themselves, the
    others take the code points from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that forms each token, in rank order: what is left of its bytes after every merge
    of a lower rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    #: A space that another white space (or the end) follows, or a NUL: then cut with care.
    _odd = re.compile(r" (?:[\s\x1c-\x1f\x85]|$)|\x00")
    #: Safe places to cut in any text: before a space that a letter or digit follows.
    _cut = re.compile(r"(?= [^\W_])")

    def __init__(self, raw: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.ranks = read_ranks(raw)
        chars = byte_table()
        show = lambda b: "".join(chars[x] for x in b)
        model = models.BPE(vocab={show(k): v for k, v in self.ranks.items()}, merges=[(show(a), show(b)) for a, b in merges_of(self.ranks)], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token))
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.cache: dict[str, bytes] = {"": b""}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        done = (x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False))
        return {chunk: pack(f"<{len(ids)}I", *ids) for chunk, ids in zip(chunks, done)}

    def chunks(self, text: str) -> list[str]:
        if self._odd.search(text):
            return self._cut.split(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode_raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks = self.chunks(text)
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            pass
        missing = list(set(chunks).difference(self.cache))
        learned = self._learn(missing)
        full = len(self.cache) >= CACHE_ENTRIES  # the frequent chunks come early; what comes after is not kept
        self.cache.update(learned)
        out = b"".join(map(self.cache.__getitem__, chunks))
        for x in missing:
            if full or len(x) > LONGEST_CACHED:
                del self.cache[x]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_raw(text), dtype="<u4")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character start and end (exclusive) of each id's bytes in ``text``."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        ends = np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        starts = ends - self.lengths[ids] if len(ids) else ends
        inside = (raw & 0xC0) == 0x80
        split = np.concatenate([inside, [False]])
        return before[starts] - split[starts], before[ends]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of each part of an id sequence; bytes of a character split between parts wait."""
        step = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield step.decode(self.decode_bytes(ids))
        yield step.decode(b"", True)


def codec(raw: bytes, pattern: str) -> ByteBpe:
    """One codec a worker process."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _MADE:
        _MADE[key] = ByteBpe(raw, pattern)
    return _MADE[key]


def _prepare(df: DataFrame, id_col: str, text_col: str, vocab: str):
    ship(df.sparkSession)
    with open(vocab, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a fixed size
    return df.select(F.col(id_col).alias("id"), whole(text_col).alias("text")), raw


def encode(df: DataFrame, vocab: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, starts array<int>, ends array<int>`` for every row; character offsets."""
    rows, raw = _prepare(df, id_col, text_col, vocab)

    def run(batches):
        bpe = codec(raw.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                spans = [bpe.offsets(t, i) for t, i in zip(part.column("text").to_pylist(), ids)]
                make = lambda xs: pa.array([np.asarray(x, dtype=np.int32) for x in xs], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), make(ids), make([s for s, _ in spans]), make([e for _, e in spans])], ["id", "ids", "starts", "ends"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, vocab: str, pattern: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` from id lists; null ids give the empty text."""
    ship(df.sparkSession)
    with open(vocab, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        bpe = codec(raw.value, pattern)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, type=pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, vocab: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both and of the offsets (all
    starts, then all ends, as little-endian 32-bit integers): ``id, n_tokens, ids_sha256,
    decoded_sha256, offsets_sha256``."""
    rows, ranks = _prepare(df, id_col, text_col, vocab)

    def run(batches):
        bpe = codec(ranks.value, pattern)
        for batch in batches:
            n, digests = [], []
            for value in batch.column("text"):
                text = value.as_py()
                raw = bpe.encode_raw(text)
                ids = np.frombuffer(raw, dtype="<u4")
                spans = np.concatenate(bpe.offsets(text, ids)).astype("<i4")
                n.append(len(ids))
                digests.append([hashlib.sha256(x).hexdigest() for x in (raw, bpe.decode_bytes(ids.tolist()), spans.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in range(3))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
