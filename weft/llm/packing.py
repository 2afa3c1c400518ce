"""Hierarchical multi-length packing of documents into training sequences.

Each document's ids (plus an end id) are cut into full windows of the longest tier; what is left is
routed to the smallest tier it fits (:class:`Tiers`). Tiers are packed from the longest down. A piece
takes over half of its tier's window (but in the shortest tier), so the gap it leaves is filled from
shorter tiers: with the longest whole piece that fits, again and again, and closed by a cut of the
shortest piece that is longer, whose rest is routed anew. A window therefore ends exactly full, at a
tier's length; the last one of a buffer is cut at powers of two, which need no padding either. Sequences of one
tier are dealt to step groups of about equal attention cost (the sum of squared piece lengths).

A task packs its own rows, in buffers of a bounded number of tokens, so nothing is shuffled and no
task holds more than a buffer. Sequence and group ids carry the partition number.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed one by
one; strings of the file's special tokens inside a text become those tokens' ids, as the library's
plain ``encode`` does it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from struct import pack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import whole
from weft.runtime import ship

TIERS = (256, 512, 1024, 2048)
END_ID = 1
BUFFER_TOKENS = 1_000_000
STEP_TOKENS = 65_536
CACHE_ENTRIES = 500_000
LONGEST_CACHED = 64
_MADE: dict = {}


class WordEncoder:
    """A tokenizers file whose pieces never span white space; chunks between it are cached as ids.

    Strings of the file's added tokens become their ids where they stand in a text, as the library
    does it: a text is cut at them before anything else, and only what lies between is ordinary. A
    file whose added tokens strip space, want word ends or are normalised is given whole texts.
    """

    _latin = re.compile(r"[^\x00-ɏ]")

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(raw.decode())
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True  # of ordinary parts: lower case may make such a string
        added = self.whole.get_added_tokens_decoder()
        self.added = {t.content: pack("<I", i) for i, t in added.items()}
        self.plain = all(t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        self.at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.lower = self.tokenizer.encode("Word Ñ", add_special_tokens=False).ids == self.tokenizer.encode("word ñ", add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {"": b""}

    def encode_raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.plain:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        if self.at and any(map(text.__contains__, self.added)):
            parts = self.at.split(text)
            return b"".join(self.added[part] if k % 2 else self._ordinary(part) for k, part in enumerate(parts))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if self.lower and not self._latin.search(text):  # no combining marks: case first changes nothing
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            pass
        missing = list(set(chunks).difference(self.cache))
        learned = {c: pack(f"<{len(ids)}I", *ids) for c, ids in zip(missing, (e.ids for e in self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)))}
        full = len(self.cache) >= CACHE_ENTRIES  # the frequent chunks come early; what comes after is not kept
        self.cache.update(learned)
        out = b"".join(map(self.cache.__getitem__, chunks))
        for x in missing:
            if full or len(x) > LONGEST_CACHED:
                del self.cache[x]
        return out


def encoder(raw: bytes) -> WordEncoder:
    key = hashlib.sha256(raw).digest()
    if key not in _MADE:
        _MADE[key] = WordEncoder(raw)
    return _MADE[key]


Piece = tuple[int, int, int]  # length, document, start


class Tiers:
    """Left-overs by the smallest tier that holds them, each tier sorted by length."""

    def __init__(self, tiers: tuple[int, ...], pieces: list[Piece]):
        self.tiers = tiers
        self.pools: list[list[Piece]] = [[] for _ in tiers]
        for piece in pieces:
            self.pools[self.route(piece[0])].append(piece)
        for pool in self.pools:
            pool.sort()

    def route(self, length: int) -> int:
        return bisect_left(self.tiers, length)

    def add(self, piece: Piece) -> None:
        insort(self.pools[self.route(piece[0])], piece)

    def fitting(self, gap: int) -> Piece | None:
        """The longest piece that fits the gap, from the gap's own tier or the next shorter ones."""
        for tier in range(self.route(gap), -1, -1):
            k = bisect_right(self.pools[tier], (gap, sys.maxsize, 0))
            if k:
                return self.pools[tier].pop(k - 1)
        return None

    def longer(self, gap: int) -> Piece | None:
        """The shortest piece that is longer than the gap; none shorter is left when this is asked."""
        return next((pool.pop(0) for pool in self.pools[self.route(gap) :] if pool), None)


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences ``(window, [(document, start, length), ...])`` that hold every token once."""
    longest = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    left_over: list[Piece] = []
    for doc, n in enumerate(lengths):
        for at in range(0, n - longest + 1, longest):
            out.append((longest, [(doc, at, longest)]))
        if n % longest:
            left_over.append((n % longest, doc, n - n % longest))
    routed = Tiers(tiers, left_over)
    for tier in range(len(tiers) - 1, -1, -1):
        window = tiers[tier]
        while routed.pools[tier]:
            n, doc, at = routed.pools[tier].pop()
            row, gap = [(doc, at, n)], window - n
            while gap:
                if piece := routed.fitting(gap):
                    n, doc, at = piece
                    row.append((doc, at, n))
                    gap -= n
                elif piece := routed.longer(gap):
                    n, doc, at = piece
                    row.append((doc, at, gap))
                    routed.add((n - gap, doc, at + gap))
                    gap = 0
                else:
                    break
            out += [(window, row)] if not gap else _by_powers(row, window - gap)
    return out


def _by_powers(row: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The last, unfilled window of a buffer, cut at powers of two."""
    out = []
    while row:
        window = 1 << (total.bit_length() - 1)
        part, room = [], window
        while room:
            doc, at, n = row.pop(0)
            if n > room:
                row.insert(0, (doc, at + room, n - room))
                n = room
            part.append((doc, at, n))
            room -= n
        out.append((window, part))
        total -= window
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence: each window length is dealt, heaviest first and back and
    forth, to groups of about ``step_tokens`` tokens."""
    out, first = [0] * len(sequences), 0
    for window in sorted({w for w, _ in sequences}, reverse=True):
        own = sorted((i for i, (w, _) in enumerate(sequences) if w == window), key=lambda i: -sum(n * n for _, _, n in sequences[i][1]))
        groups = max(1, -(-len(own) * window // step_tokens))
        for k, i in enumerate(own):
            turn, at = divmod(k, groups)
            out[i] = first + (at if turn % 2 == 0 else groups - 1 - at)
        first += groups
    return out


def pack_documents(df: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window,
    step_group``. Tiers are powers of two in ascending order."""
    spark = df.sparkSession
    ship(spark)
    with open(vocab, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a fixed size
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = pack("<I", end_id)

    def run(batches):
        words = encoder(raw.value)
        base = TaskContext.get().partitionId() << 36
        made = groups = 0

        def flush(ids, docs):
            nonlocal made, groups
            sequences = pack_lengths([len(d) // 4 for d in docs], tiers)
            group = step_groups(sequences, step_tokens)
            cols: list[list] = [[] for _ in range(8)]
            owner = []
            for k, (window, row) in enumerate(sequences):
                at = 0
                for doc, start, n in row:
                    owner.append(doc)
                    for c, v in zip(cols, (start, n, zlib.crc32(docs[doc][4 * start : 4 * (start + n)]), len(docs[doc]) // 4, base + made + k, at, window, base + groups + group[k])):
                        c.append(v)
                    at += n
            made += len(sequences)
            groups += max(group, default=-1) + 1
            taken = pa.concat_arrays(ids).take(pa.array(owner, pa.int64()))
            return pa.RecordBatch.from_arrays([taken, *(pa.array(c, pa.int64()) for c in cols)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"])

        ids: list = []
        docs: list[bytes] = []
        size = 0
        for batch in batches:
            texts = batch.column("text")
            done = 0
            for k in range(batch.num_rows):
                docs.append(words.encode_raw(texts[k].as_py()) + end)
                size += len(docs[-1]) // 4
                if size >= BUFFER_TOKENS:
                    ids.append(batch.column("id").slice(done, k + 1 - done))
                    yield flush(ids, docs)
                    ids, docs, size, done = [], [], 0, k + 1
            if done < batch.num_rows:
                ids.append(batch.column("id").slice(done))
        if docs:
            yield flush(ids, docs)

    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long")
