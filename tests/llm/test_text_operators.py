"""Tokenisers, packing, personal data, fingerprints and exact copies against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

from weft.llm import bpe, exact_dedup, packing, pii, simhash  # noqa: E402
from weft.llm.registry import QUERIES  # noqa: E402

SPACE = "[\x20\x09-\x0d]"
LUHN_CARD, BAD_CARD = "4111 1111 1111 1111", "4111 1111 1111 1112"
ODD = [
    None,
    "",
    " ",
    "a",
    "a  b\n\n c \x00 d\t",
    "Ünï 漢字 🙂🙂 x" * 30,
    "word " * 9000,
    "1" * 30000,
    "." * 5000 + "@" * 50,
    f"Card {LUHN_CARD}, {BAD_CARD}; 4111-1111-1111-1111-1",
    "mail a.b+c@x-y.example.com_d@e.f, a@b, @x.y, 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255",
    "+49 (30) 123-4567 +1 2 +123456789012345678 tel 030 1234567 GB82 WEST 1234 5698 7654 32",
    "漢字 mail é@x.de 10.0.0.1 +44 20 7946 0958",
    "a.b.c.d." * 4000,
    "a@b" + ".c" * 6000,
    "x@" * 3000,
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = real + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(10_000, None), (10_003, "a"), (None, "a"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def key(row, *names):
    return tuple((row[n] is None, row[n]) for n in names)


def test_byte_bpe_is_what_tiktoken_gives(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for row in docs.collect():
        text = row["text"] or ""
        ids = exact.encode_ordinary(text)
        ends = np.cumsum([len(exact.decode_single_token_bytes(i)) for i in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
        inside = np.array([b & 0xC0 == 0x80 for b in text.encode()] + [False], dtype=bool)
        char = np.cumsum(~inside) - 1  # the character that each byte belongs to
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ids)]
        spans = np.concatenate([char[starts], char[ends] + inside[ends]]) if ids else starts
        digest = lambda x: hashlib.sha256(x).hexdigest()
        want.append((row["doc_id"], len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text.encode()), digest(spans.astype("<i4").tobytes())))
    got = bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    back = bpe.decode(coded, path, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)
    for row in coded.filter("id < 20").collect():
        assert len(row["starts"]) == len(row["ids"]) and all(a < b for a, b in zip(row["starts"], row["ends"]))
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_split_characters_and_offsets():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = bpe.ByteBpe(f.read(), public_tokenizers.PATTERN)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    draw = random.Random(3)
    for _ in range(1500):
        text = "".join(draw.choice(" \n\t\x00\x1c ab'sé1漢🙂.,-_THE") for _ in range(draw.randint(0, 30)))
        ids = own.encode(text)
        assert ids.tolist() == exact.encode_ordinary(text)
        assert own.decode(ids) == text and "".join(own.decode_stream([[i] for i in ids])) == text
        starts, ends = own.offsets(text, ids)
        for i, a, b in zip(ids, starts, ends):
            assert own.bytes_of[i] in text[a:b].encode()
    tokens = [t.decode() for t in own.ranks if len(t) > 1 and t.isascii()]
    for _ in range(3000):  # runs of tokens, which merge in other ways
        text = "".join(draw.choices(tokens, k=draw.randint(1, 6)))
        assert own.encode(text).tolist() == exact.encode_ordinary(text)
    for base in range(0, 0x110000, 64):  # the classes of every code point
        text = "".join(f"a{c}1{c} {c}.{c}{c}\n" for c in map(chr, range(base, base + 64)) if not "\ud800" <= c < "\ue000")
        assert own.tokenizer.encode(text, add_special_tokens=False).ids == exact.encode_ordinary(text)
    assert own.decode([own.ranks[b"\xe6"]]) == "�"
    assert len(set(bpe.byte_table())) == 256


def test_packing_holds_every_id_once(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    exact = Tokenizer.from_file(path)
    odd = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|> É", "<|endoftext|", " <|endoftext|>\n" * 50, "é<|endoftext|>\u0301 x"]
    docs = docs.union(spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    assert len(exact.encode(odd[0], add_special_tokens=False).ids) == 3
    want = sorted(np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs.collect())
    got = packing.pack_documents(docs, path).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["window"]))
        pieces.setdefault((r["id"], r["doc_tokens"]), []).append(r)
    padding = total = 0
    for rows in sequences.values():
        at = 0
        for offset, length, window in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert total == sum(len(x) // 4 for x in want) and padding <= 0.01 * total
    by_doc = {}
    for r in docs.collect():
        by_doc.setdefault(r["doc_id"], []).append(np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    for (doc, n), rows in pieces.items():
        raws = [x for x in by_doc[doc] if len(x) == 4 * n]
        assert sum(r["length"] for r in rows) == n * len(raws)
        assert all(any(zlib.crc32(x[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for x in raws) for r in rows)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_pack_lengths_and_step_groups():
    draw = random.Random(1)
    for n in (0, 1, 2, 50, 700):
        lengths = [draw.choice((1, 3, 200, 256, 1000, 2048, 5000)) + draw.randint(0, 60) for _ in range(n)]
        made = packing.pack_lengths(lengths)
        assert all(sum(k for _, _, k in row) == w and w & (w - 1) == 0 and w <= 2048 for w, row in made)
        seen = sorted((d, s, k) for _, row in made for d, s, k in row)
        at = dict.fromkeys(range(n), 0)
        for d, s, k in seen:
            assert s == at[d]
            at[d] += k
        assert [at[d] for d in range(n)] == lengths
        groups = packing.step_groups(made, 8192)
        cost = {}
        for g, (w, row) in zip(groups, made):
            cost.setdefault((w, g), []).append(sum(k * k for _, _, k in row))
        assert all(len(v) * w <= 8192 + w for (w, _), v in cost.items())


def test_exact_copies(spark, docs, monkeypatch):
    groups = {}
    for r in docs.collect():
        norm = re.sub(SPACE, "", r["text"] or "")
        groups.setdefault(norm, []).append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
    want = []
    for norm, rows in groups.items():
        rows.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        want += [(i, rows[0][2], len(rows), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, (_, _, i) in enumerate(rows)]
    got = exact_dedup.duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 4)  # most groups are not hot
    assert sorted(map(tuple, exact_dedup.duplicates(docs).collect()), key=repr) == sorted(want, key=repr)
    with monkeypatch.context() as m:  # comparisons decide: digests that all collide change nothing
        m.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.lit("collision"))
        clash = [tuple(r)[:4] for r in exact_dedup.duplicates(docs).collect()]
        assert sorted(clash, key=repr) == sorted((w[:4] for w in want), key=repr)
        assert exact_dedup.distinct_documents(docs).count() == len(groups)
    wide = docs.selectExpr("*", "1 as norm", "2 as sha", "3 as salt", "4 as _row", "5 as kept")
    stay = exact_dedup.distinct_documents(wide)
    assert stay.columns == wide.columns
    assert sorted(key(r, "doc_id")[0] for r in stay.collect()) == sorted((i is None, i) for i, _, _, kept, _ in want if kept)
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0 and exact_dedup.distinct_documents(docs.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def confirmed(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if confirmed(k, m[0])] for k, p in BASE.items()}


def test_personal_data(spark, docs):
    slow = {k for k, t in enumerate(ODD) if t and len(t) > 4000 and t[0] in ".a"}  # quadratic for the plain patterns
    want = {}
    for r in docs.filter(~docs.doc_id.isin([10_000 + k for k in slow]) | docs.doc_id.isNull()).collect():
        spans = base_spans(r["text"] or "")
        listing = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k])
        want.setdefault(r["doc_id"], set()).add((*(len(spans[k]) for k in BASE), hashlib.sha256(listing.encode()).hexdigest(), listing))
    for r in pii.digest(docs).collect():
        if r["id"] in want:
            own = {w for w in want[r["id"]] if w[:5] == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])}
            assert own, (r, want[r["id"]])
            assert any(r["spans"].startswith(w[5]) for w in own)
    assert pii.digest(docs.limit(0)).count() == 0
    got = {r["id"]: r["spans"] for r in pii.digest(docs.filter("doc_id = 10011")).collect()}[10_011]
    assert "iban:" in got and "local_phone:" in got


def test_redaction(spark):
    rows = [(1, f"é a@b.cd and {LUHN_CARD}.", 5), (2, None, 6), (3, "clean 12", 7), (4, "", 8), (5, f"bad {BAD_CARD}", 9)]
    done = {r["doc_id"]: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    assert done[1]["text"] == "é [EMAIL] and [CARD]." and done[1]["spans"] == 5
    assert done[2]["text"] is None and done[3]["text"] == "clean 12" and done[4]["text"] == "" and done[5]["text"] == f"bad {BAD_CARD}"


def test_many_matches_in_one_text(spark):
    """Long texts with many matches of one or several kinds: spans, order and redaction by brute force."""
    draw = random.Random(4)
    bits = ["a@b.cd ", "+49 30 1234567;", f"{LUHN_CARD}, ", "é1.2.3.4 ", "12,", "漢🙂", " x "]
    rows = [(1, "a@b.cd,é" * 100_000), (2, "12," * 100_000), (3, "".join(draw.choice(bits) for _ in range(30_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["id"]: r for r in pii.digest(frame).collect()}
    done = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    for k, text in rows:
        spans = base_spans(text)
        listing = ",".join(f"{kind}:{a}:{b}" for kind in BASE for a, b in spans[kind])
        assert got[k]["base_sha256"] == hashlib.sha256(listing.encode()).hexdigest() and got[k]["spans"].startswith(listing)
        assert [got[k][f"n_{kind}"] for kind in BASE] == [len(spans[kind]) for kind in BASE]
        every = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in got[k]["spans"].split(",") if x))
        out, at = [], 0
        for a, b, kind in every:
            out += [] if a < at else [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert done[k] == "".join(out) + text[at:]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_simhash(spark, docs):
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"] or "") for r in rows]
    want = sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r["doc_id"] for r in rows], fps))), key=repr)
    got = simhash.near_duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_survive_large_buckets(spark):
    """Chains, a ball of close fingerprints and noise, with buckets so small that they divide."""
    draw = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        f = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            fps.add(f)
            for _ in range(draw.randint(1, 4)):
                f ^= 1 << draw.randrange(64)
    centre = draw.getrandbits(64)
    for _ in range(150):
        fps.add(centre ^ (1 << draw.randrange(16)) ^ (1 << draw.randrange(64)))
    fps = sorted(fps)
    signed = lambda f: f - 2**64 if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {}
    for f, c in zip(fps, plain_components([signed(f) for f in fps], fps)):
        want[signed(f)] = c
    for bucket in (40, 4096):
        found = simhash.components(simhash.bucket_links(frame, bucket=bucket)).collect()
        got = {r["node"]: r["root"] for r in found}
        assert all(got.get(f, f) == c for f, c in want.items())


def test_queries_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_near_copies_by_similarity(spark):
    """Documents with a few words changed are found, others are not; recall is at least 0.9."""
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(3000)]
    rows, family = [], {}
    for k in range(120):
        text = [draw.choice(words) for _ in range(draw.randint(120, 400))]
        for c in range(draw.choice([1, 1, 2, 4])):
            own = list(text)
            for _ in range(len(own) // 60):
                own[draw.randrange(len(own))] = draw.choice(words)
            family[len(rows)] = k
            rows.append((len(rows), " ".join(own if c else text)))
    shingles = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    frame = spark.createDataFrame([*rows, (9000, None), (9001, ""), (9002, "a"), (9003, "a"), (None, "zz")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if family[a] == family[b] and alike(a, b) >= 0.8]
    assert len(pairs) > 40 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(family[i] == family[c] for i, c in got.items() if i is not None and i < 9000)
    assert got[9001] == 9000 and got[9003] == 9002 and got[None] is None
    kept = simhash.one_of_each(frame.selectExpr("*", "1 as node", "2 as w0")).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i, c in got.items() if i == c and i is not None)
    assert simhash.near_copies(frame.limit(0)).count() == 0
    small = {r["id"]: r["component_id"] for r in simhash.near_copies(frame, bucket=3, stars=0).collect()}
    assert sum(small[a] == small[b] for a, b in pairs) >= 0.9 * len(pairs)


def _copies(shape, share, pairs, seed):
    """Pairs of a text and its copy, edited in one shape over that share of the words, and their
    similarity in five-word shingles."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(4000)]
    fresh = lambda n: [draw.choice(words) for _ in range(n)]
    texts, alike = [], []
    for _ in range(pairs):
        a = fresh(draw.randint(200, 600))
        n = int(share * len(a))
        at = draw.randrange(len(a) - n)
        b = a + fresh(n) if shape == "appended" else a[:-n] if shape == "truncated" else a[:at] + fresh(n) + a[at + n :]
        texts += [" ".join(a), " ".join(b)]
        x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
        alike.append(len(x & y) / len(x | y))
    return texts, alike


def _roots(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component_id"] for r in simhash.near_copies(frame, **options).collect()}
    return [got[k] for k in range(len(texts))]


def test_near_copies_of_any_shape(spark):
    """Every pair at 0.8 or more is linked, whether text was added, cut off or replaced in one block."""
    texts, alike = [], []
    for seed, (shape, share) in enumerate((("appended", 0.22), ("truncated", 0.17), ("replaced", 0.085))):
        more, own = _copies(shape, share, 50, seed)
        texts, alike = texts + more, alike + own
    root = _roots(spark, texts, stars=0)
    linked = [root[2 * k] == root[2 * k + 1] for k in range(len(alike))]
    assert all(0.78 < x < 0.86 for x in alike) and sum(x >= 0.8 for x in alike) > 100
    assert linked == [x >= 0.8 for x in alike]


def test_near_copies_leave_clean_documents(spark):
    """Pairs below 0.8 stay apart, though most of their words are the same."""
    draw, texts, alike = random.Random(5), [], []
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(4000)]
    for k in range(60):
        a = [draw.choice(words) for _ in range(400)]
        b = list(a)
        for at in range(7, 400, 12 + k % 12):  # scattered single words
            b[at] = "zz"
        x, y = ({tuple(t[i : i + 5]) for i in range(396)} for t in (a, b))
        texts += [" ".join(a), " ".join(b)]
        alike.append(len(x & y) / len(x | y))
    root = _roots(spark, texts)
    assert max(alike) < 0.8 and min(alike) > 0.35 and sum(x > 0.6 for x in alike) > 10
    assert root == list(range(len(texts)))


def test_near_copies_in_large_buckets(spark):
    """Links of a hot group that shares long passages are the same in blocks of any size, and those
    of brute force; some do not go through the smallest member of their bucket."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(4000)]
    passage, texts = [draw.choice(words) for _ in range(150)], []
    for _ in range(60):  # members are about 0.6 alike, each with a copy at about 0.82
        own = passage + [draw.choice(words) for _ in range(50)]
        texts += [" ".join(own), " ".join(own[:182] + [draw.choice(words) for _ in range(18)])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    assert len(set(want)) == 60
    assert _roots(spark, texts, bucket=3, stars=0) == _roots(spark, texts) == want


def test_join_spread_splits_hot_keys(spark):
    """Rows of a key that holds most of a table meet their look-up row in many parts, each row once."""
    from pyspark.sql import functions as F

    from weft.llm.common import join_spread

    big = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("by"))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    lookup = big.select("k").distinct().filter("k <> 2999").select("k", F.array("k", F.lit(1)).alias("value"))
    rows = join_spread(big, counts, lookup, "k", "n", 3000, "by").collect()
    assert sorted(r.by for r in rows) == list(range(2999))
    assert all(list(r.value) == [r.k, 1] for r in rows) and set(rows[0].asDict()) == {"k", "by", "value"}
    assert join_spread(big.limit(0), counts.limit(0), lookup, "k", "n", 0, "by").count() == 0
