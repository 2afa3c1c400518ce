"""Near-duplicates by SimHash with pivot distance tables.

A fingerprint has a bit set where more than half of a document's shingle hashes have it. Two
fingerprints are linked when they differ in at most ``BITS`` places. Equal fingerprints are one
class from the start. Classes meet in buckets that agree in one of ``BITS + 1`` blocks of bits (two
linked fingerprints agree in at least one); a bucket with more than ``BUCKET`` classes is divided by
blocks of its remaining bits, again and again — since its members are distinct and agree in all
other bits, it must fit once few bits remain, so there is no cap and no lost link. In a bucket a
table of Hamming distances to reference fingerprints is made; the first coordinate sorts it, pairs
that differ by more than ``BITS`` in any coordinate are discarded, and survivors are verified. A
bucket hands on a spanning forest of its links, never its pairs. Components come from alternating
large-star and small-star rounds over that forest.

Pivot distances alone cannot list candidates in less than quadratic time (random fingerprints all
lie about 32 bits from any pivot), so they filter within buckets.

Defined results: null or wordless text has fingerprint zero and is linked like any other; a text
with fewer words than a shingle is one shingle; null ids never become a component's id while it has
another; repeated rows belong to one component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import join_lookup, join_spread, whole
from weft.runtime import materialize, ship

BITS = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
PIVOTS = 16
#: For near copies by similarity: words of a shingle, bands of a MinHash signature and places of
#: each, members of a block when pairs are dealt out, and rounds of stars before that.
WIDE_SHINGLE, BANDS, ROWS, BLOCK, STARS = 5, 48, 6, 256, 1
#: Shingles of a text that are hashed to bits at a time.
CHUNK = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    from xxhash import xxh64_digest

    words = text.encode().translate(_LOWER).split()  # splits at [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), SEED), "big")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):  # a bounded table of bits, however long the text
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), ends[at + shingle - 1 : at + shingle - 1 + CHUNK].tolist())
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, fp`` (signed) for every row."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS, words: int = 1) -> np.ndarray:
    """Reference fingerprints, drawn once with a fixed seed."""
    return np.random.default_rng(SEED).integers(0, 2**64, (n, words), dtype=np.uint64)


def links(fps: np.ndarray, bucket: np.ndarray, bits: int = BITS, refs: np.ndarray | None = None):
    """Yield index pairs of fingerprints of one bucket at ``bits`` or fewer differing bits, in parts."""
    fps = fps.reshape(len(fps), -1)  # a row a fingerprint, a column for each 64 bits
    refs = pivots(words=fps.shape[1]) if refs is None else refs
    table = np.stack([np.bitwise_count(fps ^ r).sum(axis=1, dtype=np.int16) for r in refs], axis=1)
    place = np.unique(bucket, return_inverse=True)[1] * 4096 + table[:, 0]  # by bucket, then by the first distance
    order = np.argsort(place, kind="stable")
    fps, table, place = fps[order], table[order], place[order]
    count = np.searchsorted(place, place + bits, side="right") - np.arange(len(fps)) - 1
    done = np.cumsum(count)
    at, room = 0, 2_000_000 // fps.shape[1]
    while at < len(fps):  # rows whose windows hold so many pairs
        past = done[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(done, past + room, side="right")))
        own = count[at:stop]
        i = np.repeat(np.arange(at, stop), own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + i + 1
        for k in range(1, table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, k] - table[j, k]) <= bits
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= bits
        yield order[i[near]], order[j[near]]
        at = stop


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each node reaches over the pairs and what ``label`` has joined."""
    nodes = np.arange(len(label))
    i, j = np.concatenate([i, nodes]), np.concatenate([j, label])
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(free), parts)]


def _nested(free: list[int], bits: int) -> list[tuple[int, int, list]]:
    """Blocks of the free bits of one word, one of which two linked fingerprints must agree in."""
    out = []
    for block in np.array_split(np.array(free), bits + 1):
        mask = sum(1 << int(b) for b in block)
        out.append((0, mask, [b for b in free if b not in set(block.tolist())]))
    return out


def bucket_links(classes: DataFrame, bits: int = BITS, bucket: int = BUCKET, lanes: tuple[str, ...] = ("fp",), node: str = "fp", choose=None, start: list | None = None) -> DataFrame:
    """A spanning forest of the links in each bucket: ``u, v`` of the column ``node``.

    ``choose`` lists the blocks (word, mask, what is free afterwards) that a bucket is divided by;
    by default those of a single word in which linked fingerprints must agree.
    """
    refs = pivots(words=len(lanes))
    spark = classes.sparkSession
    choose = choose or (lambda free: _nested(free, bits))
    names = ["u", "v"]

    def solve(codes: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        root = np.arange(len(nodes))
        for i, j in links(fps.view(np.uint64), codes, bits, refs):
            root = forest(root, i, j)
        off = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[root[off]])], names)

    def run(batches):
        """Batches come sorted by bucket; whole buckets are solved, the last of a batch waits."""
        codes, nodes, fps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(lanes)), np.int64)
        for batch in batches:
            codes = np.concatenate([codes, batch.column("code").to_numpy()])
            nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
            fps = np.concatenate([fps, np.stack([batch.column(f"w{k}").to_numpy() for k in range(len(lanes))], axis=1)])
            last = np.searchsorted(codes, codes[-1]) if len(codes) else 0
            if last:
                yield solve(codes[:last], nodes[:last], fps[:last])
                codes, nodes, fps = codes[last:], nodes[last:], fps[last:]
        yield solve(codes, nodes, fps)

    words = [f"w{k}" for k in range(len(lanes))]

    def divide(rows: DataFrame, free_of: dict[str, list]) -> tuple[DataFrame, dict[str, list]]:
        """Each row once for every block of its path, with a code of all it agrees in so far."""
        after, choices = {}, []
        for path, free in free_of.items():
            for k, (word, mask, rest) in enumerate(choose(free)):
                name = f"{path}.{k}"
                after[name] = rest
                choices.append((path, name, word, mask - (1 << 64) if mask >> 63 else mask))
        blocks = F.broadcast(spark.createDataFrame(choices, "path string, name string, word int, mask long"))  # choices of blocks: few, whatever the data
        part = F.xxhash64("code", "name", F.element_at(F.array(*words), F.col("word") + 1).bitwiseAND(F.col("mask")))
        return rows.join(blocks, "path").select("node", *words, F.col("name").alias("path"), part.alias("code")), after

    first = classes.select(F.col(node).alias("node"), *[F.col(c).alias(w) for c, w in zip(lanes, words)], F.lit("").alias("path"), F.lit(0).cast("long").alias("code"))
    rows, free_of = divide(first, {"": list(range(64)) if start is None else start})
    found = None
    while True:
        rows = materialize(rows, "buckets")
        large = materialize(rows.groupBy("path", "code").count().filter(F.col("count") > bucket).select("path", "code"), "large")
        paths = sorted(r[0] for r in large.select("path").distinct().collect())  # choices of blocks, not data
        dead = [p for p in paths if not free_of[p]]  # nothing left to divide by: solved as they are
        fit = rows.join(large.filter(~F.col("path").isin(dead)) if dead else large, ["path", "code"], "left_anti") if paths else rows
        own = fit.select("code", "node", *words).repartition("code").sortWithinPartitions("code").mapInArrow(run, "u long, v long")
        found = own if found is None else found.unionByName(own)
        paths = [p for p in paths if p not in dead]
        if not paths:
            return found.distinct()
        rows, free_of = divide(rows.join(large, ["path", "code"], "left_semi").filter(F.col("path").isin(paths)), {p: free_of[p] for p in paths})


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``: alternating large-star and small-star
    rounds until nothing changes; roots are the smallest node of each component."""

    def star(pairs: DataFrame, total: int) -> DataFrame:
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        return join_lookup(pairs, low, "u", "n", total)

    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first())
    mark = state(edges)
    while n := mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(star(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        small = star(large, n).select("u", F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u <> v").distinct(), "small-star")
        new = state(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _named(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``docs`` with ``component_id``: ``docs(id, node, ...)``, ``classes(node, rep, rows)``."""
    found = components(edges)
    placed = materialize(classes.join(found, "node", "left").select("node", "rep", "rows", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = materialize(join_lookup(placed, least, "root", "n", placed.count()).select("node", "component_id", "rows"), "named")
    return join_lookup(docs, named, "node", "rows", docs.count())


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``id, fingerprint, component_id`` for every row of ``df``: fingerprints of 64 bits that differ
    in at most ``bits`` are linked, all of them."""
    docs = materialize(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle).withColumnRenamed("fp", "node"), "fingerprints")
    classes = materialize(docs.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    out = _named(docs, classes, bucket_links(classes, bits, bucket, ("node",), "node"))
    return out.select("id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


# -- near copies by similarity ---------------------------------------------------------------------


def shingle_set(text: str, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; a text with fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())], dtype=np.uint64))


def band_codes(hashes: np.ndarray, seeds: np.ndarray) -> list[int]:
    """A code for each band of the MinHash signature of a set; ``seeds`` has a row for each of its
    ``BANDS * ROWS`` places: what is xored to a hash, and the odd factor after that."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    step = max(1, 200_000 // len(hashes))  # places at a time: small tables, however long the text
    least = np.concatenate([((hashes ^ seeds[k : k + step, :1]) * seeds[k : k + step, 1:]).min(axis=1) for k in range(0, len(seeds), step)])
    return [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _seeds() -> np.ndarray:
    draw = np.random.default_rng(SEED).integers(0, 2**64, (BANDS * ROWS, 2), dtype=np.uint64)
    draw[:, 1] |= np.uint64(1)
    return draw


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose sets have that Jaccard similarity or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("su"), batch.column("sv")):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both / max(1, len(a) + len(b) - both) >= similarity)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    total = pairs.count()
    counts = {side: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")) for side in ("u", "v")}
    for side, other in (("u", "v"), ("v", "u")):
        pairs = join_spread(pairs, counts[side], sets.select(F.col("node").alias(side), F.col("set").alias(f"s{side}")), side, "n", total, other)
    return materialize(pairs.mapInArrow(run, "u long, v long"), "links")


def _sets(signatures: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, set`` of those nodes: the hashes of their shingles, from their own row's text."""
    texts = signatures.join(nodes.select(F.col("node").alias("at")), "at", "left_semi").select(F.col("at").alias("node"), "text")

    def run(batches):
        for batch in batches:
            own = [shingle_set(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "set"])

    return materialize(texts.mapInArrow(run, "node long, set array<long>"), "sets")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-6)


def near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bucket: int = BLOCK, stars: int = STARS) -> DataFrame:
    """``id, component_id`` for every row: documents whose sets of five-word shingles have that
    Jaccard similarity or more are linked, others are not.

    Documents with equal sets (by a digest of 128 bits) are one class. A class that agrees with no
    other in any of ``BANDS`` bands of a MinHash signature has no partner; that depends on the
    similarity alone, not on the shape of an edit nor on the size of a bucket, and a pair at 0.8 is
    missed once in two million. Within a bucket each round compares all members with two of them, twice
    as many pairs as members, which joins large groups of copies. Members of buckets that still hold
    several components then meet by their rarest shingles (:func:`_by_rare_shingles`), which loses no
    link and makes no pairs of documents that merely share a passage. Every compared pair is decided
    by the sets themselves.
    """
    ship(df.sparkSession)
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def run(batches):
        from xxhash import xxh3_128_digest

        seeds = _seeds()
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            codes = [np.array(band_codes(s, seeds), dtype=np.uint64).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("at", "id", "text")), pa.array([xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(codes, pa.list_(pa.int64()))], ["at", "id", "text", "digest", "size", "codes"])

    signatures = materialize(rows.mapInArrow(run, f"at long, id {rows.schema['id'].dataType.simpleString()}, text string, digest binary, size int, codes array<long>"), "signatures")
    classes = materialize(signatures.groupBy("digest").agg(F.min("at").alias("node"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    docs = materialize(join_lookup(signatures.select("id", "digest"), classes.select("digest", "node", "rows"), "digest", "rows", signatures.count()).drop("digest"), "numbered")
    bands = signatures.join(classes.select(F.col("node").alias("at")), "at", "left_semi").select(F.col("at").alias("node"), "size", F.explode("codes").alias("code"))
    bands = materialize(bands, "bands")
    buckets = materialize(bands.groupBy("code").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b"), "shared")
    members = materialize(join_lookup(bands, buckets, "code", "n", bands.count()).filter("a IS NOT NULL").select("code", "node", "size"), "members")
    sets = _sets(signatures, members.select("node").distinct())
    edges = done = df.sparkSession.createDataFrame([], "u long, v long")
    placed = members.withColumn("root", F.col("node"))
    for turn in range(stars):
        star = _star(placed, done, similarity, turn)
        found = _verified(star, sets, similarity)
        edges, done = edges.unionByName(found), done.unionByName(star)
        placed = materialize(_mixed(_rooted(members, edges), "code").drop("blocks"), "mixed")
        if found.isEmpty():
            break
    edges = edges.unionByName(_verified(_by_rare_shingles(placed, sets, done, similarity, bucket), sets, similarity))
    return _named(docs, classes, edges).select("id", "component_id")


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    return materialize(members.join(components(edges), "node", "left").select(*members.columns, F.coalesce("root", "node").alias("root")), "placed")


def _mixed(placed: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The rows ``(key, node, size, root)`` of the keys that several roots share, with the number of
    ``blocks`` that hold a key's rows."""
    shared = placed.groupBy(key).agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b").select(key, "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    return join_lookup(placed, shared, key, "n", placed.count()).filter("blocks IS NOT NULL")


def _star(placed: DataFrame, done: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Each member paired with two of its bucket, others each turn."""
    drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "size", "root")
    centres = placed.groupBy("code").agg(F.array(F.min(drawn), F.max(drawn)).alias("centres"), F.count(F.lit(1)).alias("n"))
    pairs = join_lookup(placed, centres, "code", "n", placed.count()).select("node", "size", "root", F.explode("centres").alias("c")).filter((F.col("root") != F.col("c.root")) & _alike(F.col("size"), F.col("c.size"), similarity))
    pairs = pairs.select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v")).distinct()
    return materialize(pairs.join(done, ["u", "v"], "left_anti"), "star")


def _by_rare_shingles(placed: DataFrame, sets: DataFrame, done: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs of the nodes of ``placed`` that have different roots and can have the similarity, but
    those ``done``; complete by the prefix filter.

    A node's shingles are ordered by the number of these nodes that have them. Of sets that are
    alike enough each has another's shingle among its ``size - ceil(similarity * size) + 1`` first
    ones, so nodes meet only there: a passage that many share comes last and meets nobody. Where it is
    most of a text, the sizes that a partner can have are bounded by the shingles held in common.
    """
    nodes = materialize(placed.select("node", "root").distinct(), "open")
    each = materialize(sets.join(nodes, "node").select("node", "root", F.size("set").alias("size"), F.explode("set").alias("token")), "shingles")
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("df", F.col("n"))
    shared = join_lookup(each, common, "token", "n", each.count()).filter("df IS NOT NULL")
    own = Window.partitionBy("node")
    held = F.count(F.lit(1)).over(own)  # of the node's shingles; those of this node only come before all others
    first = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - F.lit(1e-6)) + 1
    # Two sets share no more than either holds in common with anybody: that bounds a partner's size.
    most = F.floor(held * F.lit((1 + similarity) / similarity) + F.lit(1e-6)) - F.col("size")
    prefix = shared.select("token", "node", "root", "size", most.alias("most"), (F.col("size") - held + F.row_number().over(own.orderBy("df", "token"))).alias("place"))
    prefix = materialize(prefix.filter(F.col("place") <= first), "prefixes")
    least = prefix.groupBy("token").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("n"))
    prefix = join_lookup(prefix, least, "token", "n", prefix.count()).filter("most >= least").drop("least")
    rare = materialize(_mixed(materialize(prefix, "partners"), "token", block), "rare")
    left = rare.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    right = rare.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *[F.col(c).alias(f"_{c}") for c in ("node", "root", "size", "most", "place")])
    # Where it is their first shingle in common, no more than this one and those behind it are.
    overlap = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) + 1
    enough = overlap >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("_size")) - F.lit(1e-6)
    fit = enough & (F.col("most") >= F.col("_size")) & (F.col("_most") >= F.col("size")) & _alike(F.col("size"), F.col("_size"), similarity)
    pairs = left.join(right, ["token", "part"]).filter((F.col("node") > F.col("_node")) & (F.col("root") != F.col("_root")) & fit)
    return materialize(pairs.select(F.col("node").alias("u"), F.col("_node").alias("v")).distinct().join(done, ["u", "v"], "left_anti"), "rare-pairs")


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, **options) -> DataFrame:
    """The rows of ``df`` whose id names their component of near copies (or whose component has no id)."""
    found = near_copies(df, id_col=id_col, text_col=text_col, similarity=similarity, **options).filter(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("_keep_id"))
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"))
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi").select("_row.*")
