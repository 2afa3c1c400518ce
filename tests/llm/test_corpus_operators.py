"""Archives, search, URL rules, HTML extraction, the quality classifier and the pipeline."""

import base64
import hashlib
import html
import io
import math
import random
import re
import struct
import zipfile
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from weft.llm import html_extract, quality, registry, url_rules, vafile, warc


class Bytes:
    """Range reads of bytes in memory; counts what was read."""

    def __init__(self, data: bytes):
        self.data, self.size, self.got = data, len(data), 0

    def read(self, at, n):
        if at < 0 or at + n > self.size:
            raise ValueError("out of range")
        self.got += n
        return self.data[at : at + n]


# -- archives ----------------------------------------------------------------------------------------


def zip64_of(members: dict[str, bytes]) -> bytes:
    """A ZIP file whose every size and offset stands in ZIP64 fields."""
    out, central = io.BytesIO(), io.BytesIO()
    for name, data in members.items():
        offset, n = out.tell(), name.encode()
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(local)) + n + local + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), offset)
        central.write(b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + n + extra)
    start, raw = out.tell(), central.getvalue()
    out.write(raw)
    end = out.tell()
    out.write(b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(raw), start))
    out.write(b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1))
    out.write(b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    return out.getvalue()


def test_zip_directories():
    members = {"archive/a": b"x" * 1000, "ü/b": b"", "c": b"PK\x05\x06" * 3}
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.comment = b"PK\x05\x06 a comment"
    for raw in (plain.getvalue(), zip64_of(members)):
        file = Bytes(raw)
        found = warc.directory(file)
        assert set(found) == set(members)
        for name, data in members.items():
            at, n = warc.stored_member(file, found[name])
            assert file.read(at, n) == data
    for wrong in (b"", b"PK\x05\x06", b"no archive at all" * 10):
        with pytest.raises(ValueError):
            warc.directory(Bytes(wrong))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    with pytest.raises(ValueError):
        warc.stored_member(Bytes(packed.getvalue()), warc.directory(Bytes(packed.getvalue()))["a"])


def test_records_are_standard():
    raw = warc.record("response", "urn:x-page:1", "http://x/\r\nWARC-Type: evil", b"hi", digest=warc.payload_digest(b"hi"), size=2)
    got = warc.parse_record(raw)
    assert got["payload"] == b"hi" and got["warc"]["warc-type"] == "response" and "%0D%0A" in got["warc"]["warc-target-uri"]


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://ü/4", ""), (5, "x", "é漢🙂" * 2000), (None, "http://n", "same"), (None, "http://n", "alone"), (7, "y", "other"), (7, "y", "other")]


def test_archives_round_trip(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as id", "3 as payload").repartition(3)
    last = {}
    for i, _, page in PAGES:
        if i is not None:
            last[page or ""] = max(i, last.get(page or "", i))
    want = []
    for i, _, page in PAGES:
        body = (page or "").encode()
        top = last.get(page or "")
        revisit = top is not None and i != top
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    got = warc.page_records(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r["record_type"] for r in warc.page_records(frame, min_bytes=5).filter("payload_bytes < 5").collect()} == {"response"}
    packages = warc.write_archives(frame, package_bytes=200)
    urls = [(r["record_id"], r["target_uri"]) for r in warc.read_archives(packages).collect()]
    assert sorted(urls, key=repr) == sorted((("urn:x-page:" + ("" if i is None else str(i)), u) for i, u, _ in PAGES), key=repr)
    assert packages.count() >= 3
    full = {r["record_id"]: r["payload"] for r in warc.read_archives(packages, payloads=True).filter("record_type = 'response'").collect()}
    assert bytes(full["urn:x-page:5"]).decode() == "é漢🙂" * 2000
    assert warc.page_records(frame.limit(0)).count() == 0


# -- search ------------------------------------------------------------------------------------------


def brute(queries, rows, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    ints = lambda v: [math.floor(256 * Fraction(x)) for x in v]
    live = [(i, ints(v)) for i, v in rows if i is not None and ok(v)]
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for q, v in queries:
        if q is None or not ok(v):
            continue
        x = ints(v)
        found = sorted(((-clamp(sum(a * b for a, b in zip(x, y))), i) for i, y in live if i != q and len(y) == len(x)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_is_exact(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=12).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # many ties
    rows += [(2000, None), (2001, [1.0, None] * 6), (2050, [float("nan")] * 12), (2100, [float("inf")] * 12), (2150, [0.5] * 3), (2151, [0.25] * 3), (None, [1.0] * 12), (2200, []), (2250, [1e30] * 12), (2251, [0.0] * 12), (2252, [0.0] * 12)]
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    got = vafile.top_k(frame.filter("vec_id % 50 = 0"), frame, 5)
    assert sorted(map(tuple, got.collect())) == brute(asked, rows, 5)
    few = vafile.top_k(frame.filter("vec_id % 50 = 0"), frame, 5, first=1)
    assert sorted(map(tuple, few.collect())) == brute(asked, rows, 5)
    assert vafile.top_k(frame.limit(0), frame, 5).count() == 0 and vafile.top_k(frame.filter("vec_id = 0"), frame.limit(0), 5).count() == 0


def test_top_k_to_the_limits_of_a_long(spark):
    """Scores near a long's limits and beyond, components that no long holds, repeated rows."""
    draw = random.Random(8)
    size = lambda: draw.choice([0.0, -0.0, 1.0, 1e-300, 1e5, 3e7, 1e14, 1e18, 1e40, 1e200, 1.7e308]) * draw.choice([1, -1]) * draw.choice([1, 1 / 3])
    rows = [(0, [1e14, 1.0]), (1, [1.0, 0.0]), (50, [1.0, 0.0]), (51, [1e14, 1.0]), (2, [2.0**31, 2.0**15]), (100, [2.0**15, 2.0**31 - 1]), (3, [2.0**31, 2.0**14])]
    rows += [(200 + k, [size(), size()]) for k in range(60)] + [(400 + k, [draw.uniform(-3e7, 3e7) for _ in range(2)]) for k in range(120)]
    rows += [(500, [1.0, 1.0])] * 4 + [(501, [1e14, 1.0])] * 9 + [(450, [5e6, -5e6])] * 7
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 50 == 0]
    got = sorted(map(tuple, vafile.top_k(frame.filter("vec_id % 50 = 0"), frame, 5).collect()))
    assert got == brute(asked, rows, 5)
    pair = frame.filter("vec_id in (0, 50)")
    assert sorted(map(tuple, vafile.top_k(pair, pair, 5).collect())) == [(0, 1, 50, 6553600000000000000), (50, 1, 0, 6553600000000000000)]
    beyond = spark.createDataFrame([(k, [1e18 * (1 + k % 7), 0.0]) for k in range(60)] + [(100, [-1e18, 0.0])], frame.schema)
    live = [tuple(r) for r in beyond.collect()]
    asked = [r for r in live if r[0] % 50 == 0]
    assert sorted(map(tuple, vafile.top_k(beyond.filter("vec_id % 50 = 0"), beyond, 5).collect())) == brute(asked, live, 5)


def test_bounds_hold_and_few_vectors_are_read():
    draw = np.random.default_rng(1)
    x, q = draw.integers(-200, 200, (500, 16)).astype(float), draw.integers(-200, 200, (20, 16)).astype(float)
    for more in (1.0, 1e9, 1e30):
        low, step, slack, cells = vafile.to_cells(x * more)
        lower, upper = vafile.bounds(q, low, step, slack, cells)
        exact = [[max(-(2**63), min(2**63, sum(int(a) * int(b) for a, b in zip(u, v)))) for v in x * more] for u in q]
        assert all(lower[i, j] <= exact[i][j] <= upper[i, j] for i in range(20) for j in range(500))
    scan, x = vafile.Scan(5), draw.normal(size=(4000, 16)) * 100
    scan.add(np.arange(20), np.full(20, -1), q)
    left = sum(len(found[0]) for at in range(0, 4000, 500) for found in scan.survivors(np.arange(at, at + 500), np.arange(at, at + 500), vafile.to_cells(np.floor(x[at : at + 500]))))
    assert 20 * 5 <= left < 20 * 200


# -- rules -------------------------------------------------------------------------------------------


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    draw = random.Random(2)
    labels, parts = ["a", "b", "com", "example", "x-y", "net"], ["", "/", "/en", "/en/", "/en/7", "/en/77/x", "/de"]
    rules = {}
    for _ in range(120):
        h = ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))
        rules[h, draw.choice(parts)] = draw.choice(["block", "allow"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "nope", "://", "http://", "http://?x", "HTTP://A.COM/en/7#y", "http://com", "http://xcom/en/", "http://a.com:80/en/", "http://.com/en", "http://u@com/"]
    urls += ["http://hot.example.com/en/7"] * 300
    urls += [f"http{draw.choice(['', 's'])}://{'.'.join(draw.choice(labels) for _ in range(draw.randint(1, 5)))}{draw.choice(parts)}{draw.choice(['', '/q', '?a=/b', '#c'])}" for _ in range(600)]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as key", "2 as bucket", "3 as salt", "4 as host")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["id"]: tuple(r)[1:] for r in url_rules.judge(frame, table).collect()}
    assert got == {k: plain_judge(u, rules) for k, u in enumerate(urls)}
    assert url_rules.judge(frame.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judge(frame, table.limit(0)).collect()} == {"allow"}


# -- html --------------------------------------------------------------------------------------------


def test_message_passing_is_exact():
    draw = random.Random(3)
    for _ in range(30):
        n = draw.randint(1, 9)
        parent = [-1, *(draw.randrange(k) for k in range(1, n))]
        unary, edges = [draw.gauss(0, 2) for _ in range(n)], [[draw.gauss(0, 1) for _ in range(4)] for _ in range(n)]
        weight = []
        for state in range(2**n):
            bit = lambda k: state >> k & 1  # noqa: E731, B023
            weight.append(np.exp(sum(unary[k] * bit(k) for k in range(n)) + sum(edges[k][2 * bit(parent[k]) + bit(k)] for k in range(1, n))))
        total = sum(weight)
        prob, pairs, log_total = html_extract.marginals(parent, unary, edges)
        assert np.isclose(log_total, np.log(total))
        for k in range(n):
            assert np.isclose(prob[k], sum(w for s, w in enumerate(weight) if s >> k & 1) / total)
            if k:
                assert np.isclose(sum(pairs[k]), 1)


def test_held_out_pages():
    model, wrong, total = html_extract.default_model(), 0, 0
    for page, labels in html_extract.labelled_pages(150, seed=99):
        prob = model.probabilities(page)
        for k, _ in page.segments:
            total += 1
            wrong += (prob[k] >= 0.5) != labels[k]
    assert wrong / total < 0.02


def test_extraction(spark):
    model = html_extract.default_model()
    source = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy now.</div>
    <article><h1>A  title &amp; more</h1><p><b>First&nbsp;line<br>goes on<p>Second &lt;p&gt; here, with <a href="/x">a link</a> and text.
    <!-- hidden --><p>Third.</p><div class="comments"><div class="comment"><p>I disagree with this.</p></div></div></article><footer>&copy; x</footer>"""
    assert model.extract(source) == "A title & more\nFirst line goes on\nSecond <p> here, with a link and text.\nThird."
    plain = {2: "plain text only", 10: "x y", 12: "Out in."}
    odd = [None, "", "plain text only", "<" * 3000, "<p", "</div></div>", "<div>" * 3000 + "deep", "<script>never closed", "<a b='", "&#x110000; &#0;", "<body><p>x <svg><text>no</text><svg/></svg> y</p></body>", "<p>a <object>b <object>c", "<p>Out <button>Buy <button>no</button></button>in.<select><option>One<option>Two</select></p>"]
    frame = spark.createDataFrame([(k, h) for k, h in enumerate(odd)], "page_id long, html string").selectExpr("*", "'u' as url", "1 as text", "2 as n_chars")
    plain[11] = "a b c"
    got = {r["id"]: r for r in html_extract.extract(frame, keep=("url",)).collect()}
    assert {k: got[k]["text"] for k in plain} == plain
    assert len(got) == len(odd) and got[0]["text"] == "" and got[1]["n_chars"] == 0 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(frame.limit(0)).count() == 0


LONG = "The council met on Tuesday and after a long debate agreed to rebuild the old bridge over the river. "
#: Layouts that the labelled pages do not have, and the blocks that are their articles.
UNLIKE = [
    ("<body>" + "".join(f"<p>{LONG}{k}</p>" for k in range(20)) + "</body>", [f"{LONG}{k}" for k in range(20)]),
    (f"<body><div>{LONG * 20}</div></body>", [(LONG * 20).strip()]),
    (LONG * 3, [(LONG * 3).strip()]),
    (f"<body><nav><a href=/>Home</a></nav><p>{LONG}</p><p>Short.</p><footer>&copy; us</footer></body>", [LONG.strip(), "Short."]),
    (f"<html><body><div><div><div><h2>Title of it</h2>{LONG}<p>{LONG}</p></div></div></div></body></html>", ["Title of it", LONG.strip(), LONG.strip()]),
    (f"<ul class=navbar><li><a href=/a>One</a><li><a href=/b>Two</a></ul><h1>The old bridge</h1><p>{LONG}<p>{LONG}<div class=sidebar><p>{LONG}</p></div>", ["The old bridge", LONG.strip(), LONG.strip()]),
    (f"<body><center><table><tr><td>{LONG * 2}</td></tr></table></center><div id=footer>Mail us</div></body>", [(LONG * 2).strip()]),
    (f"<body><div id=menu><a href=/>A</a> <a href=/b>B</a></div><div><p>{LONG}</p><blockquote>{LONG}</blockquote><p>{LONG}</p></div><div class=comments><p>{LONG}</p><p>I agree.</p></div></body>", [LONG.strip()] * 3),
    (f"<h1>The old bridge</h1>{LONG}", ["The old bridge", LONG.strip()]),
    (f"<main><h1>The old bridge</h1><section><h2>First</h2><p>{LONG}</p></section><section><h2>Second</h2><p>{LONG}</p></section><aside><p>{LONG}</p></aside></main>", ["The old bridge", "First", LONG.strip(), "Second", LONG.strip()]),
]


def test_unlike_pages():
    """Articles in layouts that no labelled page has: whole, and nothing else."""
    model = html_extract.default_model()
    for source, blocks in UNLIKE:
        assert model.extract(source) == "\n".join(blocks), source[:80]


def plain_article(source):
    """The article of this table's pages, by their one template."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)
    inner = re.sub(r"</?b>", "", re.sub("<br>", " ", re.sub(r"<!--.*?(-->|\Z)", "", found[1] if found else "", flags=re.S)))
    blocks = (" ".join(html.unescape(part).split()) for part in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(block for block in blocks if block)


def test_pages_by_their_template(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"] or "") for r in pages.collect()}
    assert {r["id"]: r["text"] for r in html_extract.extract(pages).collect()} == want


# -- quality -----------------------------------------------------------------------------------------


def test_em_recovers_labellers():
    draw = np.random.default_rng(2)
    accuracy = [(0.9, 0.95), (0.7, 0.98), (0.6, 0.9)]
    truth = draw.random(20_000) < 0.15
    counts = {}
    for t in truth:
        vote = tuple(quality.JUNK if (draw.random() < a if t else draw.random() > b) else quality.CLEAN for a, b in accuracy)
        counts[vote] = counts.get(vote, 0) + 1
    model = quality.LabelModel(sorted(counts.items()))
    assert abs(model.prior[0] - 0.15) < 0.05
    for k, (a, b) in enumerate(accuracy):
        assert abs(model.table[0, k, 0] - a) < 0.15 and abs(model.table[1, k, 1] - b) < 0.05
    assert model.history[-1] > model.history[0]


def test_classifier_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{sf}/documents.parquet"))
    both = got.withColumnRenamed("id", "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = sum(r["keep"] == bool(r["quality"]) for r in both) / len(both)
    clean = [r["keep"] for r in both if r["quality"] == 1]
    assert right >= 0.97 and sum(clean) / len(clean) >= 0.98


def plain_votes(text):
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 1, 0, 0
    noise = sum(len(re.search(r"[^\w\s.,;:!?'\"()-]*$", w)[0]) >= 2 for w in words) / n
    shout = (len(re.findall("!!", text)) + sum(1 for w in words if len(w) > 1 and w.isupper())) / 2 / n
    bars = sum(w in "|•·»>" for w in words) / n
    repeats = sum(words[k] == words[k + 1] for k in range(n - 1)) / n
    vote = lambda x, junk, clean: (1 if round(x * n, 6) >= 4 else 0) if x >= junk else -1 if x <= clean else 0
    solid = sum(c.isalnum() for c in text) / len(text)
    variety, small = len({*words}) / n, sum(1 for w in words if w.isalpha() and len(w) < 4) / n
    return (
        *(vote(*x) for x in ((noise, 0.1, 0.03), (shout, 0.15, 0.05), (bars, 0.1, 0.03), (repeats, 0.15, 0.05))),
        1 if solid < 0.5 else -1 if solid > 0.7 else 0,
        (1 if variety < min(0.2, 8 / math.sqrt(n)) else -1 if variety > 0.4 else 0) if n >= 40 else 0,
        (1 if small < 0.06 else -1 if small > 0.15 else 0) if n >= 12 else 0,
    )


def plain_em(counts):
    """Log-odds of each pattern, by loops."""
    total, labels = sum(counts.values()), len(next(iter(counts)))
    junk = {p: 0.9 if 1 in p else 0.02 for p in counts}
    last = None
    for _ in range(200):
        weight = [{p: n * junk[p] for p, n in counts.items()}, {p: n * (1 - junk[p]) for p, n in counts.items()}]
        mass = [sum(w.values()) for w in weight]
        prior = [(m + 1) / (sum(mass) + 2) for m in mass]
        right = []
        for c in (0, 1):
            row = []
            for k in range(labels):
                says = [sum(w for p, w in weight[c].items() if p[k] == v) + 0.5 + (quality.TRUST * total * prior[c] if (v == 1) == (c == 0) else 0) for v in (1, -1)]
                row.append([x / sum(says) for x in says])
            right.append(row)
        like = {p: [math.log(prior[c]) + sum(math.log(right[c][k][0 if v == 1 else 1]) for k, v in enumerate(p) if v) for c in (0, 1)] for p in counts}
        fit = sum(n * (max(like[p]) + math.log(sum(math.exp(x - max(like[p])) for x in like[p]))) for p, n in counts.items())
        junk = {p: 1 / (1 + math.exp(max(-60, min(60, b - a)))) for p, (a, b) in like.items()}
        if last is not None and abs(fit - last) < 1e-7 * max(1, total):
            break
        last = fit
    return {p: a - b for p, (a, b) in like.items()}


def plain_scorer(examples):
    w, seen = [0.0] * quality.BUCKETS, [1e-6] * quality.BUCKETS
    order = np.random.default_rng(0)
    for _ in range(5):
        for r in order.permutation(len(examples)):
            at, x, y = examples[r]
            off = 1 / (1 + math.exp(-max(-30, min(30, sum(w[k] * v for k, v in zip(at, x)))))) - y
            slopes = [(k, off * v + 1e-4 * w[k]) for k, v in zip(at, x)]
            for k, g in slopes:
                seen[k] += g * g
                w[k] -= 0.5 * g / math.sqrt(seen[k])
    return w


def plain_features(text):
    words, m, out = text.split(), quality.measures(text), {}
    add = lambda name, v: out.__setitem__(zlib.crc32(name.encode()) % quality.BUCKETS, out.get(zlib.crc32(name.encode()) % quality.BUCKETS, 0) + v)
    for w in words:
        kind = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", w))
        add("shape " + kind + ("U" if len(w) > 1 and w.isupper() else ""), 1 / len(words))
    size = min(len(words).bit_length(), 14)
    add(f"length {size}", 1)
    for name, grid in quality.GRIDS.items():
        step = sum(m[name] >= g for g in grid)
        add(f"{name} {step}", 0.5)
        add(f"{name} {step} {size // 2}", 0.5)
    return out


def test_classifier_by_brute_force(spark, sf):
    """Votes, EM, features and scorer over a small table, each against plain code."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", "a", "| a b | c •" * 9, "WOW!! " * 30, "x## y%% " * 20, "a a " * 40, "-" * 5000, "é---" * 999, "漢字 🙂🙂 ok"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r for r in quality.score(frame).collect()}
    own = {k: plain_votes(t or "") for k, t in enumerate(texts)}
    assert {k: tuple(map(int, r["votes"].split(","))) for k, r in got.items()} == own
    counts = {}
    for v in own.values():
        counts[v] = counts.get(v, 0) + 1
    odds = plain_em(counts)
    examples = []
    for k, t in enumerate(texts):
        at, x = quality.features(t or "", quality.measures(t or ""), {})
        plain = plain_features(t or "")
        assert len(at) == len(plain) and all(abs(plain[i] - v) < 1e-5 for i, v in zip(at.tolist(), x.tolist()))
        examples.append((at, x, 1 / (1 + math.exp(-odds[own[k]]))))
    order = sorted(range(len(examples)), key=lambda k: (examples[k][0].tobytes(), examples[k][1].tobytes()))
    weights = plain_scorer([tuple(np.asarray(c).tolist() for c in examples[k]) for k in order])
    for k, (at, x, _) in enumerate(examples):
        z = sum(weights[i] * v for i, v in zip(at.tolist(), x.tolist()))
        assert abs(got[k]["quality_score"] - 1 / (1 + math.exp(z))) < 1e-3, k
        assert got[k]["keep"] == (got[k]["quality_score"] >= 0.5)
    kept = quality.clean_documents(frame).collect()
    assert sorted(r["doc_id"] for r in kept) == [k for k in range(len(texts)) if got[k]["keep"]]


def test_classifier_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "Was. " * 500), (5, "word " * 20_000), (None, "x y z"), (1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as keep", "2 as votes", "3 as _row", "4 as quality")
    assert quality.score(frame).count() == len(rows)
    assert quality.clean_documents(frame).columns == frame.columns
    assert quality.score(frame.limit(0)).count() == 0 and quality.clean_documents(frame.limit(0)).count() == 0


def test_wordless_vote_reads_the_whole_text():
    """Fixed-width lines, where a stride meets the same column every time."""
    for text in ("a---" * 1000, "é---" * 1000, "-aaa" * 1000, "-éaa" * 1000, "ab_ ²٣漢字🙂\n" * 900):
        share = sum(map(str.isalnum, text)) / len(text)
        assert quality.votes(quality.measures(text))[4] == (quality.JUNK if share < 0.5 else quality.CLEAN if share > 0.7 else quality.ABSTAIN)
        assert quality.alphanumerics(text) == sum(map(str.isalnum, text))
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert quality.alphanumerics(every) == sum(map(str.isalnum, every))


# -- queries and pipeline ------------------------------------------------------------------------------


def test_sql_of_queries(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        flat = lambda df: sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
        assert flat(registry.QUERIES[name](spark, sf).toPandas()) == flat(con.sql(sql).df()), name


def test_pipeline(spark, sf):
    from test_text_operators import base_spans

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).persist()
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count() and kept.select("doc_id").distinct().count() == kept.count()
        if name == "exact_dedup":
            norm = lambda r: "".join(c for c in r["text"] if c not in "\t\n\x0b\x0c\r ")
            assert len({norm(r) for r in kept.collect()}) == kept.count() == len({norm(r) for r in before.collect()})
        if name == "pii":
            assert all(r["n_chars"] == len(r["text"]) and not any(base_spans(r["text"]).values()) for r in kept.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    tokens = lambda df: {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert tokens(corpus_pipeline.run(spark, sf)) == tokens(packed)  # how tasks cut documents may differ
