"""Personal data in text, in SQL functions alone.

A pattern proposes spans, a validator confirms them (Luhn for cards, mod-97 for IBANs, ranges for
the others), and words near a span adjust its score. Positions come from splitting the text by the
pattern: the lengths of the gaps and of the matches add up to code-point offsets. The patterns are
written so that Java's matcher neither recurses nor retries inside a run (possessive groups; a match
begins at a run's first character or where the last match ended), which leaves their matches as they
are and keeps very long texts linear. So are the steps after it: running sums and extremes go by
blocks of about the square root of the spans (:func:`_running`), pieces of a text are cut from its
``PIECE``-long parts instead of its start, and overlaps come from one sorted sweep.

Base kinds: email, ip, card, phone; all are kept as they match. Added kinds: iban (mod-97), and
spans that only context confirms — short_card (13 to 15 digits, Luhn, a card word near) and
local_phone (no plus sign, a phone word just before). One of the last two that overlaps a
base span is dropped.

Defined results: null text is the empty text; a text without spans has counts of zero, the digest of
the empty string and empty ``spans``; repeated rows are scanned one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import whole

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,8}){1,4}(?![0-9.-])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "local_phone")
NEAR = 40
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact)",
    "ip": r"(?i)\b(?:ip|address|host|server)",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit)",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax)",
    "iban": r"(?i)\b(?:iban|account|bank)",
    "short_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit)",
    "local_phone": r"(?i)\b(?:tel|phone|call|mobile|fax)[a-z]{0,6}\W{0,3}$",
}
#: Score without and with a context word; spans that only context confirms need the latter.
SCORES = {"email": (0.9, 0.95), "ip": (0.7, 0.9), "card": (0.9, 0.99), "phone": (0.7, 0.9), "iban": (0.95, 0.99), "short_card": (0.0, 0.8), "local_phone": (0.0, 0.7)}
#: A text is cut from parts of so many code points.
PIECE = 512
FAR = 2**31 - 1


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check; every second digit from the right counts double."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.when(n > 0, F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes its check: the first four characters go last, letters count from 10."""
    x = F.regexp_replace(iban, r"\x20", "")
    x = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & luhn(_digits(x))
    if kind == "short_card":
        return F.length(_digits(x)).between(13, 15) & luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "local_phone":
        return F.length(_digits(x)).between(7, 12)
    if kind == "iban":
        return mod97(x)
    return F.lit(True)


def _running(rows: DataFrame, sources: dict[str, Column], join, zero: int) -> DataFrame:
    """``rows`` with a column for each of ``sources`` (arrays of int): at each place ``join`` over the
    elements before it. Two passes over blocks, so that no array is copied once an element."""
    kept, new = rows.columns, list(sources)
    ints = F.array().cast("array<int>")
    start = lambda: F.struct(F.lit(zero).alias("at"), ints.alias("out"))
    append = lambda a, x, y: F.struct(join(a.at, y).alias("at"), F.concat(a.out, F.array(x)).alias("out"))
    rows = rows.select(*kept, *[c.alias(f"_v_{n}") for n, c in sources.items()])
    rows = rows.select("*", *[F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(f"_v_{n}"))).cast("int")).alias(f"_b_{n}") for n in new])

    def blocks(n: str) -> Column:
        values, width = F.col(f"_v_{n}"), F.col(f"_b_{n}")
        each = F.transform(F.sequence(F.lit(1), F.size(values), width), lambda k: F.aggregate(F.slice(values, k, width), start(), lambda a, x: append(a, a.at, x)))
        return F.when(F.size(values) > 0, each)

    rows = rows.select(*kept, *[blocks(n).alias(f"_p_{n}") for n in new])
    rows = rows.select(*kept, *[f"_p_{n}" for n in new], *[F.when(F.col(f"_p_{n}").isNotNull(), F.aggregate(f"_p_{n}", start(), lambda a, x: append(a, a.at, x.at), lambda a: a.out)).alias(f"_o_{n}") for n in new])
    whole_of = lambda n: F.flatten(F.zip_with(f"_p_{n}", f"_o_{n}", lambda p, o: F.transform(p.out, lambda x: join(o, x))))
    return rows.select(*kept, *[F.when(F.col(f"_p_{n}").isNotNull(), whole_of(n)).otherwise(ints).alias(n) for n in new])


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _short_cut(pieces: str, at: Column, n: Column) -> Column:
    """``n`` (up to ``PIECE``) code points of the text from ``at``."""
    k = F.floor(at / PIECE).cast("int")
    return F.substring(F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit(""))), at % PIECE + 1, n)


def _cut(pieces: str, at: Column, end: Column) -> Column:
    """The code points of the text from ``at`` to ``end``."""
    first, last = F.floor(at / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    long = F.concat(F.substring(piece(first), at % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(piece(last), F.lit(1), end % PIECE))
    return F.when(first == last, F.substring(piece(first), at % PIECE + 1, end - at)).otherwise(long)


def _pieces(wanted: Column) -> Column:
    return F.when(wanted, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), 0)).otherwise(F.array().cast("array<string>"))


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, text, spans`` (and the columns ``keep``): all confirmed spans,
    ``array<struct<kind,start,end,text,score>>``, by kind and start."""
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), *keep)
    names = rows.columns
    empty = F.array().cast("array<string>")
    hits, gaps = [], []
    for kind, pattern in PATTERNS.items():
        may = F.col("text").contains(NEEDS[kind]) if kind in NEEDS else F.col("text").rlike("[0-9]")
        hits.append(F.when(may, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(empty).alias(f"_hit_{kind}"))
    rows = rows.select("*", *hits)
    for kind, pattern in PATTERNS.items():
        some = F.size(f"_hit_{kind}") > 0
        lengths = F.transform(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(f"_hit_{kind}")), lambda g: F.char_length(g))
        gaps.append(F.when(some, lengths).otherwise(F.array().cast("array<int>")).alias(f"_gap_{kind}"))
    rows = rows.select("*", *gaps, _pieces(F.greatest(*[F.size(f"_hit_{k}") for k in PATTERNS]) > 0).alias("_pieces"))
    rows = _running(rows, {f"_at_{k}": F.zip_with(f"_gap_{k}", f"_hit_{k}", lambda g, h: g + F.char_length(h)) for k in PATTERNS}, _plus, 0)
    place = lambda k: F.zip_with(F.zip_with(f"_at_{k}", f"_gap_{k}", _plus), f"_hit_{k}", lambda a, h: F.struct(a.alias("start"), h.alias("text")))
    rows = rows.select(*names, "_pieces", *[place(k).alias(f"_at_{k}") for k in PATTERNS])

    def scored(kind: str, source: str) -> Column:
        def one(s):
            near = _short_cut("_pieces", F.greatest(s.start - NEAR, F.lit(0)), F.least(s.start, F.lit(NEAR)))
            base, more = SCORES[kind]
            return F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), (s.start + F.char_length(s.text)).alias("end"), s.text.alias("text"), F.when(near.rlike(CONTEXT[kind]), more).otherwise(base).alias("score"))

        return F.transform(F.filter(F.col(f"_at_{source}"), lambda s: _valid(kind, s.text)), one)

    more = F.concat(*[scored(k, "card" if k == "short_card" else k) for k in ADDED])
    rows = rows.select(*names, F.concat(*[scored(k, k) for k in BASE]).alias("_base"), F.filter(more, lambda s: s.score > 0.5).alias("_more"))
    return _clear(rows, names)


def _clear(rows: DataFrame, names: list[str]) -> DataFrame:
    """``spans``: ``_base`` and those of ``_more`` that meet none of it (IBANs may)."""
    rank = {k: n for n, k in enumerate(ADDED)}
    event = lambda added: lambda s: F.struct(s.start.alias("start"), F.lit(added).alias("added"), s.end.alias("end"), (F.coalesce(*[F.when(s.kind == k, n) for k, n in rank.items()]) if added else F.lit(-1)).alias("rank"), s.kind.alias("kind"), s.text.alias("text"), s.score.alias("score"))
    events = F.array_sort(F.concat(F.transform("_base", event(0)), F.transform("_more", event(1))))
    rows = rows.select(*names, "_base", F.when((F.size("_more") > 0) & (F.size("_base") > 0), events).otherwise(F.transform("_more", event(1))).alias("_events"))
    rows = _running(rows, {"_left": F.transform("_events", lambda e: F.when(e.added == 0, e.end).otherwise(0))}, F.greatest, 0)
    rows = _running(rows, {"_right": F.reverse(F.transform("_events", lambda e: F.when(e.added == 0, e.start).otherwise(FAR)))}, F.least, FAR)
    sides = F.zip_with("_left", F.reverse("_right"), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    free = lambda e, x: F.when((e.added == 1) & ((e.kind == "iban") | ((x.left <= e.start) & (x.right >= e.end))), F.struct(e["rank"].alias("rank"), e.start.alias("start"), e.end.alias("end"), e.kind.alias("kind"), e.text.alias("text"), e.score.alias("score")))
    rows = rows.select(*names, "_base", F.array_sort(F.filter(F.zip_with("_events", sides, free), lambda s: s.isNotNull())).alias("_more"))
    back = F.transform("_more", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.text.alias("text"), s.score.alias("score")))
    return rows.select(*names, F.concat("_base", back).alias("spans"))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    rows = find(df, id_col=id_col, text_col=text_col)
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return rows.select("id", *counts, F.sha2(_listing(base), 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans"))


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with each span in ``text_col`` replaced by its kind in brackets. Spans that overlap
    are replaced once, by the kind that begins first. Null text stays null."""
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = find(rows, id_col="_id", text_col="_text", keep=("_row",))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    rows = rows.select("text", "_row", order.alias("_spans"), _pieces(F.size("spans") > 0).alias("_pieces"))
    rows = _running(rows, {"_done": F.transform("_spans", lambda s: s.end)}, F.greatest, 0)
    part = lambda s, done: F.when(s.start < done, "").otherwise(F.concat(_cut("_pieces", done, s.start), F.lit("["), F.upper(s.kind), F.lit("]")))
    last = F.greatest(F.element_at("_done", -1), F.element_at("_spans", -1).end)
    new = F.concat(F.array_join(F.zip_with("_spans", "_done", part), ""), _cut("_pieces", last, F.char_length("text")))
    new = F.when(F.size("_spans") > 0, new).otherwise(F.col(f"_row.`{text_col}`"))
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names])
