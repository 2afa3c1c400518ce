"""Parsers of Turtle, TriG and RDF/XML text: generators of (subject, predicate, object, literal?)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

from weft.errors import InvalidFormatError

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "{http://www.w3.org/XML/1998/namespace}"
Triple = tuple[str, str, str, bool]

_TOKEN = re.compile(
    r"""(?:\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<str>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<dir>@prefix\b|@base\b)
    |(?P<lang>@[A-Za-z][\w-]*)
    |(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<name>(?:[^\W\d_][\w-]*(?:\.[\w-]+)*)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w.:%-]|\\.)*(?:[\w:%-]|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<op>\^\^|[.;,\[\](){}])""",
    re.X | re.S,
)


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else plain.get(m[3], m[3]), text, flags=re.S)


class _Turtle:
    def __init__(self, text: str, base: str = ""):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise InvalidFormatError(f"unexpected text: {text[at : at + 30]!r}")
            if found.lastgroup:
                self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.base, self.prefixes, self.made = 0, base, {}, 0
        self.out: list[Triple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if value is not None and got[1] != value:
            raise InvalidFormatError(f"expected {value!r}, found {got[1] or 'the end'!r}")
        self.at += 1
        return got

    def blank(self) -> str:
        self.made += 1
        return f"_:g{self.made}"

    def iri(self) -> str:
        kind, value = self.take()
        if kind == "iri":
            value = unescape(value[1:-1])
            return urljoin(self.base, value) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", value) else value
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise InvalidFormatError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if (kind, value) == ("word", "a"):
            return RDF + "type"
        raise InvalidFormatError(f"expected an IRI, found {value or 'the end'!r}")

    def node(self) -> tuple[str, bool]:
        kind, value = self.peek()
        if kind == "blank":
            self.at += 1
            return value, False
        if value == "[":
            self.at += 1
            own = self.blank()
            if self.peek()[1] != "]":
                self.properties(own)
            self.take("]")
            return own, False
        if value == "(":
            self.at += 1
            head = last = None
            while self.peek()[1] != ")":
                item, literal = self.node()
                cell = self.blank()
                if last:
                    self.out.append((last, RDF + "rest", cell, False))
                head = head or cell
                self.out.append((cell, RDF + "first", item, literal))
                last = cell
            self.at += 1
            if last:
                self.out.append((last, RDF + "rest", RDF + "nil", False))
            return head or RDF + "nil", False
        if kind == "str":
            self.at += 1
            body = value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1]
            if self.peek()[0] == "lang":
                self.at += 1
            elif self.peek()[1] == "^^":
                self.at += 1
                self.iri()
            return unescape(body), True
        if kind == "num" or (kind == "word" and value in ("true", "false")):
            self.at += 1
            return value, True
        return self.iri(), False

    def properties(self, subject: str) -> None:
        while True:
            predicate = self.iri()
            while True:
                value, literal = self.node()
                self.out.append((subject, predicate, value, literal))
                if self.peek()[1] != ",":
                    break
                self.at += 1
            while self.peek()[1] == ";":
                self.at += 1
            if self.peek()[1] in (".", "]", "}", ""):
                return

    def statement(self) -> None:
        kind, value = self.peek()
        word = value.lstrip("@").upper()
        if kind == "dir" or (kind == "word" and word in ("PREFIX", "BASE")):
            self.at += 1
            if word == "BASE":
                self.base = self.iri()
            else:
                name = self.take()[1].removesuffix(":")
                self.prefixes[name] = self.iri()
            if kind == "dir":
                self.take(".")
            return
        only = value == "["
        subject, literal = self.node()
        if literal:
            raise InvalidFormatError("a literal cannot be a subject")
        if not (only and self.peek()[1] in (".", "}")):
            self.properties(subject)

    def run(self, graphs: bool) -> Iterator[Triple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if graphs and ((kind == "word" and value.upper() == "GRAPH") or value == "{" or (kind in ("iri", "name", "blank") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "{")):
                if value != "{":
                    self.at += 1 + (kind == "word")
                self.take("{")
                while self.peek()[1] != "}":
                    self.statement()
                    if self.peek()[1] == ".":
                        self.at += 1
                self.take("}")
                if self.peek()[1] == ".":
                    self.at += 1
            else:
                directive = kind == "dir" or (kind == "word" and value.upper() in ("PREFIX", "BASE"))
                self.statement()
                if not directive:
                    self.take(".")
            yield from self.out
            self.out.clear()


def turtle(text: str) -> Iterator[Triple]:
    return _Turtle(text).run(False)


def trig(text: str) -> Iterator[Triple]:
    return _Turtle(text).run(True)


def rdf_xml(text: str) -> Iterator[Triple]:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise InvalidFormatError(f"invalid XML: {e}") from e
    out: list[Triple] = []
    made = 0

    def fresh() -> str:
        nonlocal made
        made += 1
        return f"_:g{made}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def full(value: str, base: str) -> str:
        return urljoin(base, value) if base and not re.match(r"[A-Za-z][\w+.-]*:", value) else value

    def subject_of(el, base: str) -> str:
        if (v := el.get(f"{{{RDF}}}about")) is not None:
            return full(v, base)
        if (v := el.get(f"{{{RDF}}}ID")) is not None:
            return full(f"#{v}", base)
        if (v := el.get(f"{{{RDF}}}nodeID")) is not None:
            return f"_:{v}"
        return fresh()

    def node(el, base: str) -> str:
        base = el.get(f"{XML}base", base)
        own = subject_of(el, base)
        if name(el.tag) != RDF + "Description":
            out.append((own, RDF + "type", name(el.tag), False))
        for key, value in el.attrib.items():
            if key.startswith((XML, f"{{{RDF}}}")):
                if key == f"{{{RDF}}}type":
                    out.append((own, RDF + "type", full(value, base), False))
                continue
            out.append((own, name(key), value, True))
        count = 0
        for child in el:
            base_c = child.get(f"{XML}base", base)
            predicate = name(child.tag)
            if predicate == RDF + "li":
                count += 1
                predicate = f"{RDF}_{count}"
            kind = child.get(f"{{{RDF}}}parseType")
            if (v := child.get(f"{{{RDF}}}resource")) is not None:
                out.append((own, predicate, full(v, base_c), False))
            elif (v := child.get(f"{{{RDF}}}nodeID")) is not None:
                out.append((own, predicate, f"_:{v}", False))
            elif kind == "Literal":
                out.append((own, predicate, (child.text or "") + "".join(ElementTree.tostring(x, encoding="unicode") for x in child), True))
            elif kind == "Resource":
                inner = fresh()
                out.append((own, predicate, inner, False))
                shell = ElementTree.Element(f"{{{RDF}}}Description", {f"{{{RDF}}}nodeID": inner[2:]})
                shell.extend(list(child))
                node(shell, base_c)
            elif kind == "Collection":
                items = [node(x, base_c) for x in child]
                cells = [fresh() for _ in items]
                out.append((own, predicate, cells[0] if cells else RDF + "nil", False))
                for k, (cell, item) in enumerate(zip(cells, items)):
                    out.append((cell, RDF + "first", item, False))
                    out.append((cell, RDF + "rest", cells[k + 1] if k + 1 < len(cells) else RDF + "nil", False))
            elif len(child):
                out.append((own, predicate, node(child[0], base_c), False))
            elif any(not k.startswith((XML, f"{{{RDF}}}")) for k in child.attrib):
                inner = fresh()
                out.append((own, predicate, inner, False))
                out.extend((inner, name(k), v, True) for k, v in child.attrib.items() if not k.startswith((XML, f"{{{RDF}}}")))
            else:
                out.append((own, predicate, child.text or "", True))
        return own

    base = root.get(f"{XML}base", "")
    for el in list(root) if name(root.tag) == RDF + "RDF" else [root]:
        node(el, base)
    return iter(out)


PARSERS = {"turtle": turtle, "trig": trig, "rdfxml": rdf_xml}
