"""RDF readers: N-Triples and N-Quads by lines in the JVM; Turtle and RDF/XML by
whole files in Arrow batches.  All give ``s, p, o, o_kind, lang, dtype, g``.

Line formats split files anywhere between lines; unparsable lines are skipped,
or kept in ``_corrupt_record`` (``permissive=True``).  The whole-file formats
need a file to fit a task, as their syntax has no record borders.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, o_kind string, lang string, dtype string, g string"
FIELDS = ["s", "p", "o", "o_kind", "lang", "dtype", "g"]

# Namespaces of the syntaxes.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "{http://www.w3.org/XML/1998/namespace}"

_NODE = r"(?:<([^>]*)>|(_:[^\s]+))"
_LITERAL = r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?'
LINE = rf"^\s*{_NODE}\s*<([^>]*)>\s*(?:{_NODE}|{_LITERAL})\s*(?:{_NODE})?\s*\.\s*(?:#.*)?$"


def unescaped(c):
    r"""``\n``, ``\"`` and the like and ``\uXXXX``; plain values skip the work."""
    marks = F.regexp_replace(c, r"\\\\", "\u0000")
    for a, b in (("n", "\n"), ("r", "\r"), ("t", "\t"), ('"', '"'), ("'", "'"), ("b", "\b"), ("f", "\f")):
        marks = F.replace(marks, F.lit("\\" + a), F.lit(b))
    parts = F.split(marks, r"(?=\\u[0-9A-Fa-f]{4})|(?=\\U[0-9A-Fa-f]{8})")

    def one(x):
        short, long = x.rlike(r"^\\u[0-9A-Fa-f]{4}"), x.rlike(r"^\\U[0-9A-Fa-f]{8}")
        code = lambda n: F.conv(F.substring(x, 3, n), 16, 10).cast("int")
        sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")
        return F.when(short, F.concat(sign(4), F.substring(x, 7, 1 << 30))).when(long, F.concat(sign(8), F.substring(x, 11, 1 << 30))).otherwise(x)

    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.replace(F.array_join(F.transform(parts, one), ""), F.lit("\u0000"), F.lit("\\")))


def parse_lines(df: DataFrame, permissive: bool = False) -> DataFrame:
    """Statements of the N-Triples or N-Quads lines in ``value``."""
    at = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    df = df.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    lit = F.col("value").rlike(LINE) & F.coalesce(at(4), at(5)).isNull()
    out = df.select(
        unescaped(F.coalesce(at(1), at(2))).alias("s"), unescaped(at(3)).alias("p"),
        unescaped(F.when(lit, F.regexp_extract("value", LINE, 6)).otherwise(F.coalesce(at(4), at(5)))).alias("o"),
        F.when(lit, "literal").when(at(5).isNotNull(), "bnode").when(at(4).isNotNull(), "uri").alias("o_kind"),
        at(7).alias("lang"), at(8).alias("dtype"), F.coalesce(at(9), at(10)).alias("g"),
        F.when(~F.col("value").rlike(LINE), F.col("value")).alias("_corrupt_record"),
    )
    return out if permissive else out.where("_corrupt_record is null").drop("_corrupt_record")


def read_ntriples(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    return parse_lines(spark.read.text(path), permissive)


read_nquads = read_ntriples


class TurtleError(ValueError):
    pass


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>"\s]*>)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<name>[\w\-.]*:(?:[\w\-:%]|\\.|\.(?=[\w\-:%\\]))*|[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.X,
)


def _plain(s: str) -> str:
    table = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}

    def sub(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else table.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", sub, s, flags=re.S)


class _Turtle:
    """Recursive reader of one Turtle document."""

    def __init__(self, text: str, base: str = ""):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"at {at}: {text[at:at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i, self.base, self.prefixes, self.n = 0, base, {}, 0
        self.out: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if mark is not None and t[1] != mark:
            raise TurtleError(f"expected {mark}, got {t[1]!r}")
        self.i += 1
        return t

    def fresh(self) -> tuple:
        self.n += 1
        return f"_:b{self.n}", "bnode", None, None

    def iri(self, s: str) -> str:
        return urljoin(self.base, _plain(s[1:-1])) if self.base else _plain(s[1:-1])

    def run(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, x = self.peek()
            if x.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1][:-1]
                self.prefixes[name] = self.iri(self.take()[1])
                if x[0] == "@":
                    self.take(".")
            elif x.lower() in ("@base", "base"):
                self.take()
                self.base = self.iri(self.take()[1])
                if x[0] == "@":
                    self.take(".")
            else:
                blank = x == "["
                s = self.term()
                if not (blank and self.peek()[1] == "."):
                    self.verbs(s)
                self.take(".")
        return self.out

    def verbs(self, s: tuple) -> None:
        while True:
            p = (RDF + "type", "uri", None, None) if self.peek() == ("name", "a") else None
            if p:
                self.take()
            else:
                p = self.term()
            while True:
                o = self.term()
                self.out.append((s[0], p[0], *o, None))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                more = self.peek()[1] not in (".", "]", ";", "")
                if more:
                    break
            else:
                return
            if not more:
                return

    def term(self) -> tuple:
        kind, x = self.take()
        if kind == "iri":
            return self.iri(x), "uri", None, None
        if kind in ("str", "long"):
            cut = 3 if kind == "long" else 1
            text, lang, dtype = _plain(x[cut:-cut]), None, None
            if self.peek()[0] == "at":
                lang = self.take()[1][1:]
            elif self.peek()[0] == "type":
                self.take()
                dtype = self.term()[0]
            return text, "literal", lang, dtype
        if kind == "num":
            dtype = "double" if "e" in x.lower() else "decimal" if "." in x else "integer"
            return x, "literal", None, XSD + dtype
        if kind == "bnode":
            return x, "bnode", None, None
        if x in ("true", "false"):
            return x, "literal", None, XSD + "boolean"
        if kind == "name" and ":" in x:
            p, _, rest = x.partition(":")
            if p not in self.prefixes:
                raise TurtleError(f"unknown prefix {p}")
            return self.prefixes[p] + re.sub(r"\\(.)", r"\1", rest), "uri", None, None
        if x == "[":
            s = self.fresh()
            if self.peek()[1] != "]":
                self.verbs(s)
            self.take("]")
            return s
        if x == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            at = (RDF + "nil", "uri", None, None)
            for item in reversed(items):
                cell = self.fresh()
                self.out += [(cell[0], RDF + "first", *item, None), (cell[0], RDF + "rest", *at, None)]
                at = cell
            return at
        raise TurtleError(f"unexpected {x!r}")


def turtle(text: str, base: str = "") -> list[tuple]:
    """Statements ``(s, p, o, o_kind, lang, dtype, g)`` of a Turtle document."""
    return _Turtle(text, base).run()


def rdfxml(text: str, base: str = "") -> list[tuple]:
    """Statements of an RDF/XML document; a fragment without a root or document
    type is read as the content of one, undeclared entities as ``&name;``."""
    declared = dict(re.findall(r"<!ENTITY\s+(\w+)\s+['\"]([^'\"]*)['\"]", text))
    body = re.sub(r"<\?xml[^>]*\?>|<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", "", text, flags=re.S)
    known = {"amp", "lt", "gt", "quot", "apos"}
    for _ in range(5):  # entities may stand in entities
        body = re.sub(r"&(\w+);", lambda m: m[0] if m[1] in known else declared.get(m[1], f"&amp;{m[1]};"), body)
    if not re.search(r"<\w+:RDF[\s>]", body):
        used = sorted(set(re.findall(r"[<\s/](\w+):\w", body)) - set(re.findall(r"xmlns:(\w+)", body)) - {"xml", "http", "https"})
        names = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", **declared}
        spaces = " ".join(f'xmlns:{u}="{names.get(u, u + ":")}"' for u in {*used, "rdf"})
        body = f"<rdf:RDF {spaces}>{body}</rdf:RDF>"
    root = ET.fromstring(body)
    out: list[tuple] = []
    count = [0]
    plain = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag
    at = lambda e, n: e.get(f"{{{RDF}}}{n}")
    full = lambda u, b: urljoin(b, u) if b else u

    def blank() -> str:
        count[0] += 1
        return f"_:b{count[0]}"

    def node(e: ET.Element, lang: str | None, b: str) -> tuple[str, str]:
        b, lang = e.get(XML + "base", b), e.get(XML + "lang", lang)
        if at(e, "about") is not None:
            s, kind = full(at(e, "about"), b), "uri"
        elif at(e, "ID") is not None:
            s, kind = b + "#" + at(e, "ID"), "uri"
        else:
            s, kind = ("_:" + at(e, "nodeID") if at(e, "nodeID") else blank()), "bnode"
        if plain(e.tag) != RDF + "Description":
            out.append((s, RDF + "type", plain(e.tag), "uri", None, None, None))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", XML)) and k[0] == "{":
                out.append((s, plain(k), v, "literal", lang, None, None))
        number = 0
        for c in e:
            p = plain(c.tag)
            if p == RDF + "li":
                number += 1
                p = f"{RDF}_{number}"
            prop(s, p, c, c.get(XML + "lang", lang), c.get(XML + "base", b))
        return s, kind

    def prop(s: str, p: str, c: ET.Element, lang: str | None, b: str) -> None:
        add = lambda o, kind, lg=None, d=None: out.append((s, p, o, kind, lg, d, None))
        parse = at(c, "parseType")
        if at(c, "resource") is not None:
            add(full(at(c, "resource"), b), "uri")
        elif at(c, "nodeID") is not None:
            add("_:" + at(c, "nodeID"), "bnode")
        elif parse == "Resource":
            o = blank()
            add(o, "bnode")
            for x in c:
                prop(o, plain(x.tag), x, lang, b)
        elif parse == "Collection":
            head: tuple[str, str] = (RDF + "nil", "uri")
            for item in reversed([node(x, lang, b) for x in c]):
                cell = blank()
                out.append((cell, RDF + "first", *item, None, None, None))
                out.append((cell, RDF + "rest", *head, None, None, None))
                head = (cell, "bnode")
            add(*head)
        elif parse == "Literal":
            add((c.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in c), "literal", None, RDF + "XMLLiteral")
        elif len(c):
            for x in c:
                add(*node(x, lang, b))
        else:
            d = at(c, "datatype")
            add(c.text or "", "literal", None if d else lang, d)

    if plain(root.tag) == RDF + "RDF":
        for e in root:
            node(e, root.get(XML + "lang"), root.get(XML + "base", base))
    else:
        node(root, None, base)
    return out


def _whole_files(spark: SparkSession, path: str, parse, base: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = parse(content.as_py().decode("utf-8-sig"), base)
                # blank nodes of different files are different
                tag = format(hash(name) & 0xFFFFFFFF, "x")
                own = lambda v: f"_:{tag}{v[2:]}" if isinstance(v, str) and v.startswith("_:") else v
                cols = list(zip(*[(own(r[0]), r[1], own(r[2]) if r[3] == "bnode" else r[2], *r[3:]) for r in rows])) or [[] for _ in FIELDS]
                for a in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c[a : a + 50_000]), pa.string()) for c in cols], names=FIELDS)

    return files.mapInArrow(run, SCHEMA)


def read_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    return _whole_files(spark, path, turtle, base)


def read_rdfxml(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    return _whole_files(spark, path, rdfxml, base)


def read_rdf(spark: SparkSession, path: str, inference: bool = False) -> DataFrame:
    """Reader by the path's ending; ``inference`` adds entailed statements (as
    ``s, p, o``, see ``taxonomy.rdfs_closure``)."""
    end = path.rstrip("/").rpartition(".")[2].lower()
    if end in ("nt", "nq"):
        df = read_ntriples(spark, path)
    elif end in ("ttl", "n3"):
        df = read_turtle(spark, path)
    elif end in ("rdf", "owl", "xml"):
        df = read_rdfxml(spark, path)
    else:
        raise ValueError(f"unknown ending {end}")
    if inference:
        from tessera.functions.curie import expand, shorten
        from tessera.operators.taxonomy import rdfs_closure

        std = [("rdf", RDF), ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"), ("skos", "http://www.w3.org/2004/02/skos/core#")]
        short = df.select("s", shorten(F.col("p"), std).alias("p"), "o")
        return rdfs_closure(short).select("s", expand(F.col("p"), std).alias("p"), "o")
    return df
