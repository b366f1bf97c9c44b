"""HTTP endpoints, HTTP calls and package uses in C# source text (S8-S12, S10a-b, S18, F11, F25).

A lexical scan: comments are blanked, classes and methods found by their headers and braces. Without a compiler, names
resolve against a table of known symbols by simple name, and what cannot be told apart says so in its confidence. Constants,
base classes and handlers of other files are joined by name, over all files that are scanned together.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loomgraph.lineage import cut

# How generated files are named and marked.
GENERATED_ENDS, GENERATED_PARTS, GENERATED_MARKS = (".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs"), (".generated.", ".g."), ("<auto-generated", "<autogenerated")
# Verbs by attribute and by client method, and status codes by their constant.
VERB_ATTRIBUTES = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
MAP_METHODS = {"MapGet": "GET", "MapPost": "POST", "MapPut": "PUT", "MapDelete": "DELETE", "MapPatch": "PATCH"}
CLIENT_METHODS = {"GetAsync": "GET", "PostAsync": "POST", "PutAsync": "PUT", "DeleteAsync": "DELETE", "PatchAsync": "PATCH", "SendAsync": "UNKNOWN"}
STATUS = {"Status200OK": 200, "Status201Created": 201, "Status204NoContent": 204, "Status400BadRequest": 400, "Status401Unauthorized": 401, "Status403Forbidden": 403, "Status404NotFound": 404, "Status409Conflict": 409, "Status422UnprocessableEntity": 422, "Status500InternalServerError": 500}

_COMMENT = re.compile(r'//[^\n]*|/\*.*?\*/|(@"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\')', re.S)
_CLASS = re.compile(r"\b(class|record|struct)\s+([A-Za-z_]\w*)(?:<[^>{]*>)?\s*(?:\([^)]*\)\s*)?(?::\s*([^{;]+?))?\s*(?=\{)")
_METHOD = re.compile(r"\b(?:public|private|protected|internal)\s+(?:(?:static|async|virtual|override|sealed|abstract|partial|new)\s+)*([\w<>\[\],.? ]+?)\s+([A-Za-z_]\w*)\s*\(([^()]*)\)\s*(?=\{|=>)")
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)")
_ATTRIBUTE = re.compile(r"\[\s*([A-Za-z_][\w.]*)\s*(?:\((.*?)\))?\s*\]", re.S)
_CONSTANT = re.compile(r"\bconst\s+string\s+([A-Za-z_]\w*)\s*=\s*([^;]+);")
_STRING = re.compile(r'\$?@?"((?:\\.|[^"\\])*)"')
_MODIFIERS = frozenset("public private protected internal static sealed abstract partial async".split())
# what a walk over code stops at: strings, brackets of one sort, and what parts arguments and sums
_MARKS = {"{}": re.compile(r'["{}]'), "()": re.compile(r'["()]'), ",": re.compile(r'[",()\[\]{}]'), "+": re.compile(r'["+()\[\]{}]')}
_NEWLINE, _NOT_NEWLINE = re.compile("\n"), re.compile(r"[^\n]")
_MAPPED = re.compile(r"\.\s*(Map(?:Get|Post|Put|Delete|Patch))\s*\(")
_LAMBDA, _DOTTED = re.compile(r"(?:(?:async|static)\s+)*(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>"), re.compile(r"[\w.]+")
_SENT = re.compile(r"\.\s*((?:Get|Post|Put|Delete|Patch|Send)Async)\s*(?:<[^>(]*>)?\(")
_NAME, _PATH = re.compile(r"[A-Za-z_]\w*"), re.compile(r"[A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*")
_MADE, _CREATED = re.compile(r"new\s*[\w.<>]*\s*\("), re.compile(r'CreateClient\s*\(\s*"([^"]*)"[^()]*\)\s*$')
_PLAIN, _FORMAT = re.compile(r'(\$?@?|@\$)"((?:\\.|""|[^"\\])*)"', re.S), re.compile(r"[\w.]+\.Format\s*\(")
_USES = (("Calls", re.compile(r"\.\s*([A-Za-z_]\w*)\s*\(")), ("Uses", re.compile(r"\bnew\s+([A-Z]\w*)")), ("Uses", re.compile(r"(?<![\w.])([A-Z]\w*)(?:<[^>]*>)?\s+[a-z_]\w*\s*(?=[=;,)])")))


def _without_comments(text: str) -> str:
    """Comments as blanks, so that places stay as they are; strings stay."""
    return _COMMENT.sub(lambda m: m[1] if m[1] else _NOT_NEWLINE.sub(" ", m[0]), text)


def _close(text: str, at: int, pair: str = "{}") -> int:
    """The place behind the bracket that closes the one at ``at``; strings do not count."""
    depth, i, mark = 0, at, _MARKS[pair]
    while m := mark.search(text, i):
        i = m.end()
        if m[0] == '"':
            s = _STRING.match(text, i - 1)
            i = s.end() if s else i
            continue
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return i
    return len(text)


def _before(text: str, at: int) -> int:
    """The place behind what stands before ``at``, white space and modifiers passed over."""
    while True:
        while at and text[at - 1].isspace():
            at -= 1
        i = at
        while i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            i -= 1
        if text[i:at] not in _MODIFIERS:
            return at
        at = i


@dataclass
class _Class:
    kind: str
    name: str
    bases: str
    attributes: list[tuple[str, str]]
    start: int
    end: int


@dataclass
class _Member:
    name: str
    owner: _Class
    attributes: list[tuple[str, str]]
    public: bool
    first: int  # with its attributes
    start: int
    end: int
    parameters: str = ""


class Source:
    """One file: its classes and methods, its constants, and the line and column of a place."""

    def __init__(self, text: str) -> None:
        self.text = _without_comments(text)
        self.starts = [0, *(m.end() for m in _NEWLINE.finditer(self.text))]
        space = _NAMESPACE.search(self.text)
        self.namespace = space[1] if space else ""
        self.classes: list[_Class] = []
        self.methods: list[_Member] = []
        for c in _CLASS.finditer(self.text):
            body = self.text.index("{", c.end())
            self.classes.append(_Class(c[1], c[2], c[3] or "", self._attributes_before(c.start())[0], body, _close(self.text, body)))
        for m in _METHOD.finditer(self.text):
            owner = self.class_at(m.start())
            if owner is None:
                continue
            stop = _close(self.text, m.end()) if self.text[m.end()] == "{" else self.text.find(";", m.end()) + 1 or owner.end
            attributes, first = self._attributes_before(m.start())
            self.methods.append(_Member(m[2], owner, attributes, m[0].startswith("public"), first, m.start(), stop, m[3]))
        self.constants: dict[tuple[str, str], str] = {}
        for m in _CONSTANT.finditer(self.text):
            owner = self.class_at(m.start())
            value, sure, _ = Url(self, owner).of(m[2])
            if owner is not None and sure == "high" and "\x01" not in value:
                self.constants[(owner.name, m[1])] = value

    def class_at(self, at: int) -> _Class | None:
        inside = [c for c in self.classes if c.start <= at < c.end]
        return min(inside, key=lambda c: c.end - c.start) if inside else None

    def _attributes_before(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """The attributes that stand right before a declaration, modifiers in between, and where they begin (else the declaration)."""
        text, first = self.text, at
        found: list[tuple[str, str]] = []
        while True:
            end = _before(text, at)
            if not end or text[end - 1] != "]":
                return found[::-1], first
            depth, i = 0, end
            while i:
                i -= 1
                depth += (text[i] == "]") - (text[i] == "[")
                if not depth:
                    break
            found += [(m[1].split(".")[-1].removesuffix("Attribute"), m[2] or "") for m in _ATTRIBUTE.finditer(text, i, end)][::-1]
            at = first = i

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def span(self, start: int, end: int) -> dict:
        (line, col), (end_line, end_col) = self.place(start), self.place(end)
        return {"line": line, "col": col, "end_line": end_line, "end_col": end_col}

    def method_at(self, at: int) -> _Member | None:
        inside = [m for m in self.methods if m.start <= at < m.end]
        return min(inside, key=lambda m: m.end - m.start) if inside else None

    def type_name(self, c: _Class) -> str:
        return ".".join(x for x in (self.namespace, c.name) if x)

    def full_name(self, m: _Member) -> str:
        return f"{self.type_name(m.owner)}.{m.name}({_types(m.parameters)})"

    def receiver(self, dot: int) -> int:
        """Where the expression before a dot begins: names, dots and closed brackets."""
        i = dot
        while i:
            c = self.text[i - 1]
            if c in ")]":
                depth, j = 0, i
                while j:
                    j -= 1
                    depth += (self.text[j] in ")]") - (self.text[j] in "([")
                    if not depth:
                        break
                i = j
            elif c.isalnum() or c in "_.?!":
                i -= 1
            elif c.isspace() and (self.text[i:dot].lstrip()[:1] == "." or not self.text[i:dot].strip()):
                i -= 1
            else:
                break
        return i + len(self.text[i:dot]) - len(self.text[i:dot].lstrip())


def _types(parameters: str) -> str:
    return ",".join(re.sub(r"^(?:\[[^\]]*\]\s*|(?:this|ref|out|in|params)\s+)*", "", p.strip()).split("=")[0].strip().rsplit(" ", 1)[0] for p in parameters.split(",") if p.strip())


def _first_string(arguments: str) -> str | None:
    """The first argument if it is a string, given by name or not."""
    m = re.match(r'\s*(?:\w+\s*[=:]\s*)?@?"((?:\\.|[^"\\])*)"', arguments)
    return m[1] if m else None


def _unconstrained(route: str) -> str:
    return re.sub(r"\{(\w+):[^}]+\}", r"{\1}", route)


def _status(arguments: str) -> int | None:
    """The first argument that is a number or a known constant."""
    for a in _split(arguments):
        a = a.strip()
        if re.fullmatch(r"\d+", a):
            return int(a)
        if "." in a and a.split(".")[-1] in STATUS:
            return STATUS[a.split(".")[-1]]
    return None


def _row(at: Source, start: int, end: int, **found) -> dict:
    return {"record": "http", "codes": [], "joined": False, "handler": None, "owner": None, "action": None, "client": None, "base": None} | found | at.span(start, end)


def _base(c: _Class) -> str | None:
    """The simple name of the first base."""
    return c.bases.split(",")[0].strip().split("<")[0].split(".")[-1] or None


def controller_endpoints(text: str | Source) -> list[dict]:
    """Endpoints of controllers: the public methods with a verb of classes that are [ApiController] or come from Controller or ControllerBase; ``base`` names a base
    that is not in this file. A method's own [Route] hides the verb's template, and only its first verb counts."""
    source = text if isinstance(text, Source) else Source(text)
    known = {c.name: c for c in source.classes}
    out = []
    for m in source.methods:
        verb = next(((VERB_ATTRIBUTES[n], a) for n, a in m.attributes if n in VERB_ATTRIBUTES), None)
        if verb is None or not m.public or m.owner.kind != "class":
            continue
        base, at, seen = None, m.owner, set()
        if not any(n == "ApiController" for n, _ in m.owner.attributes):
            while at is not None and at.name not in seen:  # up to where the file has no class of the name
                seen.add(at.name)
                base = _base(at)
                at = known.get(base or "")
            if base is None or base in seen:
                continue
            base = None if base in ("Controller", "ControllerBase") else base
        prefix = next((_first_string(a) for n, a in m.owner.attributes if n == "Route"), None)
        template = _first_string(next((a for n, a in m.attributes if n == "Route"), verb[1]))
        name = m.owner.name
        short = name.removesuffix("Controller") or name
        route = "/" + "/".join(p.strip("/") for p in (prefix, template) if p and p.strip("/"))
        route = re.sub(r"(?i)\[controller\]", lambda _, t=short: t.lower(), route)
        route = re.sub(r"(?i)\[action\]", lambda _, t=m.name: t.lower(), route)
        codes = {c for n, a in m.attributes if n == "ProducesResponseType" and (c := _status(a)) is not None}
        full = source.full_name(m)
        out.append(_row(source, m.first, m.end, scanner="controller", method=verb[0], route=_unconstrained(route), source=full, handler="method", owner=source.type_name(m.owner), action=m.name, confidence="high", codes=sorted(codes), base=base))
    return out


def minimal_endpoints(text: str | Source) -> list[dict]:
    """Endpoints mapped by MapGet and its like, on any receiver, with two arguments or more; a route that is no constant is ``unknown``. The handler is a lambda, or a
    method by its name."""
    source, out = text if isinstance(text, Source) else Source(text), []
    for m in _MAPPED.finditer(source.text):
        end = _close(source.text, m.end() - 1, "()")
        arguments = _split(source.text[m.end() : end - 1])
        if len(arguments) < 2:
            continue
        value, sure, _ = Url(source, source.class_at(m.start()), constant=True).of(arguments[0])
        route = "unknown" if sure != "high" else value
        handler = arguments[1].strip()
        at = m.end() + len(arguments[0]) + 1 + len(arguments[1]) - len(arguments[1].lstrip())
        kind = "lambda" if _LAMBDA.match(handler) else "name" if _DOTTED.fullmatch(handler) else None
        named = f"lambda:{source.place(at)[0]}" if kind == "lambda" else handler if kind else None
        route = "/" if not route.strip() else _unconstrained(route if route.startswith(("/", "\x01")) else "/" + route)
        out.append(_row(source, source.receiver(m.start()), end, scanner="minimal-api", method=MAP_METHODS[m[1]], route=route, source=named, handler=kind, confidence="low" if sure != "high" else "high"))
    return out


def _parts(text: str, at: str) -> list[str]:
    """The parts of a text between the signs ``at`` of the outermost level; strings do not count."""
    parts, depth, last, i, mark = [], 0, 0, 0, _MARKS[at]
    while m := mark.search(text, i):
        c, i = m[0], m.end()
        if c == '"':
            s = _STRING.match(text, i - 1)
            i = s.end() if s else i
        elif c != at:
            depth += 1 if c in "([{" else -1
        elif not depth:
            parts.append(text[last : i - 1])
            last = i
    return [*parts, text[last:]]


def _split(arguments: str) -> list[str]:
    """Arguments at commas of the outermost level."""
    return _parts(arguments, ",") if arguments.strip() else []


def _added(expression: str) -> list[str]:
    """The operands of + at the outermost level."""
    return _parts(expression, "+")


class Url:
    """What url expressions of one place in a file say: the template, how sure it is, and whether it is a sum. A constant of a class that the file does not have stands
    in the template as its name between \\x01 and \\x02. With ``constant`` only what a compiler takes for a constant is sure."""

    def __init__(self, source: Source, owner: _Class | None, constant: bool = False) -> None:
        self.source, self.owner, self.constant = source, owner, constant

    def of(self, expression: str) -> tuple[str, str, bool]:
        operands = [p.strip() for p in _added(expression)]
        if len(operands) > 1:
            parts = [self._one(p) for p in operands]
            return "".join(t for t, _ in parts), "high" if all(c == "high" for _, c in parts) else "medium", True
        return *self._one(operands[0]), False

    def _one(self, e: str) -> tuple[str, str]:
        plain = _PLAIN.fullmatch(e)
        if plain and "$" not in plain[1]:
            return plain[2].replace('""', '"') if "@" in plain[1] else re.sub(r"\\(.)", r"\1", plain[2]), "high"
        if plain:
            return ("unknown", "low") if self.constant else (re.sub(r"\{[^{}]+\}", "{var}", plain[2]), "high")
        called = _FORMAT.match(e)
        if called and _close(e, called.end() - 1, "()") == len(e) and not self.constant:
            arguments = _split(e[called.end() : -1])
            text = re.fullmatch(r'@?"((?:\\.|[^"\\])*)"', arguments[0].strip()) if len(arguments) > 1 else None
            return (re.sub(r"\{[0-9]+\}", "{var}", text[1]), "high") if text else ("unknown", "low")
        if _PATH.fullmatch(e):
            path = re.split(r"\s*\.\s*", e)
            owner = path[-2] if len(path) > 1 else self.owner.name if self.owner else ""
            value = self.source.constants.get((owner, path[-1])) if hasattr(self.source, "constants") else None
            if value is not None:
                return value, "high"
            if len(path) > 1 and path[-2][:1].isupper() and all(c.name != owner for c in self.source.classes):
                return f"\x01{owner}.{path[-1]}\x02", "high"
        return "unknown", "low"


def url_of(expression: str) -> tuple[str, str]:
    """The template of a url expression that stands alone, and how sure it is: texts, interpolations and formats high, sums with anything else medium, all else low."""
    template, sure, joined = Url(Source(""), None).of(expression)
    return _unresolved(template, sure, joined)


def _unresolved(template: str, sure: str, joined: bool) -> tuple[str, str]:
    if "\x01" not in template:
        return template, sure
    return re.sub("\x01[^\x02]*\x02", "unknown", template), "medium" if joined else "low"


def client_calls(text: str | Source) -> list[dict]:
    """Calls by HttpClient methods, on any receiver; the url of SendAsync is that of a request made there or in a variable of the method."""
    source, out = text if isinstance(text, Source) else Source(text), []
    for m in _SENT.finditer(source.text):
        end = _close(source.text, m.end() - 1, "()")
        arguments = _split(source.text[m.end() : end - 1])
        caller = source.method_at(m.start())
        body = source.text[caller.start : caller.end] if caller else source.text
        expression = arguments[0].strip() if arguments else ""
        if m[1] == "SendAsync":
            made = expression
            if _NAME.fullmatch(expression):
                found = re.search(rf"\b{expression}\s*=\s*(?=new\b)", body)
                made = body[found.end() :] if found else ""
            opened = _MADE.match(made)
            inner = _split(made[opened.end() : _close(made, opened.end() - 1, "()") - 1]) if opened else []
            expression = inner[1] if len(inner) > 1 else ""
        url, sure, joined = Url(source, source.class_at(m.start())).of(expression)
        start = source.receiver(m.start())
        receiver = source.text[start : m.start()].strip()
        client = _CREATED.search(receiver)
        if client is None and _NAME.fullmatch(receiver):
            client = re.search(rf'\b{receiver}\s*=\s*[\w.]*CreateClient\s*\(\s*"([^"]*)"', body)
        caller_name = source.full_name(caller) if caller else None
        out.append(_row(source, start, end, scanner="http-client", method=CLIENT_METHODS[m[1]], route=url, source=caller_name, handler="method" if caller else None, confidence=sure, joined=joined, client=client[1] if client else None))
    return out


def uses(text: str) -> list[dict]:
    """What each method mentions by simple name: calls (a name before a bracket) and types (a name after new, or before a variable)."""
    source, out = Source(text), []
    for m in source.methods:
        body = _STRING.sub(lambda s: " " * len(s[0]), source.text[m.start : m.end])
        for kind, pattern in _USES:
            for x in pattern.finditer(body):
                line, col = source.place(m.start + x.start(1))
                out.append({"kind": kind, "source": source.full_name(m), "name": x[1], "line": line, "col": col, "end_col": col + len(x[1])})
    return out


def is_generated(file, text):
    """Whether a file was generated: by its name, or by a mark near its beginning."""
    name, head = F.lower(file), F.lower(F.substring(text, 1, 2048))
    tests = [name.endswith(x) for x in GENERATED_ENDS] + [name.contains(x) for x in GENERATED_PARTS] + [head.contains(x) for x in GENERATED_MARKS]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


#: Files whose finds go back to Spark at once.
_BATCH = 256
#: What one pass over the files gives: HTTP endpoints and calls (record http), constants, classes and methods that others may refer to.
_RECORDS = (
    "file string, record string, scanner string, method string, route string, source string, handler string, owner string, action string, client string, confidence string, joined boolean, codes array<int>, base string, "
    "line int, col int, end_line int, end_col int"
)


def _scanned(files: DataFrame, found: Callable[[str, str], Iterable[dict]], ddl: str) -> DataFrame:
    """What a function finds in each of the C# files in (file, text): dicts of the columns of ddl, those that are not there null. Few files at a time go back to Spark."""
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                rows = [r for f, t in zip(part["file"].to_pylist(), part["text"].to_pylist(), strict=True) for r in found(f, t)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c.name) for r in rows], c.type) for c in schema], schema=schema)

    return _sources(files).mapInArrow(run, ddl)


def records(files: DataFrame) -> DataFrame:
    """Everything that one scan of the C# files in (file, text) finds, generated ones aside, written once: the plans that use it do not scan again."""

    def found(file: str, text: str) -> Iterator[dict]:
        s = Source(text)
        for r in (*controller_endpoints(s), *minimal_endpoints(s), *client_calls(s)):
            yield r | {"file": file}
        for (owner, name), value in s.constants.items():
            yield {"file": file, "record": "constant", "owner": owner, "action": name, "route": value}
        for c in s.classes:
            yield {"file": file, "record": "class", "owner": c.name, "base": _base(c), "joined": any(n == "ApiController" for n, _ in c.attributes)}
        for m in s.methods:
            yield {"file": file, "record": "method", "owner": m.owner.name, "action": m.name, "source": s.full_name(m)} | s.span(m.start, m.end)

    return cut(_scanned(files, found, _RECORDS))


def controllers_by_base(found: DataFrame) -> DataFrame:
    """(name) of the classes that come from a controller class of some file: inheritance is followed as deep as it goes, one join for each level."""
    classes = found.where("record = 'class'").select(F.col("owner").alias("name"), "base", "joined")
    known = classes.where("joined or base in ('Controller', 'ControllerBase')").select("name").distinct()
    while True:
        more = classes.join(known.select(F.col("name").alias("base")), "base", "left_semi").select("name").distinct().join(known, "name", "left_anti")
        more = cut(more)
        if more.isEmpty():
            return known
        known = known.unionByName(more)


def resolved(found: DataFrame) -> DataFrame:
    """The HTTP records of records(): constants of other files in their urls, controllers only where the base in another file is one, names of handlers turned into methods
    (source is null where there is none)."""
    http = found.where("record = 'http'")
    if not http.where("base is not null").isEmpty():
        http = http.where("base is null").unionByName(http.where("base is not null").join(controllers_by_base(found).select(F.col("name").alias("base")), "base", "left_semi").select(http.columns))
    named = F.coalesce(F.col("route").contains("\x01"), F.lit(False))
    if not http.where(named).isEmpty():
        # each name once, then all values of a route in one map; routes without a name, most of them and often the same, stay where they are
        plain, http = http.where(~named), http.where(named)
        names = http.select("route", F.explode(F.array_distinct(F.regexp_extract_all("route", F.lit("\x01([^\x02]*)\x02"), F.lit(1)))).alias("name")).distinct()
        constants = found.where("record = 'constant'").groupBy(F.concat_ws(".", "owner", "action").alias("name")).agg(F.min("route").alias("value"))
        values = names.join(constants, "name", "left").groupBy("route").agg(F.collect_list(F.struct("name", "value")).alias("values"))  # of one route
        joined = http.join(values, "route", "left")
        mark = lambda v: F.concat(F.lit("\x01"), v["name"], F.lit("\x02"))
        template = F.aggregate(F.coalesce("values", F.array().cast("array<struct<name:string,value:string>>")), F.col("route"), lambda t, v: F.replace(t, mark(v), F.coalesce(v["value"], F.lit("unknown"))))
        lost = F.coalesce(F.exists("values", lambda v: v["value"].isNull()), F.lit(False))
        mapped = F.col("scanner") == "minimal-api"
        sure = F.when(lost & (~F.col("joined") | mapped), "low").when(lost, "medium").otherwise(F.col("confidence"))
        whole = F.when(mapped & lost, F.lit("/unknown")).when(mapped & ~template.startswith("/"), F.concat(F.lit("/"), template)).otherwise(template)
        http = plain.unionByName(joined.withColumn("confidence", sure).withColumn("route", whole).select(http.columns))
    path = F.split("source", r"\.")
    called = http.where("handler = 'name'").withColumn("__owner", F.when(F.size(path) > 1, F.element_at(path, -2))).withColumn("__action", F.element_at(path, -1))
    methods = found.where("record = 'method'")
    # by class and name; a bare name only within its file. Each has one method, the least, so no handler meets all methods of its name
    of_class = methods.groupBy(F.col("owner").alias("__owner"), F.col("action").alias("__action")).agg(F.min("source").alias("__source"))
    of_file = methods.groupBy("file", F.col("action").alias("__action")).agg(F.min("source").alias("__source"))
    by_class = called.where("__owner is not null").join(of_class, ["__owner", "__action"], "left")
    by_file = called.where("__owner is null").join(of_file, ["file", "__action"], "left")
    handled = by_class.unionByName(by_file).withColumn("source", F.col("__source")).select(http.columns)
    return http.where("handler is null or handler <> 'name'").unionByName(handled)


def scan_http(files: DataFrame) -> DataFrame:
    """Endpoints and calls of all C# files in (file, text), generated ones aside."""
    return resolved(records(files)).select("file", "scanner", "method", "route", "source", "handler", "owner", "action", "client", "confidence", "codes", "line", "col", "end_line", "end_col")


def scan_uses(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Uses of known symbols (symbol_id, kind, name) by user methods: file, source, usage, symbol_id, place and confidence, which is low
    where several symbols share the name."""
    ddl = "file string, kind string, source string, name string, line int, col int, end_col int"

    found = _scanned(files, lambda f, t: ({"file": f} | r for r in uses(t)), ddl)
    known = symbols.select("symbol_id", F.when(F.col("kind") == "Method", "Calls").otherwise("Uses").alias("kind"), "name")
    several = known.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return found.join(known, ["kind", "name"]).join(several, ["kind", "name"]).select("file", "source", F.col("kind").alias("usage"), "symbol_id", "line", "col", "end_col", F.when(F.col("n") > 1, "low").otherwise("medium").alias("confidence"))


def _sources(files: DataFrame) -> DataFrame:
    return files.where(F.lower("file").endswith(".cs") & F.col("text").isNotNull() & ~is_generated(F.col("file"), F.col("text"))).select("file", "text")
