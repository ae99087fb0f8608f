"""Functions, call sites and imports of TypeScript and JavaScript sources, read from their tokens, in Arrow batches.

There is no type checker: what a call means is told by names, by imports and by `this`, and the types of other receivers are
not inferred. Function declarations, methods with a body, and arrows and function expressions that are bound to a variable, a
class's property or an object's key are functions; constructors, accessors and anonymous functions are none, but what
is inside the latter counts for no other function's complexity.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import resolve_calls
from ..runtime import batched, ship, spread, written
from .pysource import BINDING, FUNCTION, PARSED, SITE, SOURCE_LENGTH, SOURCE_MARK, unpacked

EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<word>[#A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<punct>=>|===?|!==?|<=|>=|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\.\.\.|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_WORDS_BEFORE_VALUES = frozenset("return typeof case in of delete void throw new else do yield await instanceof default".split())
_BEFORE_OBJECTS = frozenset("= ( , [ return ? && || ?? ... default yield await in of".split())
_BEFORE_EXPRESSIONS = frozenset("= ( , : [ return ? && || ?? ! ... => await new typeof yield + -".split())
_BRANCHES = frozenset("if for while do case catch".split())
_NO_CALLS = frozenset("async if for while switch catch function return typeof super import await new with do else in of case void delete yield throw constructor".split())
_DECLARES = frozenset("const let var".split())


@dataclass
class _Function:
    name: str | None
    start: int  # tokens
    end: int
    shown: int  # where what is shown begins
    method: bool = False
    exported: bool = False


class Source:
    """The tokens of one file, and what they declare."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], []
        self._read(0, len(text))
        self.lines = [i for i, c in enumerate(text) if c == "\n"]
        n = len(self.tokens)
        self.match, self.kind, self.frame = [-1] * n, [""] * n, [-1] * n  # frame: the open bracket around each token
        self._brackets()
        self.classes: list[tuple[int, int, str]] = []
        self.functions: list[_Function] = []
        self.imports: list[tuple[str, str | None, str | None]] = []  # module, local, name
        self._declarations()
        self.functions.sort(key=lambda f: (f.start, -f.end))

    def _read(self, at: int, end: int) -> None:
        while at < end:
            c, last = self.text[at], self.tokens[-1] if self.tokens else ""
            if c == "`":
                at = self._template(at, end)
                continue
            value = last and (last[0].isalnum() or last[0] in "_$#\"'`)]}" or ord(last[0]) > 127) and last not in _WORDS_BEFORE_VALUES
            if c == "/" and not value and self.text[at + 1 : at + 2] not in ("/", "*") and (m := _REGEX.match(self.text, at, end)):
                self._add('""', at)
            else:
                m = _TOKEN.match(self.text, at, end)
                if m.lastgroup != "skip":
                    self._add(m[0], at)
            at = m.end()

    def _add(self, token: str, at: int) -> None:
        self.tokens.append(token)
        self.at.append(at)

    def _template(self, at: int, end: int) -> int:
        """Reads what is embedded in a template, in brackets, as if it were an argument."""
        self._add('""', at)
        at += 1
        while at < end and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                depth, to = 1, at + 2
                while to < end and depth:
                    depth += {"{": 1, "}": -1}.get(self.text[to], 0)
                    to += 1
                for x in ("+", "("):
                    self._add(x, at)
                self._read(at + 2, to - 1)
                self._add(")", to - 1)
                at = to
            else:
                at += 1
        return at + 1

    def token(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < len(self.tokens) else ""

    def _brackets(self) -> None:
        open_: list[int] = []
        declared = ""
        for i, t in enumerate(self.tokens):
            if t in (")", "]", "}"):
                pair = {")": "(", "]": "[", "}": "{"}[t]
                while open_ and self.tokens[open_[-1]] != pair:
                    open_.pop()  # what never closes
                if open_:
                    self.match[i] = open_.pop()
                    self.match[self.match[i]] = i
            self.frame[i] = open_[-1] if open_ else -1
            if t in ("class", "interface", "enum") and self.token(i - 1) != "." and self.token(i + 1) not in (":", "(", ",", ")", "=", "}"):
                declared = t
            if t in ("(", "[", "{"):
                if t == "{":
                    self.kind[i] = self._brace(i, declared)
                    declared = ""
                open_.append(i)

    def _brace(self, i: int, declared: str) -> str:
        before, around = self.token(i - 1), self.kind[self.frame[i]] if self.frame[i] >= 0 else ""
        if declared:
            return "class" if declared == "class" else "type"
        if before == ":":
            back = i - 2
            while back >= 0 and self.tokens[back] not in (";", "{", "}", "case", "default", "?"):
                back -= 1
            label = back >= 0 and self.tokens[back] in ("case", "default", "?")
            return "object" if around == "object" else ("object" if self.token(back) == "?" else "block") if label else "type"
        if around == "type" or before in ("|", "&", "<", "extends") or before == "=" and self.token(i - 3) == "type":
            return "type"
        return "object" if before in _BEFORE_OBJECTS else "block"

    def _around(self, i: int) -> str:
        """The kind of bracket that token i is in directly: class, object, type, block, ( or [; empty at the top."""
        f = self.frame[i]
        return "" if f < 0 else self.kind[f] or self.tokens[f]

    def _after_type(self, i: int) -> int:
        """Where a type that begins at i ends: at a bracket of a body, an arrow, or what ends a declaration."""
        begun, depth = False, 0
        while i < len(self.tokens):
            t = self.tokens[i]
            depth += {"<": 1, ">": -1}.get(t, 0)
            if not depth and (t in ("=>", ";", ",", ")", "]", "}", "=") or t == "{" and begun and self.token(i - 1) not in ("|", "&")):
                return i
            i = self.match[i] + 1 if t in ("(", "[", "{") and self.match[i] > i else i + 1
            begun = True
        return i

    def _after_generics(self, i: int) -> int:
        if self.token(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            depth += {"<": 1, ">": -1}.get(self.tokens[i], 0)
            i += 1
            if not depth:
                break
        return i

    def _body(self, i: int) -> int:
        """The end of the body of a function whose parameters open at i; -1 if it has none."""
        if self.token(i) != "(" or self.match[i] < 0:
            return -1
        at = self.match[i] + 1
        if self.token(at) == ":":
            at = self._after_type(at + 1)
        return self.match[at] if self.token(at) == "{" and self.match[at] > at else -1

    def _bound(self, i: int) -> tuple[str | None, int, bool]:
        """The name that a function that begins at token i is bound to, where its statement begins, and if it's exported."""
        before = self.token(i - 1)
        if before == ":" and self._around(i) == "object":
            return self.token(i - 2).strip("\"'"), i - 2, False
        if before != "=":
            return None, i, False
        back = name = i - 2
        frame = self.frame[i]
        while back >= 0 and self.tokens[back] not in (";", "{", "}", ",") and self.frame[back] >= frame and self.tokens[back] not in _DECLARES:
            if self.frame[back] == frame and self.tokens[back] == ":":
                name = back - 1
            back -= 1
        in_class = self._around(i) == "class"
        name = name - 1 if self.token(name) in ("!", "?") else name
        if not re.match(r"[#\w$]", self.token(name) or " ") or self.frame[name] != frame or self.token(name - 1) == ".":
            return None, i, False
        if in_class:
            return self.tokens[name], back + 1, False
        if self.token(name - 1) not in _DECLARES | {","}:
            return None, i, False
        while back >= 0 and self.tokens[back] not in _DECLARES and self.frame[back] >= frame and self.tokens[back] != ";":
            back -= 1
        if self.token(back) not in _DECLARES:
            return None, i, False
        exported = self.token(back - 1) == "export"
        return self.tokens[name], back - exported, exported

    def _declarations(self) -> None:
        i, n = 0, len(self.tokens)
        while i < n:
            t, before, around = self.tokens[i], self.token(i - 1), self._around(i)
            if t == "import" and around == "" and self.token(i + 1) not in ("(", "."):
                self._import(i)
            elif t == "class" and before != "." and re.match(r"[\w$]", self.token(i + 1) or " ") and self.token(i + 1) != "extends":
                at = next((k for k in range(i, n) if self.kind[k] == "class" and self.frame[k] == self.frame[i]), -1)
                if at > 0 and before not in _BEFORE_EXPRESSIONS:
                    self.classes.append((i, self.match[at], self.tokens[i + 1]))
            elif t == "function" and before != "." and around != "type":
                self._function(i)
            elif t == "=>" and around != "type":
                self._arrow(i)
            elif around in ("class", "object") and re.match(r"[\w$#\"']", t) and self.token(i + 1) in ("(", "<"):
                self._method(i)
            i += 1

    def _first(self, i: int) -> int:
        """Back over what may stand before a declaration."""
        while self.token(i - 1) in ("async", "export", "default", "declare", "public", "private", "protected", "static", "override", "readonly", "abstract", "*"):
            i -= 1
        return i

    def _function(self, i: int) -> None:
        at = i + 1 + (self.token(i + 1) == "*")
        name = None
        if re.match(r"[\w$]", self.token(at) or " "):
            name, at = self.tokens[at], at + 1
        end = self._body(self._after_generics(at))
        if end < 0:
            return
        first = i - (self.token(i - 1) == "async")
        if self.token(first - 1) in _BEFORE_EXPRESSIONS:
            bound, shown, exported = self._bound(first)
            self.functions.append(_Function(bound, first, end, shown, exported=exported))
        else:
            start = self._first(i)
            self.functions.append(_Function(name, start, end, start, exported="export" in self.tokens[start:i]))

    def _arrow(self, i: int) -> None:
        start = i - 1
        if self.token(start) == ")" and self.match[start] >= 0:
            start = self.match[start]
        elif self.token(start - 1) in (":",) or not re.match(r"[\w$]", self.token(start) or " ") or self.token(start - 1) in ("is", ".", "|", "&"):
            back = start  # a type of what is returned
            while back > 0 and not (self.tokens[back] == ":" and self.tokens[back - 1] == ")") and self.tokens[back] not in (";", "{", "="):
                back = self.match[back] - 1 if self.tokens[back] in (")", "]", "}") and 0 <= self.match[back] < back else back - 1
            if self.token(back) != ":" or self.match[back - 1] < 0:
                return
            start = self.match[back - 1]
        while self.token(start - 1) == ">":  # type parameters
            depth, back = 0, start - 1
            while back >= 0:
                depth += {">": 1, "<": -1}.get(self.tokens[back], 0)
                if not depth:
                    break
                back -= 1
            start = max(back, 0)
        start -= self.token(start - 1) == "async"
        before, around = self.token(start - 1), self._around(start)
        if before in ("as", "|", "&", "<", "extends") or before == ":" and around != "object" and not self._ternary(start - 1):
            return
        if before == "=" and (self.token(start - 3) == "type" or self.token(start - 2) == ">"):
            return
        at = i + 1
        end = self.match[at] if self.token(at) == "{" and self.match[at] > at else self._expression(at)
        name, shown, exported = self._bound(start)
        self.functions.append(_Function(name, start, end, shown, exported=exported))

    def _ternary(self, i: int) -> bool:
        """Whether the colon at i belongs to a question mark."""
        back, frame = i - 1, self.frame[i]
        while back >= 0 and self.frame[back] >= frame and self.tokens[back] not in (";", ",", "{"):
            if self.tokens[back] == "?" and self.frame[back] == frame and self.token(back + 1) != ":":
                return True
            back = self.match[back] - 1 if self.tokens[back] in (")", "]", "}") and 0 <= self.match[back] < back else back - 1
        return False

    def _expression(self, i: int) -> int:
        """The last token of an expression that begins at i: before what ends it, or a line end that nothing goes on from."""
        first = i
        while i < len(self.tokens):
            t = self.tokens[i]
            if t in (",", ";", ")", "]", "}") or t == ":" and i > first:
                return max(first, i - 1)
            if i > first and self.line(i) > self.line(i - 1) and re.match(r"[\w$@#\"']", t) and re.match(r"[\w$)\]}\"']", self.tokens[i - 1]):
                return i - 1
            i = self.match[i] + 1 if t in ("(", "[", "{") and self.match[i] > i else i + 1
        return len(self.tokens) - 1

    def _method(self, i: int) -> None:
        before = self.token(i - 1)
        if before in (".", "?.", "=", "@", "new", "get", "set", "function", ":", "=>", "return", "?") and not (before in ("get", "set") and self.token(i - 2) in (".", "@")):
            return
        if self.tokens[i] == "constructor" and self._around(i) == "class":
            return
        end = self._body(self._after_generics(i + 1))
        if end > 0:
            start = self._first(i)
            while self.token(start - 1) == ")" and self.token(self.match[start - 1] - 2) == "@":  # decorators
                start = self.match[start - 1] - 2
            self.functions.append(_Function(self.tokens[i].strip("\"'"), start, end, start, method=True))

    def _import(self, i: int) -> None:
        end = i + 1
        while end < len(self.tokens) and self.tokens[end][0] not in "\"'":
            end += 1
        module, words = self.token(end).strip("\"'"), self.tokens[i + 1 : end]
        if words and words[-1] == "from":
            words = words[:-1]
        if words[:1] == ["type"] and len(words) > 1 and words[1] != ",":
            words = words[1:]
        if not words:
            self.imports.append((module, None, None))
        inside = False
        k = 0
        while k < len(words):
            w = words[k]
            if w in ("{", "}"):
                inside = w == "{"
            elif w == "*" and words[k + 1 : k + 2] == ["as"]:
                self.imports.append((module, words[k + 2], words[k + 2]))
                k += 2
            elif re.match(r"[\w$]", w):
                if inside and w == "type" and re.match(r"[\w$]", (words[k + 1 : k + 2] or [" "])[0]) and words[k + 1] != "as":
                    k += 1
                    w = words[k]
                local = words[k + 2] if words[k + 1 : k + 2] == ["as"] else w
                self.imports.append((module, local, w))
                k += 2 * (local != w or words[k + 1 : k + 2] == ["as"])
            k += 1

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.at[i] - 1) + 1

    def complexity(self, f: _Function) -> int:
        """One, and one more for each branch, but for those inside of other functions."""
        inner = [g for g in self.functions if f.start <= g.start and g.end <= f.end and g is not f]
        total, i = 1, f.start
        skip = {g.start: g.end for g in sorted(inner, key=lambda g: g.end)}
        while i <= f.end:
            if i in skip:
                i = skip[i] + 1
                continue
            t = self.tokens[i]
            if t in ("&&", "||") or t == "?" and self.token(i + 1) not in (":", ")", ",", "=", ";"):
                total += 1
            elif t in _BRANCHES and self.token(i - 1) != "." and self.token(i + 1) != ":":
                body = self.match[i - 1] if t == "while" and self.token(i - 1) == "}" else -1
                total += not (body > 0 and self.token(body - 1) == "do")
            i += 1
        return total


def read(path: str, text: str) -> dict[str, list[dict]]:
    """functions, sites and bindings of one file, as rows."""
    s = Source(text)
    language = EXTENSIONS[path.rsplit(".", 1)[-1].lower()]
    named = [f for f in s.functions if f.name]
    functions, names = {}, {}
    for f in named:
        around = sorted([(a, n) for a, b, n in s.classes if a <= f.start and f.end <= b] + [(g.start, g.name) for g in named if g is not f and g.start <= f.start and f.end <= g.end])
        qualname = ".".join([*(n for _, n in around), f.name])
        names[id(f)] = f"{path}::{qualname}"
        last = s.at[f.end] + len(s.tokens[f.end])
        shown = text[s.at[f.shown] : last]
        functions[names[id(f)]] = {
            "id": names[id(f)], "path": path, "name": f.name, "qualname": qualname, "language": language, "start_line": s.line(f.start),
            "end_line": s.line(f.end), "is_exported": f.exported, "is_method": f.method,
            "source": shown if len(shown) <= SOURCE_LENGTH else shown[:SOURCE_LENGTH] + SOURCE_MARK, "complexity": s.complexity(f),
        }
    imported = {local: name for _, local, name in s.imports if local}
    sites, open_ = [], []
    begins = {}
    for f in named:
        begins.setdefault(f.start, []).append(f)
    for i, t in enumerate(s.tokens):
        while open_ and open_[-1].end < i:
            open_.pop()
        open_ += begins.get(i, [])
        after = i + 1 + (s.token(i + 1) == "?.")
        if not open_ or s.token(after) != "(" or not re.match(r"[A-Za-z_$#\u0080-￿]", t) or t in _NO_CALLS and s.token(i - 1) not in (".", "?."):
            continue
        before = s.token(i - 1)
        if before in ("new", "function", "@") or s._around(i) in ("class", "object") and s._body(after) > 0 or s._around(i) == "type":
            continue
        row = {"caller_id": names[id(open_[-1])], "path": path, "kind": "name", "base": None, "name": t, "line": s.line(i), "pos": len(sites)}
        if before in (".", "?."):
            base = s.token(i - 2)
            simple = s.token(i - 3) not in (".", "?.") and re.match(r"[\w$]", base or " ")
            row["line"] = s.line(i - 2) if simple else row["line"]
            row |= {"kind": "self_attr"} if base == "this" and simple else {"kind": "name_attr", "base": base if simple else None}
        elif t in imported:  # under its own name, in the file that it comes from
            row |= {"kind": "name_attr", "base": t, "name": imported[t]}
        sites.append(row)
    bindings = [{"path": path, "local": local, "module": module, "name": name, "level": 0, "pos": k} for k, (module, local, name) in enumerate(s.imports)]
    return {"functions": list(functions.values()), "sites": sites, "bindings": bindings}


#: Two closing tags in a line, the slashes of which may look like a regular expression's ends; and text between tags and braces with two
#: quotes in a line, which may look like a string; and a closing tag that ends a statement without a semicolon, the last sign of which looks
#: like an operator.
MARKUP = r"</[A-Za-z>]"
MARKUP_TEXT = r"""</[\w.]*>[^\n]*</|[>}][^<>{}()=;\n]*(['"`])[^\n;]*\1[^<>{}()=;\n]*(?:</|\{)|</[\w.]*>\s*\n(?:export|function|const|let|var|class|import|async|type|interface)\b"""


def unreadable(path: str, source: str) -> str | None:
    """Why a file is not read although it could be: text in markup would be taken for code."""
    if not path.lower().endswith(".ts") and re.search(MARKUP, source) and re.search(MARKUP_TEXT, source):
        return "text inside of markup is not read"
    return None


def parse(sources: DataFrame) -> DataFrame:
    """functions, sites and bindings (arrays of structs) of sources (path, source) in these languages, and reason: null, or why a
    file is not read; the arrays are empty then."""
    ship(sources.sparkSession)
    extension = F.lower(F.element_at(F.split("path", r"\."), -1))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, source in zip(*(c.to_pylist() for c in batch.columns)):
                    got, reason = {}, unreadable(path, source or "")
                    try:
                        got = {} if reason else read(path, source or "")
                    except IndexError:
                        reason = "ends too early"
                    except RecursionError:
                        reason = "nested too deeply"
                    yield path, *(json.dumps(got.get(k, [])) for k in ("functions", "sites", "bindings")), reason

        return batched(rows(), pa.schema([(c, pa.string()) for c in PARSED]))

    some = sources.where(extension.isin(*EXTENSIONS)).select("path", "source")
    return unpacked(spread(some, "path").mapInArrow(parsed, ", ".join(f"{c} string" for c in PARSED)))


def resolve_modules(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """bindings with target: the file among files (path) that a relative module names, with an extension, a file's extension
    in place of .js, or an index; null for packages."""
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "/")
    steps = F.filter(F.split(F.concat_ws("/", folder, "module"), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(  # `..` takes the last folder away
        steps, F.array().cast("array<string>"),
        lambda a, x: F.when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    stem = F.array_join(up, "/")
    bare = F.regexp_replace(stem, r"\.jsx?$", "")
    tries = [stem, *(F.concat(b, F.lit(f"{i}.{e}")) for b, i in ((stem, ""), (bare, ""), (stem, "/index")) for e in EXTENSIONS)]
    each = bindings.where(F.col("module").startswith(".")).select("path", "pos", F.posexplode(F.array(*tries)).alias("rank", "file"))
    found = each.join(files.select(F.col("path").alias("file")).distinct().hint("merge"), "file").groupBy("path", "pos").agg(F.min_by("file", "rank").alias("target"))
    return bindings.join(found.hint("merge"), ["path", "pos"], "left")


def analyze(sources: DataFrame) -> dict[str, DataFrame]:
    """functions, call sites (resolved) and imports of sources (path, source), as sources.tsjson reads them from an analyzer, and
    unread (path, reason). Nothing is type-checked here, so no call says so: that is the analyzer's word."""
    parsed = written(parse(sources), "parsed-scripts")
    functions = parsed.select(F.inline("functions"))
    bound = resolve_modules(parsed.select(F.inline("bindings")), parsed.where("reason is null").select("path"))
    calls = resolve_calls(parsed.select(F.inline("sites")), functions, bound)
    edges = bound.where("target is not null and target <> path").groupBy(F.col("path").alias("from_path"), F.col("target").alias("to_path"))
    imports = edges.agg(F.array_sort(F.collect_set("name")).alias("imported_names"))
    return {"functions": functions, "calls": calls, "imports": imports, "unread": parsed.where("reason is not null").select("path", "reason")}
