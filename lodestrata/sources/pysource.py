"""Functions, call sites and imports of Python sources, with the standard parser, in Arrow batches."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension_of
from ..runtime import batched, ship, spread

#: Characters of a source that are kept, and what marks that there were more.
SOURCE_LENGTH, SOURCE_MARK = 20_000, "\n... (truncated)"
FUNCTION = (
    "id string, path string, name string, qualname string, language string, start_line int, end_line int, "
    "is_exported boolean, is_method boolean, source string, complexity int"
)
SITE = "caller_id string, path string, kind string, base string, name string, line int, pos long"
BINDING = "path string, local string, module string, name string, level int, pos long"


def complexity(node: ast.AST) -> int:
    """One, and one more for each branch, loop, handler, case and further operand; nested functions count for themselves."""
    total, todo = 1, list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.match_case)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.comprehension):
            total += 1 + len(n.ifs)
        todo += ast.iter_child_nodes(n)
    return total


class _Reader(ast.NodeVisitor):
    """Collects from one file; the scope holds names of classes and functions around."""

    def __init__(self, path: str, source: str):
        self.path, self.lines = path, source.splitlines(keepends=True)
        self.scope: list[tuple[str, str]] = []
        self.used: dict[str, int] = {}
        self.functions, self.sites, self.bindings = [], [], []

    def _within(self, kind: str, name: str, node: ast.AST) -> None:
        self.scope.append((kind, name))
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._within("class", node.name, node)

    def visit_FunctionDef(self, node) -> None:
        plain = ".".join([n for _, n in self.scope] + [node.name])
        self.used[plain] = self.used.get(plain, 0) + 1
        qualname = plain if self.used[plain] == 1 else f"{plain}#{self.used[plain]}"
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        source = "".join(self.lines[first - 1 : node.end_lineno])
        if len(source) > SOURCE_LENGTH:
            source = source[:SOURCE_LENGTH] + SOURCE_MARK
        self.functions.append(
            {
                "id": f"{self.path}::{qualname}", "path": self.path, "name": node.name, "qualname": qualname, "language": "python",
                "start_line": first, "end_line": node.end_lineno, "is_exported": not node.name.startswith("_"),
                "is_method": bool(self.scope) and self.scope[-1][0] == "class", "source": source, "complexity": complexity(node),
            }
        )
        self._within("function", node.name, node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        f, kind, base, name = node.func, None, None, None
        if isinstance(f, ast.Name):
            kind, name = "name", f.id
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            base, name = f.value.id, f.attr
            kind = "self_attr" if base in ("self", "cls") else "name_attr"
        if kind and self.scope:  # module-level calls have no caller
            caller = f"{self.path}::{'.'.join(n for _, n in self.scope)}"
            self.sites.append(
                {"caller_id": caller, "path": self.path, "kind": kind, "base": base, "name": name, "line": node.lineno, "pos": len(self.sites)}
            )
        self.generic_visit(node)

    def _bound(self, local: str, module: str | None, name: str | None, level: int) -> None:
        row = {"path": self.path, "local": local, "module": module, "name": name, "level": level, "pos": len(self.bindings)}
        self.bindings.append(row)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._bound(a.asname or a.name.split(".")[0], a.name, None, 0)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self._bound(a.asname or a.name, node.module, a.name, node.level)


def read(path: str, source: str) -> _Reader | str:
    """What a file holds, or why it can't be read."""
    try:
        tree = ast.parse(source)
        reader = _Reader(path, source)
        reader.visit(tree)
    except SyntaxError as e:
        return f"syntax error in line {e.lineno}: {e.msg}"
    except ValueError as e:
        return f"not a source text: {e}"
    except RecursionError:
        return "nested too deeply"
    return reader


def parse(sources: DataFrame) -> DataFrame:
    """functions, sites and bindings (arrays of structs) of sources (path, source), and reason: null, or why the file could not be
    read; the arrays are empty then."""
    ship(sources.sparkSession)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, source in zip(*(c.to_pylist() for c in batch.columns)):
                    got = read(path, source or "")
                    failed = isinstance(got, str)
                    yield path, *(["[]"] * 3 if failed else map(json.dumps, (got.functions, got.sites, got.bindings))), got if failed else None

        return batched(rows(), pa.schema([(c, pa.string()) for c in PARSED]))

    raw = spread(sources.select("path", "source"), "path").mapInArrow(parsed, ", ".join(f"{c} string" for c in PARSED))
    return unpacked(raw)


PARSED = ["path", "functions", "sites", "bindings", "reason"]


def unpacked(raw: DataFrame) -> DataFrame:
    """raw with its texts of functions, sites and bindings as arrays of structs."""
    kinds = {n: structs(k) for n, k in (("functions", FUNCTION), ("sites", SITE), ("bindings", BINDING))}
    return raw.withColumns({n: F.from_json(n, k) for n, k in kinds.items()})


def structs(ddl: str) -> str:
    """An array of structs of these columns."""
    return f"array<struct<{', '.join(':'.join(c.split(' ')) for c in ddl.split(', '))}>>"


#: Of a file that is read all the same.
REPLACED = "not UTF-8: bytes were replaced"


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("py",)) -> DataFrame:
    """path (relative), source of the files under root with these extensions, read by the executors; bytes that are not UTF-8
    are replaced, and noted as such in reason, which is null for all other files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}")
    files = files.load(re.sub(r"([\[\]{}*?\\])", r"\\\1", root))  # a name, not a pattern
    folder = F.lit(urlsplit(root).path.rstrip("/") + "/" if "://" in root or root.startswith("file:") else root.rstrip("/") + "/")
    relative = F.substr(F.col("path"), F.instr(F.col("path"), folder) + F.length(folder))
    reason = F.when(~F.is_valid_utf8(F.col("content").cast("string")), REPLACED)
    return files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), reason.alias("reason")).where(extension_of(F.col("path")).isin(*extensions))


def with_empty(sources: DataFrame, paths: DataFrame, extensions: tuple[str, ...] = ("py",)) -> DataFrame:
    """sources with the files of paths (path) that it lacks, as empty: Spark's readers skip files without bytes."""
    python = paths.where(extension_of(F.col("path")).isin(*extensions)).select("path").distinct()
    empty = python.join(sources, "path", "left_anti").select("path", F.lit("").alias("source"))
    return sources.unionByName(empty, allowMissingColumns=True)
