"""Facts about Python sources: definitions, calls, imports, references, exceptions, accesses and environment variables, from each file's syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, owner string, name string, label string, parent string, line int, end_line int, detail string"
NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]


def dotted(node: ast.AST) -> str:
    """a.b.c of a name or an attribute of names, else nothing."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


class _Facts(ast.NodeVisitor):
    """One walk over a file; owner is the dotted path of the definition that a fact is in."""

    def __init__(self, path: str, source: str):
        self.path, self.source, self.stack, self.rows = path, source, [], []

    def add(self, kind: str, node: ast.AST, name: str, label: str = "", parent: str = "", detail: str = "") -> None:
        self.rows.append((self.path, kind, ".".join(n for n, _ in self.stack), name, label, parent, getattr(node, "lineno", 1), getattr(node, "end_lineno", 1) or 1, detail))

    def _define(self, node, label: str, detail: str) -> None:
        inside = self.stack[-1][1] if self.stack else ""
        self.add("definition", node, node.name, "Method" if label == "Function" and inside == "Class" else label, self.stack[-1][0] if inside == "Class" else "", detail)
        for d in node.decorator_list:
            self.add("decorator", d, node.name, detail=ast.get_source_segment(self.source, d) or "")
        self.stack.append((node.name, label))
        self.generic_visit(node)
        self.stack.pop()

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "Function", f"({ast.unparse(node.args)})")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for base in node.bases:
            self.add("base", base, dotted(base), parent=node.name)
        self._define(node, "Class", "")

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", node, a.name, detail=a.asname or a.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add("import", node, f"{'.' * node.level}{node.module or ''}.{a.name}", detail=a.asname or a.name)

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        if name:
            self.add("call", node, name)
        first = node.args[0] if node.args else None
        if name in ("os.getenv", "os.environ.get", "getenv") and isinstance(first, ast.Constant) and isinstance(first.value, str):
            self.add("env", node, first.value)
        if name.rpartition(".")[2] in ("emit", "on") and isinstance(first, ast.Constant) and isinstance(first.value, str):
            self.add("channel", node, first.value, label=name.rpartition(".")[2])
        for part in [*node.args, *(k.value for k in node.keywords)]:
            if dotted(part):
                self.add("reference", part, dotted(part))
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if dotted(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
            self.add("env", node, str(node.slice.value))
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        what = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        if what is not None and dotted(what):
            self.add("throw", node, dotted(what))
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        self.add("read" if isinstance(node.ctx, ast.Load) else "write", node, node.id)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if dotted(node.target):
            self.add("typed", node, dotted(node.target), detail=ast.unparse(node.annotation))
        self.generic_visit(node)


def facts_of(path: str, source: str | None) -> list[tuple]:
    """A file's facts; a file that can't be parsed gives one of kind "unparsed"."""
    try:
        walk = _Facts(path, source or "")
        walk.visit(ast.parse(source or ""))
        return walk.rows
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "unparsed", "", "", "", "", 1, 1, str(e)[:200])]


def python_facts(sources: DataFrame) -> DataFrame:
    """Facts of every Python file of sources (path, text), each file parsed in the task that reads it. Empty and null texts have none."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if n in ("line", "end_line") else pa.string() for n in NAMES]
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = facts_of(path, text)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=NAMES)

    return sources.filter(F.col("path").rlike(r"\.pyi?$")).select("path", "text").mapInArrow(run, SCHEMA)
