"""Source files as rows: imports, definitions, calls and marks of what cannot be followed.

Python is parsed by the standard library's parser in Arrow batches; a file that does not parse is one row with an error,
never a file without imports. Script imports are read natively by pattern (a lexer's subset: comments are removed first).
Files beyond MOST_BYTES, or with a line beyond MOST_LINE, are not parsed, and say so.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES, MOST_LINE = 300_000, 50_000
PARSED = "project string, file string, kind string, name string, target string, line int, end int"


class _Reader(ast.NodeVisitor):
    """kind, name, target, line, end: import, def, call and dynamic rows of a module."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.scope: list[str] = []

    def visit_Import(self, node):
        for a in node.names:
            self.rows.append(("import", a.asname or a.name.split(".")[0], a.name, node.lineno, node.end_lineno))

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.rows.append(("import", a.asname or a.name, f"{module}:{a.name}", node.lineno, node.end_lineno))

    def _named(self, node):
        self.scope.append(node.name)
        self.rows.append(("def", ".".join(self.scope), None, node.lineno, node.end_lineno))
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _named

    def visit_Call(self, node):
        target = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else None
        dynamic = target in ("eval", "exec", "__import__", "getattr", "importlib.import_module") or target is None
        self.rows.append(("dynamic" if dynamic else "call", ".".join(self.scope), target, node.lineno, node.end_lineno))
        self.generic_visit(node)


def read_python(text: str | None) -> list[tuple]:
    if text is None:
        return [("error", "no text", None, 0, 0)]
    if len(text.encode()) > MOST_BYTES or any(len(x.encode()) > MOST_LINE for x in text.split("\n")):
        return [("error", "too long", None, 0, 0)]
    reader = _Reader()
    try:
        reader.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", type(e).__name__, None, 0, 0)]
    return reader.rows


def python(files: DataFrame) -> DataFrame:
    """project, file, kind (import, def, call, dynamic, error), name, target, line, end. files: project, file, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, f, *r) for p, f, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for r in read_python(t)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string()] * 5 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["project", "file", "kind", "name", "target", "line", "end"])

    return files.select("project", "file", "content").mapInArrow(run, PARSED)


_QUOTED = r"""["']([^"'\n]+)["']"""


def script(files: DataFrame) -> DataFrame:
    """project, file, kind (import, require, dynamic, dispatch, error), specifier (null if it is not a literal). files: project, file, content."""
    long = (F.octet_length("content") > MOST_BYTES) | F.exists(F.split("content", "\n"), lambda x: F.octet_length(x) > MOST_LINE)
    rows = files.select("project", "file", F.coalesce(long, F.lit(True)).alias("bad"), F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)/\*.*?\*/", " "), r"(?m)(^|[^:\"'])//[^\n]*", "$1").alias("c"))
    of = lambda kind, pattern: F.transform(F.regexp_extract_all("c", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.when(x != "", x).alias("specifier")))
    found = F.concat(
        of("import", rf"(?:^|[\s;}}])(?:import|export)\s*(?:[\w$*{{][^;\"'()]*?\sfrom\s*)?{_QUOTED}"),
        of("require", rf"(?:^|[^\w$.])require\s*\(\s*{_QUOTED}\s*\)"),
        of("import", rf"(?:^|[^\w$.])import\s*\(\s*{_QUOTED}\s*\)"),
        F.transform(F.regexp_extract_all("c", F.lit(r"((?:^|[^\w$.])(?:import|require)\s*\(\s*[^\"'\s)])"), F.lit(1)), lambda x: F.struct(F.lit("dynamic").alias("kind"), F.lit(None).cast("string").alias("specifier"))),
        F.transform(F.regexp_extract_all("c", F.lit(r"([\w$\])]\[[^\]]+\]\s*\(|(?:^|[^\w$.])eval\s*\(|new\s+Function\s*\()"), F.lit(1)), lambda x: F.struct(F.lit("dispatch").alias("kind"), F.lit(None).cast("string").alias("specifier"))),
    )
    error = F.array(F.struct(F.lit("error").alias("kind"), F.lit(None).cast("string").alias("specifier")))
    return rows.select("project", "file", F.explode(F.when(F.col("bad"), error).otherwise(F.array_distinct(found))).alias("x")).select("project", "file", "x.*")
