"""Signals of source code: units, imports, edges."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seams.checkpoints import settle
from seams.config import CODE_SUFFIXES
from seams.functions.text import LAYERS, layer_hints, tokenize

# Annotations that count as hints.
SPRING = ("Bean", "Component", "Configuration", "Controller", "Entity", "FeignClient", "KafkaListener", "Repository", "RestController", "Service")
ROOT_FOLDERS = ("app", "lib", "main", "pkg", "python", "src")

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp)
_LAYERS = [(layer, re.compile(pattern, re.I)) for layer, pattern in LAYERS]


def _hints(name: str) -> list[str]:
    return [layer for layer, pattern in _LAYERS if pattern.search(name)]


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def module_id(path: str) -> str:
    """Dotted path without suffix and without leading source folders."""
    absolute, parts = path.startswith("/"), [p for p in path.split("/") if p not in ("", ".")]
    if not parts:
        return _stem(path)
    parts[-1] = _stem(parts[-1])
    parts = ["/", *parts] if absolute else parts
    while parts and parts[0].lower() in ROOT_FOLDERS:
        parts = parts[1:]
    return ".".join(parts) or _stem(path)


def parse_python(path: str, source: str) -> dict:
    """Names, imports and texts of a module; only its stem as id where it does not parse."""
    unit = {"unit_id": _stem(path), "package": ""}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return unit
    classes, methods, imports, hints, notes, bases = [], [], [], [], [], []
    complexity = []
    for node in ast.walk(tree):
        match node:
            case ast.ClassDef():
                classes.append(node.name)
                hints += _hints(node.name)
                bases += [ast.unparse(b) for b in node.bases]
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                methods.append(node.name)
                complexity.append(1 + sum(isinstance(x, _DECISIONS) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(node)))
            case ast.Import():
                imports += [a.name for a in node.names]
            case ast.ImportFrom() if node.module:
                imports.append(node.module)
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and (text := ast.get_docstring(node)):
            notes.append(text)
    lines = [line.strip() for line in source.splitlines()]
    notes += [line.lstrip("# ") for line in lines if line.startswith("#")]
    return unit | {
        "unit_id": module_id(path), "class_names": classes, "method_names": methods, "imports": imports, "domain_hints": hints,
        "comments": " ".join(notes), "bases": bases, "cyclomatic_complexity": sum(complexity) / len(complexity) if complexity else 0.0,
        "loc": sum(1 for line in lines if line and not line.startswith("#")),
    }


_JAVA_CLASS = re.compile(r"((?:@[\w.]+(?:\s*\([^()]*\))?\s*)*)(?:(?:public|protected|private|abstract|final|static|strictfp|sealed)\s+)*\bclass\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?")
_JAVA_METHOD = re.compile(r"(?:^|[;{}])\s*(?:@[\w.]+(?:\s*\([^()]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?[\w$.<>\[\],? ]+?[\s\]>]([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?:throws\s+[\w$., ]+)?\s*[{;]", re.M)
_JAVA_WORDS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "try", "do", "throw", "synchronized"}


def parse_java(path: str, source: str) -> dict:
    """Package, classes, methods, imports and annotations found by patterns over code without comments and strings.

    Interfaces and enums are no classes. Methods are read at any depth; anonymous classes are not told apart.
    """
    notes = re.findall(r"/\*\*?(.*?)\*/", source, re.S) + re.findall(r"//(.+)", source)
    code = re.sub(r'"(?:\\.|[^"\\\n])*"|/\*.*?\*/|//[^\n]*', lambda m: '""' if m[0][0] == '"' else " ", source, flags=re.S)
    package = (re.search(r"^\s*package\s+([\w.]+)\s*;", code, re.M) or ("", ""))[1]
    classes, annotations, hints, bases = [], [], [], []
    for m in _JAVA_CLASS.finditer(code):
        classes.append(f"{package}.{m[2]}" if package else m[2])
        hints += _hints(m[2])
        for name in re.findall(r"@([\w.]+)", m[1]):
            annotations.append(name)
            if name in SPRING:
                hints.append(name.lower())
        if m[3]:
            bases.append(m[3])
    methods = [m[1] for m in _JAVA_METHOD.finditer(code) if m[1] not in _JAVA_WORDS]
    decisions = len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?", code))
    return {
        "unit_id": classes[0] if classes else _stem(path), "package": package, "class_names": classes, "method_names": methods,
        "imports": re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", code, re.M), "annotations": annotations, "domain_hints": hints,
        "comments": " ".join(notes), "bases": bases, "cyclomatic_complexity": 1 + decisions / max(len(methods), 1) if methods else 0.0,
        "loc": sum(1 for line in code.splitlines() if line.strip()),
    }


def parse_generic(path: str, source: str) -> dict:
    notes = [a or b for a, b in re.findall(r"//(.+)|#(.+)", source)]
    return {"unit_id": _stem(path), "package": "", "comments": " ".join(notes), "loc": sum(1 for line in source.splitlines() if line.strip())}


_PARSERS = {"python": parse_python, "java": parse_java}
_LISTS = ("class_names", "method_names", "imports", "annotations", "domain_hints", "bases")
_FIELDS = "unit_id string, file_path string, language string, package string, " + ", ".join(f"{c} array<string>" for c in _LISTS) + ", comments string, cyclomatic_complexity double, loc bigint, content string"


def parse_sources(files: DataFrame) -> DataFrame:
    """files (path, content) -> units in the order of paths, with unique ids (X, X_1, X_2) and unit_idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                language = CODE_SUFFIXES.get("." + path.rsplit(".", 1)[-1].lower(), "unknown")
                unit = dict.fromkeys(_LISTS, ()) | {"comments": "", "cyclomatic_complexity": 0.0, "loc": 0} | _PARSERS.get(language, parse_generic)(path, content or "")
                rows.append(unit | {"file_path": path, "language": language, "content": content or ""})
            schema = pa.schema([(n, pa.list_(pa.string()) if t.startswith("array") else {"double": pa.float64(), "bigint": pa.int64()}.get(t, pa.string())) for n, t in (x.split(" ") for x in _FIELDS.split(", "))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    units = files.select("path", "content").mapInArrow(run, _FIELDS)
    return number(unique_ids(units.withColumn("raw_tokens", tokenize(F.col("content"))).drop("content")))


def unique_ids(units: DataFrame, order: str = "file_path") -> DataFrame:
    """The second unit X becomes X_1, the third X_2, in the given order."""
    nth = F.row_number().over(W.partitionBy("unit_id").orderBy(order)) - 1
    return units.withColumn("nth", nth).withColumn("unit_id", F.when(F.col("nth") > 0, F.concat_ws("_", "unit_id", F.col("nth").cast("string"))).otherwise(F.col("unit_id"))).drop("nth")


def number(units: DataFrame, order: str = "file_path") -> DataFrame:
    """unit_idx from 0 in the given order. Units are the (few) components of one analysis."""
    return units.withColumn("unit_idx", (F.row_number().over(W.orderBy(order, "unit_id")) - 1).cast("long"))


def symbol_table(units: DataFrame, all_modules: bool = False) -> DataFrame:
    """(symbol, unit_id). Full class names (the last writer), ids of units with classes, then short class names (the first writer).

    Full names and ids stand above short names. all_modules registers units without classes, too.
    """
    own = units.select("unit_id", "unit_idx", F.posexplode("class_names").alias("pos", "name"))
    full = own.select(F.col("name").alias("symbol"), "unit_id", F.struct(F.lit(2).alias("tier"), "unit_idx", "pos").alias("rank"))
    ids = (units if all_modules else units.where(F.size("class_names") > 0)).select(F.col("unit_id").alias("symbol"), "unit_id", F.struct(F.lit(2).alias("tier"), "unit_idx", F.lit(1 << 30).alias("pos")).alias("rank"))
    short = own.select(F.element_at(F.split("name", "[.]"), -1).alias("symbol"), "unit_id", F.struct(F.lit(1).alias("tier"), -F.col("unit_idx").alias("unit_idx"), (-F.col("pos")).alias("pos")).alias("rank"))
    return full.unionAll(ids).unionAll(short).groupBy("symbol").agg(F.max_by("unit_id", "rank").alias("unit_id"))


#: Symbols up to this many are told to every task.
MOST_SYMBOLS = 200_000


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports (source, pos, name) -> (source, pos, name, target): the whole name, else for i from the last part down the first i parts, then part i."""
    parts = F.split("name", "[.]")
    tries = F.when(F.size(parts) > 1, F.flatten(F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array(F.array_join(F.slice(parts, F.lit(1), i), "."), F.element_at(parts, i + 1))))).otherwise(F.array().cast("array<string>"))
    asked = imports.select("source", "pos", "name", F.posexplode(F.concat(F.array("name"), tries)).alias("rank", "symbol"))
    symbols = settle(symbols)  # counted, then joined
    known = F.broadcast(symbols) if symbols.count() <= MOST_SYMBOLS else symbols.hint("merge")
    # what is not found stays in the groups: imports are not joined with their own results, which would be sent to the driver
    found = F.min_by("unit_id", F.when(F.col("unit_id").isNotNull() & F.col("source").isNotNull() & F.col("pos").isNotNull(), F.col("rank")))
    hit = asked.join(known, "symbol", "left").groupBy("source", "pos", "name").agg(found.alias("target"), F.count_if(F.col("rank") == 0).cast("int").alias("times"))
    return hit.select("source", "pos", "name", F.explode(F.array_repeat("target", F.col("times"))).alias("target"))


def edges(resolved: DataFrame, strong: int = 5) -> DataFrame:
    """(source, target, kind, weight): import statements per pair of units, without self and unresolved ones."""
    counts = resolved.where("target is not null and target <> source").groupBy("source", "target").agg(F.count("*").alias("weight"))
    return counts.select("source", "target", F.when(F.col("weight") >= strong, "strong_import").otherwise("import").alias("kind"), "weight")


def inheritance_edges(units: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of kind inheritance from units to those of their base classes."""
    bases = units.select(F.col("unit_id").alias("source"), F.posexplode("bases").alias("pos", "name"))
    found = resolve_imports(bases, symbols).where("target is not null and target <> source")
    return found.groupBy("source", "target").agg(F.count("*").alias("weight")).select("source", "target", F.lit("inheritance").alias("kind"), "weight")


def coupling(edge_table: DataFrame) -> DataFrame:
    """(comp_a, comp_b, coupling): the larger of both directions' weights, comp_a < comp_b."""
    return edge_table.groupBy(F.least("source", "target").alias("comp_a"), F.greatest("source", "target").alias("comp_b")).agg(F.max("weight").alias("coupling"))


def layers(units: DataFrame) -> DataFrame:
    """Graph nodes: (unit_id, language, layer, loc, cyclomatic_complexity)."""
    return units.select("unit_id", "language", F.coalesce(F.try_element_at("domain_hints", F.lit(1)), F.lit("unknown")).alias("layer"), "loc", "cyclomatic_complexity")


__all__ = ["coupling", "edges", "inheritance_edges", "layer_hints", "layers", "module_id", "number", "parse_sources", "resolve_imports", "symbol_table", "unique_ids"]
