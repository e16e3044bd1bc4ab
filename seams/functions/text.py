"""Functions of identifiers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layers by name, document types by content (first hit wins), words left out of service names.
LAYERS = (
    ("service", r"service|usecase|use_case|business"),
    ("repository", r"repo|repository|dao|store|persist"),
    ("controller", r"controller|handler|view|endpoint|route|resource"),
    ("model", r"model|entity|domain|schema|dto|vo\b"),
    ("util", r"util|helper|common|shared|mixin|support"),
)
DOCUMENT_TYPES = (
    ("requirements", r"requirement|shall|must|user.stor|acceptance"),
    ("architecture", r"architect|component|service|module|layer|design"),
    ("api-spec", r"endpoint|rest|graphql|swagger|openapi|grpc"),
    ("data-model", r"entity|table|schema|erd|data.model|relation"),
    ("runbook", r"runbook|playbook|incident|deploy|rollback"),
)
NAME_SUFFIXES = ("Service", "Controller", "Repository", "Handler", "Manager", "Facade", "Impl", "Dao", "Repo")

WHITE = r"(?U)[\s\x1c-\x1f]+"
CHUNK_WORDS, CHUNK_STRIDE, CHUNK_LEAST, TEXT_LEAST = 500, 450, 10, 50


def tokenize(text: Column) -> Column:
    """Lower-cased identifier parts of over two characters: case words and acronyms, then all runs of three small letters (repeats stay)."""
    camel = F.regexp_extract_all(text, F.lit(r"([A-Za-z][a-z]+|[A-Z]+(?=[A-Z]|$))"), F.lit(1))
    small = F.regexp_extract_all(text, F.lit(r"([a-z]{3,})"), F.lit(1))
    return F.filter(F.transform(F.concat(camel, small), F.lower), lambda t: F.length(t) > 2)


def layer_hints(name: Column) -> Column:
    return F.array_compact(F.array(*[F.when(name.rlike(f"(?iU){pattern}"), F.lit(layer)) for layer, pattern in LAYERS]))


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def clean_text(text: Column) -> Column:
    kept = F.regexp_replace(text, r"(?U)[^A-Za-z0-9\s\x1c-\x1f\-_./]", " ")
    return F.trim(F.regexp_replace(kept, WHITE, " "))


def chunks(text: Column) -> Column:
    """Array of (chunk_no, text): 500-word pieces of a clean text every 450 words, without those of 10 words or fewer."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.floor((F.size(words) - 1) / CHUNK_STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda k: F.struct(k.alias("chunk_no"), F.slice(words, k * CHUNK_STRIDE + 1, F.lit(CHUNK_WORDS)).alias("words")))
    return F.transform(F.filter(pieces, lambda c: F.size(c["words"]) > CHUNK_LEAST), lambda c: F.struct(c["chunk_no"].alias("chunk_no"), F.array_join(c["words"], " ").alias("text")))


def classify_document(text: Column, filename: Column) -> Column:
    sample = F.lower(F.concat_ws(" ", filename, F.substring(text, 1, 500)))
    out = F.lit("general")
    for kind, pattern in reversed(DOCUMENT_TYPES):
        out = F.when(sample.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def markdown_text(raw: Column) -> Column:
    """Text without heading marks, emphasis, code, images and link targets."""
    for pattern, new in ((r"#{1,6}\s+", ""), (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"`{1,3}[^`]*`{1,3}", " "), (r"!\[.*?\]\(.*?\)", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
        raw = F.regexp_replace(raw, pattern, new)
    return raw


# Character entities.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_text(raw: Column) -> Column:
    """Text of a page without script, style, head and tags."""
    raw = F.regexp_replace(raw, r"(?is)<(script|style|head)\b[^>]*>.*?</(script|style|head)>", " ")
    raw = F.regexp_replace(raw, r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        raw = F.replace(raw, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def normalize_path(path: Column) -> Column:
    """Forward slashes, no empty or `.` parts, no leading dots or slashes."""
    path = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(\./|/)+", "/")
    return F.regexp_replace(path, r"^[./]+", "")


def decay(age_seconds: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), age_seconds / F.lit(86400.0 * half_life_days))


def cosine(x: Column, y: Column) -> Column:
    """Of two arrays of numbers; norms of zero count as 1e-9."""
    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)

    dot = total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))
    norms = [F.greatest(F.sqrt(total(F.transform(v, lambda a: a.cast("double") * a.cast("double")))), F.lit(1e-9)) for v in (x, y)]
    return dot / (norms[0] * norms[1])


def suggest_name(a: Column, b: Column) -> Column:
    """Name of a service for a pair: the longer of the two short names without common suffixes."""
    def bare(unit: Column) -> Column:
        name = short_name(unit)
        for word in NAME_SUFFIXES:
            name = F.replace(name, F.lit(word), F.lit(""))
        name = F.trim(name)
        return F.when(name == "", unit).otherwise(name)

    x, y = bare(a), bare(b)
    longer = F.when(F.length(x) >= F.length(y), x).otherwise(y)
    return F.when(longer == "", F.lit("UnnamedService")).otherwise(F.concat(longer, F.lit("Service")))


def cross_layer(a: Column, b: Column) -> Column:
    """1 where hints of both sides are among controller and repository, or controller and model, and the hint sets differ."""
    differ = F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b))
    hit = F.lit(False)
    for pair in (("controller", "repository"), ("controller", "model")):
        both = F.array(*[F.lit(x) for x in pair])
        hit = hit | (F.arrays_overlap(a, both) & F.arrays_overlap(b, both))
    return F.when(F.coalesce(hit & differ, F.lit(False)), 1).otherwise(0)
