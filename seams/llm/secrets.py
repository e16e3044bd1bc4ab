"""Secret scans through a trigram index, in DataFrame functions only.

Each rule is a regex. From its syntax tree comes a Boolean query over lower-cased
trigrams that any match must hold (`trigram_query`): literals give the trigrams of
their strings, sequences AND, branches OR. The index is partitioned by document: a row's postings are
the trigrams that some query asks for and its text holds, and they stay in the row, so no text is ever moved and
copies and hot sources cost what other rows cost. A query's clauses are intersected with the row's postings; rows
that pass are verified with the regex itself. Rules without a mandatory trigram
(the hex rule) scan every text.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. To
get them without leaving the JVM, matches are framed by a control character (one that
no rule can match, and that is first replaced where a text holds it) and the lengths of
the pieces are summed up. The span of a private key goes to its END line, or, where that is missing, over up to 200 lines of base64.

Nulls: a null text is empty and has no spans; `redact` leaves it null. Repeated rows and null ids are scanned like others, texts
whole whatever their length. Spans of different kinds that start together are in the order of RULES. Other columns, of whatever
name, are kept as they are. No documents: no rows.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    #: Java regex that Python's parser reads too; `(?i:` groups are ASCII.
    pattern: str
    #: Group that must have at least `least` characters; 0 is the match.
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of [0-9a-f]+ of 16 characters or more
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:\s{1,2}[A-Za-z0-9+/=]{16,}){0,200})"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.%+~-]{1,64}@"),
)
RULES = BASE + MORE

Clause = frozenset[str]
#: The query that holds for every text: one clause without trigrams.
ALWAYS: frozenset[Clause] = frozenset({frozenset()})
_MOST = 256


def _and(a: frozenset[Clause], b: frozenset[Clause]) -> frozenset[Clause]:
    if len(a) * len(b) > _MOST:
        return min(a, b, key=lambda q: (q == ALWAYS, len(q)))
    out = {x | y for x in a for y in b}
    return frozenset(x for x in out if not any(y < x for y in out))


def _or(a: frozenset[Clause], b: frozenset[Clause]) -> frozenset[Clause]:
    out = a | b
    out = frozenset(x for x in out if not any(y < x for y in out))
    return out if len(out) <= _MOST else ALWAYS


def _held(strings: set[str]) -> frozenset[Clause]:
    """What a text holds that has one of the strings."""
    out: frozenset[Clause] = frozenset()
    for s in strings:
        out = _or(out, frozenset({frozenset(s[i : i + 3].lower() for i in range(len(s) - 2))}))
    return out or ALWAYS


def _walk(nodes) -> tuple[set[str] | None, frozenset[Clause]]:
    """The strings that a sequence matches, if they are few, and its query."""
    known: set[str] = {""}
    whole, query = True, ALWAYS
    for op, arg in nodes:
        own: set[str] | None = None
        more = ALWAYS
        again = False
        if op is C.LITERAL:
            own = {chr(arg)}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 6:
            own = {chr(v) for _, v in arg}
        elif op is C.SUBPATTERN:
            own, more = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            own = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            more = parts[0][1]
            for _, q in parts[1:]:
                more = _or(more, q)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = arg
            own, more = _walk(inner)
            if (least, most) == (0, 1) and own is not None:
                own, more = own | {""}, ALWAYS
            elif least == 0:
                own, more = None, ALWAYS
            elif own is not None and len(own) ** least <= 16 and least <= 16:
                one, own = own, {""}
                for _ in range(least):
                    own = {a + b for a in own for b in one}
                again = most != least
            else:
                own = None
        if own is not None and len(known) * len(own) <= 64:
            known = {a + b for a in known for b in own}
            if again:
                whole, query, known = False, _and(query, _held(known)), {""}
        else:
            query = _and(_and(query, _held(known)), more if own is None else _held(own))
            whole, known = False, {""}
    return (known, _held(known)) if whole else (None, _and(query, _held(known)))


def trigram_query(pattern: str) -> frozenset[Clause]:
    """Clauses of lower-case trigrams: every text with a match has all trigrams of some clause."""
    query = _walk(parser.parse(pattern))[1]
    return ALWAYS if frozenset() in query else query


def postings(low: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The trigrams that the rules ask for and the lower-case text holds."""
    asked = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in asked] or [F.lit(None).cast("string")]))


def candidate(index: Column, rule: Rule) -> Column:
    """Whether a text with these postings may match."""
    query = sorted(map(sorted, trigram_query(rule.pattern)))
    met = [F.size(F.array_intersect(index, F.array(*map(F.lit, c)))) == len(c) for c in query if c]
    return reduce(lambda x, y: x | y, met) if len(met) == len(query) else F.lit(True)


_FRAME = "\u0001"
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: str, may: Column, rules: tuple[Rule, ...], i: int) -> Column:
    rule = rules[i]
    clean = F.translate(F.col(text), _FRAME, "\u0002")
    pieces = F.split(F.regexp_replace(clean, F.lit(rule.pattern), F.lit(f"{_FRAME}$0{_FRAME}")), _FRAME, -1)

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        good = acc["odd"]
        if rule.least:
            good = good & (F.char_length(F.regexp_extract(piece, rule.pattern, rule.group)) >= rule.least)
        found = F.array(F.struct(acc["at"].alias("start"), F.lit(i).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(good, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("odd"), none.alias("out"))
    return F.when(may & F.col(text).rlike(rule.pattern), F.aggregate(pieces, start, step, lambda a: a["out"])).otherwise(none)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text, spans): docs' columns as a struct, the text (null: empty), and its spans, an array of (start, kind as a place in rules, end) in order."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    met = own.withColumn("low", F.lower("text")).withColumn("index", postings(F.col("low"), rules))
    for i, r in enumerate(rules):
        met = met.withColumn(f"s{i}", _spans("text", candidate(F.col("index"), r), rules, i))
    return met.select("row", "text", F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))])).alias("spans"))


def shown(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans."""
    found = scan(docs.select("doc_id", "text"), "text", rules)
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("row.doc_id", *n, F.sha2(shown(base, rules), 256).alias("base_sha256"), shown(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of found spans replaced by mark in text, and n_chars (if there) recounted."""
    found = scan(docs, "text", rules)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = (s["start"] >= acc["at"]) & (s["end"] > acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    out = found.withColumn("walk", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)))
    text = F.concat(F.array_join(F.col("walk.out"), ""), F.expr("substring(text, cast(walk.at + 1 as int))"))
    columns = []
    for f in docs.schema:
        c = F.col("row")[f.name]
        if f.name == "text":
            c = F.when(F.col("walk").isNull(), c).otherwise(text)
        elif f.name == "n_chars":
            c = F.when(F.col("walk").isNull(), c).otherwise(F.char_length(text).cast(f.dataType))
        columns.append(c.alias(f.name))
    return out.select(*columns)
