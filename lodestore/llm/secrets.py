"""Secret scans in DataFrame expressions only: fixed patterns, and windows of high entropy.

Base spans: per kind, the leftmost non-overlapping matches of its pattern, without
those that are too short.  Positions are code points; they follow from splitting
the text at the matches and summing lengths.

Entropy spans: candidates are maximal runs of a class's characters, at least one
window long.  A window slides over the candidate; the counts of its characters
and the sum of ``c * log2(c)`` change by the entering and the leaving character
only.  A candidate whose greatest window entropy reaches the class's threshold is
a span, unless the allow-list suppresses it: runs without both a letter and a
digit, UUIDs, paths and dates.  Windows that touch a known placeholder don't count.

Defined cases: a null or empty text has no spans; repeated rows are scanned one
by one; a null doc_id stays null; other columns stay as they are, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import _shared

# The base patterns and the least lengths that count.
# Each kind: name, pattern, group whose length counts, least length, and a test that every text with a span passes.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (
    ("assign", ASSIGN, 2, 8, ASSIGN),
    ("access", ACCESS, 0, 16, r"AKIA[A-Z0-9]{12,}"),
    ("hex", HEX, 0, 32, r"[0-9a-f]{32,}"),
)

WINDOW = 24
#: Class: characters of a candidate, least entropy of a window in bits a character.
CLASSES = (("entropy_hex", "0-9a-fA-F", 3.2), ("entropy_base64", r"A-Za-z0-9+/_\-", 4.0))
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Candidates that these match are not secrets.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[a-z0-9_-]*(/[a-z0-9_-]+){2,}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T_/-]?[0-9-]*Z?$",
)
#: Windows that touch one of these don't count.
PLACEHOLDER = r"(?i:example|placeholder|changeme|0123456789|123456789|abcdef0123|abcdefghij|xxxxxx)"


def quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def _spans(text: str, pattern: str, least: int, group: int, kind: int, test: str) -> Column:
    """Array of (start, kind, end, value) of a pattern's matches whose group has at least so many characters."""
    p = quoted(pattern)
    found = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> struct(length(g) as gap, m as value))"
    if group:
        found = f"zip_with({found}, regexp_extract_all({text}, {p}, {group}), (x, v) -> struct(x.gap as gap, x.value as value, length(v) as size))"
    else:
        found = f"transform({found}, x -> struct(x.gap as gap, x.value as value, length(x.value) as size))"
    # the last gap has no match
    found = f"filter({found}, x -> x.value is not null)"
    walked = f"""aggregate({found}, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)),
        (a, x) -> named_struct('at', a.at + x.gap + length(x.value),
            'out', if(x.size >= {least}, concat(a.out, array(named_struct('start', a.at + x.gap, 'kind', {kind}, 'end', a.at + x.gap + length(x.value), 'value', x.value))), a.out)),
        a -> a.out)"""
    # the test first: most texts have no such match
    none = "cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)"
    return F.expr(f"if({text} rlike {quoted(test)}, {walked}, {none})")


def _entropy(spans: str, threshold: float) -> str:
    """The spans with a window, free of placeholders, whose entropy reaches the threshold."""
    table = "array(" + ", ".join(f"{0.0 if c < 2 else c * math.log2(c)!r}D" for c in range(WINDOW + 2)) + ")"
    log_w = f"{math.log2(WINDOW)!r}D"
    enter, leave = "element_at(q, i)", f"if(i > {WINDOW}, element_at(q, i - {WINDOW}), 0)"
    f = lambda c: f"element_at({table}, {c} + 1)"
    was = f"element_at(a.n, {enter})"
    gone = f"(element_at(a.n, greatest({leave}, 1)) + if({enter} = {leave}, 1, 0))"
    total = f"(a.s + {f(f'({was} + 1)')} - {f(was)} - if(i > {WINDOW}, {f(gone)} - {f(f'({gone} - 1)')}, 0D))"
    step = f"""named_struct(
        'n', transform(a.n, (v, k) -> v + if(k + 1 = {enter}, 1, 0) - if(k + 1 = {leave}, 1, 0)),
        's', {total},
        'least', if(i >= {WINDOW}, least(a.least, {total}), a.least))"""
    best = f"""aggregate(sequence(1, size(q)), named_struct('n', array_repeat(0, {len(ALPHABET)}), 's', 0D, 'least', 1e9D),
        (a, i) -> {step}, a -> {log_w} - a.least / {WINDOW})"""
    allowed = " or ".join(f"x.value rlike {quoted(p)}" for p in ALLOWED)
    pieces = f"""transform(filter(split(x.value, {quoted(PLACEHOLDER)}, -1), p -> length(p) >= {WINDOW}),
        p -> transform(filter(split(p, ''), c -> c <> ''), c -> instr('{ALPHABET}', c)))"""
    return f"filter({spans}, x -> not ({allowed}) and exists({pieces}, q -> {best} >= {threshold}D))"


def _free(docs: DataFrame) -> str:
    """The start of names that no column has."""
    prefix = "secrets: "
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def scan(docs: DataFrame, text_column: str = "text", base: str = "base_spans", spans: str = "all_spans") -> DataFrame:
    """``docs`` with two more columns: sorted arrays of (start, kind number, end, value).

    Columns of ``docs`` with these two names are replaced; all others stay.
    """
    prefix = _free(docs)
    own = lambda name: f"`{prefix}{name}`"
    put = lambda df, name, value: df.withColumn(own(name).strip("`"), value)
    out = put(docs, "text", F.coalesce(F.col(text_column), F.lit("")))
    for k, (kind, pattern, group, least, test) in enumerate(KINDS):
        out = put(out, kind, _spans(own("text"), pattern, least, group, k, test))
    for k, (kind, characters, _) in enumerate(CLASSES):
        run = f"[{characters}]{{{WINDOW},}}"
        out = put(out, kind, _spans(own("text"), run, WINDOW, 0, len(KINDS) + k, run))
    for kind, _, threshold in CLASSES:
        out = put(out, kind, F.expr(_entropy(own(kind), threshold)))
    first = ", ".join(own(kind) for kind, *_ in KINDS)
    more = ", ".join(own(kind) for kind, *_ in CLASSES)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (base, spans)]
    return out.select(*kept, F.expr(f"array_sort(concat({first}))").alias(base), F.expr(f"array_sort(concat({first}, {more}))").alias(spans))


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{x[0]}'" for x in (*KINDS, *CLASSES)) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.kind + 1), ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; overlapping spans become one."""
    prefix = _free(docs)
    base, spans = f"{prefix}base spans", f"{prefix}all spans"
    found, text = f"`{spans}`", f"`{text_column}`"
    parts = f"""aggregate({found}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, x) -> named_struct('at', greatest(a.at, x.end),
            'out', if(x.start >= a.at, concat(a.out, array(substring({text}, a.at + 1, x.start - a.at), '{mark}')), a.out)),
        a -> concat(array_join(a.out, ''), substring({text}, a.at + 1, length({text}))))"""
    scanned = scan(docs, text_column, base, spans).withColumn(text_column, F.expr(f"if(size({found}) > 0, {parts}, {text})"))
    return scanned.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(_shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.kind = {k})) as bigint)").alias(f"n_{kind}") for k, (kind, *_) in enumerate(KINDS)]
    return scanned.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
