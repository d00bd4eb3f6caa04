"""Spans as arrays of struct<start, end, text>, in code points, by SQL expressions only.

Java's matcher counts UTF-16 units, so offsets are derived from the lengths of the matches and of
the gaps between them, which Spark counts in code points.
"""

from __future__ import annotations

SPAN = "array<struct<start:int,end:int,text:string>>"


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, group: int = 0) -> str:
    """All matches of a Java pattern in a SQL string; group must be a suffix of its match. No match: an empty array."""
    p = quote(pattern)
    end = "(acc.p + length(z.g[i]) + length(z.m[i]))"
    one = f"named_struct('start', {end} - length(z.v[i]), 'end', {end}, 'text', z.v[i])"
    step = f"named_struct('p', {end}, 'o', concat(acc.o, array({one})))"
    empty = f"CAST(array() AS {SPAN})"
    fold = f"aggregate(sequence(0, size(z.m) - 1), named_struct('p', 0, 'o', {empty}), (acc, i) -> {step}, acc -> acc.o)"
    bound = f"named_struct('g', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0), 'v', regexp_extract_all({text}, {p}, {group}))"
    return f"IF({text} RLIKE {p}, element_at(transform(array({bound}), z -> {fold}), 1), {empty})"


def overlaps(a: str, b: str) -> str:
    """Half-open spans a and b share a character."""
    return f"({a}.start < {b}.end AND {b}.start < {a}.end)"


def contains(a: str, b: str) -> str:
    return f"({a}.start <= {b}.start AND {b}.end <= {a}.end)"


def greedy(ordered: str, kind: str, taken: str | None = None) -> str:
    """First come, first kept: elements of an ordered array that overlap nothing kept before them (nor anything in taken)."""
    blocked = f"exists(acc, k -> {overlaps('k', 'x')})" + (f" OR exists({taken}, k -> {overlaps('k', 'x')})" if taken else "")
    return f"aggregate({ordered}, CAST(array() AS {kind}), (acc, x) -> IF({blocked}, acc, concat(acc, array(x))))"


def free_parts(x: str, blockers: str) -> str:
    """What is left of span x without the blockers: array<struct<s, e>>."""
    kind = "array<struct<s:int,e:int>>"
    order = f"array_sort(transform({blockers}, b -> named_struct('s', greatest(b.start, {x}.start), 'e', least(b.end, {x}.end))))"
    step = "named_struct('c', greatest(acc.c, b.e), 'o', IF(acc.c < b.s, concat(acc.o, array(named_struct('s', acc.c, 'e', b.s))), acc.o))"
    last = f"IF(acc.c < {x}.end, concat(acc.o, array(named_struct('s', acc.c, 'e', {x}.end))), acc.o)"
    return f"aggregate({order}, named_struct('c', {x}.start, 'o', CAST(array() AS {kind})), (acc, b) -> {step}, acc -> {last})"


def replace_spans(text: str, repl: str) -> str:
    """text with each element of repl (start, end, marker; ordered by start) put in; overlaps are clipped by a cursor."""
    step = f"named_struct('c', greatest(acc.c, r.end), 'o', IF(r.end <= acc.c, acc.o, concat(acc.o, substring({text}, acc.c + 1, greatest(0, r.start - acc.c)), r.marker)))"
    return f"aggregate({repl}, named_struct('c', 0, 'o', ''), (acc, r) -> {step}, acc -> concat(acc.o, substring({text}, acc.c + 1)))"
