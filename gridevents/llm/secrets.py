"""Secrets in texts: three plain patterns, and an assignment-aware lexer.

The lexer finds every assignment operator of source and configuration syntax, reads
the name to its left and the expression to its right (quoted and bare literals, joined
by ``+`` or standing next to each other, or other names).  Values of names are carried
to where the names are used (``k = "..."; password = k``).  A literal is scored by the
words of the names it reaches and by how much it looks like key material.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridevents.llm.frames import map_slices, texts

#: Fixed patterns of the plain scan.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as runs start at their first character
KINDS = ("assign", "access", "hex", "literal")

#: Words of a target name and what they add to the score of its literals.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3,
             "credential": 2, "credentials": 2, "auth": 1, "authorization": 2, "bearer": 2, "private": 1, "signing": 1,
             "encryption": 1, "access": 1, "client": 0, "api": 1, "key": 1, "salt": 1, "cookie": 1, "session": 1,
             "dsn": 1, "connection": 1, "webhook": 1}
#: Last words of a name that make it a description of something rather than the thing.
HARMLESS = {"id", "name", "url", "uri", "path", "file", "length", "len", "size", "count", "type", "field", "label",
            "prefix", "header", "hint", "expiry", "ttl", "public", "format", "regex", "pattern", "max", "min"}
_FILLER = re.compile(r"(?i)^(none|null|true|false|changeme|example.*|your[-_ ].*|xxx+|\*+|\.+|<.*>|\$\{.*\}|%\(.*|\{\{.*|str|string|int|todo)$")
_OPERATOR = re.compile(r":=|=>|=(?![=>~])|:(?![:/=])")
_NAME_END = re.compile(r"""["'`\]]?[ \t]*$""")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
_QUOTED = re.compile(r'''"""(.*?)"""|\'\'\'(.*?)\'\'\'|"((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`''', re.S)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]+""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?(?=[ \t\"'])|\\\n)[ \t]*\n?[ \t]*|[ \t]+(?=[\"'])")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*$")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends just before ``at``, without quotes (empty if there is none), and the colon it follows (or -1)."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] in "\"'`]":
        at -= 1
        if at and text[at - 1] in "\"'`":
            at -= 1
    end = at
    while at and text[at - 1] in _NAME_CHARS:
        at -= 1
    name, lead = text[at:end], at
    while lead and text[lead - 1] in " \t":
        lead -= 1
    follows = name and lead > 1 and text[lead - 1] == ":" and text[lead - 2] in _NAME_CHARS
    return name, lead - 1 if follows else -1


def name_score(name: str) -> int:
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts:
        return 0
    total = sum(SENSITIVE.get(p, 0) for p in parts)
    total += sum(SENSITIVE.get(a + b, 0) for a, b in zip(parts, parts[1:]))
    return total - 3 if parts[-1] in HARMLESS else total


def literal_score(value: str) -> float:
    """What a literal adds: -9 for fillers and short ones, up to 4 for dense mixed characters."""
    if len(value) < 8 or _FILLER.match(value) or any(c.isspace() for c in value):
        return -9
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if kinds == 1 and value.isalpha():
        return -1  # a word
    return (bits >= 2.5) + (bits >= 3.3) + (kinds >= 2) + (n >= 16)


Span = tuple[int, int]


def assignments(text: str) -> list[tuple[str, list[Span], list[Span]]]:
    """(name, literals, bare names) of every assignment, in order; both as spans.

    In ``name: type = value`` the first name counts.  A colon after a name that follows a
    colon itself (``00:07:0e``) assigns nothing.
    """
    out: list = []
    if "=" not in text and ":" not in text:
        return out
    firsts: dict[int, str] = {}  # by colon, the first name of its run
    bare = [m.span() for m in _BARE.finditer(text)]
    starts = [a for a, _ in bare]
    for op in _OPERATOR.finditer(text):
        name, colon = name_before(text, op.start())
        if not name:
            continue
        first = firsts.get(colon, name)
        if op.group() == ":":
            firsts[op.start()] = first
            if colon >= 0:
                continue
        name, at, literals, used = first, op.end(), [], []
        while at < len(text) and text[at] in " \t":
            at += 1
        while at < len(text):
            if m := _QUOTED.match(text, at):
                literals.append(m.span(m.lastindex))
                at = m.end()
            else:
                run = bisect_right(starts, at) - 1
                if run < 0 or bare[run][1] <= at:
                    break
                span = (at, bare[run][1])
                (used if _IDENTIFIER.match(text, *span) else literals).append(span)
                at = span[1]
            if not (m := _JOIN.match(text, at)):
                break
            at = m.end()
        out.append((name, literals, used))
    return out


def literal_spans(text: str, least: float = 4) -> list[Span]:
    """Literals whose own score and that of the most sensitive name they reach are ``least`` together.

    An assignment gives its name a version; the versions it uses are earlier ones.  Going
    back from the last assignment, each version hands its score to those that it used.
    """
    versions: dict[str, int] = {}
    owned: list[tuple[str, list[Span], list[int]]] = []
    for name, literals, used in assignments(text):
        read = [(span, versions.get(text[slice(*span)])) for span in used]
        own = literals + [span for span, v in read if v is None]  # a bare word nothing was assigned to is a literal
        versions[name] = versions[name.rpartition(".")[2]] = len(owned)
        owned.append((name, own, [v for _, v in read if v is not None]))
    best = [0] * len(owned)
    out = set()
    for i in range(len(owned) - 1, -1, -1):
        name, own, earlier = owned[i]
        best[i] = max(best[i], name_score(name))
        for v in earlier:
            best[v] = max(best[v], best[i])
        if best[i] > 0 and own and best[i] + literal_score("".join(text[slice(*span)] for span in own)) >= least:
            out.update(own)  # the pieces of one expression are one secret
    return sorted(out)


def scan(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    plain = sorted((a, b) for _, a, b, _ in out)
    starts, reach = [a for a, _ in plain], list(accumulate((b for _, b in plain), max))
    for start, end in literal_spans(text):
        before = bisect_right(starts, start)
        if not before or reach[before - 1] < end:  # not inside a plain one
            out.append(("literal", start, end, start))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:long,end:long,value:long>>"


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``: kind, start, end, start of the secret value (code points).

    Kinds: ``assign``, ``access`` and ``hex`` are the plain patterns; ``literal`` is a literal
    found by the lexer that lies in no plain span.  A null text is empty and has no spans; a
    null doc_id stays null; repeated rows give repeated rows; texts are read whole.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "value"), s)) for s in scan(t)] for t in part["text"].to_pylist()]
        return pa.record_batch([part["doc_id"], pa.array(spans, kind)], ["doc_id", "spans"])
    return map_slices(texts(docs), run, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the value of every secret in ``text`` replaced; ``n_chars`` follows, other columns stay.

    A null text stays null.
    """
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for text in part["text"].to_pylist():
            spans = scan(text) if text else []
            new.append(redact(text, [(value, end) for _, _, end, value in spans]) if spans else text)
        for name, column in (("text", pa.array(new, pa.string())),
                             ("n_chars", pa.array([None if t is None else len(t) for t in new], pa.int64()))):
            if name in part.schema.names:
                part = part.set_column(part.schema.names.index(name), name, column.cast(part.schema.field(name).type))
        return part
    return map_slices(docs, run, docs.schema)
