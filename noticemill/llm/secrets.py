"""Secrets in texts: fixed detectors, and an assignment-aware reading of source and configuration.

Base spans come from three patterns with checks. Beside them every text is read for assignments, in
the forms that source code and configuration share: ``name = value``, ``name: type = value``,
``"name": value``, ``config["name"] = value``, ``name => value``, ``call(name="value")``,
``set_name("value")``, ``--name value``, ``<name>value</name>``, and entries that keep name and value
apart, as ``{"name": ..., "value": ...}``. A value is read as an expression of literals and names joined
by ``+``, ``.``, ``||`` or nothing, inside calls and brackets too, so an assignment is a target name, the
literals it is made of and the earlier assignments whose names it uses.

Constants are propagated along these uses: a literal counts for every target that it reaches, however
many names lie between. It is scored by the most sensitive of these names, read word by word, times how
much the literal looks like a secret; from ``LEAST_SCORE`` on it is a span of kind ``literal``, unless
it touches a base span, which stands already.

A text is read whole, in one task, in time linear in its length: patterns never give back what they
have taken, uses point to earlier assignments, and one pass from the last to the first spreads the
sensitivity. Nothing is shuffled.

Null text counts as empty: no spans. Null and repeated ids are answered row by row. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.llm.frames import whole_text

#: Kinds in the order of the contract, then what the reading adds.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: The greedy patterns AKIA[A-Z0-9]+ and [0-9a-f]+ with their least lengths: what is too short holds
#: no longer match inside, so leaving it out at once is the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: The target of an assignment and its operator, up to where the value begins.
HEAD = re.compile(
    r"""(?<![\w$.\-])(?P<flag>-{0,2}+)
    (?:"(?P<double>[^"\\\n]++)"\]?+|'(?P<single>[^'\\\n]++)'\]?+|(?P<bare>[^\W\d][\w$]*+(?:[.-][\w$]++)*+))
    (?:[\x20\t]*+:[\x20\t]*+[A-Za-z_][\w.\[\]|<>?]*+(?=[\x20\t]*+=[^=]))?+
    (?:[\x20\t]*+(?P<op>:=|=>|[+?]=|=(?![=>~])|:(?![:/=]))(?:[\x20\t]*+\\?+\n(?=[\x20\t]*+["']))?+
      |(?P<call>\((?=[\x20\t]*+["'])))
    [\x20\t]*+""",
    re.VERBOSE,
)
#: A command's option whose value follows a space.
OPTION = re.compile(r"(?<![\w-])--(?P<name>[A-Za-z][\w-]*+)[\x20\t]++(?P<value>[^\s\"'`;,(){}\[\]<>#=-][^\s\"'`;,(){}\[\]<>#]*+)")
TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?+>(?P<value>[^<>]++)</")
#: One literal of a value: quoted, with an optional prefix, or bare.
QUOTED = re.compile(
    r'''[rRbBuUfF@$]{0,2}+(?:"""(?P<long_double>(?:[^"\\]|\\.|"(?!""))*+)"""|\'\'\'(?P<long_single>(?:[^'\\]|\\.|'(?!''))*+)\'\'\'
    |"(?P<double>(?:[^"\\\n]|\\.)*+)"|'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<back>(?:[^`\\\n]|\\.)*+)`)''',
    re.VERBOSE | re.DOTALL,
)
BARE = re.compile(r"[^\s\"'`;,(){}\[\]<>#]++")
OPEN = re.compile(r"[(\[{][\x20\t]*+")
JOIN = re.compile(r"[\x20\t]*+[)\]]*+[\x20\t]*+(?:\+|\|\||&|\.(?=[\x20\t]*+[\"'$]))[\x20\t]*+(?:\\?+\n[\x20\t]*+)?+")
BESIDE = re.compile(r"""(?:[\x20\t]*+\\?+\n)?+[\x20\t]*+(?=["'])""")
AFTER_WORD = re.compile(r"[\x20\t]++")

#: Words that stand before a value and are none themselves.
LEADING = {"new", "bearer", "basic", "return", "await", "const", "final"}
#: Calls that take a literal to look a value up elsewhere.
LOOKUPS = {"getenv", "environ", "env", "get", "getproperty", "getstring", "input", "prompt", "open", "read", "load", "lookup", "fetch", "require"}
NAME_KEYS, VALUE_KEYS = {"name", "key", "id", "property", "variable"}, {"value", "val", "content", "default"}

#: How much a word of a name tells of a secret, and words that say the name means something about it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.7, "pw": 0.6,
    "secret": 1.0, "credential": 0.9, "credentials": 0.9, "token": 0.85, "apikey": 0.95, "authorization": 0.9,
    "auth": 0.7, "bearer": 0.8, "jwt": 0.8, "private": 0.6, "key": 0.6, "api": 0.4, "access": 0.4, "signing": 0.5,
    "encryption": 0.5, "session": 0.4, "cookie": 0.5, "salt": 0.6, "license": 0.4, "dsn": 0.5, "webhook": 0.4,
}
ABOUT = {
    "id", "name", "path", "file", "dir", "url", "uri", "host", "port", "length", "len", "size", "count", "type", "field",
    "label", "hint", "policy", "regex", "pattern", "expiry", "ttl", "timeout", "header", "algorithm", "prompt", "message",
    "error", "format", "prefix", "suffix", "public", "column", "index", "test",
}
WHOLE = ("password", "passwd", "passphrase", "secret", "apikey", "token", "credential")
PLACEHOLDER = re.compile(
    r"(?:(.)\1*|<.*>|\$\{.*|\$\(.*|\{\{.*|%\(?\w+\)?.?|(?:your|my|the|some|enter|insert|replace)[\W_].*|.*(?:change.?me|example|placeholder|redacted|dummy|sample).*"
    r"|(?:none|null|nil|true|false|undefined|todo|test|password|secret|token)\W*)",
    re.IGNORECASE | re.DOTALL,
)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CODE_NAME = re.compile(r"[A-Za-z_$][A-Za-z_$.\-]*+\Z")
LEAST_SCORE = 0.45

SECRET = "struct<kind:string,start:long,stop:long,name:string,value:string,score:double>"


class Assignment(NamedTuple):
    """A target, the places of its literals, and which earlier assignments it uses."""

    name: str
    literals: list[tuple[int, int, bool]]
    uses: list[int]


def name_score(name: str) -> float:
    """How sensitive what a name holds is, from 0 to 1: the words' evidence together, lessened where the
    last word or a ``public`` says that the name is about the secret rather than the secret."""
    words = [w.lower() for w in CAMEL.findall(name)]
    if not words:
        return 0.0
    doubt = 1.0
    for word in set(words):
        found = SENSITIVE.get(word, 0.0)
        doubt *= 1.0 - (found or max((0.8 * SENSITIVE[w] for w in WHOLE if w in word and word != w + "s"), default=0.0))
    return (1.0 - doubt) * (0.2 if words[-1] in ABOUT or "public" in words else 1.0)


def literal_score(value: str, bare: bool) -> float:
    """How much a literal looks like a secret, from 0 to 1: by its length, kinds of characters and the
    entropy of its characters. Placeholders, prose, names of code and places count little or nothing."""
    if len(value) < LEAST_VALUE or PLACEHOLDER.fullmatch(value):
        return 0.0
    if bare and CODE_NAME.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    score = 0.5 * min(entropy / 3.5, 1.0) + 0.3 * min(kinds, 3) / 3 + 0.2 * min(n, 16) / 16
    if "://" in value or value.startswith(("/", "./", "../", "~/")):
        score *= 0.4
    if len(value.split()) > 3:
        score *= 0.4
    if value.isalpha() and kinds == 1:
        score *= 0.75
    return score


def assignments(text: str) -> list[Assignment]:
    """The assignments of a text in the order of their values."""
    if "=" not in text and ":" not in text and "(" not in text:
        return []
    found: list[Assignment] = []
    held: dict[str, int] = {}
    title = ""
    at = 0
    while head := HEAD.search(text, at):
        name = head["bare"] or head["double"] or head["single"]
        literals, uses, at = _value(text, head.end(), held, head["op"])
        at = max(at, head.end())
        if head["op"] == "+=" and name in held:
            uses.append(held[name])
        lower = name.lower()
        if lower in VALUE_KEYS and title:
            name = title
        title = ""
        if lower in NAME_KEYS and len(literals) == 1 and not uses:
            a, e, _ = literals[0]
            title = text[a:e]
            # what the literal names is the next target; the head is read again where the value ends
            found.append(Assignment(name, literals, uses))
            continue
        held[name] = len(found)
        found.append(Assignment(name, literals, uses))
    return found


def _value(text: str, at: int, held: dict[str, int], op: str | None) -> tuple[list[tuple[int, int, bool]], list[int], int]:
    """The literals of the value that begins at a place, the assignments it uses, and its end."""
    literals: list[tuple[int, int, bool]] = []
    uses: list[int] = []
    while True:
        if opened := OPEN.match(text, at):
            # an inner bracket of data starts heads of its own
            if text[at] == "{" or (op != "=" and text[at] == "["):
                return literals, uses, at
            at = opened.end()
            continue
        if string := QUOTED.match(text, at):
            a, e = string.span(string.lastgroup)
            literals.append((a, e, False))
            at = string.end()
            if beside := BESIDE.match(text, at):
                at = beside.end()
                continue
        elif word := BARE.match(text, at):
            value = word[0]
            at = word.end()
            if text.startswith("(", at):
                if re.split(r"[.:]|->", value)[-1].lower() in LOOKUPS:
                    return literals, uses, at
                continue
            name = value.rstrip(".")
            if value.lower() in LEADING:
                if space := AFTER_WORD.match(text, at):
                    at = space.end()
                    continue
            elif name in held or name.lstrip("$") in held:
                uses.append(held[name] if name in held else held[name.lstrip("$")])
            elif op is not None:
                literals.append((word.start(), word.start() + len(name), True))
        else:
            return literals, uses, at
        joined = JOIN.match(text, at)
        if not joined:
            return literals, uses, at
        at = joined.end()


def sensitivities(found: list[Assignment]) -> list[tuple[float, str]]:
    """For each assignment the most sensitive target its literals reach, as (score, name). Uses point to
    earlier assignments, so one pass from the last to the first is enough."""
    out = [(name_score(a.name), a.name) for a in found]
    for k in range(len(found) - 1, -1, -1):
        for used in found[k].uses:
            if out[k][0] > out[used][0]:
                out[used] = out[k]
    return out


def named_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, stop, name, score) of the literals that a sensitive name gives away."""
    out = []
    found = assignments(text)
    for (sensitive, name), one in zip(sensitivities(found), found, strict=True):
        if sensitive >= LEAST_SCORE:
            for a, e, bare in one.literals:
                out.append((a, e, name, sensitive * literal_score(text[a:e], bare)))
    if "<" in text:
        out += [_given(m) for m in TAG.finditer(text)]
    if "--" in text:
        out += [_given(m) for m in OPTION.finditer(text)]
    return [one for one in out if one[3] >= LEAST_SCORE]


def _given(match: re.Match) -> tuple[int, int, str, float]:
    sensitive = name_score(match["name"])
    score = sensitive * literal_score(match["value"], True) if sensitive >= LEAST_SCORE else 0.0
    return *match.span("value"), match["name"], score


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, stop) of the valid matches of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def secrets_of(text: str) -> list[dict]:
    """All secrets of a text by start, then kind."""
    base = sorted(base_spans(text))
    out = [(a, kind, e, "", 1.0) for a, kind, e in base]
    ends, last = [], 0
    for _, _, e in base:
        last = max(last, e)
        ends.append(last)
    seen: set[int] = set()
    at = 0
    for a, e, name, score in sorted(named_literals(text)):
        while at < len(base) and base[at][0] < e:
            at += 1
        # of the base spans that begin before the literal ends, none may end after it begins
        if a not in seen and not (at and ends[at - 1] > a):
            seen.add(a)
            out.append((a, 3, e, name, score))
    return [
        {"kind": KINDS[kind], "start": a, "stop": e, "name": name, "value": text[a:e], "score": score}
        for a, kind, e, name, score in sorted(out)
    ]


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, secrets) for every row: the spans of its secrets with the names that gave them away."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("name", pa.string()), ("value", pa.string()), ("score", pa.float64())]
        )
        for batch in batches:
            found = [secrets_of(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(one))], ["id", "secrets"])

    return rows.mapInArrow(run, f"id {kind}, secrets array<{SECRET}>").withColumnRenamed("id", id_column)


def spelled(secrets: Column) -> Column:
    """kind:start:stop of secrets, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) for every row."""
    found = find_secrets(docs, id_column, text_column)
    of_kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select(
        id_column,
        *map(of_kind, KINDS[:3]),
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
        of_kind("literal"),
    )
