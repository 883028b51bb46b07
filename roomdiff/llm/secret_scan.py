"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams that every match must hold is derived. A segment of texts gets an
inverted index of the trigrams that occur in some query; postings are intersected and united, and only the candidates are verified with
the expression itself. Rules without mandatory trigrams scan every text. Segments are batches of a task, so an index is bounded in
memory and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roomdiff.llm.text import per_text, rewrite


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` characters. ``pattern`` is read with ASCII rules."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login_url", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{1,64}@"),
]
RULES = BASE + MORE

MOST_STRINGS = 24           # exact strings followed at once while a query is derived; more of them only make the query weaker
MOST_CHARS = 6              # of a character class whose members are followed
ANY = ("all",)              # the query every text satisfies


def both(a, b):
    return b if a == ANY else a if b == ANY or a == b else ("and", a, b)


def either(a, b):
    return ANY if ANY in (a, b) else a if a == b else ("or", a, b)


def of_string(s: bytes):
    """All trigrams of ``s``."""
    out = ANY
    for k in range(len(s) - 2):
        out = both(out, ("tri", s[k:k + 3]))
    return out


def of_strings(strings: set[bytes]):
    out = None
    for s in sorted(strings):
        out = of_string(s) if out is None else either(out, of_string(s))
    return ANY if out is None else out


def trigram_query(pattern: str):
    """What every match of ``pattern`` must hold, over lower-cased UTF-8 trigrams: ("all",), ("tri", t), ("and", a, b) or ("or", a, b)."""
    exact, query = _sequence(rp.parse(pattern, re.ASCII))
    return both(query, of_strings(exact) if exact is not None else ANY)


def _sequence(items):
    """(exact strings or None, query) of consecutive parts. Strings grow by products; where a part has none, or there would be too many,
    what has grown becomes part of the query and growing starts again."""
    exact, query, whole = {b""}, ANY, True
    for op, arg in items:
        own, need = _part(op, arg)
        query = both(query, need)
        if own is not None and len(exact) * len(own) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in own}
        else:
            query, exact, whole = both(query, of_strings(exact)), own or {b""}, False
    return (exact, query) if whole else (None, both(query, of_strings(exact)))


def _part(op, arg):
    if op is rc.LITERAL:
        return {chr(arg).lower().encode() if arg < 128 else chr(arg).encode()}, ANY
    if op is rc.IN:
        chars = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                chars.add(value)
            elif kind is rc.RANGE and value[1] - value[0] < MOST_STRINGS:
                chars.update(range(value[0], value[1] + 1))
            else:
                return None, ANY
        strings = {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in chars}
        return (strings, ANY) if len(strings) <= MOST_CHARS else (None, ANY)
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])
    if op is rc.BRANCH:
        exacts, query = set(), None
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None and q == ANY for e, q in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
            for e, _ in parts:
                exacts |= e
            return exacts, ANY
        for e, q in parts:
            q = both(q, of_strings(e) if e is not None else ANY)
            query = q if query is None else either(query, q)
        return None, query
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, item = arg
        exact, query = _sequence(item)
        if low == 0:
            return (exact | {b""}, ANY) if high == 1 and exact is not None and query == ANY else (None, ANY)
        if low == high and exact is not None and len(exact) ** low <= MOST_STRINGS:
            grown = {b""}
            for _ in range(low):
                grown = {a + b for a in grown for b in exact}
            return grown, query
        return None, both(query, of_strings(exact) if exact is not None else ANY)
    if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
        return {b""}, ANY
    return None, ANY


def trigrams(query) -> set[bytes]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams(q) for q in query[1:])) if query[0] in ("and", "or") else set()


class Index:
    """Postings of the wanted trigrams over a segment of texts."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        self.slot = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def build(self, texts: list[bytes]) -> None:
        """A zero byte keeps texts apart; no query holds one."""
        joined = np.frombuffer(b"\0".join(texts).lower() + b"\0\0", np.uint8).astype(np.uint32)
        slots = self.slot[joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]]
        at = np.flatnonzero(slots)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique((slots[at].astype(np.int64) - 1) * len(texts) + owner)
        ends = np.searchsorted(pairs, np.arange(len(self.wanted) + 1) * len(texts))
        self.count = len(texts)
        self.postings = {t: pairs[ends[k]:ends[k + 1]] - k * len(texts) for k, t in enumerate(self.wanted)}

    def look_up(self, query) -> np.ndarray:
        """Texts of the segment that satisfy a query, ascending."""
        if query == ANY:
            return np.arange(self.count)
        if query[0] == "tri":
            return self.postings[query[1]]
        a = self.look_up(query[1])
        if query[0] == "and":
            return a if not len(a) else np.intersect1d(a, self.look_up(query[2]), assume_unique=True)
        return np.union1d(a, self.look_up(query[2]))


def finder(rules: list[Rule] = RULES):
    """Gives a function from a segment of UTF-8 texts to the sorted (start, place of the rule, end) of each text, in code points."""
    queries = [trigram_query(r.pattern) for r in rules]
    compiled = [r.compiled() for r in rules]
    index = Index(sorted(set().union(*map(trigrams, queries))))

    def find(texts):
        raw = [t or b"" for t in texts]
        index.build(raw)
        decoded: dict[int, str] = {}
        found: list[list] = [[] for _ in raw]
        for k, (rule, query, regex) in enumerate(zip(rules, queries, compiled)):
            for i in index.look_up(query):
                text = decoded.get(i)
                if text is None:
                    text = decoded[i] = raw[i].decode()
                for m in regex.finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found
    return find


def _joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, more: list[Rule] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_spans) for every row; matches of a rule are leftmost and do not overlap.

    ``spans`` lists kind:start:end by start and then rule order, base_sha256 is of the base rules' part of it. A null text is empty. Repeated
    rows get a result each; a null id stays null.
    """
    rules = BASE + list(more)

    def make():
        find = finder(rules)

        def work(texts):
            found = find(texts)
            base = [[s for s in spans if s[1] < len(BASE)] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
            return [*counts, pa.array([hashlib.sha256(_joined(s, rules).encode()).hexdigest() for s in base]),
                    pa.array([_joined(s, rules) for s in found]), pa.array([len(s) for s in found], pa.int64())]
        return work
    return per_text(docs, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint", id_col, text_col)


def redact(docs: DataFrame, rules: list[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every secret replaced by its kind in brackets; overlapping spans become one, under the first's kind."""
    def make():
        find = finder(rules)

        def work(texts):
            out = []
            for raw, spans in zip(texts, find(texts)):
                if spans:
                    text, parts, last = raw.decode(), [], 0
                    for a, k, b in spans:
                        if a >= last:
                            parts += [text[last:a], f"[{rules[k].kind}]"]
                        last = max(last, b)
                    out.append("".join(parts) + text[last:])
                else:
                    out.append(None if raw is None else raw.decode())
            return out, None
        return work
    return rewrite(docs, make, text_col)
