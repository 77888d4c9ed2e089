"""Secret scans: the regexes of all rules compiled into one minimal automaton that reads each text's bytes once.

A rule matches ASCII only, so it can be run over UTF-8 bytes.  The automaton of all reversed rules reads a text from its
last byte to its first and so knows, at every byte, which rules have a match that starts there.  Only from these starts is
a rule's own automaton run forwards to the longest end, over the bytes of the match alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches


@dataclass(frozen=True)
class Rule:
    """``head`` + ``tail`` is the regex; of its leftmost non-overlapping matches those with too short a tail or whole go.

    ``kind`` names the rule.  The syntax is that of regular expressions with literals, ``.``-free classes, ``\\xHH``,
    groups, ``|``, ``?``, ``*``, ``+`` and ``{m,}``; ends are the longest ones.  All characters are ASCII.
    """

    kind: str
    head: str
    tail: str
    least_tail: int = 1
    least: int = 1


def any_case(words: str) -> str:
    """The regex of ``words`` with each letter in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


#: The three kinds whose spans are always reported, in the order of their listing.
BASE = (
    Rule("assign", any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", least_tail=6),
    Rule("access", "AKIA", "[A-Z0-9]+", least=20),
    Rule("hex", "", "[0-9a-f]{24,}", least=24),
)
#: Public formats of keys and tokens that the base kinds don't know.
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z\\x20]*", "PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]+", least_tail=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", least_tail=20),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", least_tail=35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", least_tail=10),
)

# ---------------------------------------------------------------------------------------------------- compiling


def parsed(pattern: str) -> tuple:
    """The syntax tree: ("set", bytes), ("cat", parts), ("alt", parts) or ("rep", part, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c, at = pattern[at], at + 1
        if c == "\\":
            c, at = pattern[at], at + 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        if ord(c) > 127:
            raise ValueError(f"only ASCII can be matched: {pattern!r}")
        return ord(c)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = choice()
            at += 1
            return inner
        if pattern[at] != "[":
            return ("set", frozenset([char()]))
        at, found = at + 1, set()
        while pattern[at] != "]":
            lo = hi = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                hi = char()
            found.update(range(lo, hi + 1))
        at += 1
        return ("set", frozenset(found))

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, None)}[pattern[at]]
                if pattern[at] == "{":
                    end = pattern.index(",}", at)
                    least, at = int(pattern[at + 1 : end]), end + 1
                at += 1
                part = ("rep", part, least, most)
            parts.append(part)
        return ("cat", parts)

    def choice() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    tree = choice()
    if at != len(pattern):
        raise ValueError(f"not understood at {at}: {pattern!r}")
    return tree


def backwards(tree: tuple) -> tuple:
    kind, rest = tree[0], tree[1:]
    if kind == "cat":
        return ("cat", [backwards(t) for t in reversed(rest[0])])
    if kind == "alt":
        return ("alt", [backwards(t) for t in rest[0]])
    return ("rep", backwards(rest[0]), *rest[1:]) if kind == "rep" else tree


class Steps:
    """An automaton with free moves, grown from syntax trees."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.on) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Grows ``tree`` from ``start``; gives the state that is reached by its matches."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            via = self.state()
            self.free[start].append(via)
            self.on[via] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        again = self.state()
        self.free[start].append(again)
        out = self.add(part, again)
        end = self.state()
        self.free[again].append(end)
        self.free[out].append(again if most is None else end)
        return end

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.on[s] or not self.free[s])


@dataclass
class Automaton:
    """``moves[state + byte]`` is the next state, a multiple of 256; states from ``hot`` on accept ``accepts[state >> 8]``.

    State 0 is the start; ``dead`` is the state that no byte leaves and that accepts nothing, or -1.
    """

    moves: list[int]
    accepts: list[tuple[int, ...]]
    hot: int
    dead: int
    start: int


def compiled(trees: list[tuple], anywhere: bool) -> Automaton:
    """The minimal deterministic automaton that tells which of ``trees`` match up to the byte read last.

    Subset construction over classes of bytes that no rule tells apart, then states with the same future are merged by
    refining the partition by what they accept.  ``anywhere``: a match may begin at every byte, else only at the first.
    """
    nfa = Steps()
    begin = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        end = nfa.add(tree, begin)
        final = nfa.state()  # of its own, so that it stays in the closure
        nfa.free[end].append(final)
        ends[final] = k
    sets = {s for on in nfa.on if on for s in [on[0]]}
    kind_of = {}
    byte_class = np.array([kind_of.setdefault(tuple(b in s for s in sets), len(kind_of)) for b in range(256)])
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(kind_of))]
    first = nfa.closed([begin])
    number, order, rows = {first: 0}, [first], []
    for states in order:  # grows while it is read
        row = []
        for b in sample:
            to = {nfa.on[s][1] for s in states if nfa.on[s] and b in nfa.on[s][0]}
            nxt = nfa.closed(to) | first if anywhere else nfa.closed(to)
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    table = np.array(rows)
    accept = [tuple(sorted(ends[s] for s in states if s in ends)) for states in order]
    kinds = {a: i for i, a in enumerate(sorted(set(accept), key=lambda a: (len(a), a)))}
    group = np.array([kinds[a] for a in accept])
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    n = group.max() + 1
    chosen = np.array([int(np.flatnonzero(group == g)[0]) for g in range(n)])
    rank = np.argsort([len(accept[c]) > 0 for c in chosen], kind="stable")  # accepting states last
    place = np.empty(n, int)
    place[rank] = np.arange(n)
    chosen = chosen[rank]
    moves = place[group[table[chosen]]][:, byte_class] * 256
    accepts = [accept[c] for c in chosen]
    silent = [i for i in range(n) if not accepts[i] and (moves[i] == i * 256).all()]
    return Automaton(moves.reshape(-1).tolist(), accepts, 256 * next((i for i in range(n) if accepts[i]), n), 256 * silent[0] if silent and not anywhere else -1, 256 * int(place[group[0]]))


class Scanner:
    """All rules' automata; made once on the driver and sent to the tasks (its size is fixed by the rules)."""

    def __init__(self, rules: tuple[Rule, ...]):
        trees = [parsed(r.head + r.tail) for r in rules]
        self.rules = rules
        self.starts = compiled([backwards(t) for t in trees], anywhere=True)
        self.whole = [compiled([t], anywhere=False) for t in trees]
        self.heads = [compiled([parsed(r.head)], anywhere=False) for r in rules]

    @staticmethod
    def longest(a: Automaton, data: bytes, at: int) -> int:
        """The end of the longest match from ``at``; ``at`` itself if there is none."""
        state, end, moves, hot, dead = a.start, at, a.moves, a.hot, a.dead
        for i in range(at, len(data)):
            state = moves[state + data[i]]
            if state >= hot:
                end = i + 1
            elif state == dead:
                break
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, index of the rule, end) in code points, by start and then by rule."""
        starts = self.starts
        state, moves, hot, found = starts.start, starts.moves, starts.hot, []
        for i, byte in enumerate(data[::-1]):
            state = moves[state + byte]
            if state >= hot:
                found.append((i, state))
        size, done, out = len(data), [0] * len(self.rules), []
        for i, state in reversed(found):
            at = size - 1 - i
            for k in starts.accepts[state >> 8]:
                if at < done[k]:
                    continue
                done[k] = end = self.longest(self.whole[k], data, at)
                rule = self.rules[k]
                if end - at >= rule.least and end - self.longest(self.heads[k], data, at) >= rule.least_tail:
                    out.append((at, k, end))
        if data.isascii():
            return out
        chars, before, exact = 0, 0, []
        for at, k, end in out:  # matches are ASCII: only what lies between them is longer in bytes
            chars += sum(b & 0xC0 != 0x80 for b in data[before:at])
            before = at
            exact.append((chars, k, chars + end - at))
        return exact


# ---------------------------------------------------------------------------------------------------- operators

SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def span_udf(spark, rules: tuple[Rule, ...] = BASE + ADDED):
    """A column function: the spans of a text column, by start and then in the order of the rules."""
    shared = spark.sparkContext.broadcast(Scanner(rules))

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = shared.value
        of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in batches:
            rows = []
            for t in texts:
                found = scanner.spans(t.as_py() or b"")
                rows.append([{"kind": scanner.rules[k].kind, "start": a, "end": b} for a, k, b in found])
            yield pa.array(rows, of)

    return lambda text: spans(F.col(text).cast("binary"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array of (kind, start, end)) of every row's whole text, offsets in code points, ends exclusive.

    Null and empty texts have no spans.  Repeated rows and null keys stay, row for row; other columns are ignored.  A
    match of one rule hides none of another; inside a rule the leftmost match wins and the next one starts after it,
    also where it is then dropped for its length.
    """
    return in_small_batches(docs).select(key, span_udf(docs.sparkSession, rules)(text).alias("spans"))


def of_kinds(spans: str, *kinds: str) -> Column:
    """The spans of these kinds only."""
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def listed(spans: str | Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text", mark: str = "█") -> DataFrame:
    """``docs`` with every character that a span covers replaced by ``mark``, so that lengths and offsets stay.

    All columns and rows stay; null texts stay null.
    """
    shared, one = docs.sparkSession.sparkContext.broadcast(Scanner(rules)), mark[:1]

    @F.arrow_udf("string")
    def covered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                if t is not None:
                    for a, _, b in shared.value.spans(t.encode()):
                        t = t[:a] + one * (b - a) + t[b:]
                out.append(t)
            yield pa.array(out, pa.string())

    return in_small_batches(docs).withColumn(text, covered(F.col(text)))


def _sql_kind(rule: Rule, at: int) -> str:
    """The spans of one rule in DuckDB: matches and the gaps between them, their lengths summed up."""
    head, whole = (p.replace("'", "''") for p in (rule.head, rule.head + rule.tail))
    tail = f"length(m) - length(regexp_extract(m, '^{head}'))" if rule.head else "length(m)"
    return f"""SELECT doc_id, {at} AS ord, '{rule.kind}' AS kind, e - length(m) AS s, e, m FROM (
      SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{whole}') AS ms, string_split_regex(t, '{whole}') AS gaps FROM d)))
    WHERE length(m) >= {rule.least} AND {tail} >= {rule.least_tail}"""


def oracle_sql(rules: tuple[Rule, ...] = BASE + ADDED, base: int = len(BASE)) -> str:
    """DuckDB SQL of the registered query."""
    kinds = "\n    UNION ALL ".join(_sql_kind(r, i) for i, r in enumerate(rules))
    line = "kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord"
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(rules[:base]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({kinds}),
g AS (SELECT doc_id, {counts}, string_agg({line}) FILTER (ord < {base}) AS b, string_agg({line}) AS a FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in rules[:base])}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
