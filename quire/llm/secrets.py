"""Secret scanning by one deterministic automaton over bytes for all rules.

The rules are parsed, joined in one non-deterministic automaton, made deterministic by subset construction and
minimised; the result is one array of transitions. A text is read once, byte by byte, from a start state that is
entered anew at each byte; each state knows the rules of which a match ends there. When a rule first accepts, its
reversed automaton (built the same way) finds the earliest start, and the rule's own automaton the longest end, which
touches the bytes of the match only. Matches of a rule are leftmost, longest and don't overlap.

The rule language: literals, classes, groups, |, ?, *, +, {n}, {n,}, \\xHH; a rule accepts no empty text. For a rule
where a match could hold the start of another match of the same rule before it first accepts, the first to accept wins
(none of RULES is such). Rules see UTF-8 bytes; offsets are given in code points.

Defined results: a null or empty text has no spans; rows are handled one by one, so ties and repeated rows change
nothing; other columns are kept, whatever their names; a column of the output's name is replaced. An empty table gives
no rows. Bytes that aren't UTF-8 count as U+FFFD. Time and memory for a text grow with its length only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.frames import released, replace_column, slices, texts


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Of a match's bytes: whether it stays. A failing match still uses up its bytes.
    keep: Callable[[bytes], bool] = lambda m: True


def _assigned(match: bytes) -> bool:
    """The value is what follows the first sign, blanks and a quote; at least 6 characters."""
    value = re.match(rb"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?", match)
    return len(match) - value.end() >= 6


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", _assigned),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: len(m) >= 20),
    # A run of this class is its own leftmost longest match, so its least length can stand in the automaton.
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN\\x20([A-Z]+\\x20)*PRIVATE\\x20KEY-----"),
    # Checked afterwards: counting in more rules multiplies the states.
    Rule("hosted", "gh[pousr]_[A-Za-z0-9]+", lambda m: len(m) >= 40),
)


class _Nfa:
    """Thompson's construction: states with byte moves and free moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """The state reached from `start` after a tree."""
        kind, x = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((x, end))
        elif kind == "cat":
            end = start
            for part in reversed(x) if reverse else x:
                end = self.add(part, end, reverse)
        elif kind == "or":
            end = self.state()
            for part in x:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(part, own, reverse)].append(end)
        else:  # some number of times
            part, least, most = x
            end = start
            for _ in range(least):
                end = self.add(part, end, reverse)
            if most is None:
                loop = self.state()
                self.free[end].append(loop)
                self.free[self.add(part, loop, reverse)].append(loop)
                end = loop
            else:
                for _ in range(most - least):
                    own, after = self.state(), self.state()
                    self.free[end] += [own, after]
                    self.free[self.add(part, own, reverse)].append(after)
                    end = after
        return end


def parse(pattern: str):
    """The tree of a rule: ("set", bytes), ("cat", trees), ("or", trees) or ("rep", (tree, least, most))."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII; write other bytes as \\xHH")
        return ord(c)

    def members():
        nonlocal at
        negative = pattern[at] == "^"
        at += negative
        found: set[int] = set()
        while pattern[at] != "]":
            a = char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                found |= set(range(a, char() + 1))
            else:
                found.add(a)
        at += 1
        return frozenset(set(range(256)) - found if negative else found)

    def either():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            if c == "(":
                at += 1
                one = either()
                at += 1
            elif c == "[":
                at += 1
                one = ("set", members())
            else:
                one = ("set", frozenset({char()}))
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                if c == "{":
                    close = pattern.index("}", at)
                    low, comma, high = pattern[at:close].partition(",")
                    least, most = int(low), (int(high) if high else None) if comma else int(low)
                    at = close + 1
                else:
                    least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                one = ("rep", (one, least, most))
            parts.append(one)
        return ("cat", parts)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} from {at}")
    return tree


class Dfa:
    """table[256 * state + byte] is the next state; accepts[state] has the rules that end there. State 0 is dead."""

    def __init__(self, trees: list, anywhere: bool, reverse: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        for r, tree in enumerate(trees):
            own = nfa.state()
            nfa.free[start].append(own)
            ends[nfa.add(tree, own, reverse)] = r

        def closure(states: frozenset[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        first = closure(frozenset({start}))
        numbers = {frozenset(): 0, first: 1}
        rows, queue = [[0] * 256], [first]
        while queue:  # subset construction
            here = queue.pop(0)
            to: dict[int, set[int]] = {}
            for s in here:
                for chars, x in nfa.moves[s]:
                    for c in chars:
                        to.setdefault(c, set()).add(x)
            row, made = [0] * 256, {}
            for c in range(256):
                key = frozenset(to.get(c, ()))
                if key not in made:
                    made[key] = closure(key) | (first if anywhere else frozenset())
                nxt = made[key]
                if nxt not in numbers:
                    numbers[nxt] = len(numbers)
                    queue.append(nxt)
                row[c] = numbers[nxt]
            rows.append(row)
        sets = sorted(numbers, key=numbers.__getitem__)
        accepts = [frozenset(ends[s] for s in x if s in ends) for x in sets]
        # Minimisation: split blocks of equal acceptance until all members of a block move alike.
        block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
        of, n = [block[a] for a in accepts], 0
        while n != len(set(of)):
            n = len(set(of))
            made = {}
            of = [made.setdefault((of[i], *(of[x] for x in rows[i])), len(made)) for i in range(len(rows))]
        one_of = {b: i for i, b in reversed(list(enumerate(of)))}
        self.start, self.dead = of[1], of[0]
        self.accepts = [accepts[one_of[b]] for b in range(n)]
        self.table = [of[x] for b in range(n) for x in rows[one_of[b]]]

    def linked(self) -> list[list]:
        """Each state as a list of the 256 next states, with its rules (or None) at 256: one index per byte."""
        states: list[list] = [[None] * 257 for _ in self.accepts]
        for i, s in enumerate(states):
            s[:256] = [states[x] for x in self.table[256 * i : 256 * i + 256]]
            s[256] = self.accepts[i] or None
        return states


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.dfa = Dfa(trees, anywhere=True)
        self.first = self.dfa.linked()[self.dfa.start]
        self.forward = [Dfa([t], anywhere=False) for t in trees]
        self.back = [Dfa([t], anywhere=False, reverse=True) for t in trees]

    @staticmethod
    def _far(dfa: Dfa, data: bytes, at: int, stop: int, step: int) -> int:
        """The furthest place where an automaton accepts, run from `at` towards `stop`."""
        s, best = dfa.start, at
        while at != stop:
            s = dfa.table[256 * s + data[at if step > 0 else at - 1]]
            if s == dfa.dead:
                break
            at += step
            if dfa.accepts[s]:
                best = at
        return best

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches that stay, sorted."""
        found, used = [], [0] * len(self.rules)
        row, size = self.first, len(data)
        for i, b in enumerate(data, 1):
            row = row[b]
            if row[256] is not None:
                for r in row[256]:
                    if i > used[r]:
                        start = self._far(self.back[r], data, i, used[r], -1)
                        if start == i:  # accepted only by reaching into a match already used up
                            continue
                        end = self._far(self.forward[r], data, start, size, 1)
                        used[r] = end
                        if self.rules[r].keep(data[start:end]):
                            found.append((start, r, end))
        return sorted(found)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by the order of the rules."""
        if not text:
            return []
        data = text.encode()
        found = self.byte_spans(data)
        if len(data) != len(text):
            marks, at, chars = {}, 0, 0
            for p in sorted({x for s, _, e in found for x in (s, e)}):
                chars += len(data[at:p].decode())
                marks[p], at = chars, p
            found = [(marks[s], r, marks[e]) for s, r, e in found]
        return [(self.rules[r].kind, s, e) for s, r, e in found]


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] | None = None) -> Scanner:
    return Scanner(rules or RULES)


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """All columns, and the spans of RULES: array of (kind, start, end), sorted by start and rule."""

    def run(batches):
        own = scanner()
        for b in batches:
            for s in slices(b, text):
                rows = [[{"kind": k, "start": a, "end": e} for k, a, e in own.spans(t)] for t in texts(s.column(text))]
                yield replace_column(s, out, pa.array(rows, _ARROW))

    return df.mapInArrow(lambda b: released(run(b)), T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, SPANS)]))
