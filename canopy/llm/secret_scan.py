"""Secret scans with one combined deterministic automaton.

Rules are regular expressions over ASCII. Each becomes a Thompson NFA, then a search DFA by
subset construction over *ordered* thread lists, which gives the leftmost, greedy matches of a
backtracking engine. The product of all rule automata, minimised by partition refinement and
compressed to byte classes, is one transition array: a single pass over the UTF-8 bytes scans
every rule. The pass steps many lanes of a buffer at once; lanes that began in a wrong state
are run again up to the byte where they meet what was recorded, so lanes change nothing.

A match ends where a rule's accepting bytes end, and the reversed rule finds its start. This
needs rules whose accepting states lead only to accepting states or to none, and matches of
two bytes at least; others are refused when compiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from canopy.llm.common import id_text, raw, sliced

SEPARATOR = 0xFF  # in no UTF-8 text, so in no rule
BLOCK_LANES, BLOCK_STEPS = 1024, 1024


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and how many accepting bytes (the pattern's last repeat) it must have."""

    kind: str
    pattern: str
    min_tail: int = 1


#: The base rules of the contract, then well-known public token formats.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    Rule("access", r"AKIA[A-Z0-9]+", 14),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 16),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)


# --- pattern to NFA ---------------------------------------------------------------------------


class _Nfa:
    """States with either a byte set and one successor, or an ordered list of empty moves."""

    def __init__(self) -> None:
        self.sets: list[frozenset[int] | None] = []
        self.moves: list[list[int]] = []

    def state(self, chars: frozenset[int] | None = None, moves: Sequence[int] = ()) -> int:
        self.sets.append(chars)
        self.moves.append(list(moves))
        return len(self.sets) - 1


def _ascii(code: int, fold: bool) -> set[int]:
    if code > 127:
        raise ValueError("rules are over ASCII")
    c = chr(code)
    return {ord(c.lower()), ord(c.upper())} if fold and c.isalpha() else {code}


def _set(items, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            out |= _ascii(arg, fold)
        elif name == "RANGE":
            for code in range(arg[0], arg[1] + 1):
                out |= _ascii(code, fold)
        else:
            raise ValueError(f"a rule may not use {name} in a class")
    return frozenset(out)


def _build(nfa: _Nfa, items, then: int, fold: bool, backwards: bool) -> int:
    """Entry state of ``items`` followed by state ``then``; ``backwards`` reverses the language."""
    for op, arg in items if backwards else reversed(list(items)):
        name = str(op)
        if name == "LITERAL":
            then = nfa.state(frozenset(_ascii(arg, fold)), [then])
        elif name == "IN":
            then = nfa.state(_set(arg, fold), [then])
        elif name == "SUBPATTERN":
            then = _build(nfa, arg[3], then, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I, backwards)
        elif name == "BRANCH":
            then = nfa.state(None, [_build(nfa, x, then, fold, backwards) for x in arg[1]])
        elif name == "MAX_REPEAT":
            least, most, body = arg
            if str(most) == "MAXREPEAT":
                loop = nfa.state()
                nfa.moves[loop] = [_build(nfa, body, loop, fold, backwards), then]
                then = loop
            else:
                for _ in range(int(most) - least):
                    then = nfa.state(None, [_build(nfa, body, then, fold, backwards), then])
            for _ in range(least):
                then = _build(nfa, body, then, fold, backwards)
        else:
            raise ValueError(f"a rule may not use {name}")
    return then


def _closure(nfa: _Nfa, starts: Sequence[int], final: int) -> tuple[int, ...]:
    """States with byte sets that are reached by empty moves, in priority order; cut after the final state."""
    out: list[int] = []
    seen: set[int] = set()
    stack = list(reversed(starts))
    while stack:
        s = stack.pop()
        if s in seen:
            continue
        seen.add(s)
        if s == final:
            out.append(s)
            break
        if nfa.sets[s] is None:
            stack.extend(reversed(nfa.moves[s]))
        else:
            out.append(s)
    return tuple(out)


def _search_dfa(pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, accepting) of the leftmost search; state 0 is the start."""
    nfa = _Nfa()
    final = nfa.state(frozenset())
    tree = re._parser.parse(pattern)
    if tree.getwidth()[0] < 2:
        raise ValueError("a rule must match two bytes at least")
    start = _build(nfa, tree, final, False, False)
    first = _closure(nfa, [start], final)
    numbers, todo, rows = {first: 0}, [first], []

    def step(threads: tuple[int, ...], byte: int, again: bool) -> list[int]:
        out = [nfa.moves[s][0] for s in threads if s != final and byte in nfa.sets[s]]
        return out + [start] * again

    while todo:
        threads = todo.pop(0)
        matched = final in threads
        row = []
        for byte in range(128):
            now = _closure(nfa, step(threads, byte, not matched), final)
            if matched and not now:  # the match has ended; this byte begins anew
                now = _closure(nfa, step(first, byte, True), final)
            elif matched and final not in now:
                raise ValueError(f"an accepted match of {pattern} may go on without accepting")
            if now not in numbers:
                numbers[now] = len(numbers)
                todo.append(now)
            row.append(numbers[now])
        rows.append(row + [0] * 128)
    return np.array(rows), np.array([final in t for t in numbers])


def _reverse_dfa(pattern: str) -> tuple[list[list[int]], list[bool]]:
    """Anchored automaton of the reversed rule; state -1 is dead."""
    nfa = _Nfa()
    final = nfa.state(frozenset())
    start = _build(nfa, re._parser.parse(pattern), final, False, True)

    def close(states) -> frozenset[int]:
        seen, stack = set(), list(states)
        while stack:
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                if nfa.sets[s] is None:
                    stack.extend(nfa.moves[s])
        return frozenset(s for s in seen if nfa.sets[s] is not None)

    first = close([start])
    numbers, todo, rows = {first: 0}, [first], []
    while todo:
        states = todo.pop(0)
        row = [-1] * 256
        for byte in range(128):
            now = close(nfa.moves[s][0] for s in states if s != final and byte in nfa.sets[s])
            if now:
                if now not in numbers:
                    numbers[now] = len(numbers)
                    todo.append(now)
                row[byte] = numbers[now]
        rows.append(row)
    return rows, [final in s for s in numbers]


def _minimised(table: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement: states stay apart while outputs or successors' groups differ."""
    group = np.unique(output, return_inverse=True)[1].ravel()
    count = group.max() + 1
    while True:
        rows = np.column_stack([group, group[table]])
        first, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)[1:]
        group = group.ravel()
        if len(first) == count:
            break
        count = len(first)
    order = np.argsort(first)  # the start state keeps number 0
    number = np.empty(count, dtype=np.int64)
    number[order] = np.arange(count)
    return number[group][table[first[order]]], output[first[order]]


class Automaton:
    """All rules as one transition array over byte classes, accepting states last."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = tuple(rules)
        if not 0 < len(self.rules) <= 62 or len({r.kind for r in rules}) < len(self.rules):
            raise ValueError("one to 62 rules of different kinds")
        parts = [_minimised(*_search_dfa(r.pattern)) for r in self.rules]
        self.back = [_reverse_dfa(r.pattern) for r in self.rules]
        table, output = self._product(parts)
        table, output = _minimised(table, output)
        order = np.argsort(output != 0, kind="stable")  # the start accepts nothing, so it stays first
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        table, self.output = place[table[order]], output[order]
        columns, self.class_of = np.unique(table, axis=1, return_inverse=True)
        self.class_of = self.class_of.ravel().astype(np.int64)
        self.width = columns.shape[1]
        self.flat = np.ascontiguousarray(columns * self.width).ravel()  # successors are offsets of rows
        self.accepting = int((self.output == 0).sum()) * self.width

    @staticmethod
    def _product(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        start = (0,) * len(parts)
        numbers, todo, rows = {start: 0}, [start], []
        classes = np.unique(np.vstack([t for t, _ in parts]), axis=1, return_index=True, return_inverse=True)
        bytes_, inverse = classes[1], classes[2].ravel()
        while todo:
            at = todo.pop(0)
            successors = np.stack([t[s, bytes_] for (t, _), s in zip(parts, at)], axis=1)
            row = []
            for x in map(tuple, successors.tolist()):
                if x not in numbers:
                    numbers[x] = len(numbers)
                    todo.append(x)
                row.append(numbers[x])
            rows.append(row)
        output = [sum(1 << i for i, s in enumerate(x) if parts[i][1][s]) for x in numbers]
        return np.array(rows)[:, inverse], np.array(output)

    def accepts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose byte leaves some rule accepting, and the rules' bits there."""
        flat, found, bits, state = self.flat, [], [], 0
        size = BLOCK_LANES * BLOCK_STEPS
        rest = self.class_of[SEPARATOR]
        for at in range(0, len(data), size):
            classes = self.class_of[data[at : at + size]]
            steps = BLOCK_STEPS if len(classes) == size else max(1, -(-len(classes) // BLOCK_LANES))
            if len(classes) < steps * BLOCK_LANES:
                classes = np.concatenate([classes, np.full(steps * BLOCK_LANES - len(classes), rest)])
            turned = np.ascontiguousarray(classes.reshape(BLOCK_LANES, steps).T)
            states = np.empty((steps, BLOCK_LANES), dtype=np.int64)
            now = np.zeros(BLOCK_LANES, dtype=np.int64)
            now[0] = state
            where = np.empty(BLOCK_LANES, dtype=np.int64)
            for t in range(steps):
                np.add(now, turned[t], out=where)
                now = np.take(flat, where, out=states[t], mode="clip")
            for lane in np.flatnonzero(states[-1, :-1]) + 1:  # a lane before it did not end at the start state
                self._mend(states, turned, int(lane))
            state = int(states[-1, -1])
            t, lane = np.nonzero(states >= self.accepting)
            place = at + lane * steps + t
            order = np.argsort(place)
            found.append(place[order])
            bits.append(self.output[states[t, lane][order] // self.width])
        return (np.concatenate(found), np.concatenate(bits)) if found else (np.empty(0, int), np.empty(0, int))

    def _mend(self, states: np.ndarray, turned: np.ndarray, lane: int) -> None:
        while lane < states.shape[1]:
            now = int(states[-1, lane - 1])
            last = int(states[-1, lane])
            for t in range(states.shape[0]):
                now = int(self.flat[now + turned[t, lane]])
                if now == states[t, lane]:
                    return
                states[t, lane] = now
            if last == int(states[-1, lane]):
                return
            lane += 1

    def _start(self, rule: int, data: np.ndarray, end: int, least: int) -> int:
        rows, final = self.back[rule]
        state, best, i = 0, end, end
        while i > least and (state := rows[state][data[i - 1]]) >= 0:
            i -= 1
            if final[state]:
                best = i
        return best

    def spans(self, texts: Sequence[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end) in code points, ordered; rules by number."""
        data = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        place, bits = self.accepts(data)
        for r, rule in enumerate(self.rules):
            own = place[(bits >> r) & 1 == 1]
            if not len(own):
                continue
            breaks = np.flatnonzero(np.diff(own) != 1)
            firsts = own[np.concatenate([[0], breaks + 1])]
            lasts = own[np.concatenate([breaks, [len(own) - 1]])]
            docs = np.searchsorted(begins, firsts, side="right") - 1
            before, doc_before = 0, -1
            for first, last, doc in zip(firsts.tolist(), lasts.tolist(), docs.tolist()):
                begin = int(begins[doc])
                if doc != doc_before:
                    before, doc_before = begin, doc
                end, least = last + 1, before
                before = end
                if end - first < rule.min_tail:
                    continue
                out[doc].append((self._start(r, data, end, least) - begin, r, end - begin))
        for doc, found in enumerate(out):
            found.sort()
            if found and not texts[doc].isascii():
                heads = np.cumsum((np.frombuffer(texts[doc], dtype=np.uint8) & 0xC0) != 0x80)
                points = lambda i: int(heads[i - 1]) if i else 0
                out[doc] = [(points(a), r, points(b)) for a, r, b in found]
        return out


@lru_cache(maxsize=8)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    """Compiled once in each Python process."""
    return Automaton(rules)


# --- operators --------------------------------------------------------------------------------


def find_secrets(
    df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end) in code points, by start, then kind as listed.

    Every row gives one row, whole texts are read, nothing is shuffled. A null or empty text has
    no spans; a null id stays null; repeated rows and equal texts are scanned each for itself; an
    empty table gives an empty table; other columns are left out. Matches of one kind do not
    overlap, those of different kinds may.
    """
    rules = tuple(rules)
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in sliced(batches, 1024):
            found = machine.spans(raw(batch.column(1)))
            spans = [[{"kind": kinds[r], "start": a, "end": b} for a, r, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return id_text(df, id_col, text_col).mapInArrow(scan, schema)


def redact_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of ``text_col`` replaced by ``<kind>``.

    Overlapping spans become one, named after the first. Null texts stay null.
    """
    rules = tuple(rules)
    index = df.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rules)
        for batch in sliced(batches, 1024):
            texts = batch.column(index).to_pylist()
            found = machine.spans([(x or "").encode() for x in texts])
            for i, spans in enumerate(found):
                if spans:
                    parts, at = [], 0
                    for a, r, b in spans:
                        if a >= at:
                            parts += [texts[i][at:a], f"<{rules[r].kind}>"]
                        at = max(at, b)
                    texts[i] = "".join(parts) + texts[i][at:]
            yield batch.set_column(index, batch.schema.field(index), pa.array(texts, batch.schema.field(index).type))

    return df.mapInArrow(clean, df.schema)


def secret_report(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts and digests of ``find_secrets`` by document."""
    told = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE_KINDS))
    return find_secrets(df, rules).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
