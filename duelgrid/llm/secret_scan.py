"""Secret scans: all rules in one automaton, all texts in one pass over their bytes.

The rules' regular expressions become one nondeterministic automaton over bytes. Subset construction makes it
deterministic with every rule restarted at each byte, partition refinement makes it small, and bytes that no state
tells apart share a column. The transition array then runs over fixed-length segments of many texts side by side; a
segment that began in the wrong state is repaired from its left neighbour until both runs meet. States say which rules
end at a byte. The few ends found are walked backwards by each rule's reversed automaton, which gives the start.

Rules are heads followed by a greedy tail, or fixed texts: once such a rule has matched, every byte that continues
the match is a match again. Longest matches are then runs of ending states, and the leftmost start wins. Matches of
one kind never overlap; a match that fails its length test is dropped but keeps its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from duelgrid.llm.arrow import as_bytes, give_back, joined, pieces

SEGMENT = 1024


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `group` of the match (0: all of it) has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False  # ASCII letters outside classes match in either case


# The three base rules, then formats of keys that services publish.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{6,}", 0, 24),  # runs are greedy, so asking for six here changes no span, only the states
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    # with the body: base64, line feeds (also as \n in JSON) and the blanks that stand for them in flattened text
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\\x20\t\r\n]*"),
)
RULES = BASE_RULES + MORE_RULES


class Graph:
    """States with empty moves and moves on sets of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _members(parts) -> frozenset[int]:
    out: set[int] = set()
    for kind, value in parts:
        if kind is ops.LITERAL:
            out.add(value)
        elif kind is ops.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"unsupported in a class: {kind}")
    if max(out) > 127:
        raise ValueError("rules are made of ASCII characters")
    return frozenset(out)


def _add(graph: Graph, items, start: int, any_case: bool, backwards: bool) -> int:
    """Append the parsed items after `start`; returns the state behind them."""
    for kind, value in reversed(list(items)) if backwards else items:
        if kind in (ops.LITERAL, ops.IN):
            letters = _members([(kind, value)] if kind is ops.LITERAL else value)
            if any_case and kind is ops.LITERAL:
                letters = frozenset(ord(c) for x in letters for c in (chr(x).lower(), chr(x).upper()))
            end = graph.state()
            graph.moves[start].append((letters, end))
        elif kind is ops.SUBPATTERN:
            end = _add(graph, value[3], start, any_case, backwards)
        elif kind is ops.BRANCH:
            end = graph.state()
            for way in value[1]:
                graph.empty[_add(graph, way, start, any_case, backwards)].append(end)
        elif kind is ops.MAX_REPEAT:
            least, most, body = value
            for _ in range(least):
                start = _add(graph, body, start, any_case, backwards)
            end = graph.state()
            graph.empty[start].append(end)
            if most is ops.MAXREPEAT:
                graph.empty[_add(graph, body, end, any_case, backwards)].append(end)
            else:
                for _ in range(most - least):
                    start = _add(graph, body, start, any_case, backwards)
                    graph.empty[start].append(end)
        else:
            raise ValueError(f"unsupported in a rule: {kind}")
        start = end
    return start


@dataclass
class Automaton:
    columns: np.ndarray  # byte -> column
    table: np.ndarray  # state * width + column -> state
    width: int
    ends: np.ndarray  # state -> bits of the rules that end there


def compiled(rules: tuple[Rule, ...], backwards: bool = False) -> Automaton:
    """One minimal deterministic automaton; forwards every rule restarts at each byte, state 0 is the fresh start."""
    graph, first, final = Graph(), [], {}
    for i, rule in enumerate(rules):
        first.append(graph.state())
        final[_add(graph, _parser.parse(rule.pattern), first[-1], rule.any_case, backwards)] = i
    sets = list({letters for moves in graph.moves for letters, _ in moves})
    member = np.array([[b in letters for letters in sets] for b in range(256)])
    _, sample, byte_class = np.unique(member, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.ravel()
    classes = {letters: np.flatnonzero(member[sample, i]).tolist() for i, letters in enumerate(sets)}
    begin = graph.closed(first)
    known, order, rows = {begin: 0}, [begin], []
    while len(rows) < len(order):
        targets: list[set[int]] = [set() for _ in sample]
        for s in order[len(rows)]:
            for letters, t in graph.moves[s]:
                for c in classes[letters]:
                    targets[c].add(t)
        row = []
        for reached in targets:
            subset = graph.closed(reached) if backwards else graph.closed(reached) | begin
            if subset not in known:
                known[subset] = len(order)
                order.append(subset)
            row.append(known[subset])
        rows.append(row)
    table = np.array(rows)
    ends = np.array([sum(1 << i for f, i in final.items() if f in s) for s in order])
    block = np.unique(ends, return_inverse=True)[1]
    while True:  # states in one block stay together while all bytes lead them to equal blocks
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    rank = np.full(block.max() + 1, -1)
    rank[block[0]] = 0
    for b in block:
        if rank[b] < 0:
            rank[b] = rank.max() + 1
    block = rank[block]
    chosen = np.array([np.flatnonzero(block == k)[0] for k in range(block.max() + 1)])
    small = block[table[chosen]]
    _, sample, columns = np.unique(small, axis=1, return_index=True, return_inverse=True)
    width = len(sample)
    return Automaton(columns.ravel()[byte_class].astype(np.int32), small[:, sample].astype(np.int32).ravel(), width, ends[chosen])


@lru_cache(maxsize=4)
def _machines(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton], list[re.Pattern]]:
    def spelled(rule: Rule) -> re.Pattern:
        return re.compile(rule.pattern.encode(), re.IGNORECASE if rule.any_case else 0)

    return compiled(rules), [compiled((r,), backwards=True) for r in rules], [spelled(r) for r in rules]


def states_of(data: np.ndarray, starts: np.ndarray, machine: Automaton) -> np.ndarray:
    """The state after every byte; each text begins afresh."""
    columns, table, width = machine.columns[data], machine.table, machine.width
    lengths = np.diff(starts)
    counts = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[text] + nth * SEGMENT
    size = np.minimum(SEGMENT, starts[text + 1] - begin)
    order = np.argsort(-size, kind="stable")
    lanes, alive = begin[order], np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")
    out = np.zeros(len(data), np.int32)
    state = np.zeros(len(lanes), np.int32)
    for i in range(SEGMENT):
        k = alive[i]
        if k == 0:
            break
        at = lanes[:k] + i
        state = table[state[:k] * width + columns[at]]
        out[at] = state
    for j in np.flatnonzero(nth > 0):
        p = int(begin[j])
        now = int(out[p - 1])
        stop = p + int(size[j])
        while p < stop:
            now = int(table[now * width + columns[p]])
            if now == out[p]:
                break
            out[p] = now
            p += 1
    return out


def spans_in(texts: list[bytes], rules: tuple[Rule, ...] = RULES, machines=None) -> list[list[tuple[int, int, int]]]:
    """For each text the (start, rule, end) of every secret, in bytes, ordered by start, then rule."""
    machine, reverse, patterns = machines or _machines(rules)
    data, starts = joined(texts)
    ends = machine.ends[states_of(data, starts, machine)]
    ends[starts[1:] - 1] = 0  # the line feed behind a text is not part of it
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hits = np.flatnonzero(ends)
    bits = ends[hits]
    for i, rule in enumerate(rules):
        at = hits[(bits >> i) & 1 == 1]
        last = at[np.append(np.diff(at) > 1, True)] if len(at) else at  # nothing ends behind a text, so runs do not join
        back, previous, floor = reverse[i], -1, 0
        for p, n in zip(last.tolist(), (np.searchsorted(starts, last, side="right") - 1).tolist()):
            if n != previous:
                previous, floor = n, int(starts[n])
            state, q, start = 0, p, -1
            while q >= floor:
                state = int(back.table[state * back.width + back.columns[data[q]]])
                if back.ends[state]:
                    start = q
                elif state == _dead(back):
                    break
                q -= 1
            if start < 0:
                continue
            floor = p + 1
            base = int(starts[n])
            if rule.least > 1:
                match = patterns[i].fullmatch(data[start : p + 1].tobytes())
                if match is None or len(match[rule.group]) < rule.least:
                    continue
            found[n].append((start - base, i, p + 1 - base))
    return [sorted(x) for x in found]


def _dead(machine: Automaton) -> int:
    """The state that no byte leaves and where nothing ends, -1 if there is none."""
    if not hasattr(machine, "dead"):
        rows = machine.table.reshape(-1, machine.width)
        stuck = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(1) & (machine.ends == 0))
        machine.dead = int(stuck[0]) if len(stuck) else -1
    return machine.dead


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte positions turned into code points."""
    if not spans or text.isascii():
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[s]), i, int(lead[e])) for s, i, e in spans]


SPAN_TYPE = "array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the `spans` of secrets of every text, in code points, the end excluded.

    Spans are ordered by start, then rule. A null or empty text has none. Repeated rows give repeated rows, other
    columns are not looked at, and an empty table gives an empty one. One pass over the scan, no shuffle.
    """
    kinds, machines = [r.kind for r in rules], _machines(rules)  # compiled once, sent to the tasks
    kept = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = as_bytes(piece.column("text"))
            rows = [
                [{"kind": kinds[i], "start": s, "end": e} for s, i, e in in_code_points(t, x)]
                for t, x in zip(texts, spans_in(texts, rules, machines))
            ]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows, kept)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN_TYPE}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, label: str = "[{kind}]") -> DataFrame:
    """`docs` with every secret replaced by its label and n_chars, if there, set to the new length.

    Overlapping spans become one, labelled by the first. Texts without secrets stay as they are, null stays null; all
    other columns pass through.
    """
    kinds, names, machines = [r.kind for r in rules], docs.columns, _machines(rules)

    def masked(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        out, done = [], 0
        for start, i, end in spans:
            if start >= done:
                out += [text[done:start], label.format(kind=kinds[i]).encode()]
            done = max(done, end)
        return b"".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=1 << 20):
            column = piece.column("text")
            texts = as_bytes(column)
            new = [masked(t, x) if x else t for t, x in zip(texts, spans_in(texts, rules, machines))]
            values = pa.array([None if gone else t.decode() for t, gone in zip(new, column.is_null().to_pylist())], pa.string())
            columns = {n: piece.column(n) for n in names} | {"text": values}
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(values).cast(piece.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def digests(spans: DataFrame, base: int = len(BASE_RULES), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base kinds, and all spans as one text."""
    from pyspark.sql import functions as F

    kinds = [r.kind for r in rules[:base]]

    def text(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return spans.select(
        "doc_id",
        *[number(k) for k in kinds],
        F.sha2(text(own), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


def plain_digest(rows: list[tuple[str, int, int]]) -> str:
    """What base_sha256 holds for (kind, start, end) rows."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in rows).encode()).hexdigest()
