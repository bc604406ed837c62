"""Chat formatting: records of many layouts become canonical turns, then one marked text per conversation.

A layout is declared by the nested field paths it has and by how its turns are read from them. Field paths that any
layout knows are hashed to a fingerprint, and the fingerprint chooses the layout: for a whole table if its schema is
one layout's, else row by row from the paths that are not null. Paths that no layout knows do not count.

In the text, a turn is `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Texts and roles cannot
hold the marks: `<`, n backslashes, `|` is written with n + 1 backslashes, which is undone exactly.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Paths that must and may be there, and an expression for the turns of a record."""

    name: str
    needed: tuple[str, ...]
    turns: Callable[[frozenset[str]], Column] = field(compare=False)
    optional: tuple[str, ...] = ()

    def fingerprints(self) -> set[int]:
        choices = (c for k in range(len(self.optional) + 1) for c in combinations(self.optional, k))
        return {path_hash((*self.needed, *c)) for c in choices}


def path_hash(paths) -> int:
    """XXH64 of the sorted paths, the same number as Spark's xxhash64 of them joined by line feeds."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.cast("string").alias("text"))


def _present(*turns: tuple[Column, Column]) -> Column:
    """The turns whose condition holds."""
    return F.array_compact(F.array(*[F.when(given, turn) for given, turn in turns]))


def _asked(question: str, answer: str) -> Callable[[frozenset[str]], Column]:
    def turns(paths: frozenset[str]) -> Column:
        system = F.col("system") if "system" in paths else F.lit(None).cast("string")
        return _present(
            (system.isNotNull(), _turn("system", system)),
            (F.lit(True), _turn("user", F.col(question))),
            (F.lit(True), _turn(TRAINED, F.col(answer))),
        )

    return turns


def _instructed(paths: frozenset[str]) -> Column:
    system = F.col("system") if "system" in paths else F.lit(None).cast("string")
    more = F.col("input") if "input" in paths else F.lit(None).cast("string")
    task = F.when(F.coalesce(more, F.lit("")) != "", F.concat_ws("\n\n", "instruction", more)).otherwise(F.col("instruction"))
    return _present(
        (system.isNotNull(), _turn("system", system)), (F.lit(True), _turn("user", task)), (F.lit(True), _turn(TRAINED, F.col("output")))
    )


def _speakers(name: Column) -> Column:
    return F.when(name == "human", "user").when(name == "gpt", TRAINED).otherwise(name)


LAYOUTS = (
    Layout("turn", ("role", "text"), lambda _: F.array(_turn(F.col("role"), F.col("text")))),
    Layout("prompt", ("prompt", "response"), _asked("prompt", "response"), ("system",)),
    Layout("completion", ("prompt", "completion"), _asked("prompt", "completion"), ("system",)),
    Layout("question", ("question", "answer"), _asked("question", "answer"), ("system",)),
    Layout("instruction", ("instruction", "output"), _instructed, ("input", "system")),
    Layout("messages", ("messages[].content", "messages[].role"), lambda _: F.transform("messages", lambda m: _turn(m["role"], m["content"]))),
    Layout(
        "conversations", ("conversations[].from", "conversations[].value"),
        lambda _: F.transform("conversations", lambda m: _turn(_speakers(m["from"]), m["value"])),
    ),
)


def _leaves(schema: T.StructType) -> dict[str, Column]:
    """Every nested path with the condition that a row has it; an array has a path if one of its members does."""
    out: dict[str, Column] = {}

    def walk(kind: T.DataType, path: str, has: Callable[[Callable[[Column], Column]], Column]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", lambda test, n=f.name: has(lambda c: test(c[n])))
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]", lambda test: has(lambda c: F.exists(c, lambda x: F.coalesce(test(x), F.lit(False)))))
        else:
            out[path] = has(lambda c: c.isNotNull())

    for f in schema.fields:
        walk(f.dataType, f.name, lambda test, n=f.name: test(F.col(f"`{n}`")))
    return out


def layout_of(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[str | None, Column]:
    """(layout of the whole table or None, layout of each row as a column that is null where none fits)."""
    known = {p for x in layouts for p in (*x.needed, *x.optional)}
    leaves = {p: c for p, c in sorted(_leaves(records.schema).items()) if p in known}
    by_hash = {h: x.name for x in layouts for h in x.fingerprints()}
    whole = by_hash.get(path_hash(leaves))
    if whole:
        return whole, F.lit(whole)
    there = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in leaves.items()])), "\n") if leaves else F.lit("")
    mark = F.xxhash64(there)
    named = F.lit(None).cast("string")
    for x in layouts:
        if set(x.needed) <= set(leaves):
            named = F.when(mark.isin(sorted(x.fingerprints())), x.name).otherwise(named)
    # a row that lacks a needed value goes to the one layout that has a place for all it holds
    able = [x for x in layouts if set(x.needed) <= set(leaves)]
    fitting = F.lit(0)
    only = F.lit(None).cast("string")
    for x in able:
        fits = F.lit(True)
        for path, there_is in leaves.items():
            if path not in (*x.needed, *x.optional):
                fits = fits & ~F.coalesce(there_is, F.lit(False))
        fitting = fitting + fits.cast("int")
        only = F.when(fits, x.name).otherwise(only)
    return None, F.coalesce(named, F.when(fitting == 1, only))


def canonical_turns(records: DataFrame, id_column: str = "conv_id", order_column: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, place, nth, role, text) of every record: `place` is the record's `order_column`, nth counts within it.

    A row that lacks a needed value belongs to the one layout that has a place for all it holds. Rows that fit none, or
    several, give no turns; `layout_of` finds them. A null role or text is empty. Columns
    that no layout names are not looked at, and repeated rows give repeated turns.
    """
    paths = frozenset(_leaves(records.schema))
    whole, name = layout_of(records, layouts)
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        if (x.name == whole) or (whole is None and set(x.needed) <= paths):
            turns = F.when(name == x.name, x.turns(paths).cast(TURNS)).otherwise(turns)
    place = F.col(order_column) if order_column else F.lit(0).cast("long")
    listed = records.select(F.col(id_column).alias("conv_id"), place.alias("place"), turns.alias("turns"))
    split = listed.select("conv_id", "place", F.posexplode("turns").alias("nth", "said"))
    return split.select("conv_id", "place", "nth", *[F.coalesce(f"said.{x}", F.lit("")).alias(x) for x in ("role", "text")])


def _marked(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_line(role: Column) -> Column:
    return F.replace(F.replace(_marked(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_back(line: Column) -> Column:
    """Backslash pairs and line feeds undone from left to right, then the marks."""
    parts = F.split(line, r"\\\\", -1)
    return _unmarked(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conv_id: `formatted`, the place in it where each turn starts, and the loss mask.

    Turns are ordered by place, nth, role and text, nulls first. The mask lists (turn, start, end) of every assistant
    text in code points of `formatted`, turns counted from 0, the end excluded. A null conv_id is a conversation too.
    """
    turn = turns.withColumns({"__role": _role_line(F.col("role")), "__said": _marked(F.col("text"))})
    segment = F.concat(F.lit(START), "__role", F.lit("\n"), "__said", F.lit(END + "\n"))
    sized = turn.select(
        "conv_id", "place", "nth", "role", "text", segment.alias("segment"),
        (F.length("__role") + len(START) + 1).alias("head"), F.length("__said").alias("size"),
    )
    before = Window.partitionBy("conv_id").orderBy("place", "nth", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0).cast("long"))
    placed = sized.select("conv_id", start.alias("start"), "segment", "head", "size", (F.col("role") == TRAINED).alias("trained"))
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "head", "size", "trained"))).alias("turns"))
    spans = F.transform(
        "turns",
        lambda t, i: F.struct(i.alias("turn"), (t["start"] + t["head"]).alias("start"), (t["start"] + t["head"] + t["size"]).alias("end"), t["trained"].alias("trained")),
    )
    mask = F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: s.dropFields("trained"))
    return listed.select(
        "conv_id", F.array_join("turns.segment", "").alias("formatted"), F.col("turns.start").alias("turn_starts"), mask.alias("loss_mask")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, the `turns` parsed from `formatted`, and `loss_text`, all text under the mask, both unescaped."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    cut = chats.select("conv_id", "formatted", "turn_starts", "loss_mask", segments.alias("segments"))

    def turn(segment: Column) -> Column:
        line = F.substring_index(segment, "\n", 1)
        skip = F.length(line) + 1
        text = F.substring(segment, skip + 1, F.length(segment) - skip - len(END) - 1)
        return F.struct(_role_back(line).alias("role"), _unmarked(text).alias("text"))

    def under(span: Column) -> Column:
        # the span's own segment is searched, so a long conversation is not walked from its start for every turn
        within = (span["start"] - F.get("turn_starts", span["turn"]) - len(START)).cast("int")
        return F.substring(F.get("segments", span["turn"]), within + 1, (span["end"] - span["start"]).cast("int"))

    masked = F.array_join(F.transform("loss_mask", lambda s: _unmarked(under(s))), "")
    return cut.select("conv_id", F.transform("segments", turn).alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(records: DataFrame, id_column: str = "conv_id", order_column: str | None = None) -> DataFrame:
    """Per conversation: numbers and SHA-256 of what is read back from the formatted text."""
    back = read_back(formatted(canonical_turns(records, id_column, order_column)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars",
    )
