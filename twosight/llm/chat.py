"""Operator 13: records of any known layout become canonical turns, formatted with a loss mask. DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import let

#: The template's marks around a turn: OPEN role line feed text CLOSE line feed.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string that a text mustn't hold as it stands.
_AFTER_ANGLE = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>"
_AFTER_BRACKET = r"/?INST\]"


@dataclass(frozen=True)
class Layout:
    """How one kind of record holds its turns, told by nested field paths such as ``messages[].role``.

    Either ``items`` names a list whose elements hold ``role`` and ``text``; or ``turns`` gives (role, paths) in order,
    where the texts at the paths are joined by a blank line and null or absent ones are left out; or ``key`` and
    ``order`` name the conversation and the place of a record that is itself one turn (``role``, ``text``).
    ``optional`` are paths that a record may lack. ``roles`` renames roles.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    key: str = ""
    order: str = ""
    optional: frozenset[str] = frozenset()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> frozenset[str]:
        if self.items:
            return frozenset(f"{self.items}[].{p}" for p in (self.role, self.text))
        return frozenset(p for _, ps in self.turns for p in ps) | frozenset(p for p in (self.key, self.order, self.role, self.text) if p)

    def fingerprints(self) -> list[str]:
        """One hash for each set of paths that a record of this layout may have."""
        must, may = self.paths() - self.optional, sorted(self.optional)
        return [fingerprint(must | set(some)) for n in range(len(may) + 1) for some in combinations(may, n)]


SPEAKERS = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The layouts tried by default, in this order.
LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content", roles=SPEAKERS),
    Layout("conversations", items="conversations", role="from", text="value", roles=SPEAKERS),
    Layout("nested_turns", items="dialog.turns", role="speaker", text="utterance", roles=SPEAKERS),
    Layout("turn_rows", key="conv_id", order="turn", role="role", text="text"),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Layout("prompt_completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Layout("prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Layout("question_answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"context"})),
)


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: DataType, at: str = "") -> set[str]:
    """The leaf paths of a declared schema, in the spelling of record_paths()."""
    if isinstance(kind, StructType) and kind.fields:
        quoted = [f.name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f.name) else "`" + f.name.replace("`", "``") + "`" for f in kind.fields]
        return set().union(*(schema_paths(f.dataType, f"{at}.{name}" if at else name) for f, name in zip(kind.fields, quoted, strict=True)))
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def record_paths(record: Column) -> Column:
    """The distinct leaf paths of a variant, such as ``messages[].role``; names that are not plain stand in back quotes.

    The variant's own schema text is read from left to right with a stack of the paths that enclose a place."""
    name = r"(?:`(?:[^`]|``)*`|[A-Za-z_][A-Za-z0-9_]*)"
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(rf"({name}: |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9,]+\))?)"), F.lit(1))
    strings = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("here"), strings.alias("leaves"))

    def step(s: Column, token: Column) -> Column:
        top = F.element_at(s["open"], -1)
        named = F.regexp_replace(token, ": $", "")
        named = F.when(top == "", named).otherwise(F.concat(top, F.lit("."), named))
        listed = F.concat(s["here"], F.lit("[]"))
        state = lambda opened, here, leaves: F.struct(opened.alias("open"), here.alias("here"), leaves.alias("leaves"))
        return (
            F.when(token.endswith(": "), state(s["open"], named, s["leaves"]))
            .when(token == "OBJECT<", state(F.concat(s["open"], F.array(s["here"])), s["here"], s["leaves"]))
            .when(token == "ARRAY<", state(F.concat(s["open"], F.array(listed)), listed, s["leaves"]))
            .when(token == ">", state(F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(1))), s["here"], s["leaves"]))
            .otherwise(state(s["open"], s["here"], F.concat(s["leaves"], F.array(s["here"]))))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["leaves"])))


def layout_of(paths: Column, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """The name of the first layout one of whose fingerprints the paths have, other paths left out; null if none."""
    names = []
    for layout in layouts:
        known = F.array_intersect(paths, F.array(*(F.lit(p) for p in sorted(layout.paths() | layout.optional))))
        found = F.sha2(F.concat_ws("\n", known), 256).isin(*layout.fingerprints())
        names.append(F.when(found, F.lit(layout.name)))
    return F.coalesce(*names)


def _renamed(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _turns(layout: Layout, get, key: Column) -> Column:
    """The turns of a record as an array of (conv, at, role, text); get(path, type) reads a value."""
    if layout.items:
        items = get(layout.items, f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")
        return F.transform(items, lambda x, i: _turn(key, i, _renamed(x[layout.role], layout), x[layout.text]))
    if layout.key:
        return F.array(_turn(get(layout.key, None), get(layout.order, "long"), _renamed(get(layout.role, "string"), layout), get(layout.text, "string")))
    parts = []
    for i, (role, paths) in enumerate(layout.turns):
        texts = F.array_compact(F.array(*(get(p, "string") for p in paths)))
        wanted = (F.size(texts) > 0) | F.lit(role != "system")
        parts.append(F.when(wanted, _turn(key, F.lit(i), F.lit(role), F.array_join(texts, "\n\n"))))
    return F.array_compact(F.array(*parts))


def _turn(conv: Column, at: Column, role: Column, text: Column) -> Column:
    return F.struct(conv.alias("conv"), at.cast("long").alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def table_turns(table: DataFrame, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The canonical turns (conv, at, role, text, layout) of a table whose schema is one of the layouts.

    The layout follows from the fingerprint of the declared schema, so no row is looked at for it; columns of no layout
    don't count. key names the conversation, unless the layout has its own. A table without a layout is an error that
    names its paths. A record whose list is null or empty gives one row with null at, role and text, so that the
    conversation is not lost. Null roles and texts are empty. Repeated records are repeated turns of one conversation.
    """
    paths = schema_paths(table.schema)
    for layout in layouts:
        if fingerprint(paths & (layout.paths() | layout.optional)) in layout.fingerprints():
            break
    else:
        raise ValueError(f"no layout has the paths {sorted(paths)}")

    def get(path: str, kind: str | None) -> Column:
        if path not in paths and not any(p.startswith(f"{path}[]") for p in paths):
            return F.lit(None).cast(kind or "string")
        value = table[path]
        if layout.items:
            fields = lambda x: F.struct(*(x[f].cast("string").alias(f) for f in (layout.role, layout.text)))
            return F.transform(value, fields)
        return value.cast(kind) if kind else value

    if layout.key:
        one = _turns(layout, get, None)[0]
        return table.select(one.alias("_t")).select("_t.*", F.lit(layout.name).alias("layout"))
    own = table[key]
    return table.select(own.alias("_key"), F.explode_outer(_turns(layout, get, own)).alias("_t")).select(
        F.col("_key").alias("conv"), "_t.at", "_t.role", "_t.text", F.lit(layout.name).alias("layout")
    )


def record_turns(table: DataFrame, key: str, record: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """The canonical turns (conv, at, role, text, layout) of a column of JSON texts, each of a layout of its own.

    Every record's fingerprint is taken from its own nested paths. Null, broken and empty records and those of no known
    layout give one row with null layout, at, role and text. Otherwise as table_turns(); numbers and truth values that
    stand where a text is wanted are written out, lists and objects there are null.
    """
    kind = table.schema[key].dataType
    rows = table.select(table[key].alias("_key"), F.try_parse_json(table[record]).alias("_v"))
    rows = rows.withColumn("layout", F.when(F.col("_v").isNotNull(), let(record_paths(F.col("_v")), lambda p: layout_of(p, layouts))))

    def get(path: str, kind_: str | None) -> Column:
        steps = re.findall(r"`(?:[^`]|``)*`|[^.`]+", path)
        at = "$" + "".join(f"['{s.strip('`').replace('``', '`')}']" for s in steps)
        return F.try_variant_get("_v", at, kind_) if kind_ else F.try_variant_get("_v", at, "string").try_cast(kind)

    chosen = None
    for layout in layouts:
        turns = _turns(layout, get, F.col("_key"))
        chosen = F.when(F.col("layout") == layout.name, turns) if chosen is None else chosen.when(F.col("layout") == layout.name, turns)
    rows = rows.select("_key", "layout", F.explode_outer(chosen).alias("_t"))
    return rows.select(F.coalesce("_t.conv", "_key").alias("conv"), "_t.at", "_t.role", "_t.text", "layout")


def escaped(text: Column) -> Column:
    """The text without control strings: each gets a backslash after its first character, as do those that have some already."""
    return F.regexp_replace(text, rf"((?<=<)\\*(?={_AFTER_ANGLE})|(?<=\[)\\*(?={_AFTER_BRACKET}))", r"\\$1")


def unescaped(text: Column) -> Column:
    """The text that escaped() was given."""
    return F.regexp_replace(text, rf"(?<=<)\\(?=\\*(?:{_AFTER_ANGLE}))|(?<=\[)\\(?=\\*{_AFTER_BRACKET})", "")


def formatted(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss.

    Every turn is marked and escaped where it stands; one shuffle then brings a conversation's pieces together, since its
    text is one value. Turns are ordered by at (null first), equal ones by role and text; roles are URL-encoded, so they
    can hold nothing of the template. loss lists the spans of the assistant's texts, in code points: turn (from 0), start
    in the formatted text, offset behind the turn's mark, chars. Rows with null role (see silent) are no turns. Turns of
    the null key are one conversation. An empty table gives no rows.
    """
    rows = turns.select("conv", "at", "role", "text", F.url_encode("role").alias("_name"), escaped(F.coalesce("text", F.lit(""))).alias("_text"))
    rows = rows.where(F.col("role").isNotNull())
    rows = rows.withColumn("_offset", F.length("_name") + 1).withColumn("_chars", F.length("_text"))
    order = Window.partitionBy("conv").orderBy("at", "role", "text")
    length = F.col("_offset") + F.col("_chars") + len(OPEN) + len(CLOSE) + 1
    rows = rows.withColumn("_turn", F.row_number().over(order) - 1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(length.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct(
        F.col("_turn").alias("turn"), (F.col("_start") + len(OPEN) + F.col("_offset")).alias("start"), F.col("_offset").alias("offset"), F.col("_chars").alias("chars")
    )
    piece = F.struct("_turn", F.concat(F.lit(OPEN), "_name", F.lit("\n"), "_text", F.lit(CLOSE + "\n")).alias("piece"))
    made = rows.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
    )
    return made.select("conv", "n_turns", F.array_join(F.col("_pieces.piece"), "").alias("formatted"), "loss")


def silent(turns: DataFrame) -> DataFrame:
    """The conversations (conv, layout) that have no turns: unknown layouts (null) and empty lists."""
    return turns.where(F.col("role").isNull()).select("conv", "layout")


def read_back(made: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_texts, both read from the formatted text and the loss mask alone."""
    pieces = F.split("formatted", re.escape(OPEN))
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        name = F.substring_index(piece, "\n", 1)
        return let(name, lambda n: F.struct(
            F.url_decode(n).alias("role"),
            unescaped(piece.substr(F.length(n) + 2, F.length(piece) - F.length(n) - (2 + len(CLOSE)))).alias("text"),
        ))

    cut = made.withColumn("_pieces", pieces)
    spoken = F.transform("loss", lambda x: unescaped(F.element_at("_pieces", x["turn"] + 1).substr(x["offset"] + 1, x["chars"])))
    return cut.withColumn("turns", F.transform("_pieces", turn)).withColumn("loss_texts", spoken).drop("_pieces")
