"""Repair of the turn structure of conversations over tables.

1. Every row is reduced to what the repair needs: its place, the initial of its role, a
   hash of its text, its fault. Texts are not moved.
2. Repeats of role and text inside a conversation are found by an aggregate.
3. Rows are ordered by conversation and turn over all tasks by ranges, so a conversation
   of any length is dealt over tasks. A task runs the agenda over stretches of at most
   STRETCH rows, from every state a stretch may be entered in, and chains the stretches:
   it gives one row per conversation. Chaining is associative, so the pieces of a
   conversation that lies in several tasks are chained afterwards.
4. Texts are shuffled once, by conversation, to apply the letters. Rows pass one by one
   through the hash of the repaired conversation, which is a sequential function; nothing
   but the letters of one conversation is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm import dialogue
from tablecraft.llm.common import Workspace

#: Rows of a conversation that one agenda goes over.
STRETCH = 256
#: Rows per task of the ordered table.
ORDERED_ROWS = 200_000

SPACES = " \t\n\x0b\x0c\r"
#: The order of rows: by turn, NULL first; rows of one turn by role and text, repeats together.
ORDER = ["turn", "role0", "text0", "copy"]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with one row in five damaged by the crc32 of its place.

    Gives conv_id, turn, role, text, gone (a dropped row), copy (1 for the second of a
    repeated row) and role0, text0, by which rows of one turn are ordered. NULL is one
    space in the key, the role and the text.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    hit = (F.crc32(key) % 20).cast("int")
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("hit"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit(""))
        .when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("hit") == 0).alias("gone"),
        F.col("role").alias("role0"),
        F.unhex(F.md5("text")).alias("text0"),
        F.explode(copies).alias("copy"),
    )


def intact(rows: DataFrame) -> DataFrame:
    """``rows`` in the form of ``damaged``, as they are."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.lit(False).alias("gone"),
        role.alias("role0"), F.unhex(F.md5(text)).alias("text0"), F.lit(0).alias("copy"),
    )


def marks(rows: DataFrame) -> DataFrame:
    """One small row per row: its place, initial, and whether it is blank, cut off or seen before.

    ``first`` is true for rows at the first place of their role and text in the
    conversation, ``again`` says that this role and text come more than once.
    """
    body = F.rtrim("text", F.lit(SPACES))
    small = rows.select(
        "conv_id",
        *ORDER,
        "gone",
        "role",
        F.unhex(F.md5("text")).alias("print"),
        (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    place = F.struct(*ORDER)
    seen = (
        small.where(~F.col("gone"))
        .groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p"))
        .agg(F.count("*").alias("n"), F.min(place).alias("least"))
        .where("n > 1")
    )
    same: Column = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p"))
    return small.join(seen, same, "left").select(
        "conv_id",
        *ORDER,
        "gone",
        F.when(F.col("role") == "", F.lit(" ")).otherwise(F.substring("role", 1, 1)).alias("initial"),
        "blank",
        "cut",
        F.col("n").isNotNull().alias("again"),
        place.eqNullSafe(F.col("least")).alias("first"),
    )


PIECE = (
    "conv_id long, task long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "least long, most long, turns long, head_turn long, tail_turn long, "
    "paths array<struct<entry:int,to:int,cost:long,letters:string>>"
)
_PIECE = pa.schema(
    [
        ("conv_id", pa.int64()), ("task", pa.int64()),
        *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")],
        ("head", pa.string()), ("tail", pa.string()),
        *[(k, pa.int64()) for k in ("least", "most", "turns", "head_turn", "tail_turn")],
        ("paths", pa.list_(pa.struct([("entry", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))),
    ]
)

_LEGAL = {"su", "ua", "au"}


class _Piece:
    """What is known of the rows of one conversation that lie next to each other in a task."""

    def __init__(self, conv_id: int | None, begun: bool):
        self.conv_id, self.begun = conv_id, begun
        self.counts = {dialogue.BLANK: 0, dialogue.DUPLICATE: 0, dialogue.CUT: 0}
        self.illegal = self.turns = 0
        self.head = self.tail = self.least = self.most = self.head_turn = self.tail_turn = None
        self.place: tuple | None = None
        self.stretch: list[dialogue.Row] = []
        entries = [dialogue.START] if begun else dialogue.STATES
        self.paths: dialogue.Paths = {(s, s): (0, "") for s in entries}
        self.whole = True

    def add(self, row: dict) -> None:
        if row["gone"]:
            return
        place = tuple(row[k] for k in ORDER)
        repeat = row["again"] and (not row["first"] or place == self.place)
        self.place = place
        fault = (
            dialogue.BLANK if row["blank"]
            else dialogue.DUPLICATE if repeat
            else dialogue.CUT if row["cut"]
            else dialogue.FINE
        )
        if fault:
            self.counts[fault] += 1
        initial, turn = row["initial"], row["turn"]
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in _LEGAL:
            self.illegal += 1
        self.tail = initial
        if turn is not None:
            if self.tail_turn is None:
                self.head_turn = self.least = turn
            self.turns += turn != self.tail_turn
            self.tail_turn = self.most = turn
        if len(self.stretch) == STRETCH:
            self._close()
        self.stretch.append((initial, fault))

    def _close(self) -> None:
        self.paths = dialogue.extended(self.paths, self.stretch)
        self.stretch, self.whole = [], False

    def end(self, ended: bool) -> list:
        """The piece as a row; ``ended`` says that no later task has rows of this conversation."""
        if ended and self.begun and self.whole:
            found = dialogue.lightest(self.stretch, dialogue.START, dialogue.ACCEPTED, any_goal=True)
            self.paths = {(dialogue.START, to): value for to, value in found.items()}
        elif self.stretch:
            self._close()
        paths = [{"entry": a, "to": b, "cost": c, "letters": x} for (a, b), (c, x) in self.paths.items()]
        return [
            self.conv_id, None, *self.counts.values(), self.illegal, self.head, self.tail,
            self.least, self.most, self.turns, self.head_turn, self.tail_turn, paths,
        ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _out(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), f.type) for column, f in zip(zip(*rows), schema)], schema=schema
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    piece, out = None, []
    for row in _rows(batches):
        if piece is None or row["conv_id"] != piece.conv_id:
            if piece is not None:
                out.append(piece.end(ended=True))
                if len(out) == 1000:
                    yield _out([[r[0], task, *r[2:]] for r in out], _PIECE)
                    out = []
            # Only the first conversation of a task may have begun in an earlier one.
            piece = _Piece(row["conv_id"], begun=piece is not None)
        piece.add(row)
    if piece is not None:
        out.append(piece.end(ended=False))
        yield _out([[r[0], task, *r[2:]] for r in out], _PIECE)


REPAIR = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_REPAIR = pa.schema(
    [("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
     ("audit", pa.string())]
)


def _joined(a: dict, b: dict) -> dict:
    """Two pieces of one conversation, ``a`` before ``b``."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    if a["tail"] is not None and b["head"] is not None and a["tail"] + b["head"] not in _LEGAL:
        out["illegal"] += 1
    if a["tail_turn"] is not None and a["tail_turn"] == b["head_turn"]:
        out["turns"] -= 1
    for k in ("head", "head_turn", "least"):
        out[k] = b[k] if a[k] is None else a[k]
    for k in ("tail", "tail_turn", "most"):
        out[k] = a[k] if b[k] is None else b[k]
    return out | {"conv_id": a["conv_id"], "paths": dialogue.chained(a["paths"], b["paths"])}


def _finished(piece: dict) -> list:
    cost, audit = dialogue.goal(piece["paths"])
    gaps = 0 if piece["least"] is None else piece["most"] - piece["least"] + 1 - piece["turns"]
    return [piece["conv_id"], gaps, *[piece[k] for k in ("blank", "duplicate", "truncated", "illegal")], cost, audit]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations from pieces sorted by conversation and task."""
    piece, out = None, []
    for row in _rows(batches):
        row["paths"] = {(p["entry"], p["to"]): (p["cost"], p["letters"]) for p in row["paths"]}
        if piece is not None and row["conv_id"] == piece["conv_id"]:
            piece = _joined(piece, row)
            continue
        if piece is not None:
            out.append(_finished(piece))
            if len(out) == 1000:
                yield _out(out, _REPAIR)
                out = []
        piece = row
    if piece is not None:
        out.append(_finished(piece))
        yield _out(out, _REPAIR)


def repairs(rows: DataFrame, workspace: Workspace) -> DataFrame:
    """Faults, cost and letters of the lightest repair per conversation of ``rows`` (form of ``damaged``)."""
    small = workspace.keep(marks(rows), "marks")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-small.count() // ORDERED_ROWS))
    pieces = (
        small.repartitionByRange(tasks, "conv_id", *ORDER)
        .sortWithinPartitions("conv_id", *ORDER)
        .mapInArrow(_pieces, PIECE)
    )
    whole = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "task").mapInArrow(_chain, REPAIR)
    found = workspace.keep(whole, "repairs")
    workspace.drop("marks")
    return found


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(repair, its turns) of conversations whose repair comes before their rows."""
    rows = _rows(batches)
    row = next(rows, None)
    while row is not None:
        repair, edit = row, dialogue.Repaired(row["audit"])
        row = None

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal row
            for row in rows:
                if row["kind"] == 0:
                    break
                yield from edit.row(row["role"], row["text"])
            else:
                row = None
            yield from edit.inserted()

        yield repair, turns()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    schema = _REPAIR.append(pa.field("repaired_sha256", pa.string()))
    for repair, turns in _walk(batches):
        digest, first = hashlib.sha256(), True
        for role, text in turns:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            first = False
        out.append([*[repair[k] for k in _REPAIR.names], digest.hexdigest()])
        if len(out) == 1000:
            yield _out(out, schema)
            out = []
    if out:
        yield _out(out, schema)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out, held = [], 0
    for repair, turns in _walk(batches):
        for turn, (role, text) in enumerate(turns):
            out.append([repair["conv_id"], turn, role, text])
            held += len(text)
            if len(out) == 1000 or held > 1 << 24:
                yield _out(out, schema)
                out, held = [], 0
    if out:
        yield _out(out, schema)


def _with_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Every conversation in one task, in order: its repair (kind 0), then its rows (kind 1)."""
    heads = found.select(F.lit(0).alias("kind"), *_REPAIR.names)
    bodies = rows.where(~F.col("gone")).select(F.lit(1).alias("kind"), "conv_id", *ORDER, "role", "text")
    both = heads.unionByName(bodies, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)


def report(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``conversations`` has conv_id, turn (longs), role and text; other columns are left
    out. With ``damage`` one row in five is damaged first. NULL roles and texts are one
    space; rows with a NULL conv_id are one conversation; rows of one turn are ordered by
    role and by the md5 of their text, so rows that repeat lie together, and all but the
    first of them are duplicates. An empty role has the initial " ". A conversation
    without rows after the damage has zeros and the hash of an empty text. An empty
    table gives an empty table.
    """
    rows = damaged(conversations) if damage else intact(conversations)
    found = repairs(rows, Workspace(conversations.sparkSession, "dialogue"))
    return _with_rows(found, rows).mapInArrow(_hashed, REPAIR + ", repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0 without gaps), role and text.

    Rows are taken as they are, with NULLs and ties as in ``report``. A conversation
    that has no turn left has no row.
    """
    rows = intact(conversations)
    found = repairs(rows, Workspace(conversations.sparkSession, "dialogue"))
    return _with_rows(found, rows).mapInArrow(_written, "conv_id long, turn long, role string, text string")
