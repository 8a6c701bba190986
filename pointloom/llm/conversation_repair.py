"""Operator 13: conversations repaired at least cost to the role grammar s?(ua)+, in order of their turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_GROUPS, materialize
from .role_grammar import ROLES, Path, Repairer, role_repairer

#: Rows, and bytes of text, of one piece of a conversation: what one step holds of it.
PIECE_ROWS, PIECE_BYTES = 2000, 4 << 20
#: Short conversations' repairs that a Python worker remembers, by their roles' initials and faults.
MOST_REMEMBERED, SHORT = 100_000, 64

_NONBLANK = r"[^\x20\x09-\x0D]"
_LEGAL = {"su", "ua", "au"}
_FIGURES = ("blank", "duplicate", "truncated", "illegal")
_EDITS = "array<struct<edit: string, role: string, text: string, times: long>>"
_REPAIRED = f"conv_id long, piece long, whole boolean, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits {_EDITS}"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the contract damages them, with copies: 0 for a dropped row, 2 for a repeated
    one. By the remainder of the CRC-32 of conv_id:turn by 20: 0 drops, 1 empties the text, 2 takes its full stops, ! and ?
    away, 3 repeats, 4 makes the role user. Null roles and texts are one space, and so are null ids and turns in the CRC."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with their first fault, sorted by conversation, turn (nulls first), role and a hash of the text within ranges
    of them all, so that a conversation of any length is cut over many tasks. Equal rows of a turn are one row with copies,
    so they are summed before anything moves.

    A row is a duplicate unless its turn is the first that says the same in the conversation; that turn is found by grouping,
    and met by a join in which what is said in very many turns is broadcast."""
    said = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role"), "role", "text").cast("binary"))
    held = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    held = materialize(held.withColumn("said", said).withColumn("tie", F.md5(F.col("text").cast("binary"))), "turns")
    # struct, as the first turn may be null
    first = held.where("copies > 0").groupBy("said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1"), "said")
    hot = F.col("n") > max(1, held.count() // HOT_GROUPS)
    known, few = F.broadcast(first.where(hot)), first.where(~hot)  # below HOT_GROUPS rows by counting
    others = held.join(F.broadcast(first.where(hot).select("said")), "said", "left_anti").join(few, "said", "left")
    flagged = held.join(known, "said").unionByName(others)
    again = F.col("n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(~F.col("text").rlike(_NONBLANK), "b").when(again, "d").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("")
    flagged = flagged.select("conv_id", "turn", "role", "text", "copies", "tie", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    order = ["conv_id", "turn", "role", "tie"]
    return materialize(flagged, "faults").repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")


def _kind(row: dict) -> tuple[str, str, int]:
    """What the repairer asks of a row."""
    return row["initial"], "d" if row["fault"] in ("b", "d") else row["fault"], row["copies"]


def _figures(rows: list[dict]) -> dict:
    """What a piece adds to its conversation's figures, with its first and last initial and its turns."""
    out, initials, turns = dict.fromkeys(_FIGURES, 0), [], []
    for r in rows:
        n, fault = r["copies"], r["fault"]
        if not n:
            continue
        out["blank"] += n * (fault == "b")
        out["duplicate"] += n * (fault == "d") + (n - 1) * (fault in ("", "t"))
        out["truncated"] += fault == "t"
        out["illegal"] += n - 1 + bool(initials and initials[-1] + r["initial"] not in _LEGAL)
        initials.append(r["initial"])
        if r["turn"] is not None and (not turns or turns[-1] != r["turn"]):
            turns.append(r["turn"])
    out |= {"head": initials[0], "tail": initials[-1]} if initials else {"head": None, "tail": None}
    return out | ({"low": turns[0], "high": turns[-1], "turns": len(turns)} if turns else {"low": None, "high": None, "turns": 0})


def _edits(rows: Iterable[dict], audit: str, roles: str) -> list[dict]:
    """The rows as the edits leave them; a deleted row shows what it was, and times how many copies of it went."""
    out, at = [], 0
    insert = lambda role: out.append({"edit": "I", "role": ROLES[role], "text": "", "times": 1})
    for r in rows:
        if not r["copies"]:
            continue
        while audit[at] == "I":
            insert(roles[at])
            at += 1
        edit, copies = audit[at], r["copies"]
        if edit != "D":
            out.append({"edit": edit, "role": r["role"] if edit == "K" else ROLES[roles[at]], "text": r["text"], "times": 1})
            copies -= 1
        if copies:
            out.append({"edit": "D", "role": r["role"], "text": r["text"], "times": copies})
        at += r["copies"]
    for role in roles[at:]:
        insert(role)
    return out


class _Memory:
    """Repairs of whole conversations; short ones of the same initials and faults are worked out once."""

    def __init__(self, repairer: Repairer):
        self.repairer, self.known = repairer, {}

    def repair(self, rows: list[dict]) -> Path:
        kinds = tuple(map(_kind, rows))
        found = self.known.get(kinds)
        if found is None:
            _, found = self.repairer.ended(self.repairer.rows(self.repairer.grammar.empty, kinds))
            if len(kinds) <= SHORT:
                if len(self.known) >= MOST_REMEMBERED:
                    self.known.clear()
                self.known[kinds] = found
        return found


_EDIT = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64())])
_ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("initial", pa.string()), ("fault", pa.string())])
_END = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in (*_FIGURES, "low", "high", "turns", "cost")]]
    + [("head", pa.string()), ("tail", pa.string()), ("audit", pa.string()), ("edits", pa.list_(_EDIT)), ("rows", pa.list_(_ROW)), ("ends", pa.list_(_END))]
)
_PIECES = f"""conv_id long, piece long, whole boolean, {", ".join(f"{c} long" for c in (*_FIGURES, "low", "high", "turns", "cost"))}, head string, tail string,
audit string, edits {_EDITS}, rows array<struct<role: string, text: string, copies: long, initial: string, fault: string>>,
ends array<struct<start: int, end: int, cost: long, audit: string, roles: string>>"""


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], bool, bool]]:
    """Pieces of the sorted rows: rows of one conversation, and whether the conversation surely begins and ends in them.
    Of what a task reads only the first and the last conversation may go on elsewhere."""
    held, size, first, begins = [], 0, True, False
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield held, begins, True
                held, size, first, begins = [], 0, False, True
            elif len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                yield held, begins, False
                held, size, begins = [], 0, False
            held.append(row)
            size += len(row["text"])
    if held:
        yield held, begins, False


def pieces_of(rows: DataFrame) -> DataFrame:
    """Pieces of conversations. Whole ones come with their edits; of others (long ones, and those at the ends of a range)
    comes the least path from each stack before the piece to each after it, beside the rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        repairer, part, out = role_repairer(), TaskContext.get().partitionId(), []
        memory = _Memory(repairer)
        for number, (held, begins, ends) in enumerate(_runs(batches)):
            piece = {"conv_id": held[0]["conv_id"], "piece": part << 32 | number, "whole": begins and ends} | _figures(held)
            if begins and ends:
                cost, audit, roles = memory.repair(held)
                piece |= {"cost": cost, "audit": audit, "edits": _edits(held, audit, roles)}
            else:
                ways = [(s, e, *path) for s in repairer.stacks for e, path in repairer.rows(s, map(_kind, held)).items()]
                piece |= {"rows": held, "ends": [dict(zip(("start", "end", "cost", "audit", "roles"), w, strict=True)) for w in ways]}
            out.append(piece)
            if len(out) >= 500 or len(held) > 100:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, _ARROW)

    return rows.mapInArrow(task, _PIECES)


class _Fold:
    """The pieces of one conversation joined in order. Of each stack only the least path stays: its cost, and its place
    among the others by edits. All have edited the same rows and end with a row's edit, so none begins another, and
    places decide as whole strings would. Paths themselves aren't kept, only from which stack each piece was entered."""

    def __init__(self, repairer: Repairer):
        self.repairer, self.tops, self.back, self.numbers = repairer, {repairer.grammar.empty: (0, 0)}, [], []
        self.sums, self.tail, self.low, self.high, self.turns = dict.fromkeys(_FIGURES, 0), None, None, None, 0

    def add(self, piece: dict) -> None:
        best: dict[int, tuple] = {}
        for w in piece["ends"]:
            if w["start"] in self.tops:
                cost, place = self.tops[w["start"]]
                way = (cost + w["cost"], place, w["audit"], w["roles"], w["start"])
                if w["end"] not in best or way < best[w["end"]]:
                    best[w["end"]] = way
        places = {x: i for i, x in enumerate(sorted({way[1:4] for way in best.values()}))}
        self.tops = {end: (way[0], places[way[1:4]]) for end, way in best.items()}
        self.back.append({end: way[4] for end, way in best.items()})
        self.numbers.append(piece["piece"])
        for c in _FIGURES:
            self.sums[c] += piece[c]
        if piece["head"] is not None:
            self.sums["illegal"] += self.tail is not None and self.tail + piece["head"] not in _LEGAL
            self.tail = piece["tail"]
        if piece["turns"]:
            self.turns += piece["turns"] - (self.high == piece["low"])
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]

    def chosen(self) -> Iterator[dict]:
        """Of each piece the stacks before and after it; of the last also the insertions at the end and the figures."""
        def closed(node: int) -> tuple:
            _, (cost, audit, roles) = self.repairer.ended({node: (0, "", "")})
            return self.tops[node][0] + cost, self.tops[node][1], audit, roles, node

        cost, _, audit, roles, node = min(map(closed, self.tops))
        for i in reversed(range(len(self.back))):
            start, last = self.back[i][node], i == len(self.back) - 1
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            more = {"last": last, "closing": audit if last else "", "closing_roles": roles if last else ""}
            yield {"of": self.numbers[i], "start": start, "end": node} | more | (self.sums | {"cost": cost, "gaps": gaps} if last else {})
            node = start


_CHOSEN = pa.schema([("of", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_()), ("closing", pa.string()), ("closing_roles", pa.string()), *[(c, pa.int64()) for c in (*_FIGURES, "cost", "gaps")]])


def join_pieces(pieces: DataFrame) -> DataFrame:
    """Which path each piece takes. Pieces of a conversation are read in order, one at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, fold, conv = role_repairer(), None, None
        for batch in batches:
            for piece in batch.to_pylist():
                if fold is None or piece["conv_id"] != conv:
                    if fold:
                        yield pa.RecordBatch.from_pylist(list(fold.chosen()), _CHOSEN)
                    fold, conv = _Fold(repairer), piece["conv_id"]
                fold.add(piece)
        if fold:
            yield pa.RecordBatch.from_pylist(list(fold.chosen()), _CHOSEN)

    narrow = pieces.select("conv_id", "piece", *_FIGURES, "low", "high", "turns", "head", "tail", "ends")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(task, f"of long, start int, end int, last boolean, closing string, closing_roles string, {', '.join(f'{c} long' for c in (*_FIGURES, 'cost', 'gaps'))}")


_OUT = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("last", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", *_FIGURES, "cost")], ("audit", pa.string()), ("edits", pa.list_(_EDIT))])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the edits of the path that they take."""
    for batch in batches:
        for p in batch.to_pylist():
            way = next(w for w in p["ends"] if (w["start"], w["end"]) == (p["start"], p["end"]))
            audit, roles = way["audit"] + p["closing"], way["roles"] + p["closing_roles"]
            yield pa.RecordBatch.from_pylist([{c: p[c] for c in _OUT.names[:-2]} | {"audit": audit, "edits": _edits(p["rows"], audit, roles)}], _OUT)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Conversations repaired to s?(ua)+ or nothing: rows (conv_id, turn, role, text, and copies if a row stands for
    several) as pieces in order: conv_id, piece, last (whether it is the conversation's last), gaps, blank, duplicate,
    truncated, illegal and cost (of the whole conversation, null but on the last piece), audit (the piece's edits) and
    edits (edit, role, text, times): K keeps a row, R gives it another role, I inserts an empty one, D deletes it.

    Rows come by turn, nulls first; rows of one turn by role, then a hash of their text. Roles count by their first
    character. Nulls in role or text count as one space. Blank rows and duplicates are always deleted, so a conversation
    of nothing else is empty. copies of 0 say that the conversation exists; of such rows alone it has no rows and a cost
    of 0. A null conv_id is a conversation of its own. Other columns are ignored; an empty table gives an empty table.

    Generalised LR with weighted edits (role_grammar): conversations are cut into pieces of at most PIECE_ROWS rows,
    each repaired from every stack it may begin with, and pieces are joined by what path is least. No task holds more of a
    conversation than a piece and some numbers for each other piece, and their figures."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    pieces = materialize(pieces_of(in_order(rows)), "pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    whole = pieces.where("whole").select("conv_id", "piece", F.lit(True).alias("whole"), F.lit(True).alias("last"), gaps, *_FIGURES, "cost", "audit", "edits")
    cut = pieces.where("not whole")
    taken = cut.select("conv_id", "piece", "whole", "rows", "ends").join(join_pieces(cut), F.col("piece") == F.col("of"))
    return whole.unionByName(taken.drop("of").mapInArrow(_taken, _REPAIRED))


def digest_repairs(repaired: DataFrame) -> DataFrame:
    """One row a conversation, with the hash of its repaired rows. Conversations of one piece are hashed where they are;
    of others the pieces are read in order and hashed one after another."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, audit, fresh = hashlib.sha256(), [], True
        for batch in batches:
            for p in batch.to_pylist():
                for e in p["edits"]:
                    if e["edit"] != "D":
                        sha.update(("" if fresh else "\n").encode() + f"{e['role']}:{e['text']}".encode())
                        fresh = False
                audit.append(p["audit"])
                if p["last"]:
                    yield pa.RecordBatch.from_pylist([{c: p[c] for c in names[:-2]} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)
                    sha, audit, fresh = hashlib.sha256(), [], True

    names = ["conv_id", "gaps", *_FIGURES, "cost", "audit", "repaired_sha256"]
    schema = pa.schema([*[(c, pa.int64()) for c in names[:-2]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    text = F.array_join(F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    alone = repaired.where("whole").select(*names[:-1], F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    cut = repaired.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return alone.unionByName(cut.mapInArrow(task, ", ".join(f"{c} {'string' if c in names[-2:] else 'long'}" for c in names)))


def op13_repair(spark, sf_dir: str) -> DataFrame:
    return digest_repairs(repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
