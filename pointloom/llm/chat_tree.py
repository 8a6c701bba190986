"""Operator 11: chat formatting as a prefix tree. Conversations that begin with the same turns share their tokens."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .token_alignment import Side, load

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Characters of a turn's key in a path.
_KEY = 32
#: Turns whose tokens a Python worker remembers, and the longest of them.
MOST_TURNS, REMEMBERED = 20_000, 1000

_STEPS = "part long, seq long, conv_id long, path string, own int, starts array<long>, owners array<long>, sizes array<long>, places array<long>, total long"


def escape(text: str) -> str:
    """text without any control string: after each < that begins one, or an escaped one, comes one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role ends with its line, so line feeds are written as \\n and backslashes doubled."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """Turns as tokens: a begin token, role and line feed, text, an end token, line feed. The two control tokens come after
    the tokenizer's own, which texts never give."""

    def __init__(self, side: Side, trained: str):
        self.side, self.trained = side, trained
        self.begin, self.end = len(side.entries), len(side.entries) + 1
        self.entries = [*side.entries, BEGIN.encode(), END.encode()]
        self.remembered = functools.lru_cache(MOST_TURNS)(self._turn)

    def _turn(self, role: str, text: str) -> tuple[bytes, int, int, str]:
        head, body = self.side.encode(f"{escape_role(role)}\n"), self.side.encode(escape(text))
        ids = np.array([self.begin, *head, *body, self.end, *self.side.encode("\n")], "<u4").tobytes()
        first, last = (1 + len(head), 1 + len(head) + len(body)) if role == self.trained else (0, 0)
        return ids, first, last, hashlib.md5(ids, usedforsecurity=False).hexdigest()

    def turn(self, role: str, text: str) -> tuple[bytes, int, int, str]:
        """Its token ids, which of them are under the loss mask, and a key that equal turns share."""
        return (self.remembered if len(text) <= REMEMBERED else self._turn)(role, text)

    def text(self, ids: np.ndarray) -> str:
        return b"".join([self.entries[i] for i in ids.tolist()]).decode()

    def parse(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's tokens."""
        inner = ids[1 : np.flatnonzero(ids == self.end)[0]]
        role, _, text = self.text(inner).partition("\n")
        return unescape_role(role), unescape(text)


@functools.cache
def template(tokenizer: str, folder: str | None, trained: str) -> Template:
    return Template(load(tokenizer, folder, ""), trained)


@dataclass(frozen=True)
class ChatTree:
    """The forest of all conversations as one stream of tokens, written depth first in shards.

    nodes: a row for each different turn in its context: shard, seq, start (its first token's place in the stream),
    position (that token's position id, the tokens before it in its conversation), ids, loss_from, loss_to (of its tokens,
    those under the loss mask), attention (the intervals [from, to) of the stream that hold its ancestors' tokens, merged).
    leaves: a row for each conversation: shard, seq, conv_id, depth (its turns), leaf (start of its last turn).
    roots: of each shard, the starts of the turns that are open where it begins, written in shards before it."""

    nodes: DataFrame
    leaves: DataFrame
    roots: DataFrame
    spec: tuple[str, str | None, str]


def encode_turns(rows: DataFrame, spec: tuple[str, str | None, str]) -> DataFrame:
    """conv_id, turn, role, key, ids, loss_from, loss_to of each turn; null roles and texts are empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(*spec)
        for batch in batches:
            made = [form.turn(*x) for x in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            ids, first, last, key = zip(*made, strict=True) if made else ((), (), (), ())
            kept = [batch.column(c) for c in ("conv_id", "turn", "role")]
            more = [pa.array(key, pa.string()), pa.array(ids, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=["conv_id", "turn", "role", "key", "ids", "loss_from", "loss_to"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.mapInArrow(task, "conv_id long, turn long, role string, key string, ids binary, loss_from int, loss_to int")


def _shared(a: str, b: str) -> int:
    """How many turns two paths begin with alike."""
    most, n = min(len(a), len(b)), 0
    while n < most and a[n : n + _KEY] == b[n : n + _KEY]:
        n += _KEY
    return n // _KEY


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one shard in the order of their paths, which is depth first: each owns the turns beyond those that
    it shares with the one before. Starts count from the shard's beginning."""
    from pyspark import TaskContext

    part, seq, at, path = TaskContext.get().partitionId(), 0, 0, ""
    starts: list[int] = []
    owners: list[int] = []
    held: dict | None = None
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("conv_id", pa.int64()), ("path", pa.string()), ("own", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("starts", "owners", "sizes", "places")], ("total", pa.int64())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = _shared(path, row["path"])
            path, sizes = row["path"], row["sizes"]
            ends = np.cumsum(sizes)
            places = (ends - sizes).tolist()
            starts = [*starts[:own], *(at + p - places[own] for p in places[own:])]
            owners = [*owners[:own], *row["uids"][own:]]
            at += sum(sizes[own:])
            out += [held] if held else []
            held = {"part": part, "seq": seq, "conv_id": row["conv_id"], "path": path, "own": own, "starts": starts, "owners": owners, "sizes": sizes, "places": places, "total": None}
            seq += 1
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist([held | {"total": at}] if held else [], schema)


def _join_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the first and the last conversation of each shard, in order: where its tokens begin in the stream, how many
    turns at its beginning are open from before, their tokens and their starts."""
    path, starts, base, first = "", [], 0, None
    schema = pa.schema([("of", pa.int64()), ("base", pa.int64()), ("open", pa.int32()), ("cut", pa.int64()), ("roots", pa.list_(pa.int64()))])
    for batch in batches:
        for row in batch.to_pylist():
            if row["seq"] == 0:
                open_ = _shared(path, row["path"])
                first = {"of": row["part"], "base": base, "open": open_, "cut": sum(row["sizes"][:open_]), "roots": starts[:open_]}
            if row["total"] is not None:
                yield pa.RecordBatch.from_pylist([first], schema)
                path, cut = row["path"], first["cut"]
                starts = [first["roots"][i] if s < cut else base + s - cut for i, s in enumerate(row["starts"])]
                base += row["total"] - cut


def _span(first, end):
    """An interval in an array of its own."""
    return F.array(F.named_struct(F.lit("from"), first, F.lit("to"), end))


def _merged(turns):
    """Intervals of turns (start, size) in order, with those that touch made one."""
    def put(done, x):
        end, last = x["start"] + x["size"], F.try_element_at(done, F.lit(-1))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), _span(last["from"], end))
        return F.when(last["to"] == x["start"], longer).otherwise(F.concat(done, _span(x["start"], end)))

    return F.aggregate(turns, F.array().cast("array<struct<from: bigint, to: bigint>>"), put)


def format_conversations(rows: DataFrame, tokenizer: str = "byte_bpe_50k.json", folder: str | None = None, trained: str = "assistant") -> ChatTree:
    """Conversations (conv_id, turn, role, text) as a prefix tree of token ids (see ChatTree), with the loss mask over the
    texts of role trained. tokenizer is a file in folder, by default that of the installed public tokenizers.

    Turns come by turn, nulls first, those of one turn by role and a hash of their tokens. Null roles and texts are empty.
    A null conv_id is a conversation of its own. Repeated rows are turns of their own. Other columns are ignored; an empty
    table gives an empty tree. Control strings in texts are escaped, and come back when read.

    A conversation's path is its turns' 128-bit keys. Sorted by path, conversations stand depth first, and each holds as new
    just what it doesn't share with the one before, so the tree needs no grouping by what is shared: a first turn, or a whole
    conversation, that a third of them have is cut over as many shards as any others. Shards are joined by two rows each.
    Texts and tokens move once, to where they are written; what is gathered for a conversation is some 80 bytes a turn."""
    spec = (tokenizer, folder, trained)
    turns = materialize(encode_turns(rows, spec).withColumn("uid", F.monotonically_increasing_id()), "turns")
    step = F.struct("turn", "role", "key", "uid", (F.octet_length("ids") / 4).cast("long").alias("size"))
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    paths = paths.select("conv_id", F.array_join("steps.key", "").alias("path"), F.col("steps.uid").alias("uids"), F.col("steps.size").alias("sizes"))
    paths = materialize(paths, "paths").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    laid = materialize(paths.mapInArrow(_lay_out, _STEPS), "laid")
    edges = laid.where("seq = 0 or total is not null").select("part", "seq", "path", "starts", "sizes", "total")
    shards = edges.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_join_shards, "of long, base long, open int, cut long, roots array<long>")
    shards = materialize(shards, "shards")
    placed = laid.join(small(shards), F.col("part") == F.col("of"))
    moved = F.transform("starts", lambda s, i: F.when(s < F.col("cut"), F.get("roots", i)).otherwise(F.col("base") + s - F.col("cut")))
    own = F.when(F.col("seq") == 0, F.col("open")).otherwise(F.col("own"))
    placed = placed.select(F.col("part").alias("shard"), "seq", "conv_id", own.alias("own"), moved.alias("starts"), "owners", "sizes", "places")
    path = F.transform("starts", lambda s, i: F.struct(s.alias("start"), F.get("owners", i).alias("uid"), F.get("sizes", i).alias("size"), F.get("places", i).alias("position")))
    placed = placed.select("shard", "seq", "conv_id", "own", path.alias("path"))
    shared, new = F.slice("path", F.lit(1), F.col("own")), F.slice("path", F.col("own") + 1, F.size("path") - F.col("own"))
    branches = placed.where(F.col("own") < F.size("path")).select("shard", "seq", _merged(shared).alias("before"), new[0]["start"].alias("branch"), F.explode(new).alias("x"))
    own_turns = _span(F.col("branch"), F.col("x.start"))
    touches = F.try_element_at("before", F.lit(-1))["to"] == F.col("branch")
    last = _span(F.try_element_at("before", F.lit(-1))["from"], F.col("x.start"))
    attention = F.when(touches, F.concat(F.slice("before", F.lit(1), F.size("before") - 1), last)).when(F.col("x.start") > F.col("branch"), F.concat("before", own_turns)).otherwise(F.col("before"))
    nodes = branches.select("shard", "seq", F.col("x.start").alias("start"), F.col("x.position").alias("position"), attention.alias("attention"), F.col("x.uid").alias("uid"))
    nodes = nodes.join(turns.select("uid", "ids", "loss_from", "loss_to"), "uid").drop("uid")
    leaves = placed.select("shard", "seq", "conv_id", F.size("path").alias("depth"), F.element_at("path", -1)["start"].alias("leaf"))
    roots = shards.select(F.col("of").alias("shard"), F.explode("roots").alias("start"))
    return ChatTree(materialize(nodes, "nodes"), leaves, roots, spec)


@dataclass
class _Read:
    """What has been read of a conversation up to a turn."""

    tokens: int
    turns: int
    chars: int
    said: object
    loss_chars: int
    loss: object

    def then(self, form: Template, ids: np.ndarray, first: int, last: int) -> _Read:
        role, text = form.parse(ids)
        said, loss, under = self.said.copy(), self.loss.copy(), unescape(form.text(ids[first:last]))
        said.update(f"{role}\n{text}\n".encode())
        loss.update(under.encode())
        return _Read(self.tokens + len(ids), self.turns + 1, self.chars + len(form.text(ids)), said, self.loss_chars + len(under), loss)


def read_back(tree: ChatTree) -> DataFrame:
    """Each conversation's digest, read from the tree's tokens: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. A shard is read once from its beginning, with the turns that are open there put before it; position ids
    tell how far a turn goes back. A shared turn is decoded once, and its hash goes on from there in each branch."""
    spec = tree.spec

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, shard, open_ = template(*spec), None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, open_ = row["shard"], [_Read(0, 0, 0, hashlib.sha256(), 0, hashlib.sha256())]
                if row["ids"] is not None:
                    while open_[-1].tokens > row["position"]:
                        open_.pop()
                    open_.append(open_[-1].then(form, np.frombuffer(row["ids"], "<u4"), row["loss_from"], row["loss_to"]))
                else:
                    top = open_[-1]
                    if top.turns != row["depth"]:
                        raise ValueError(f"conversation {row['conv_id']} has {row['depth']} turns, and {top.turns} were read")
                    out.append((row["conv_id"], top.turns, top.said.hexdigest(), top.loss_chars, top.loss.hexdigest(), top.chars))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    body = ["start", "position", "ids", "loss_from", "loss_to"]
    nodes = tree.nodes.select("shard", "seq", F.lit(0).alias("kind"), *body)
    # some turns for each shard
    roots = small(materialize(tree.roots.withColumnRenamed("shard", "into"), "roots"))
    before = tree.nodes.join(roots, "start").select(F.col("into").alias("shard"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("kind"), *body)
    ends = tree.leaves.select("shard", "seq", F.lit(1).alias("kind"), "conv_id", "depth")
    rows = nodes.unionByName(before).unionByName(ends, allowMissingColumns=True)
    ordered = rows.repartitionByRange("shard").sortWithinPartitions("shard", "seq", "kind", "start")
    return ordered.mapInArrow(task, ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in zip(names, types, strict=True)))


def op11_format(spark, sf_dir: str) -> DataFrame:
    said = f"{END}{BEGIN}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(more)))
