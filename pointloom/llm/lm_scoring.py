"""Operator 8: language-model scoring from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize
from .words import mix, planes, unplanes

#: A count c has level 1 + floor(log(c) / log(BASE)); the filter holds an n-gram once for each level up to its own.
BASE = 1.5
#: Bits for each entry at least, and probes of an entry. The filter grows with its entries, a slice in each bucket. An n-gram
#: that isn't there is taken for one in less than 1 of 3,000 cases.
BITS, PROBES = 18, 8
#: Word pairs seen less often aren't kept in the model: all that training texts have are.
LEAST_PAIR = 1
#: Weight of the single-word model in that of a word after another, in counts.
PRIOR = 30.0

#: Bytes of text that are counted at once, and that a bucket counts and looks up the tokens and pairs of.
CHUNK, BUCKET = 4 << 20, 8 << 20
#: Buckets at least. How many there are follows from the texts alone, so that scores don't depend on how Spark is set up.
LEAST_BUCKETS = 64
#: Buckets that one chunk is dealt over at most. More are reached by dealing a second time, so what a row holds doesn't
#: shrink as the input grows.
FANOUT = 2048

_END = np.uint64(0xE703C61A5D2B4F99)  # stands for the end of a text
_FLOORS = BASE ** np.arange(1, 120)
_CEILS = np.ceil(np.concatenate([[1.0], _FLOORS]))
#: The count that a level stands for: the middle of the whole numbers at that level; 0 for none.
_MEANT = np.concatenate([[0.0], (_CEILS[:-1] + _CEILS[1:] - 1) / 2])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(_FLOORS, counts, "right")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text is 1 modulo 5. A null id is as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, with an end after each text, and the number of each token's text."""
    found = words.split([t.lower() for t in texts])  # bytes.lower() changes A-Z only
    doc = found.texts()
    out = np.full(len(doc) + len(texts), _END, np.uint64)
    at = np.arange(len(doc)) + doc
    out[at] = found.hashes()
    return out, np.repeat(np.arange(len(texts)), np.diff(found.first) + 1)


def _after(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before + np.uint64(1)) + token)


def pairs_of(token: np.ndarray) -> np.ndarray:
    """What tells, after a given token, what came next; before a text's first is an end."""
    return _after(np.concatenate([[_END], token[:-1]]), token)


def as_pair(before: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """A 64-bit name of a pair, from the token before and what tells the next. It is dealt, counted and looked up by it."""
    return mix(before + mix(pair + np.uint64(3)))


def as_context(token: np.ndarray) -> np.ndarray:
    """What a token's count as the first of a pair goes by in a model that leaves pairs out. With all pairs kept it is the
    token's own count, as each token of a text is followed by one, and score() asks for that."""
    return mix(token ^ np.uint64(0x5851F42D4C957F2D))


def pairs_in(distinct: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of a chunk's different pairs, ordered by the two tokens' places in distinct, and at each token the place
    of the pair that it ends."""
    before = np.concatenate([[np.searchsorted(distinct, _END)], code[:-1]])
    both, at = np.unique((before.astype(np.uint64) << np.uint64(32)) | code.astype(np.uint64), return_inverse=True)
    first = distinct[both >> np.uint64(32)]
    return as_pair(first, _after(first, distinct[both & np.uint64(0xFFFFFFFF)])), at


def bucket_of(ngram: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ngram + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(ngram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket and then by name, and where each bucket starts in it."""
    bucket = bucket_of(ngram, buckets)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) | named(ngram), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def named(pair: np.ndarray) -> np.ndarray:
    """The 40 bits that tell a pair within its bucket. A bucket holds some 10^6 pairs at any size of the input, of which
    about one in 10^6 shares its bits with another, far fewer than the filter takes for others."""
    return pair >> np.uint64(24)


def pack(x: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers with their entropy coded, as LZ4 wouldn't."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
    return coder.compress(planes(x, width)) + coder.flush()


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    return unplanes(zlib.decompress(data, -15), width)


def gather_counts(buckets: int):
    """Each chunk's different tokens and pairs with their counts in training, dealt over buckets by their own hashes; and a
    row of its own that says which of the chunk's tokens each text has. A token or a pair costs one number for each
    chunk, however often it comes, and the pairs that one token begins are dealt over all buckets."""
    names = {"chunk": pa.int64(), "bucket": pa.int32(), "ids": pa.binary(), "flags": pa.binary(), "sizes": pa.binary(), "codes": pa.binary(), "token": pa.binary(), "token_n": pa.binary(), "pair": pa.binary(), "pair_n": pa.binary()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.chunks(batches, limit=CHUNK):
            tags = batch.column("tag").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False)
            # named by its rows, so a task that runs again names it alike
            chunk = int(mix(np.cumsum(mix(tags.view(np.uint64)), dtype=np.uint64)[-1:] + np.uint64(len(tags)))[0].view(np.int64))
            token, doc = tokens(texts)
            distinct, code = np.unique(token, return_inverse=True)
            pair, at = pairs_in(distinct, code)
            often = np.argsort(-np.bincount(code), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))  # common tokens have small numbers, which pack well
            ids = batch.column("doc_id")
            flags = train + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            rows = [(chunk, chunk % buckets, ids.fill_null(0).to_numpy().tobytes(), flags.tobytes(), pack(np.bincount(doc, minlength=len(texts))), pack(rank[code]), distinct[often].tobytes(), None, None, None)]
            sent = []
            for ngram, place in ((distinct, code), (pair, at)):
                order, start = _by_bucket(ngram, buckets)
                sent.append((ngram[order], np.bincount(place, weights=train[doc], minlength=len(ngram)).astype(np.int64)[order], start))
            rows += packed(chunk, 0, (sent[0][0], *sent[0][1:]), (named(sent[1][0]), *sent[1][1:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], names=list(names))

    return task, SENT


SENT = "chunk long, bucket int, ids binary, flags binary, sizes binary, codes binary, token binary, token_n binary, pair binary, pair_n binary"


def packed(chunk: int, bucket: int, tokens: tuple, pairs: tuple) -> list[tuple]:
    """A row for each bucket from the given one on that gets any of a chunk's tokens and named pairs. Both come in order,
    with their counts and where each bucket starts."""
    (token, token_n, at), (pair, pair_n, pair_at) = tokens, pairs
    out = []
    for b in np.flatnonzero((np.diff(at) > 0) | (np.diff(pair_at) > 0)):
        t, p = slice(at[b], at[b + 1]), slice(pair_at[b], pair_at[b + 1])
        out.append((chunk, bucket + int(b), None, None, None, None, token[t].tobytes(), pack(token_n[t]), pack(np.diff(pair[p], prepend=np.uint64(0)), 5), pack(pair_n[p])))
    return out


def first_and_step(ngram: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of entries (ngram, level) start and how far apart they are, before they are cut to a slice."""
    first = mix(ngram + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return first, (first >> np.uint64(32)) | np.uint64(1)


def build_slice(ngram: np.ndarray, count: np.ndarray, most: int | None = None) -> bytes:
    """One bucket's slice of the filter, of BITS for each of its own entries; a caller may bound it, and then it errs more."""
    level = levels(count)
    size = (BITS * int(level.sum())).bit_length()
    bits = 1 << max(10, size if most is None else min(most.bit_length() - 1, size))
    out = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        at, step = first_and_step(ngram[level >= j], j)
        for i in range(PROBES):
            out[(at + np.uint64(i) * step) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").tobytes()


def add_up(own: list[np.ndarray], n: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different n-grams of all rows, their counts, and the places of each row's own."""
    distinct, code = np.unique(np.concatenate(own), return_inverse=True)
    count = np.bincount(code, weights=np.concatenate([unpack(x) for x in n]), minlength=len(distinct)).astype(np.int64)
    return distinct, count, np.split(code, np.cumsum([len(x) for x in own])[:-1])


def read_pairs(row: dict) -> np.ndarray:
    return np.cumsum(unpack(row["pair"], 5)).astype(np.uint64)


def _parted(ngram: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct n-grams by the part of their bucket, and where each part starts in it."""
    part = (mix(ngram ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((ngram, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def deal_again(table: pa.Table, parts: int, share: int) -> pa.Table:
    """What some of the chunks sent to one bucket, added up and dealt over the parts of the bucket as if from one chunk; and
    the rows themselves, with that chunk as their share. Rows that describe a chunk pass through."""
    every = table.to_pylist()
    rows = [r for r in every if r["ids"] is None]
    out = [(*r.values(), None) for r in every if r["ids"] is not None]
    if rows:
        bucket = rows[0]["bucket"]
        share += bucket << 32
        token, token_n, _ = add_up([np.frombuffer(r["token"], np.uint64) for r in rows], [r["token_n"] for r in rows])
        pair, pair_n, _ = add_up([read_pairs(r) for r in rows], [r["pair_n"] for r in rows])
        (a, at), (b, pair_at) = _parted(token, parts), _parted(pair, parts)
        out += [(*r, None) for r in packed(share, bucket * parts, (token[a], token_n[a], at), (pair[b], pair_n[b], pair_at))]
        out += [(*(r | {"token_n": None, "pair_n": None}).values(), share) for r in rows]
    words.give_back()
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 8, pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*table.column_names, "share"])


def hand_back(table: pa.Table, parts: int) -> pa.Table:
    """Turns the answers to one share into answers to the rows that it was added up from."""
    every = table.to_pylist()
    rows = [r for r in every if r["share"] is not None]
    answers = sorted((r for r in every if r["share"] is None), key=lambda r: r["bucket"])

    def values(own: list[np.ndarray], column: str, width: int) -> list[np.ndarray]:
        distinct, code = np.unique(np.concatenate(own), return_inverse=True)
        told = np.empty(len(distinct), np.int64)
        told[_parted(distinct, parts)[0]] = np.concatenate([unpack(r[column], width) for r in answers])
        return [pack(x, width) for x in np.split(told[code], np.cumsum([len(x) for x in own])[:-1])]

    tokens = [np.frombuffer(r["token"], np.uint64) for r in rows]
    columns = zip(rows, values(tokens, "codes", 8), values(tokens, "token_level", 1), values([read_pairs(r) for r in rows], "pair_level", 1), strict=True)
    out = [(r["chunk"], r["bucket"], *[None] * 3, n, t, p, *[None] * 3) for r, n, t, p in columns]
    words.give_back()
    return answer_table(out)


def answer_table(out: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 6, *[pa.int64()] * 3)
    names = ("chunk", "bucket", "ids", "flags", "sizes", "codes", "token", "pair", "tokens", "types", "filter_bytes")
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


@dataclass
class Model:
    """Slices of the filter with the totals that smoothing needs."""

    bits: np.ndarray
    start: np.ndarray  # of each bucket's slice, in bits
    mask: np.ndarray
    tokens: int
    types: int

    def counts(self, ngram: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The counts that repeated probes say. token tells the bucket: the token's or the pair's own name."""
        return _MEANT[self.levels(ngram, token)]

    def levels(self, ngram: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The levels of those counts: they are tried upwards until one isn't there."""
        level, live = np.zeros(len(ngram), np.uint8), np.arange(len(ngram))
        bucket = bucket_of(token, len(self.start))
        start, mask = self.start[bucket], self.mask[bucket]
        for j in range(1, len(_MEANT)):
            at, step = first_and_step(ngram[live], j)
            for _ in range(PROBES):  # most n-grams that aren't there are out after one or two probes
                bit = start[live] + (at & mask[live])
                there = (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
                ok = np.flatnonzero(there)
                live, step = live[ok], step[ok]
                at = at[ok] + step
            if not len(live):
                break
            level[live] = j
        return level


def count_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket: builds its slice of the filter from the counts of its tokens and pairs over all chunks, looks up in it
    what each chunk sent, and sends back the levels found, with the exact counts of tokens. Each n-gram is looked up where
    it was counted, so no filter leaves its bucket. Rows that describe a chunk pass through."""
    every = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    out = [(r["chunk"], -1, r["ids"], r["flags"], r["sizes"], r["codes"], r["token"], None, None, None, None) for r in every if r["ids"] is not None]
    rows = [r for r in every if r["ids"] is None]
    if rows:
        token, token_n, own_tokens = add_up([np.frombuffer(r["token"], np.uint64) for r in rows], [r["token_n"] for r in rows])
        pair, pair_n, own_pairs = add_up([read_pairs(r) for r in rows], [r["pair_n"] for r in rows])
        known, often = token_n > 0, pair_n >= LEAST_PAIR
        bits = np.frombuffer(build_slice(np.concatenate([token[known], pair[often]]), np.concatenate([token_n[known], pair_n[often]])), np.uint8)
        model = Model(bits, np.zeros(1, np.uint64), np.array([8 * len(bits) - 1], np.uint64), int(token_n.sum()), int(known.sum()))
        # a common word at a false level would move all scores, so what the probes say of words is held against their counts
        single, both = np.minimum(model.levels(token, token), np.where(known, levels(np.maximum(token_n, 1)), 0)), model.levels(pair, pair)
        for r, t, p in zip(rows, own_tokens, own_pairs, strict=True):
            out.append((r["chunk"], r["bucket"], None, None, None, pack(token_n[t], 8), pack(single[t], 1), pack(both[p], 1), None, None, None))
        out.append((None, rows[0]["bucket"], *[None] * 6, model.tokens, model.types, len(bits)))
    words.give_back()
    return answer_table(out)


def score_chunk(table: pa.Table, buckets: int, n_tokens: int, n_types: int) -> pa.Table:
    """The texts of one chunk with their scores. P(w | v) = (c(v w) + PRIOR * P(w)) / (c(v) + PRIOR), where c(v) counts the
    pairs that v begins, so that probabilities add up to 1 but for the filter's rounding."""
    every = table.to_pylist()
    back = [r for _, r in sorted({r["bucket"]: r for r in every if r["bucket"] >= 0}.items())]  # the same chunk twice says the same twice
    out = []
    for own in (r for r in every if r["bucket"] < 0):
        distinct, rank = np.unique(np.frombuffer(own["token"], np.uint64), return_index=True)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        code, sizes = place[unpack(own["codes"])], unpack(own["sizes"])
        pair, at = pairs_in(distinct, code)

        def returned(ngram: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
            out = np.empty(len(ngram), values[0].dtype)
            out[_by_bucket(ngram, buckets)[0]] = np.concatenate(values)
            return out

        count = returned(distinct, [unpack(r["codes"], 8) for r in back])[code]
        single = _MEANT[returned(distinct, [unpack(r["token"], 1) for r in back])]
        context = single[np.concatenate([[np.searchsorted(distinct, _END)], code[:-1]])]
        both = np.minimum(_MEANT[returned(pair, [unpack(r["pair"], 1) for r in back])][at], context)
        alone = (single + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        text = np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(text, np.log10(count + 0.5), len(sizes)) - sizes * np.log10(n_tokens + 0.5 * (n_types + 1))
        score = np.bincount(text, np.log10((both + PRIOR * alone[code]) / (context + PRIOR)), len(sizes))
        flags = np.frombuffer(own["flags"], np.uint8)
        out.append(pa.table({"doc_id": pa.array(np.frombuffer(own["ids"], np.int64), mask=flags >= 2), "held_out": flags % 2 == 0, "n_tokens": sizes, "n_known": np.bincount(text, count > 0, len(sizes)).astype(np.int64), "train_tokens": np.full(len(sizes), n_tokens), "base_score": base, "score": score}))
    return pa.concat_tables(out)


ANSWERED = "chunk long, bucket int, ids binary, flags binary, sizes binary, codes binary, token binary, pair binary, tokens long, types long, filter_bytes long"


def look_up(docs: DataFrame, buckets: int, more: int = 1) -> DataFrame:
    """What the buckets send back to each chunk of docs (doc_id, tag, train, text), and a row of each bucket's totals.

    Chunks are dealt over so many buckets, and each bucket again over so many more parts, some chunks at a time; then
    counts and slices are a part's, and the answers go back by the way they came."""
    task, schema = gather_counts(buckets)
    sent = docs.mapInArrow(task, schema)
    count = lambda df: materialize(df.groupBy("bucket").applyInArrow(lambda _, t: count_bucket(t), ANSWERED), "counts")
    if more == 1:
        return count(sent)
    shares = sent.groupBy("bucket", F.pmod(F.xxhash64("chunk"), F.lit(more))).applyInArrow(lambda k, t: deal_again(t, more, k[1].as_py()), schema + ", share long")
    shares = materialize(shares, "shares")
    answered = count(shares.where("share IS NULL").drop("share"))
    waiting = shares.where("share IS NOT NULL").select("share", "chunk", "bucket", "token", "pair", *[F.lit(None).cast("binary").alias(c) for c in ("codes", "token_level", "pair_level")])
    none = F.lit(None).cast("binary")
    answers = answered.where("ids IS NULL AND chunk IS NOT NULL").select(F.lit(None).cast("long").alias("share"), "chunk", "bucket", none.alias("token"), none.alias("pair"), "codes", F.col("token").alias("token_level"), F.col("pair").alias("pair_level"))
    back = waiting.unionByName(answers).groupBy(F.coalesce("share", "chunk")).applyInArrow(lambda _, t: hand_back(t, more), ANSWERED)
    return answered.where("ids IS NOT NULL OR chunk IS NULL").unionByName(materialize(back, "back"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Every document with its scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the smoothed single-word log10 probability by exact training counts; score is the model's. A null or
    blank text is its end alone; texts of any length are read whole. A null doc_id trains. Repeated rows each count in
    training and get equal scores. Other columns are ignored. With no training text nothing is known, and the base
    score is 0. An empty table gives an empty one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id").cast("long"))).alias("train"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("tag"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    buckets, more = min(buckets, FANOUT), -(-buckets // FANOUT)
    out = look_up(rows, buckets, more)
    n_tokens, n_types = out.where("chunk IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types")]).first()
    chunks = out.where("chunk IS NOT NULL").drop("tokens", "types", "filter_bytes")
    return chunks.groupBy("chunk").applyInArrow(lambda _, t: score_chunk(t, buckets, n_tokens, n_types), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
