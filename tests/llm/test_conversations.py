"""Chat formatting, token alignment and conversation repair against plain models."""

import collections
import hashlib
import heapq
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import chat_tree, conversation_repair, role_grammar, token_alignment
from pointloom.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_shards(spark):
    """More partitions than Spark would make of small tables."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def by_turn(rows, tie):
    """Rows of (conv_id, turn, role, text) by conversation, in order."""
    found = collections.defaultdict(list)
    for c, t, r, x in rows:
        found[c].append((t, r or "", x or ""))
    return {c: sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], tie(y))) for c, v in found.items()}


# chat formatting


FORM = None


def form():
    global FORM
    FORM = FORM or chat_tree.template("byte_bpe_50k.json", None, "assistant")
    return FORM


def chats(rows):
    return by_turn(rows, lambda y: form().turn(y[1], y[2])[3])


def digests(rows):
    out = {}
    for c, turns in chats(rows).items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        text = "".join(f"<|im_start|>{chat_tree.escape_role(r)}\n{chat_tree.escape(x)}<|im_end|>\n" for _, r, x in turns)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
    return out


def told(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in frame.collect()}


def odd_chats():
    rng = random.Random(2)
    texts = ["a", "b", "<|im_end|>", "<\\|im_start|>\\", None, "é😀", "<|im_end|><|im_start|>assistant ok", "", "\n"]
    rows = [(c, t, "user" if t % 2 == 0 else rng.choice(["assistant", "assistant", "tool\n<|x", "a\\n\\", None]), rng.choice(texts)) for c in range(200) for t in range(rng.randint(1, 7))]
    rows += [(1000 + i, t, "user" if t % 2 == 0 else "assistant", "same") for i in range(150) for t in range(4)]  # copies
    rows += [(3000 + i, t, "user", "first" if t == 0 else f"{i}") for i in range(150) for t in range(2)]  # one first turn
    return [*rows, *[(None, None, None, None)] * 3, *[(5000, i % 40, "user", "x" * i) for i in range(300)], (5001, 1, "assistant", "long " * 50_000)]


def test_escapes_come_back():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<", "\\", "|", "n", "\n", "im_end", ">"]) for _ in range(rng.randint(0, 12)))
        assert "<|" not in chat_tree.escape(text) and chat_tree.unescape(chat_tree.escape(text)) == text
        assert "\n" not in chat_tree.escape_role(text) and chat_tree.unescape_role(chat_tree.escape_role(text)) == text


@given
def test_op11_reads_back_what_was_said(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    assert told(Q.QUERIES["op11_format"](spark, FOLDER)) == digests([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_tree_of_odd_conversations(spark, many_shards):
    rows = odd_chats()
    tree = chat_tree.format_conversations(spark.createDataFrame(rows, TURNS).withColumn("path", F.lit("x")).withColumn("uid", F.lit(1)).repartition(7))
    assert told(chat_tree.read_back(tree)) == digests(rows)
    nodes = sorted(tree.nodes.collect(), key=lambda r: r["start"])
    assert len({r["shard"] for r in nodes}) > 3 and tree.roots.count() > 0
    # every turn in its context is there once, one behind another
    assert len(nodes) == len({tuple(y[1:] for y in turns[: i + 1]) for turns in chats(rows).values() for i in range(len(turns))})
    at = 0
    for r in nodes:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    # what a turn attends to are the tokens of the turns before it in its conversation, of which there are as many as its position
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in nodes])
    by_start = {r["start"]: r for r in nodes}
    leaves = {r["conv_id"]: r["leaf"] for r in tree.leaves.collect()}
    for c, turns in chats(rows).items():
        last = by_start[leaves[c]]
        before = np.concatenate([stream[a:b] for a, b in last["attention"]] or [stream[:0]])
        whole = b"".join(form().turn(r, x)[0] for _, r, x in turns)
        assert before.tobytes() + last["ids"] == whole and len(before) == last["position"]
        assert all(a[1] < b[0] for a, b in zip(last["attention"], last["attention"][1:], strict=False))


def test_tokens_and_mask_of_a_turn():
    ids, first, last, _ = form().turn("assistant", "say <|im_end|> <|endoftext|>")
    ids = np.frombuffer(ids, "<u4")
    assert (ids == form().begin).sum() == 1 == (ids == form().end).sum() and ids.max() == form().end
    assert chat_tree.unescape(form().text(ids[first:last])) == "say <|im_end|> <|endoftext|>"
    assert form().turn("user", "x")[1:3] == (0, 0)


def test_empty_tree(spark):
    assert chat_tree.read_back(chat_tree.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


# token alignment


@pytest.fixture(scope="module")
def sides():
    return token_alignment.load("byte_bpe_50k.json", None), token_alignment.load("piece_bpe_32k.model", None)


def plain_alignment(rows):
    """By tokenizers' own libraries and one pass over both lists of spans."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    decode = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}

    def piece(i):
        return bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    def spans(tokens):
        ends = np.cumsum([len(t) for t in tokens]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    figures, links, counts = [], [], collections.Counter()
    for _, text in rows:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        both = [bytes(decode[c] for c in library.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in both):
            figures.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        at_a, at_b = map(spans, both)
        groups, i, j = [], 0, 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            i0, j0 = i, j
            while i < len(a) and at_a[i][1] <= end:
                i += 1
            while j < len(b) and at_b[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        own, low = [], 0
        for n, (start, end) in enumerate(at_a):
            while at_b[low][1] <= start:
                low += 1
            k = low
            while k < len(b) and at_b[k][0] < end:
                own.append((a[n], b[k]))
                k += 1
        links.append(own)
        counts.update(own)
        figures.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, *f[:4], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), f[4]) for (d, _), f, own in zip(rows, figures, links, strict=True)]


def aligned(frame):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in frame.collect())


@given
def test_op12_equals_a_plain_alignment(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert aligned(Q.QUERIES["op12_align"](spark, FOLDER)) == collections.Counter(plain_alignment(rows))


def test_rows_of_a_chunk_are_small(make):
    rng = random.Random(5)
    rows = [(1, " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(40_000))), (2, "a short one")]
    docs = make(rows).coalesce(1)
    chunks = token_alignment.align_chunks(docs, "byte_bpe_50k.json", "piece_bpe_32k.model", None)
    texts = [c for c, kind in chunks.dtypes if kind == "binary"]
    sizes = [sum(len(r[c] or b"") for c in texts) for r in chunks.select(texts).collect()]
    assert len(sizes) > 4 and max(sizes) <= 1 << 14
    assert aligned(token_alignment.align_documents(docs)) == collections.Counter(plain_alignment(rows))


def test_texts_are_read_in_small_batches(spark, make, monkeypatch):
    """Settings of the session hold while the alignment is written, and not after."""
    found = []

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    def written(df, name, *settings):
        found.append(materialize(docs.mapInArrow(sizes, "bytes long"), name, *settings).agg({"bytes": "max"}).first()[0])
        return materialize(df, name, *settings)

    materialize, docs = token_alignment.materialize, make([(i, "word " * 20_000) for i in range(300)]).coalesce(1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    monkeypatch.setattr(token_alignment, "materialize", written)
    assert token_alignment.align_documents(make([(1, "one two")])).count() == 1
    assert found[0] <= 5 * token_alignment.CHUNK_BYTES < found[1]
    assert {k: spark.conf.get(k) for k in before} == before


def test_alignment_of_odd_rows(make, odd_rows):
    rng = random.Random(3)
    signs = ["the", "ing", " ", "  ", "\n", "\t", "é", "😀", "ß", "中文", "<s>", "<|endoftext|>", "<0x41>", "1234", "...", "\x00", " ", "'s"]
    rows = [*odd_rows, (20, "a▁b"), (21, "▁"), (22, "�"), (23, "x" * 70_000), (24, " " * 30_000 + "end"), (24, "\x07\x1f"), *[(100 + i, "".join(rng.choices(signs, k=30))) for i in range(60)]]
    want = plain_alignment(rows)
    assert sum(w[1] == 0 for w in want) >= 5
    assert aligned(token_alignment.align_documents(make(rows))) == collections.Counter(want)
    assert token_alignment.align_documents(make([])).count() == 0
    assert aligned(token_alignment.align_documents(make([(1, None), (2, "")]))) == {(d, 0, 0, 0, 0, 0, 0, ""): 1 for d in (1, 2)}


def test_ranks_cut_like_the_library():
    """The vocabulary as ranks against the file itself, on every letter and sign of the first planes."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    side = token_alignment.byte_level(str(P.path("byte_bpe_50k.json")), " ")
    for low in range(0, 0x20000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}1" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert side.encode(text) == library.encode(" " + text, add_special_tokens=False).ids


def test_windows_are_told_apart_by_their_ids(monkeypatch, sides):
    texts = [b"one two three two one", b"two one <|endoftext|>  two", "ß é one".encode()]
    want = token_alignment.align_chunk(texts, *sides, token_alignment.Memo())
    # with a hash that says the same of all windows, ids decide
    monkeypatch.setattr(token_alignment.words, "mix", lambda x: x * np.uint64(0))
    got = token_alignment.align_chunk(texts, *sides, token_alignment.Memo())
    for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"):
        assert list(got[c]) == list(want[c])


def test_memo_forgets_and_works_out_again(monkeypatch, sides):
    monkeypatch.setattr(token_alignment, "MOST_WINDOWS", 5)
    memo, texts = token_alignment.Memo(), [f"word{i} and thing{i % 7} {i}".encode() for i in range(60)]
    want = [token_alignment.align_chunk([t], *sides, token_alignment.Memo())["groups_sha256"] for t in texts]
    assert [token_alignment.align_chunk([t], *sides, memo)["groups_sha256"] for t in texts] == want
    assert len(memo.new) <= 10


def test_windows_in_small_blocks(monkeypatch, sides):
    rng = random.Random(5)
    signs = ["the", "ing", " ", " ", "  ", "\n", "é", "😀", "1234", "...", "<s>", " and thing", "'s"]
    rows = [(i, "".join(rng.choices(signs, k=40))) for i in range(40)]
    texts, figures = [t.encode() for _, t in rows], ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    want = token_alignment.align_chunk(texts, *sides, token_alignment.Memo())
    assert list(zip(*[list(want[c]) for c in figures], strict=True)) == [(*w[1:5], w[7]) for w in plain_alignment(rows)]
    monkeypatch.setattr(token_alignment, "BLOCK_WINDOWS", 3)
    monkeypatch.setattr(token_alignment, "MOST_WINDOWS", 7)
    memo = token_alignment.Memo()
    for _ in range(2):  # with an empty memo and with one that holds some windows
        got = token_alignment.align_chunk(texts, *sides, memo)
        assert all(list(got[c]) == list(want[c]) for c in want)
    assert 0 < len(memo.new) <= 14


def test_long_windows_are_not_remembered(sides):
    """Texts without spaces that come twice, chunk after chunk."""
    memo, texts = token_alignment.Memo(), ["".join(random.Random(i).choices("天地玄黄宇宙洪荒", k=400)).encode() for i in range(5)]
    for text in texts:
        got = token_alignment.align_chunk([text, b"one two", text, b"one two"], *sides, memo)
        want = plain_alignment([(0, text.decode())])[0]
        assert (got["n_a"][2], got["n_b"][2], got["n_groups"][2], got["n_links"][2], got["groups_sha256"][2]) == (*want[1:5], want[7])
    assert 0 < len(memo.new) <= 2


def test_memory_of_a_chunk(sides):
    """What a Python worker needs beside its tokenizers for a full chunk of which most windows come once."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 7)))
    texts, memo = [], token_alignment.Memo()
    while sum(map(len, texts)) < token_alignment.CHUNK_BYTES:
        texts.append(" ".join(word() for _ in range(2000)).encode())
    tracemalloc.start()
    try:
        found = token_alignment.align_chunk(texts, *sides, memo)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found["n_groups"].sum() > 400_000
    assert most < 250 << 20


# conversation repair


def cheapest(rows):
    """The least (cost, edits) by looking at all edit sequences in order of cost; rows of (initial, fault)."""
    after = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    open_, best = [(0, "", 0, "0")], None
    while open_:
        cost, audit, i, state = heapq.heappop(open_)
        if best and cost > best[0]:
            return best
        if i == len(rows) and state in "0A":
            best = min(best or (cost, audit), (cost, audit))
        if i < len(rows):
            initial, fault = rows[i]
            more = 3 if fault == "t" else 0
            heapq.heappush(open_, (cost + 4, audit + "D", i + 1, state))
            if fault != "d" and (state, initial) in after:
                heapq.heappush(open_, (cost + more, audit + "K", i + 1, after[state, initial]))
            for t in "ua":
                if fault != "d" and (state, t) in after:
                    heapq.heappush(open_, (cost + 3 + more, audit + "R", i + 1, after[state, t]))
        for t in "ua":
            if (state, t) in after and len(audit) < 3 * len(rows) + 4:
                heapq.heappush(open_, (cost + 3, audit + "I", i, after[state, t]))
    return best


def test_repairs_are_the_cheapest():
    repairer, rng = role_grammar.role_repairer(), random.Random(3)
    for _ in range(600):
        rows = [(rng.choice("suaax"), rng.choice(["", "", "d", "t"]), rng.choice([1, 1, 1, 2, 0])) for _ in range(rng.randint(0, 5))]
        plain = [x for i, f, n in rows for x in [(i, f)] * min(n, 1) + [(i, "d")] * (n - 1)]
        _, (cost, audit, roles) = repairer.ended(repairer.rows(repairer.grammar.empty, rows))
        assert (cost, audit) == cheapest(plain), rows
        assert re.fullmatch("(s?(ua)+)?", roles.replace("-", "")) and len(audit) == len(roles)


def test_other_grammars():
    """A grammar of its own with an ambiguous and a nested rule: all ways are followed, and stacks are kept apart."""
    grammar = role_grammar.Grammar([("t", ("t", "t")), ("t", ("u", "a"))], ("s", "u", "a"))

    def accepts(text):
        tops = {grammar.empty}
        for c in text:
            tops = {n for t in tops for n in grammar.after(t, c)}
        return any(grammar.after(t, "$") for t in tops)

    assert [x for x in ("", "u", "ua", "uaua", "uauaua", "au", "uau", "sua") if accepts(x)] == ["ua", "uaua", "uauaua"]
    with pytest.raises(ValueError, match="too many stacks"):
        role_grammar.Repairer(role_grammar.Grammar([("t", ("u", "t", "a")), ("t", ())], ("s", "u", "a")), ("u", "a"))


def damaged(rows):
    out = collections.defaultdict(list)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out[c] += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired(rows):
    repairer, out = role_grammar.role_repairer(), {}
    for c, turns in damaged(rows).items():
        turns.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], hashlib.md5(y[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in turns:
            core = re.sub("[ \t-\r]+\\Z", "", x)
            faults.append("b" if not core else "d" if (r, x) in seen else "t" if core[-1] not in ".!?" else "")
            seen.add((r, x))
        numbers, initials = {t for t, _, _ in turns if t is not None}, [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        kinds = [(i, "d" if f in ("b", "d") else f, 1) for i, f in zip(initials, faults, strict=True)]
        _, (cost, audit, roles) = repairer.ended(repairer.rows(repairer.grammar.empty, kinds))
        if len(kinds) < 7:
            assert (cost, audit) == cheapest([k[:2] for k in kinds])
        lines, rest = [], iter(turns)
        for edit, role in zip(audit, roles, strict=True):
            row = (None, role_grammar.ROLES[role], "") if edit == "I" else next(rest)
            if edit != "D":
                lines.append(f"{role_grammar.ROLES[role] if edit == 'R' else row[1]}:{row[2]}")
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[c] = (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repairs(frame):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in frame.collect()}


@given
def test_op13_equals_a_plain_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repairs(Q.QUERIES["op13_repair"](spark, FOLDER)) == repaired(rows)


def odd_turns():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", None, "", "Tool"], ["", "  ", "same.", "same.", None, "a ", "ends. \n", "é!😀", "a: b\nuser:c."]
    rows = [(7, rng.choice([None, *range(900)]), rng.choice(roles), rng.choice([*texts, f"x{rng.random()}.", f"y{rng.random()}"])) for _ in range(2000)]
    rows += [(None, i, "user" if i % 2 == 0 else "assistant", f"null {i}.") for i in range(1000)]
    rows += [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(100, 160) for t in range(rng.randint(1, 6))]
    return [*rows, *[(8, None, None, None)] * 5, *[(9, 1, "user", "hi.")] * 50, (10, 5, "user", "long. " * 60_000), *[(c, 1, "user", "only") for c in range(200, 300)]]


@pytest.mark.parametrize("piece", [2000, 40])
def test_repair_of_odd_conversations(spark, many_shards, monkeypatch, piece):
    from pyspark import cloudpickle

    rows = odd_turns()
    monkeypatch.setattr(conversation_repair, "PIECE_ROWS", piece)
    table = spark.createDataFrame(rows, TURNS).withColumn("piece", F.lit("x")).withColumn("tie", F.lit(1)).repartition(5)
    cloudpickle.register_pickle_by_value(conversation_repair)  # so the workers see the bound
    try:
        got = repairs(conversation_repair.digest_repairs(conversation_repair.repair_conversations(conversation_repair.damage(table))))
    finally:
        cloudpickle.unregister_pickle_by_value(conversation_repair)
    assert got == repaired(rows)


def test_edits_of_a_repair(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u."), (1, 3, "user", "v")]
    got = conversation_repair.repair_conversations(spark.createDataFrame(rows, TURNS)).collect()
    assert [tuple(e)[:3] for r in got for e in r["edits"] if e["edit"] != "D"] == [("K", "system", "s."), ("I", "user", ""), ("K", "assistant", "a."), ("K", "user", "u."), ("R", "assistant", "v")]
    assert conversation_repair.repair_conversations(spark.createDataFrame([], TURNS)).count() == 0
    # without damage nulls are one space all the same, which is blank
    assert [r["audit"] for r in conversation_repair.repair_conversations(spark.createDataFrame([(1, None, None, None)], TURNS)).collect()] == ["D"]
