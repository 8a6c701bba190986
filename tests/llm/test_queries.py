"""Registered queries over the smallest given tables: against SQL where there is some, else against plain models."""

import os
import zlib

import numpy as np
import pytest

from pointloom.llm import queries as Q

from . import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, compare, name):
    compare(spark, Q.QUERIES[name], Q.ORACLES[name])


def test_op6_equals_all_pairs(spark, rows):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in Q.QUERIES["op6_ngram_join"](spark, FOLDER).collect()}
    assert got == brute.near_classes(rows)


def test_op8_base_and_model(spark, rows):
    want, n = brute.unit_scores(rows)
    got = Q.QUERIES["op8_lm_score"](spark, FOLDER).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"]) == want[r["doc_id"]][:2]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2], rel=1e-12)
    held = [r for r in got if r["held_out"]]
    # held out, the model is no worse than single words
    assert sum(r["score"] for r in held) > 1.02 * sum(r["base_score"] for r in held)


def test_op9_restores_and_links(spark, rows):
    from pyspark.sql import functions as F

    from pointloom.llm import pii

    got = Q.QUERIES["op9_pii"](spark, FOLDER)
    assert pii.pseudonymize(got, pii.EXAMPLE_KEY, back=True, example=True).select("doc_id", "text").exceptAll(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    found = got.agg(*[F.sum(f"n_{k}").alias(k) for k in pii.KINDS]).first()
    assert found["email"] > 0 and found["card"] > 0 and found["ip"] > 0 and found["phone"] > 0


def test_op9_finds_what_every_window_says(spark, rows):
    """Cards by all windows of digits; addresses and e-mails by all runs of their signs, tried whole."""
    import ipaddress
    import re

    from .test_odd_rows import plain_cards

    got = {r["doc_id"]: r for r in Q.QUERIES["op9_pii"](spark, FOLDER).collect()}

    def address(x):
        try:
            return bool(ipaddress.IPv4Address(x))
        except ValueError:
            return False

    for d, text in rows:
        text = text or ""
        mails = [x for x in re.findall(r"[\w.%+-]+@[\w.-]+", text) if "." in x.partition("@")[2].strip(".-")]
        assert got[d]["n_email"] == len(mails)
        assert got[d]["n_ip"] == sum(address(x.rstrip(".")) for x in re.findall(r"(?<![\w.])[0-9.]+(?![\w])", text))
        if len(mails) == 0 and re.search("[0-9]", text):
            assert got[d]["n_card"] == sum(len(plain_cards(x)) for x in re.findall(r"[0-9](?:[0-9 -]*[0-9])?", text) if len(re.sub("[^0-9]", "", x)) >= 13)


def test_op10_ids_and_bins(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want[d, k] = (a, len(part), zlib.crc32(part.tobytes()))
    got = Q.QUERIES["op10_pack"](spark, FOLDER).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 4096
    n, rooms = brute.best_fit(got.length.tolist(), 4096)
    assert got.sequence_id.nunique() == n and sorted(4096 - got.groupby("sequence_id").length.sum()) == rooms


def test_op5_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from pointloom.llm import quality

    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else FOLDER
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge(docs, labels.where("doc_id % 4 != 0"), F.col("source"), F.col("lang"))
    held = judged.join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((held.p_bad >= 0.5) == (held.quality == 0)).mean() > 0.97
    assert held[(held.quality == 1) & (held.toxic == 0)].kept.mean() > 0.99
    assert (~held[held.toxic == 1].kept).mean() > 0.8
    assert Q.QUERIES["op5_quality"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline_stages(spark, rows):
    """Each stage against a plain model on what the stage before kept."""
    import corpus_pipeline as P
    from pointloom.llm import quality
    from pointloom.llm.common import materialize
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(materialize(stage(spark, steps[-1], FOLDER), "stage"))
    assert all(s.schema == docs.schema for s in steps[:-1])
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:-1]]
    kept = {r["doc_id"] for r in quality.judge(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), F.col("source"), F.col("lang")).where("kept").collect()}
    assert set(texts[1]) == kept and len(kept) < len(texts[0])
    groups, plain = brute.exact_groups(list(texts[1].items()))
    assert set(texts[2]) == {d for d, _ in groups.values()}
    classes = brute.near_classes(list(texts[2].items()))
    assert set(texts[3]) == {c for c, _ in classes.values()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.contained(list(texts[3].items()), items)}
    assert set(texts[4]) == set(texts[3]) - bad
    packed = steps[-1].toPandas()
    assert set(packed.doc_id) == set(texts[4])
    assert packed.sequence_id.nunique() == brute.best_fit(packed.length.tolist(), 4096)[0]
    assert P.run(spark, FOLDER).count() == len(packed)
