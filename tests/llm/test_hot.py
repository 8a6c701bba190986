"""Keys that a third of the rows have, settings of Spark that must not show, very long names, and rules of any kind."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import common, lm_scoring, ngram_join, packing, pii, secret_scan, sharding, substring_dedup
from pointloom.llm.common import materialize

from . import brute

KEY = b"a key of one's own"


@pytest.fixture
def plain_plans(spark):
    """Without Spark's own remedies for skew."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def partition_sizes(frame):
    return [r["n"] for r in frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_slots_of_hot_keys(plain_plans):
    """Half of the rows have no id, and half of those are alike in every column."""
    spark = plain_plans
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    ids = F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id"))
    rows = spark.range(40_000).select((F.col("id") % 3).cast("int").alias("shard"), ids.alias("doc_id"), F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id")).alias("size"))
    rows = materialize(rows.repartition(8), "rows")
    got = sharding.number_slots(rows, "shard", F.col("doc_id"), ["doc_id", "size"])
    found = got.toPandas()
    for _, g in found.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert collections.Counter(zip(found["doc_id"].fillna(-1), found["size"], strict=True)) == collections.Counter((-1 if i % 2 == 0 else i, 7 if i % 4 == 0 else i) for i in range(40_000))
    sizes = partition_sizes(got)
    assert max(sizes) <= 3 * np.median(sizes)
    again = sharding.number_slots(rows.repartition(5), "shard", F.col("doc_id"), ["doc_id", "size"]).toPandas()
    columns = ["shard", "doc_id", "size", "slot"]
    assert found[columns].sort_values(["shard", "slot"]).fillna(-1).values.tolist() == again[columns].sort_values(["shard", "slot"]).fillna(-1).values.tolist()


def test_pieces_without_ids_are_packed(make):
    rows = [(None, "same words here") for _ in range(300)] + [(i, "other " * (i % 9)) for i in range(200)]
    got = packing.pack_documents(make(rows), 64).toPandas()
    assert len(got) == 500
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 64
    assert got.sequence_id.nunique() == brute.best_fit(got.length.tolist(), 64)[0]


def test_few_keys_of_a_large_table(plain_plans, monkeypatch):
    spark = plain_plans
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(common, "HOT_GROUPS", 100)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("hash"), "id")
    table = materialize(spark.range(400).select((F.col("id") * 5).alias("hash"), F.col("id").alias("item")), "table")
    got = common.join_few(rows, table, "hash")
    want = {(5 if i % 3 == 0 else i, i, (5 if i % 3 == 0 else i) // 5) for i in range(30_000) if (5 if i % 3 == 0 else i) in range(0, 2000, 5)}
    assert {tuple(r) for r in got.select("hash", "id", "item").collect()} == want and got.count() == len(want)
    # items that share a hot shingle are too many to broadcast
    table = materialize(spark.range(60).select(F.lit(5).cast("long").alias("hash"), F.col("id").alias("item")), "table")
    assert common.join_few(rows.limit(300), table, "hash").count() == rows.limit(300).where("hash = 5").count() * 60


def test_bands_that_a_third_of_the_texts_share(make, monkeypatch):
    """Texts that share most of their words but aren't near copies, beside near copies, against all pairs; groups so small
    that every way of dealing is taken."""
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(60)]
    rows = [(d, " ".join([*shared, *(f"o{rng.integers(10**6)}" for _ in range(rng.integers(10, 30)))])) for d in range(60)]
    rows += [(100 + d, " ".join(f"c{i}" if i != d else "x" for i in range(80))) for d in range(20)]
    rows += [(200 + d, " ".join(f"w{rng.integers(10**6)}" for _ in range(40))) for d in range(40)]
    want = brute.near_classes(rows)
    assert 0 < sum(n > 0 for _, n in want.values()) < len(rows)
    for settings in ({}, {"BLOCK": 8, "UNIT": 300}, {"BLOCK": 8, "BROADCAST_ROWS": 0}, {"SHARED_BYTES": 2000}):
        with monkeypatch.context() as m:
            for k, v in settings.items():
                m.setattr(ngram_join, k, v)
            m.setattr(common, "HOT_GROUPS", 10)
            assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_classes(make(rows)).collect()} == want


def test_long_texts_are_dealt_over_more_blocks(spark):
    rows = materialize(spark.range(200).select(F.lit(1).cast("long").alias("component"), F.col("id").alias("node"), F.lit(4 << 20).alias("size")), "rows")
    dealt = ngram_join.deal(rows, "component", "node", F.col("size"))
    most = dealt.groupBy("group").agg(F.sum("size").alias("bytes")).agg(F.max("bytes")).first()[0]
    assert most < 320 << 20 and dealt.select("group").distinct().count() > 30
    # any two rows meet
    pairs = dealt.alias("a").join(dealt.alias("b"), F.expr("a.group = b.group AND a.node < b.node")).select("a.node", F.col("b.node").alias("other")).distinct()
    assert pairs.count() == 200 * 199 // 2


def test_repeats_of_rows_that_share_an_id(make, plain_plans, monkeypatch):
    """A third of the rows have no id; by broadcast and by a shuffle join the same goes."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None if d % 3 == 0 else d, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(15)), *([passage] if d % 4 == 0 else []), "end"])) for d in range(300)]
    found = []
    for most in (32 << 20, -1):
        monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", most)
        found.append(collections.Counter(tuple(r) for r in substring_dedup.digest_cuts(substring_dedup.remove_repeats(make(rows)), 20).collect()))
    assert found[0] == found[1] and sum(found[0].values()) == 300 and sum(n * r[2] for r, n in found[0].items()) > 0


def test_scores_do_not_depend_on_partitions(spark, make):
    rng = np.random.default_rng(8)
    rows = [(d, " ".join(f"w{min(int(rng.pareto(1) * 5), 4000)}" for _ in range(80))) for d in range(200)]
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 4, 23):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        found.append({r["doc_id"]: r["score"] for r in lm_scoring.score_documents(make(rows, n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert all(other[d] == pytest.approx(score, rel=1e-12) for other in found[1:] for d, score in found[0].items())


@pytest.mark.parametrize("n", [1, 99, 100, 101, 217, 218, 5000, 1_000_000])
def test_names_of_any_length(n):
    for letters in ("ab1Zé", "q", "и", "ŻxĸÉß", "aİıſ中"):
        text = f"to {(letters * n)[:n]}@Example.com, now"
        new, count = pii.pseudonymize_text(text, KEY)
        assert count["email"] == 1 and (new != text or n < 4) and len(new) == len(text)
        assert pii.pseudonymize_text(new, KEY, back=True)[0] == text


def test_long_names_stay_in_their_alphabets():
    name = ("ab-12.CD_é" * 30)[:291]
    new = pii.pseudonym("email", f"{name}@x.org", KEY)
    assert [c.isdigit() for c in new] == [c.isdigit() for c in f"{name}@x.org"] and [c.isupper() for c in new[:291]] == [c.isupper() for c in name]
    assert pii.pseudonym("email", f"{name.upper()}@x.org", KEY).lower() == new.lower()


def test_a_name_without_letters_is_no_find():
    assert pii.pseudonymize_text("._%@example.com", KEY) == ("._%@example.com", dict.fromkeys(pii.KINDS, 0))


@pytest.mark.parametrize(
    ("text", "kind"),
    [("(555) 223 4567", "phone"), ("call 555 223 4567.", "phone"), ("2024/3/5", "date"), ("2024-3-05", "date"), ("3-4-2024", "date"), ("13-4-2024", "date"), ("иван@example.com", "email"), ("Иван.Ż@example.com", "email"), ("03/04/24", "date"), ("12 Mar 2024", "date"), ("March 12, 2024", "date"), ("5 May 1999", "date"), ("2001:db8::1", "ip"), ("FE80::1FF:FE23:4567:890A", "ip")],
)
def test_more_ways_of_writing(text, kind):
    new, count = pii.pseudonymize_text(text, KEY)
    assert count[kind] == 1 == sum(count.values()) and new != text
    assert [c.isdigit() for c in new] == [c.isdigit() for c in text]
    assert pii.pseudonymize_text(new, KEY, back=True)[0] == text


@pytest.mark.parametrize("text", ["100 200 3000", "2024-13-45", "1-2-3", "555 123 4567", "10/20", "12:30:45", "a::b", "std::vector", "31 Feb 2020", "00:1a:2b:3c:4d:5e", "13/13/24", "2024-01-02T10:11:12"])
def test_other_numbers_stay(text):
    assert pii.pseudonymize_text(text, KEY) == (text, dict.fromkeys(pii.KINDS, 0))


def test_dates_are_linked_however_they_are_written():
    day = lambda text: [int(x) for x in re.findall("[0-9]+", pii.pseudonymize_text(text, KEY)[0])]
    assert day("2024-03-15") == day("2024/3/15") == day("15-3-2024")[::-1] == day("15.03.2024")[::-1]
    assert pii.pseudonymize_text("15 Mar 2024", KEY)[0].split()[::2] == pii.pseudonymize_text("Mar 15, 2024", KEY)[0].replace(",", "").split()[1:]


def test_any_mixture_comes_back():
    rng = random.Random(1)
    parts = ["12 Mar 2024", "Mar 3, 1999", "03/04/24", "2001:db8::1", "10.0.0.1", "4111 1111 1111 1111", "555-123-4567", "a", "7", ":", "/", ".", "-", " ", "12", "May", "1999-01-02", "DE89370400440532013000", "June 7, 2010", "и@x.com"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", ", "]) for _ in range(8))
        assert pii.pseudonymize_text(pii.pseudonymize_text(text, KEY)[0], KEY, back=True)[0] == text


def random_rule(rng, number):
    """A rule from pieces that Java and Python read alike, with or without trigrams."""
    atoms = ["[a-z]", "[0-9]", "abc", "key", "x", "[ab]", "(?:foo|bar)", "q?", "[0-9]+", "[a-z]+", "=", " "]
    body = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 4)))
    group = rng.random() < 0.5
    tail = rng.choice(["[0-9]+", "[a-z0-9]+", "[a-f]{2}", "z"])
    return secret_scan.Rule(f"r{number}", body + (f"({tail})" if group else tail), int(group), rng.randint(1, 6))


def test_random_rules_against_brute_force(make):
    rng = random.Random(12)
    rules = [secret_scan.Rule("pin", r"[a-z][0-9]+", 0, 5), secret_scan.Rule("grp", r"[a-z]([0-9]+)[ ]", 1, 4)]
    while len(rules) < 22:
        rule = random_rule(rng, len(rules))
        if not re.match(rule.regex, ""):
            rules.append(rule)
    assert {bool(secret_scan.trigram_query(r.regex)) for r in rules} == {True, False}
    rows = [(1, "a1234"), (2, "a1234 b12345 zz c99")]
    rows += [(d, "".join(rng.choice(["a", "b", "abc", "key", "foo", "bar", "12", "7", "=", " ", "x", "q", "é", "z"]) for _ in range(60))) for d in range(3, 80)]
    want = {d: sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.regex, t) if len(m[r.group]) >= r.least) for d, t in rows}
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan_secrets(make(rows), rules).collect()}
    assert got == want and len(want[1]) == 1 and len(want[2]) == 4
