"""Operator 2: secret scans through a trigram inverted index."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, key_filter, materialize, row_key


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that means the same to Java and Python, and the length its group must reach. may is a
    regex that every text with a long enough match holds, which spares a rule without trigrams the others."""

    kind: str
    regex: str
    group: int
    least: int
    base: bool = False
    may: str | None = None


# The kinds, in the order in which spans at the same place are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True, r"[0-9a-f]{32}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)

#: More alternatives than this and a rule is scanned in full.
MOST_ALTERNATIVES = 200
#: Hits of a text that are placed in one fold.
PART = 128
#: A character class of up to this many characters is spelled out.
MOST_SPELLED = 8


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The lower-case trigrams that a text must hold to match: alternatives of sets, or None if a match needs none."""

    def cut(states):  # the literal that was being read ends here
        return {(have | {tail[i : i + 3] for i in range(len(tail) - 2)}, "") for have, tail in states}

    def read(states, nodes):
        for op, arg in nodes:
            if op is sre.LITERAL:
                states = {(have, tail + chr(arg).lower()) for have, tail in states}
            elif op is sre.IN and len(arg) <= MOST_SPELLED and all(kind is sre.LITERAL for kind, _ in arg):
                states = {(have, tail + chr(c).lower()) for have, tail in states for _, c in arg}
            elif op is sre.BRANCH:
                states = set().union(*(read(states, branch) for branch in arg[1]))
            elif op is sre.SUBPATTERN:
                states = read(states, arg[3])
            elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
                states = states | read(states, arg[2])
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                states = cut(read(states, arg[2]))
            elif op is not sre.AT:
                states = cut(states)
            if len(states) > MOST_ALTERNATIVES:
                return {(frozenset(), "")}
        return states

    sets = {frozenset(have) for have, _ in cut(read({(frozenset(), "")}, sre_parser.parse(regex)))}
    least = [s for s in sets if not any(o < s for o in sets)]
    return None if frozenset() in least else sorted(least, key=sorted)


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id, text_key) of the given trigrams in the lower-cased texts, written as a table.

    One read of the texts; a posting carries no text. Only trigrams that some rule asks for are posted."""
    low = docs.select(*row_key(), F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return materialize(low.select(*KEY, F.explode(found).alias("trigram")), "postings")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """Intersect postings: (doc_id, text_key, rule) of the documents that rule may match.

    Postings meet by document, each adding its bit to a mask for each alternative, so nothing is collected and equal
    postings do no harm."""
    term = lambda **fields: F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])
    long = lambda v: F.lit(v).cast("long")
    terms = [term(rule=rule, alternative=alternative, trigram=t, bit=long(1 << bit), whole=long((1 << len(have)) - 1)) for rule, sets in queries.items() for alternative, have in enumerate(sets) for bit, t in enumerate(sorted(have))]
    table = index.sparkSession.range(1).select(F.inline(F.array(*terms)))
    met = index.join(F.broadcast(table), "trigram").groupBy(*KEY, "rule", "alternative", "whole").agg(F.bit_or("bit").alias("bits"))
    return materialize(met.where("bits = whole").select(*KEY, "rule").distinct(), "candidates")


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The rule's leftmost non-overlapping matches that are long enough: array of (start, kind, end) in code points."""
    hits = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("before"),  # has one entry more than there are matches
        *[F.regexp_extract_all(text, F.lit(rule.regex), F.lit(g)).alias(f"group{g}") for g in sorted({0, rule.group})],
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def add(done: Column, hit: Column) -> Column:
        start = done["at"] + F.length(hit["before"])
        end = start + F.coalesce(F.length(hit["group0"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(hit[f"group{rule.group}"]) >= rule.least, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    moved = lambda part, by: F.transform(part, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    # a fold copies what it has gathered at every step, so parts of PART hits are folded and then put one behind another
    def folded(hits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(PART)), lambda k: F.aggregate(F.slice(hits, k + 1, PART), F.struct(F.lit(0).alias("at"), none.alias("spans")), add))

    def joined(parts: Column) -> Column:
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda ends, p: F.concat(ends, F.array(F.element_at(ends, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(ends, 1, F.size(parts)), lambda p, by: moved(p["spans"], by)))

    return _bound(_bound(hits, folded), joined)


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once, as the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Each document with its secrets: doc_id, spans (array of start, kind's number, end), in code points.

    Rules with mandatory trigrams look only at the documents that the index offers; the others scan every text. What
    it offers comes as a key filter of bounded size, so no text moves: where the filter errs a rule looks in vain.
    Null and empty texts have no spans, nor has an empty table rows. A null doc_id is kept. Repeated rows each come
    back. Texts of any length are scanned whole. Other columns are ignored."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    rows = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("__text"))
    if queries:
        index = build_index(docs, sorted({t for q in queries.values() for s in q for t in s}))
        named = lambda rule: F.xxhash64(*KEY, rule)
        offered = key_filter(candidates(index, queries), F.xxhash64(*KEY), named(F.col("rule")))
        rows = offered.probe(rows, F.xxhash64(*KEY), {f"__may{i}": named(F.lit(i)) for i in queries})
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, rule in enumerate(rules):
        may = F.col(f"__may{i}") if i in queries else F.rlike("__text", F.lit(rule.may)) if rule.may else F.lit(True)
        found.append(F.when(may, spans_of(F.col("__text"), rule, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def listed(spans: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """One row per document with the base kinds' counts and digest, and all spans as text."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [i for i, r in enumerate(RULES) if r.base]
    of_kind = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{RULES[i].kind}") for i in base]
    first = F.filter("spans", lambda s: s["kind"] <= max(base))
    return found.select("doc_id", *counts, F.sha2(listed(first, RULES), 256).alias("base_sha256"), listed(F.col("spans"), RULES).alias("spans"))


def _oracle() -> str:
    """The rules by RE2 in DuckDB, on every text. RE2 folds case beyond ASCII, so the words are spelled as classes."""

    def spelled(regex: str) -> str:
        head, words, tail = re_split(regex)
        return head + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words) + tail

    parts = []
    for i, r in enumerate(RULES):
        regex = spelled(r.regex).replace("'", "''")
        parts.append(f"""SELECT id, {i} AS k, '{r.kind}' AS kind,
      list_transform(list_filter(range(1, len(hit) + 1), lambda i: length(val[i]) >= {r.least}), lambda i: {{'s': list_sum(list_transform(pre[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0), 'n': length(hit[i]), 'v': length(val[i])}}) AS m, {r.least} AS least
    FROM (SELECT id, regexp_extract_all(text, '{regex}', 0) AS hit, regexp_extract_all(text, '{regex}', {r.group}) AS val, string_split_regex(text, '{regex}') AS pre FROM d WHERE regexp_matches(text, '{regex}')) WHERE len(hit) > 0""")
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
  found AS ({" UNION ALL ".join(parts)}),
  spans AS (SELECT id, k, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e FROM (SELECT id, k, kind, least, unnest(m) AS x FROM found) WHERE x.v >= least),
  per AS (SELECT id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (id)"""


def re_split(regex: str) -> tuple[str, str, str]:
    """A regex around its (?i:...) part."""
    if "(?i:" not in regex:
        return regex, "", ""
    head, _, rest = regex.partition("(?i:")
    words, _, tail = rest.partition(")")
    return head + "(?:", words, ")" + tail


ORACLE = _oracle()
