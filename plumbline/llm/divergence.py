"""How far each source's word shares lie from the other sources' and from their language's.

Terms are runs of letters (A-Z in lower case, all beyond ASCII as they are). A language keeps
the terms of at least ``LEAST`` of its documents, V of them. A group, a (lang, source) or a whole
language, gives a kept term that it holds ``count`` times the share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``, N being its counts' sum, and two groups differ in
a term by ``f(p, q) = floor((p - q)**2 / q)``.

Baseline and corrections: nearly all counts are zero, so each pair of sources starts at
V * f(p0, q0), the shares of a zero count. What a term adds to that is

* for a count c on one side f(p(c), q0) - f(p0, q0), or f(p0, q(c)) - f(p0, q0): this depends on c
  alone, so a source's terms are first tallied by count, and each tally meets the other sources;
* for counts on both sides f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), from the term's postings.

So a term that a source lacks costs nothing. The terms of a source are ranked in a window, which
Spark limits to ``MOST`` in each task before the shuffle.

Hot keys: a task tallies its texts before anything is shuffled; a posting list has one row a source
at most, so its pairs are bounded by the pairs of sources, which are rows of the result. Sources
are joined by (lang, source) with small tables whose size Spark knows, or splits if they are large.

All numbers are exact integers: shares are divided as decimals, and no sum passes 64 bits below
10**9 kept terms (beyond, Spark raises an error).

Cases: a null text, lang or source is an empty one; a document is a row, so repeated rows count
each; doc_id isn't read; a source without terms has N = 0 and is compared like any other; a
language without kept terms has pairs of value 0 and no terms; ties go by the item's UTF-8 bytes;
an empty table gives no rows; texts of any length are taken whole; further columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, stored

#: Documents of a language that a kept term occurs in at least; terms ranked for a group.
LEAST, MOST = 3, 200
#: A share of one.
WHOLE = 1_000_000_000
#: Bytes that part terms, all ASCII but letters, as spaces; A-Z as a-z.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()
_SCHEMA = "lang string, source string, term string, n long, docs long"


def words(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split()


def _tallied(batch: pa.RecordBatch) -> dict:
    """How often and in how many of a batch's documents each (lang, source) has each term."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
        found = words(text)
        n[lang, source].update(found)
        docs[lang, source].update(set(found))
    flat = [(*group, term, k, docs[group][term]) for group, tally in n.items() for term, k in tally.items()]
    lang, source, term, k, d = zip(*flat) if flat else [()] * 5
    return {"lang": list(lang), "source": list(source), "term": pa.array(term, pa.binary()).cast(pa.string()), "n": list(k), "docs": list(d)}


def _share(count: str, total: str, v: str) -> Column:
    return F.expr(f"1 + cast({count} + 1 as decimal(20,0)) * {WHOLE} div cast({total} + {v} as decimal(20,0))")


def _differ(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value, rank: other sources of the language (part ``pair``) by how
    far the source's shares are from theirs, and kept terms (part ``term``, ``most`` of them) that
    the source has above its language, by how far."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text)
    counted = arrow_map(rows, _tallied, _SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("at"))
    postings = stored(by_term.where(F.col("docs") >= least).select("lang", "term", "total", "at"), "postings")
    entries = postings.select("lang", "term", "total", F.inline("at"))

    langs = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    held = entries.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    groups = rows.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["held", "v", "all_n"])
    zero = F.when(F.col("v") > 0, F.expr("1 + 1000000000 div (held + v)"))
    groups = stored(groups.withColumn("zero", zero), "sources")

    shares = entries.join(groups, ["lang", "source"]).withColumn("p", _share("n", "held", "v"))
    shares = stored(shares.withColumn("q", _share("total", "all_n", "v")).select("lang", "term", "source", "p", "q", "zero"), "shares")

    one = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("a0"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b0"))
    base = one.join(other, "lang").where("a <> b").select("lang", "a", "b", F.coalesce(F.col("v") * _differ("a0", "b0"), F.lit(0)).alias("value"))
    tally = shares.groupBy("lang", F.col("source").alias("a"), F.col("zero").alias("a0"), "p").agg(F.count(F.lit(1)).alias("k"))
    met = tally.join(other, "lang").where("a <> b")
    left = met.select("lang", "a", "b", (F.col("k") * (_differ("p", "b0") - _differ("a0", "b0"))).alias("value"))
    right = met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("k") * (_differ("b0", "p") - _differ("b0", "a0"))).alias("value"))
    x = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("a0"))
    y = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("b0"))
    both = x.join(y, ["lang", "term"]).where("a <> b")
    both = both.select("lang", "a", "b", (_differ("pa", "pb") - _differ("pa", "b0") - _differ("a0", "pb") + _differ("a0", "b0")).alias("value"))
    pairs = base.union(left).union(right).union(both).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))

    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _differ("p", "q").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return pairs.select(columns).union(terms.select(columns))
