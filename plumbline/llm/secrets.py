"""Secret scans with a trigram inverted index, in DataFrame expressions alone.

Each rule's pattern is parsed on the driver into a Boolean query over trigrams. The index
has one posting (trigram, document) for each trigram of the queries that a document holds;
postings are intersected and united by document as the queries say, and only candidates are
matched. A rule whose pattern has no mandatory trigram scans every document.

Cases: a null text is an empty text without spans; rows with equal doc_id share postings and
are each matched on their own text; a null doc_id is an id like any other; an empty table
gives an empty table; whole texts are matched, of any length; ties between kinds at one start
are ordered as the rules are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import aside, doc_texts

SPANS = "array<struct<start:int,kind:int,end:int>>"
# re._parser is the parser behind the standard library's re module.
_parse = re._parser.parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` (Java and RE2 read it alike), and the least length of a group.

    Matches are leftmost and don't overlap; one whose ``group`` has under ``least`` characters
    is dropped after it has matched. ``fold``: ASCII letters match in either case. ``long``: a
    pattern whose matches are those of ``pattern`` that aren't dropped, if there is a cheaper one.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    long: str | None = None

    @property
    def regex(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


#: The kinds that the contract names, in its order.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, long=r"[0-9a-f]{24,}"),
]
#: Published formats of further credentials.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]
RULES = BASE + MORE

#: Sets of literal strings larger than this, or longer strings, stop being followed.
FOLLOW = 64

#: Trigrams that a conjunction asks for: its rarest, by the place of their letters in this order.
ASKED, COMMON = 4, "etaoinshrdlcumwfgypbvkjxqz"

# A query is True (anything), a trigram, ("and", ...) or ("or", ...).
ANY = True


def both(*parts):
    """All of the queries."""
    parts = {p for q in parts for p in (q[1:] if isinstance(q, tuple) and q[0] == "and" else [q]) if p is not ANY}
    return ANY if not parts else next(iter(parts)) if len(parts) == 1 else ("and", *sorted(parts, key=repr))


def either(parts):
    """One of the queries at least."""
    parts = {p for q in parts for p in (q[1:] if isinstance(q, tuple) and q[0] == "or" else [q])}
    asks = {p: set(p[1:]) if isinstance(p, tuple) else {p} for p in parts if p is not ANY}
    parts -= {p for p, x in asks.items() if any(y < x for y in asks.values())}  # asked for by another already
    return ANY if ANY in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", *sorted(parts, key=repr))


def trigrams(text: str):
    return both(*(text[i : i + 3] for i in range(len(text) - 2)))


def rarest(query):
    """The query with ``ASKED`` trigrams to a conjunction at most; all its matches fulfil it still."""
    if query is ANY or isinstance(query, str):
        return query
    if query[0] == "or":
        return either(map(rarest, query[1:]))
    weight = lambda t: -sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in t)
    plain = sorted((p for p in query[1:] if isinstance(p, str)), key=lambda t: (weight(t), t))[:ASKED]
    return both(*plain, *(rarest(p) for p in query[1:] if not isinstance(p, str)))


def _node(op, value) -> tuple[set[str] | None, object]:
    """(all strings that the node matches, or None if unbounded; a query that its matches fulfil)."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, ANY
    if name == "IN":
        chars = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                chars.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < FOLLOW:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "BRANCH":
        options = [_sequence(x) for x in value[1]]
        exact = set().union(*(e for e, _ in options)) if all(e is not None for e, _ in options) else None
        return (exact, ANY) if exact is not None and len(exact) <= FOLLOW else (None, either([q if e is None else either(map(trigrams, e)) for e, q in options]))
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        exact, query = _sequence(inner)
        if exact is not None and high == 1:
            return exact | {""} if low == 0 else exact, query
        return None, ANY if low == 0 else query if exact is None else either(map(trigrams, exact))
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, object]:
    """As ``_node`` for a sequence: literal runs are multiplied out, and cut where a part is unbounded."""
    query, run, whole = ANY, {""}, True
    for op, value in items:
        exact, more = _node(op, value)
        if exact is not None and len(run) * len(exact) <= FOLLOW:
            run = {a + b for a, b in product(run, exact)}
            query = both(query, more)
            continue
        query, whole = both(query, either(map(trigrams, run)), more), False
        run = exact if exact is not None else {""}
    return (run, query) if whole else (None, both(query, either(map(trigrams, run))))


def trigram_query(pattern: str):
    """The Boolean trigram query, in lower case, that each match of ``pattern`` fulfils."""
    exact, query = _sequence(_parse(pattern))
    return rarest(query if exact is None else both(query, either(map(trigrams, exact))))


def _terms(query) -> set[str]:
    return set() if query is ANY else {query} if isinstance(query, str) else set().union(*map(_terms, query[1:]))


def any_of(terms: list[str]) -> str:
    """A pattern that captures one of ``terms`` (three characters each) where one starts, and consumes nothing."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in terms:
        tree.setdefault(a, {}).setdefault(b, []).append(c)

    def one(chars) -> str:
        return "[" + "".join(f"\\{c}" if c in "-[]^&\\" else c for c in sorted(chars)) + "]"

    # the letters that texts have most of come first
    order = sorted(tree, key=lambda c: COMMON.find(c) if c in COMMON else len(COMMON))
    branches = "|".join(one(a) + "(?:" + "|".join(one(b) + one(c) for b, c in tree[a].items()) + ")" for a in order)
    return f"(?={one(tree)})(?=({branches}))"


def postings(texts: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id) for each of ``terms``, by number, in lower-cased texts.

    One pass over a text finds all trigrams that it holds.
    """
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(terms)), F.lit(1)))
    number = F.array_position(F.array(*map(F.lit, terms)), F.col("term")) - 1
    return texts.select("doc_id", F.explode(held).alias("term")).select("doc_id", number.cast("int").alias("trigram"))


def candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): the rules with a trigram query, by bit, whose query a document's postings fulfil."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not ANY}
    terms = sorted(set().union(*map(_terms, queries.values())))
    words = range(0, len(terms), 60)  # masks of 60 trigrams each
    index = postings(texts, terms)
    masks = index.groupBy("doc_id").agg(*(F.bit_or(F.when((F.col("trigram") >= w) & (F.col("trigram") < w + 60), F.expr(f"shiftleft(1L, trigram - {w})"))).alias(f"_m{w}") for w in words))

    def holds(query) -> Column:
        if isinstance(query, str):
            k = terms.index(query)
            return F.coalesce(F.col(f"_m{k // 60 * 60}").bitwiseAND(F.lit(1 << k % 60)) != 0, F.lit(False))
        return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), map(holds, query[1:]))

    bits = reduce(lambda a, b: a + b, [F.when(holds(q), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in queries.items()])
    return masks.select("doc_id", bits.cast("long").alias("rules")).where("rules <> 0")


def _spans(rule: Rule, order: int) -> Column:
    """Array of (start, kind's place, end) of a rule's matches in ``text``, in code points.

    What lies between the matches comes from a split, so starts are running sums of lengths.
    """
    regex = rule.regex if rule.long is None else rule.long
    text, pattern = F.col("text"), F.lit(regex)
    between = F.transform(F.split(text, regex, -1), lambda x: F.length(x))
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matched
    parts = F.zip_with(F.zip_with(between, matched, lambda b, m: F.struct(b.alias("b"), F.length(m).alias("m"))), sized, lambda p, g: F.struct(p["b"].alias("b"), p["m"].alias("m"), F.length(g).alias("g")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    def step(acc, p):
        start = acc["at"] + p["b"]
        end = start + p["m"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["g"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))
    found = F.aggregate(F.filter(parts, lambda p: p["m"].isNotNull()), empty, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and text of ``docs`` with ``_text``, its null as empty, and ``_found``: an array of
    (start, kind, end), sorted. kind is the rule's place in ``rules``; starts and ends count code
    points. Further columns stay as they are, whatever their names, but those named as the
    result's two give way to it.
    """
    docs, back = aside(docs.drop("_text", "_found"), ["doc_id", "text"])
    rows = docs.withColumns({"_key": F.col("doc_id").cast("long"), "_text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    marked = candidates(doc_texts(docs), rules).select(F.col("doc_id").alias("_doc"), F.col("rules").alias("_rules"))
    wanted = rows.join(marked, F.col("_key").eqNullSafe(F.col("_doc")), "left")
    none = F.array().cast(SPANS)
    each = [
        _spans(r, i) if trigram_query(r.pattern) is ANY else F.when(F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, _spans(r, i)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    done = wanted.select(*docs.columns, "_text", F.array_sort(F.concat(*each)).alias("_found"))
    return back(done, "_text", "_found")


def joined(found: Column, rules: list[Rule] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; ``n_chars`` follows. Every row stays.

    Spans that overlap or touch are one secret.
    """
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        more = F.when((s["start"] > acc["at"]) | (acc["out"] == ""), F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    clean = F.aggregate("_found", begun, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    hit = F.size("_found") > 0
    docs, back = aside(docs, ["doc_id", "text", "n_chars"])
    done = scan(docs, rules).withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(done)
