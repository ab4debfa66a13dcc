"""SimHash near-duplicates at shingle similarity 0.8: fingerprints first, whole sets last.

Each text has its set of word shingles and their SimHash fingerprint. Candidates come from

1. the Gray-order index of ``hamming``: fingerprints at most ``NEAR`` bits apart;
2. what a bound of so few bits leaves (a pair at 0.8 differs in ten bits of 64, give or take
   three): two sets have similarity 0.8 (their common shingles over all of both) only if the
   first fifth and one more of each, in any order that all sets share, have a shingle in common.
   So those first ones are posted by shingle, and sets that meet there are candidates unless
   their two fingerprints, of other hashes each, differ by over ``FAR`` of 128 bits: a pair at 0.8
   differs in 19, give or take four, so this happens to one in 10**9.
   The order puts shingles that are frequent in a sample last: this decides how many candidates
   there are, not which pairs are found.

Each candidate pair is verified by its whole sets, so no link rests on fingerprints alone.

Hot keys: equal sets are one from the start. In each posting the sets first meet its smallest
member only, and a set is verified against the nearest such member before any other. Then, round
by round, each posting draws another member, and a set outside its smallest member's component is
verified against the nearest of those that its postings have drawn; found links join components,
and rounds go on while they find enough links. Crowded postings then draw several members a round, of those
that have the fewest rarer shingles (the least edited ones of a group of near copies), and what is outside
is verified against the nearest few that it has not been tried with, as long as that finds enough links. Only what is outside still meets all
others of its postings. So a large group of near copies ships about one set a member and round,
and pairs are written for sets that belong to no common group. Sets are verified in groups of
``MEMBERS`` around one of them.

Cases: a null text is an empty text, and texts without words are one group; fewer words than a
shingle has are one shingle; repeated rows are one group; rows with equal doc_id and other texts
are told apart by the texts' CRC-32; texts of any length are taken whole; an empty table gives an
empty table; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, dropped, grouped_map, hashed_sample, stored
from plumbline.llm.graph import components
from plumbline.llm.hamming import majority, near_links

#: Bits between fingerprints that the Gray index links before anything else.
NEAR = 3
#: Bits of 128, in two fingerprints, beyond which a pair of sets of ``SMALL`` shingles or more is not verified.
FAR, SMALL = 44, 16
#: Linked sets whose components are broadcast at most, 16 bytes each; more are joined by a shuffle.
BROADCAST = 250_000
#: Rows whose keys are broadcast at most, 8 bytes each, so that only their texts are shuffled; of more, all texts are.
FILTER = 2_000_000
#: Links that a round must find for another round to follow: of the pairs that it verifies, and of all sets.
FRUITFUL, WORTH = 0.03, 0.001
#: Sets from which a posting is crowded, members that it draws at once then, and how many of them a set is verified against.
CROWD, DRAWS, TRIES = 32, 8, 4
#: Places before a posting that are held against another's: only where none is common a pair is written.
BEFORE = 8
#: Bits of 128 that pairs of sets at 0.8 differ in, about: nearer ones are verified first.
CLOSE = 20
#: Sets that are verified against one other at once.
MEMBERS = 512
#: Documents that the order of shingles is taken from, and shingles at most that come last.
SAMPLE, FREQUENT = 8192, 1 << 17
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``width`` words, A-Z in lower case."""
    words = text.encode().lower().split()
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(width, len(one))
    out = np.full(max(len(one) - n + 1, 0) if n else 0, n, np.uint64)
    for i in range(n):
        out = (out ^ one[i : i + len(out)]) * _MIX[0]
        out = (out ^ (out >> _MIX[2])) * _MIX[1]
        out ^= out >> _MIX[2]
    return np.unique(out)


def key_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, how many documents hold each) of the most frequent ones of a sample."""
    sample = hashed_sample(texts, "doc_id", SAMPLE)
    each = arrow_map(sample, lambda b: {"grams": [shingles(x, width).view(np.int64) for x in b["text"].to_pylist()]}, "grams array<long>")
    found = each.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    table = found.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def first_of(grams: np.ndarray, hot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first fifth and one more of a set: by frequency in the sample, then by hash."""
    if not len(grams):
        return grams
    rank = np.zeros(len(grams), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        rank = np.where(hot[at] == grams, n[at], 0)
    return grams[np.lexsort((grams, rank))][: len(grams) // 5 + 1]


def _prints(texts: DataFrame, width: int) -> DataFrame:
    hot, n = frequent(texts, width)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch["text"].to_pylist()
        sets = [shingles(x, width) for x in texts]
        return {
            "doc_id": batch["doc_id"],
            "tie": [crc32(x.encode()) for x in texts],
            "key": [key_of(s) for s in sets],
            "fp": np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
            "fp2": np.array([majority(s * _MIX[0] ^ (s >> _MIX[2])) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
            "size": [len(s) for s in sets],
            "first": [first_of(s, hot, n).view(np.int64) for s in sets],
        }

    made = arrow_map(texts, run, "doc_id long, tie long, key long, fp long, fp2 long, size int, first array<long>")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "sets")


def _bits(a: str, b: str) -> Column:
    """In how many of 128 bits the fingerprints with these prefixes differ."""
    return sum((F.bit_count(F.col(f"{a}{fp}").bitwiseXOR(F.col(f"{b}{fp}"))) for fp in ("fp", "fp2")), F.lit(0))


def _may(a: str, b: str) -> Column:
    """Whether postings (size, pos and fp with these prefixes), pos being the first common shingle's
    place, can be of sets with similarity 0.8."""
    enough = 9 * F.least(F.col(f"{a}size") - F.col(f"{a}pos"), F.col(f"{b}size") - F.col(f"{b}pos")) >= 4 * (F.col(f"{a}size") + F.col(f"{b}size"))
    return enough & ((F.least(f"{a}size", f"{b}size") < SMALL) | (_bits(a, b) <= FAR))


def _common(table: pa.Table) -> dict:
    """(a, b): which sets of a group have similarity 0.8 with that of its ``b``: 9 common shingles to 4 of both sizes."""
    b, sets = table["b"][0].as_py(), {}
    for row, grams in zip(table["row"].to_pylist(), table["grams"], strict=True):
        sets[row] = np.frombuffer(grams.as_buffer(), np.uint64)
    one, near = sets.pop(b, None), []
    for row, x in sets.items() if one is not None and len(one) else ():
        few, many = (x, one) if len(x) < len(one) else (one, x)
        common = (many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum()
        if 9 * common >= 4 * (len(x) + len(one)):
            near.append(row)
    return {"a": near, "b": [b] * len(near)}


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of rows, a stored table, whose whole sets have similarity 0.8.

    Sets are made again from the texts of the pairs' rows, so those of the others never leave a
    task. Each goes to the groups of the rows that it is compared with. Texts whose keys no pair
    needs are left out before the shuffle, by hashes, while there are ``FILTER`` rows at most.
    """
    if pairs.isEmpty():
        return pairs
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("groups"))
    members = pairs.join(groups, "b").select("b", F.pmod(F.xxhash64("a"), "groups").cast("int").alias("group"), F.col("a").alias("row"))
    centres = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("b").alias("row"))
    need = members.union(centres).join(prints.select("row", "key", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), "row")
    need = stored(need, "need")
    if need.count() <= FILTER:
        hashes = need.select(F.xxhash64("_id", "_tie").alias("_hash")).distinct()
        texts = texts.join(F.broadcast(hashes), F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))) == F.col("_hash"), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.crc32(F.col("text").cast("binary")) == F.col("_tie"))

    def again(batch: pa.RecordBatch) -> dict:
        sets = [shingles(x, width) for x in batch["text"].to_pylist()]
        keep = pa.array([key_of(s) == k for s, k in zip(sets, batch["key"].to_pylist(), strict=True)], pa.bool_())
        return {c: batch[c].filter(keep) for c in ("b", "group", "row")} | {"grams": pa.array([s.tobytes() for s in sets], pa.binary()).filter(keep)}

    held = arrow_map(texts.join(need, same).select("b", "group", "row", "key", "text"), again, "b long, group int, row long, grams binary")
    found = stored(grouped_map(held, ["b", "group"], _common, "a long, b long"), "similar")
    dropped(need)
    return found


def similar_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, tie (CRC-32 of the text) and component_id of each row: the smallest doc_id that
    it reaches by texts with shingle similarity 0.8 or more."""
    texts = doc_texts(docs)
    prints = _prints(texts, width)
    same = ["key", "size", "fp"]
    owner = stored(prints.groupBy(*same).agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id")), "owners")
    whole = owner.where("size > 0").select("row", "fp")

    # 1: near fingerprints, and other sets of one fingerprint
    of_fp = whole.groupBy("fp").agg(F.min("row").alias("first"))
    linked = near_links(whole, NEAR).join(of_fp.toDF("a", "row_a"), "a").join(of_fp.toDF("b", "row_b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    equal = whole.join(of_fp, "fp").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))

    # 2: postings of first shingles that several sets have
    single = stored(prints.where("size > 0").join(owner.select("row"), "row", "left_semi").select("row", "size", "fp", "fp2", "first"), "firsts")
    posts = single.select("row", F.posexplode("first").alias("pos", "gram"), "size", "fp", "fp2")
    often = stored(posts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "often")
    shared = stored(posts.join(often, "gram", "left_semi"), "postings")
    dropped(single)
    dropped(often)
    what = ["row", "size", "pos", "fp", "fp2"]

    def with_least(rows: DataFrame, prefix: str) -> DataFrame:
        """Each posting with its gram's smallest one."""
        least = rows.groupBy("gram").agg(F.min(F.struct("size", *(c for c in what if c != "size"))).alias("r"))
        return rows.join(least.select("gram", *(F.col(f"r.{c}").alias(f"{prefix}{c}") for c in what)), "gram")

    met = with_least(shared, "r_")
    def shared_by_many(rows: DataFrame) -> DataFrame:
        """The postings of three sets or more: the others' two sets have met."""
        many = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("gram")
        return rows.join(many, "gram", "left_semi")

    star = met.where((F.col("row") != F.col("r_row")) & _may("", "r_")).select(F.col("row").alias("a"), F.col("r_row").alias("b"), _bits("", "r_").alias("bits"))
    star = stored(star.distinct(), "star")
    nearest = star.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("n")).select("a", F.col("n.b").alias("b"))
    first = stored(linked.union(equal).union(nearest).distinct(), "pairs")
    links = verified(first, prints, texts, width)

    def parts_of(links: DataFrame) -> DataFrame:
        made = stored(components(links).select(F.col("node").alias("_node"), F.col("component").alias("_part")), "parts")
        return F.broadcast(made) if made.count() <= BROADCAST else made

    def with_part(rows: DataFrame, row: str, name: str) -> DataFrame:
        return rows.join(parts, F.col(row) == F.col("_node"), "left").withColumn(name, F.coalesce("_part", row)).drop("_node", "_part")

    # then the pairs with a posting's smallest member that are in no common component yet
    parts = parts_of(links)
    apart = with_part(with_part(star, "a", "pa"), "b", "pb").where("pa <> pb").select("a", "b")
    links = links.union(verified(stored(apart.join(first, ["a", "b"], "left_anti"), "pairs"), prints, texts, width))
    parts = parts_of(links)
    n_sets = whole.count()
    named, tried, round_ = shared_by_many(met.select("gram", *what, "r_row")), star.select("a", "b"), 0

    def renewed(named: DataFrame) -> DataFrame:
        """The postings with their components as they are now, where a member is outside its smallest one's."""
        named = with_part(with_part(named.select("gram", *what, "r_row"), "row", "part"), "r_row", "r_part").withColumn("out", F.col("part") != F.col("r_part"))
        return stored(named.join(named.where("out").select("gram").distinct(), "gram", "left_semi"), "postings")

    def seen(rows: DataFrame, draws: int) -> DataFrame:
        """(a, b, bits): members that are outside with those that their postings draw."""
        turns = [F.lit(round_ * DRAWS + i) for i in range(draws)]
        first = ["pos"] if draws > 1 else []
        drawn = rows.groupBy("gram").agg(*(F.min(F.struct(*(F.col(c).alias("_least") for c in first), F.xxhash64("row", t).alias("h"), *what, "part")).alias(f"d{i}") for i, t in enumerate(turns)))
        drawn = drawn.select("gram", F.explode(F.array(*(f"d{i}" for i in range(draws)))).alias("d")).select("gram", *(F.col(f"d.{c}").alias(f"d_{c}") for c in (*what, "part")))
        met = rows.where("out").join(drawn, "gram").where((F.col("part") != F.col("d_part")) & _may("", "d_"))
        return met.select(F.col("row").alias("a"), F.col("d_row").alias("b"), _bits("", "d_").alias("bits"))

    # then, round by round, members outside its component with the nearest of those that their postings draw
    for draws in (1, DRAWS):
        fruitful = True
        while fruitful:
            named, round_ = renewed(named), round_ + 1
            if draws == 1:
                near = seen(named, 1).groupBy("a").agg(F.min(F.struct("bits", "b")).alias("n")).select("a", F.col("n.b").alias("b")).join(tried, ["a", "b"], "left_anti")
            else:
                crowded = named.join(named.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD).select("gram"), "gram", "left_semi")
                near = seen(crowded, draws).distinct().join(tried, ["a", "b"], "left_anti")
                near = near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("bits", "b"))).where(F.col("k") <= TRIES).select("a", "b")
            near = stored(near, "pairs")
            found = verified(near, prints, texts, width)
            fruitful = found.count() > max(FRUITFUL * near.count(), WORTH * n_sets)
            links, tried = links.union(found), tried.union(near)
            parts = parts_of(links)
    named = renewed(named)
    dropped(shared)
    # and what is outside still with all others, where nothing that comes just before is common: a pair's first common gram is such a place
    before = [F.lag("gram", k).over(Window.partitionBy("row").orderBy("pos")) for k in range(1, BEFORE + 1)]
    named = named.withColumn("before", F.array_compact(F.array(*before)))
    outer = named.where("out").select("gram", *(F.col(c).alias(f"o_{c}") for c in (*what, "part", "before")))
    first_there = ~F.arrays_overlap("before", "o_before")
    rest = outer.join(named, "gram").where((F.col("part") != F.col("o_part")) & _may("", "o_") & first_there & (~F.col("out") | (F.col("row") < F.col("o_row"))))
    rest = rest.select(F.col("o_row").alias("a"), F.col("row").alias("b"), _bits("", "o_").alias("bits")).distinct()
    rest = stored(rest.join(tried, ["a", "b"], "left_anti").join(tried.toDF("b", "a"), ["a", "b"], "left_anti"), "pairs")
    # the nearer ones first, as what they join needs no other pair
    links = links.union(verified(stored(rest.where(F.col("bits") <= CLOSE).select("a", "b"), "pairs"), prints, texts, width))
    parts = parts_of(links)
    rest = with_part(with_part(rest.where(F.col("bits") > CLOSE), "a", "pa"), "b", "pb").where("pa <> pb").select("a", "b")
    links = links.union(verified(stored(rest, "pairs"), prints, texts, width))
    parts = parts_of(links)

    owner = with_part(owner, "row", "part")
    least_id = owner.groupBy("part").agg(F.min("first_id").alias("component_id"))
    ids = owner.join(least_id, "part").select(*same, "component_id")
    return prints.select("doc_id", "tie", *same).join(ids, same).select("doc_id", "tie", "component_id")
