"""Integration of sources: entity resolution, master tables, leakage-safe imputation."""

from __future__ import annotations

import json
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions.lineage import cut
from plumbline.functions.names import name_match_key, normalize_league
from plumbline.functions.workers import importable
from plumbline.operators.ordered import quantiles

ADVANCED = ["true_shooting", "usage", "bpm_college", "strength_of_schedule"]
COMBINE = ["wingspan_in", "standing_reach_in", "max_vertical_in", "lane_agility_s", "body_fat_pct"]
IMPUTABLE = ADVANCED + COMBINE


def player_id(key: Column, year: Column) -> Column:
    return F.concat(F.lit("p_"), F.substring(F.sha1(F.concat_ws("|", key, year.cast("string"))), 1, 12))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity, which neither Spark nor SQL has; for prefiltered pairs only."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _grams(key: Column, q: int) -> Column:
    """A key's q-grams with how often each has occurred so far, as (g, k); of q = 1 its letters.

    Longer grams count the ends: an edit touches ``q`` grams at most, of length + q - 1.
    """
    padded = key if q == 1 else F.concat(F.lit("\x01" * (q - 1)), key, F.lit("\x02" * (q - 1)))
    n = F.length(padded) - (q - 1)
    at = lambda i: F.substring(padded, i, F.lit(q))
    grams = F.when(n < 1, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at))
    numbered = lambda gs: F.transform(gs, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(gs, F.lit(1), i + 1), lambda x: x == g)).alias("k")))
    return F.transform(F.array(grams), numbered)[0]  # as an argument they are made once


class Signatures:
    """How many grams two keys of similarity ``threshold`` must share, and which of a key's grams decide.

    Keys a and b that are alike differ by K edits at most: (1 - t) times the longer length for the
    edit similarity, (1 - t) times both lengths for difflib's ratio, whose matches are a common
    subsequence. K edits leave all but q K of the longer one's grams in common. So of two such
    keys the first q K + 1 grams of each, in any order that both share, have one in common.
    ``q`` is the longest of 3, 2 and 1 whose first grams are under half, all or any of a key's.
    For q = 1 the letters in common decide: threshold times the longer length, or half of both.
    """

    def __init__(self, threshold: float, edits: bool):
        if not 0 < threshold <= 1:
            raise ValueError("a threshold over 0, 1 at most")
        self.t, self.edits = threshold, edits
        self.share = (1 - threshold) / threshold * (1 if edits else 2)
        self.q = 3 if 3 * self.share <= 0.5 else 2 if 2 * self.share < 1 else 1

    def first(self, n: Column) -> Column:
        """Grams that a key of ``n`` letters is posted by, whatever the other's length."""
        if self.q > 1:
            return (self.q * F.floor(n * self.share + 1e-9) + 1).cast("int")
        least = self.t if self.edits else self.t / (2 - self.t)
        return (n - F.ceil(n * least - 1e-9) + 1).cast("int")

    def need(self, a: Column, b: Column) -> Column:
        """Grams in common of keys of ``a`` and ``b`` letters."""
        if self.q > 1:
            k = F.floor((1 - self.t) * (F.greatest(a, b) if self.edits else a + b) + 1e-9)
            return F.greatest(a, b) + (self.q - 1) - self.q * k
        return F.ceil((self.t * F.greatest(a, b) if self.edits else self.t * (a + b) / 2) - 1e-9)

    def lengths(self, a: Column, b: Column) -> Column:
        """Whether keys of these lengths can be alike at all."""
        return F.least(a, b) >= (self.t * F.greatest(a, b) if self.edits else self.t * (a + b) / 2) - 1e-9


#: Rows of a posting that one task meets all of a posting's rows with.
POSTING = 2000


def fuzzy_candidates(keys: DataFrame, threshold: float, similarity=ratio, posting: int = POSTING) -> DataFrame:
    """entity_a, entity_b, match_key_a, match_key_b: pairs of a block that can be ``threshold`` alike, all of them.

    An inverted index of lossless signatures: a key is posted by its block's rarest grams, as many as
    ``Signatures`` asks for. Pairs that meet in a posting stay if their lengths allow the threshold
    and so do the grams after the one that they meet in (a bound that holds at the first one in
    common, so no pair is lost), and birth dates don't conflict; then letters in common are counted:
    neither difflib's ratio nor the edit similarity exceeds twice those over both lengths. A
    posting of over ``posting`` rows is split into as many parts, each of which meets all its rows.

    A null key or block links with nothing; equal keys are alike; repeated rows are one.
    """
    by = Signatures(threshold, similarity is edit_similarity)
    rows = keys.select("entity", "match_key", "draft_year", F.col("birthdate").cast("string").alias("birthdate")).where("match_key is not null and draft_year is not null").distinct()
    rows = cut(rows)  # read twice
    each = rows.withColumn("_t", F.explode(_grams(F.col("match_key"), by.q)))
    rare = each.groupBy("draft_year", "_t").agg(F.count(F.lit(1)).alias("_n"))
    ordered = each.join(rare.where("_n > 1"), ["draft_year", "_t"]).groupBy(*rows.columns).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_ts"))
    # grams of one key only come first in the order, and are in no other key's posting
    total = F.length("match_key") + (by.q - 1)
    alone = F.greatest(total, F.lit(1)) - F.size("_ts")
    posted = ordered.select("*", F.posexplode(F.slice("_ts", F.lit(1), F.greatest(by.first(F.length("match_key")) - alone, F.lit(0)))).alias("_at", "_p"))
    posted = posted.select("entity", "match_key", "birthdate", "draft_year", F.col("_p._t").alias("_gram"), (total - alone - F.col("_at")).alias("_left"))
    posted = cut(posted)  # read three times
    sizes = posted.groupBy("draft_year", "_gram").agg(F.ceil(F.count(F.lit(1)) / posting).cast("int").alias("_parts"), F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    posted = posted.join(sizes, ["draft_year", "_gram"])
    one = lambda df, s: df.select("draft_year", "_gram", "_part", *(F.col(c).alias(f"{c}_{s}") for c in ("entity", "match_key", "birthdate", "_left")))
    a = one(posted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))), "a")
    b = one(posted.withColumn("_part", F.pmod(F.xxhash64("entity", "birthdate"), F.col("_parts")).cast("int")), "b")
    la, lb = F.length("match_key_a"), F.length("match_key_b")
    fits = F.col("birthdate_a").isNull() | F.col("birthdate_b").isNull() | (F.col("birthdate_a") == F.col("birthdate_b"))
    met = a.join(b, ["draft_year", "_gram", "_part"]).where((F.col("entity_a") < F.col("entity_b")) & by.lengths(la, lb) & (F.least("_left_a", "_left_b") >= by.need(la, lb)) & fits)
    pairs = met.select("entity_a", "entity_b", "match_key_a", "match_key_b").distinct()
    letters = lambda c: F.array(*(F.length(c) - F.length(F.translate(c, x, "")) for x in "abcdefghijklmnopqrstuvwxyz"))
    rest = lambda c: F.length(F.regexp_replace(c, "[a-z]", ""))
    common = F.least(rest("match_key_a"), rest("match_key_b")) + F.aggregate(F.zip_with(letters("match_key_a"), letters("match_key_b"), lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return pairs.where(2 * common >= threshold * (la + lb) - 1e-9)


def fuzzy_links(keys: DataFrame, threshold: float, similarity=ratio) -> DataFrame:
    """(a, b): entities of one block whose keys are at least ``threshold`` alike and whose birth dates agree.

    keys: entity, match_key, draft_year, birthdate. The similarity is worked out for ``fuzzy_candidates``.
    """
    importable(keys.sparkSession)
    pairs = fuzzy_candidates(keys, threshold, similarity)
    return pairs.where(similarity(F.col("match_key_a"), F.col("match_key_b")) >= threshold).select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"))


def smallest_reached(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(entity, root): the smallest entity that each one reaches by links.

    Each round an entity takes the least root among its own, its neighbours' and its root's, so
    roots jump along chains; rounds go on until none moves. Each round is checkpointed, so lineage
    doesn't grow and a lost executor doesn't cost the rounds before.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, labels = cut(both), nodes.select("entity", F.col("entity").alias("root"))
    while True:
        low = both.join(labels, F.col("b") == F.col("entity")).groupBy("a").agg(F.min("root").alias("_low"))
        near = labels.join(low, F.col("entity") == F.col("a"), "left").select("entity", "root", F.least("root", F.coalesce("_low", "root")).alias("_next"))
        # what an entity points to takes the least of what points to it, and then all look up where theirs points
        pulled = near.select(F.col("root").alias("_at"), "_next").union(near.select(F.col("entity").alias("_at"), "_next")).groupBy("_at").agg(F.min("_next").alias("_next"))
        jump = pulled.select(F.col("_at").alias("_via"), F.col("_next").alias("_far"))
        moved = near.select("entity", "root").join(pulled, F.col("entity") == F.col("_at")).join(jump, F.col("_next") == F.col("_via"), "left")
        new = moved.select("entity", F.least("_next", F.coalesce("_far", "_next")).alias("_to"), "root").select("entity", F.col("_to").alias("root"), (F.col("_to") != F.col("root")).alias("_moved"))
        new = cut(new)
        labels = new.select("entity", "root")
        if new.where("_moved").isEmpty():
            return labels


def resolve_entities(sources: list[DataFrame], threshold: float = 0.88, similarity=ratio) -> tuple[list[DataFrame], DataFrame]:
    """(each source with player_id, identity): records of one person across sources.

    Records with the same key and year are one entity; entities of a year with keys that are
    ``threshold`` alike and birth dates that don't conflict are joined, transitively. Each
    person's id hangs on its smallest (key, year) only, not on the order of records.
    """
    importable(sources[0].sparkSession)
    keyed = []
    for s in sources:
        birth = F.col("birthdate").cast("string") if "birthdate" in s.columns else F.lit(None).cast("string")
        keyed.append(s.withColumns({"match_key": name_match_key(F.col("full_name")), "_birth": birth}))
    every = reduce(DataFrame.unionByName, [k.select("match_key", "draft_year", "_birth", "full_name") for k in keyed])
    entity = F.concat_ws("|", "match_key", F.col("draft_year").cast("string"))
    blocks = every.groupBy(entity.alias("entity")).agg(F.first("match_key").alias("match_key"), F.first("draft_year").alias("draft_year"), F.min("_birth").alias("birthdate"), F.min("full_name").alias("full_name"))
    blocks = cut(blocks)
    roots = smallest_reached(blocks, fuzzy_links(blocks, threshold, similarity))
    ids = blocks.join(roots, "entity").join(blocks.select(F.col("entity").alias("root"), F.col("match_key").alias("_rk"), F.col("draft_year").alias("_ry")), "root")
    ids = ids.select("entity", "full_name", "draft_year", "birthdate", player_id(F.col("_rk"), F.col("_ry")).alias("player_id"))
    ids = cut(ids)
    identity = ids.groupBy("player_id").agg(F.min("full_name").alias("full_name"), F.min("draft_year").alias("draft_year"), F.min("birthdate").alias("birthdate"))
    known = ids.select(F.col("entity").alias("_entity"), "player_id")
    stamped = [k.withColumn("_entity", F.concat_ws("|", "match_key", F.col("draft_year").cast("string"))).join(known, "_entity", "left").drop("_entity", "_birth", "match_key") for k in keyed]
    return stamped, identity


def missing_flags(df: DataFrame, columns: list[str] = IMPUTABLE) -> DataFrame:
    """Add ``<c>_imputed``: whether it is null."""
    return df.withColumns({f"{c}_imputed": F.col(c).isNull() for c in columns if c in df.columns})


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows in any order and the columns in any order; ``empty`` without rows.

    Row hashes are summed, so nothing is sorted and the driver gets one row.
    """
    columns = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    n, *sums = df.agg(F.count(F.lit(1)), *(part(i) for i in range(4))).first()
    return "empty" if not n else df.sparkSession.range(1).select(F.sha2(F.lit("|".join(map(str, [columns, n, *sums]))), 256)).first()[0]


@dataclass
class Master:
    identity: DataFrame
    prospect_season: DataFrame
    combine: DataFrame
    version: str
    manifest: dict


def build_master(seasons: list[DataFrame], combine: DataFrame | None, out: str | None = None) -> Master:
    """Resolve, name leagues alike, union sources of any columns, flag missing values; write if ``out``.

    Values that weren't measured stay null; nothing is imputed here.
    """
    stamped, identity = resolve_entities([*seasons, *([combine] if combine is not None else [])])
    parts = stamped[: len(seasons)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for c in ADVANCED:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = missing_flags(rows.withColumn("league_id", normalize_league(F.col("league"))), ADVANCED)
    if combine is not None:
        first = Window.partitionBy("player_id").orderBy("full_name")
        measures = stamped[-1].withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    else:
        measures = identity.select("player_id", *(F.lit(None).cast("double").alias(c) for c in COMBINE)).limit(0)
    measures = missing_flags(measures, COMBINE)
    tables = {"identity": identity, "prospect_season": rows, "combine": measures}
    prints = {k: fingerprint(v) for k, v in tables.items()}
    version = identity.sparkSession.range(1).select(F.sha2(F.lit(json.dumps(prints, sort_keys=True)), 256)).first()[0][:12]
    manifest = {"version": version, "tables": prints}
    if out:
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{out}/version={version}/{name}")
        identity.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/version={version}/manifest")
    return Master(**tables, version=version, manifest=manifest)


class Imputer:
    """Group means, then global means, of the rows it was fitted on; flags and spreads beside them.

    A column that wasn't there when fitting stays as it is.
    """

    def __init__(self, columns: list[str], group: str):
        self.columns, self.group = columns, group

    def fit(self, train: DataFrame) -> Imputer:
        self.fitted = [c for c in self.columns if c in train.columns]
        moments = [x for c in self.fitted for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]
        self.groups = train.groupBy(F.col(self.group).alias("_group")).agg(*moments)
        self.every = train.agg(*moments).first().asDict() if moments else {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out, new = df.join(self.groups, F.col(self.group).eqNullSafe(F.col("_group")), "left"), {}
        for c in [c for c in self.fitted if c in df.columns]:
            fill = F.coalesce(F.col(f"_m_{c}"), F.lit(self.every[f"_m_{c}"]))
            filled = F.col(c).isNull() & fill.isNotNull()
            new[f"{c}_imputed"] = filled
            new[f"{c}_impute_sd"] = F.when(filled, F.coalesce(F.col(f"_s_{c}"), F.lit(self.every[f"_s_{c}"]), F.lit(0.0))).otherwise(0.0)
            new[c] = F.coalesce(F.col(c), fill)
        keep = [c for c in df.columns if c not in new]
        return out.select(*keep, *(e.alias(k) for k, e in new.items()))


class Preprocessor:
    """Context model, imputer, then training medians; the features in their declared order, missing ones null."""

    def __init__(self, features: list[str], context=None, imputer=None):
        self.features, self.context, self.imputer = features, context, imputer

    def _learned(self, df: DataFrame) -> DataFrame:
        for step in (self.context, self.imputer):
            df = step.transform(df) if step else df
        for c in self.features:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        return df

    def fit(self, train: DataFrame) -> Preprocessor:
        for step in (self.context, self.imputer):
            if step:
                train = step.fit(train).transform(train)
        rows = self._learned_columns(train)
        self.medians = {c: q[0] for c, q in quantiles(rows, {c: [0.5] for c in self.features}).items()}
        return self

    def _learned_columns(self, df: DataFrame) -> DataFrame:
        for c in self.features:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double"))
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        df = self._learned(df)
        return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(self.medians[c]).cast("double")) for c in self.features})


