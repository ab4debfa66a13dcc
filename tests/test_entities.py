"""Fuzzy links by the signature index against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from plumbline.operators import cleaning


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1.0 - row[-1] / longest


def fuzzed(n=160):
    deal = random.Random(4)
    base = ["anna maria lopez", "bo li", "ognjenovic", "mcdermottson", "aaaaaaa", "abababab", "x", "", "jean luc", "van der berg"]
    keys = list(base)
    while len(keys) < n:
        k = list(deal.choice(base[:7] + keys[-20:]))
        for _ in range(deal.randint(1, 3)):
            at = deal.randint(0, len(k))
            k[at : at + deal.randint(0, 2)] = deal.choice(["", "a", "b", " ", "é", "an"])
        keys.append("".join(k))
    return [(f"{i:03d}", k, 2000 + i % 2, deal.choice([None, None, "1990-01-01", "1991-01-01"])) for i, k in enumerate(keys)] + [("null", None, 2000, None), ("none", "bo li", None, None)]


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.88, 1.0])
@pytest.mark.parametrize("similarity, alike", [(cleaning.ratio, lambda a, b: SequenceMatcher(None, a, b).ratio()), (cleaning.edit_similarity, edits)])
def test_index_finds_all_links(spark, threshold, similarity, alike):
    rows = fuzzed()
    keys = spark.createDataFrame(rows + rows[:3], "entity string, match_key string, draft_year int, birthdate string")
    links = cleaning.fuzzy_links(keys, threshold, similarity).collect()
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] is not None and y[1] is not None and x[2] is not None and x[2] == y[2] and (None in (x[3], y[3]) or x[3] == y[3]) and alike(x[1], y[1]) >= threshold}
    assert len(links) == len(set(links)) and set(map(tuple, links)) == want


def test_split_postings_and_few_candidates(spark):
    rows = [(f"{i:04d}", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i * 7919 % 1000:03d} smith", 2000, None) for i in range(400)]
    keys = spark.createDataFrame(rows, "entity string, match_key string, draft_year int, birthdate string")
    whole = {tuple(r) for r in cleaning.fuzzy_candidates(keys, 0.88, cleaning.edit_similarity).collect()}
    assert whole == {tuple(r) for r in cleaning.fuzzy_candidates(keys, 0.88, cleaning.edit_similarity, posting=3).collect()}
    assert len(whole) < 400 * 399 / 2 / 5


def test_no_join_by_year_alone(spark):
    keys = spark.createDataFrame(fuzzed(), "entity string, match_key string, draft_year int, birthdate string")
    plan = cleaning.fuzzy_candidates(keys, 0.88)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and all("_gram" in x for x in joins) and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_rows_and_thresholds(spark):
    none = spark.createDataFrame([], "entity string, match_key string, draft_year int, birthdate string")
    assert cleaning.fuzzy_links(none, 0.88).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        cleaning.fuzzy_links(none, 0.0)
