"""The pipeline on planted documents: each stage's decisions, its columns, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import similar
from plumbline.llm.packing import Fast
from plumbline.llm.queries import BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(1)
    words = ["the", "house", "stands", "on", "a", "hill", "and", "we", "walk", "home", "when", "rain", "falls", "over", "green", "fields"]
    good = lambda n=60: " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(n))
    bad = lambda: " ".join(rng.choice(["buy!!", "$$$", "click***", "###", "now&&&"]) for _ in range(60))
    rows = [(k, good() if k % 5 else bad()) for k in range(300)]
    passage = good(50)
    rows += [(400, rows[1][1]), (401, rows[2][1] + " "), (402, good() + " " + passage + " é " + good()), (403, good() + " é " + passage + " " + good())]
    rows += [(404, good() + " token: abcdef123456 " + good()), (405, None), (406, ""), (407, good(3000))]
    labels = [(k, int(k % 5 > 0), 0) for k in range(200)]
    return rows, labels, passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels, _ = corpus()
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    rows, _, passage = corpus()
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if "text" in docs.columns else {}
        docs = stage(spark, docs, folder).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS and set(seen[name]) <= set(before)
    quality = seen["quality"]
    assert sum(k % 5 == 0 for k in quality if k < 300) <= 1 and sum(k % 5 > 0 for k in quality if k < 300) >= 238
    assert {402, 403, 404, 407} <= set(quality)
    once = seen["simhash"]
    assert not {400, 401} & set(once) and {1, 2} <= set(once)
    assert sum(not (r.text or "").split() for r in once.values()) <= 1
    cut = seen["suffix"]
    assert passage in cut[402].text and passage not in cut[403].text and "é" in cut[403].text
    assert all(r.n_chars == len(r.text or "") for r in cut.values())
    clean = seen["secrets"]
    assert "abcdef123456" not in clean[404].text and "[secret]" in clean[404].text
    assert set(clean) == set(cut)
    bpe = Fast(BPE)
    total = {i: len(bpe.encode(r.text or "")) // 4 + 1 for i, r in clean.items()}
    pieces = seen["packing"]
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in total} == total
    room = {}
    for p in pieces:
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for slots in room.values():
        ends = np.cumsum([n for _, n in sorted(slots)])
        assert [o for o, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_odd_rows(spark, folder):
    odd = [(None, "some words without an id", None, None, None), (1, "twice", "en", "s", 5), (1, "twice", "en", "s", 5), (1, "once more with other words", "en", "s", 9), (2, None, None, None, None)]
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({"label": F.lit(1), "kept": F.lit(2), "tie": F.lit(3), "_kept": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [*COLUMNS, "label", "kept", "tie", "_kept"]
    left = docs.collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, "some words without an id"), (1, "once more with other words"), (1, "twice"), (2, "")]


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


@pytest.mark.parametrize("sample", [8192, 0])
def test_edited_copies_go(spark, folder, monkeypatch, sample):
    """Planted copies with edits: those within similarity 0.8 are one group, others stay; hot or not."""
    monkeypatch.setattr(similar, "SAMPLE", sample)
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]

    def edit(words, k):
        at = set(rng.sample(range(len(words)), min(k, len(words))))
        return [f"e{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]

    base = [text(n) for n in (1, 3, 8, 30, 60, 100, 200, 400)]
    hot = text(80)
    docs = [*base, *(edit(b, 1) for b in base), *(edit(b, 3) for b in base), *(edit(b, 10) for b in base[5:]), *(edit(hot, rng.randrange(4)) for _ in range(60))]
    docs += [hot + text(90) for _ in range(20)] + [b + text(5) for b in base]
    docs = [" ".join(w) for w in docs]
    cut = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) or {t} for t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if 5 * len(cut[i] & cut[j]) >= 4 * len(cut[i] | cut[j])]
    root = list(range(len(docs)))
    for _ in root:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in enumerate(docs)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, df, folder).collect()}
    assert len(near) > 100 and kept == {k for k, r in enumerate(root) if k == r}


def test_other_text_of_a_copys_id_stays(spark, folder):
    rows = [(1, "one text of two"), (2, "one text of two"), (2, "quite another text of the id")]
    df = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], SCHEMA)
    assert {(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, df, folder).collect()} == {rows[0], rows[2]}


@pytest.mark.parametrize("keys", [similar.FILTER, 0])
def test_a_group_of_edited_copies_makes_few_pairs(spark, folder, monkeypatch, keys):
    """Copies with three edits are linked by the few with none or one, whatever the others are; texts are found by hash or all shuffled."""
    monkeypatch.setattr(similar, "FILTER", keys)
    made, store = [], similar.stored

    def counted(df, label):
        out = store(df, label)
        made.append(out.count() if label == "pairs" else 0)
        return out

    monkeypatch.setattr(similar, "stored", counted)
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]

    def edit(k):
        at = set(rng.sample(range(10, 140), k))
        return [f"e{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(base)]

    docs = [" ".join(edit(k)) for k in [3] * 400 + [0, 1, 1] + [6] * 20]
    df = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in enumerate(docs)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, df, folder).collect()}
    cut = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in docs]
    root = list(range(len(docs)))
    near = [(i, j) for i in range(len(docs)) for j in range(i) if 5 * len(cut[i] & cut[j]) >= 4 * len(cut[i] | cut[j])]
    for _ in root:
        before = root.copy()
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert kept == {k for k, r in enumerate(root) if k == r}
    assert sum(made) < 20_000, made
