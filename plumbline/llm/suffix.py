"""Removal of repeated 100-byte strings by suffix sorting, over documents of any number.

A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document
with a smaller doc_id, or earlier in the same one. Strings are compared as UTF-8 bytes within
documents, on the input as it is. A full suffix array of the corpus isn't needed for that:

1. Chunks that end where a rolling hash of their own bytes says so, each taken with the
   ``width`` - 1 bytes behind it: a chunk that occurs earlier is settled, all strings that
   start in it repeat. A settled chunk never holds the first place of any string.
2. Of the other strings, each has an anchor: the place of the smallest hash of the
   ``GRAM``-byte grams in it. Equal strings have equal anchors at the same offset, so
   strings of an anchor whose hash is found once are unique.
3. The strings that are left, with an anchor's together in one stretch of text, go to the
   part of that anchor's hash. There suffixes smaller than their successors are sorted
   directly, the others are induced by bucket scans, and equal neighbours in the order,
   by common prefix, are the repeats; the smallest place of each stays.

Hot keys: within a batch only one record of a hash goes on, so none has more records than
there are batches. Anchors with over ``HOT`` places, the ``MOST_HOT`` largest of them at most,
have their strings dealt by the strings' own hash, one of equal strings from each part; an
anchor that isn't among those has under 1/``MOST_HOT`` of all places.
What is gathered in one task is bounded by the input over the number of parts, which grows
with ``spark.sql.shuffle.partitions``.

Cases: a null text is an empty text; texts shorter than ``width`` stay whole; rows with equal
doc_id and equal text are one document, and each row gets its result; rows with equal doc_id
and other texts are ordered by a hash of the text, which also deals them to different parts; a
null doc_id comes before all others. A text of any length is taken whole, in one task; an empty table
gives an empty table; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, partition_map, partitions, stored

GRAM = 24
#: A chunk has about so many bytes (a power of two).
CHUNK = 128
#: Places of an anchor from which its strings are dealt by their own hash, and such anchors at most.
HOT, MOST_HOT = 5_000, 20_000
#: Bytes that are suffix-sorted at once, unless one anchor has more.
STRETCH = 1 << 20
NONE = np.iinfo(np.int64).min  # stands for a null doc_id

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Columns of the packed records.
MARK = [("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("at", "<u8"), ("span", "<u4"), ("n", "<u4"), ("kind", "<u1")]
TEXT = [("doc", "<i8"), ("tie", "<u8"), ("size", "<u4")]
STRIP = [("h", "<u8"), ("doc", "<i8"), ("at", "<u8"), ("size", "<u4")]
RANGE = [("doc", "<i8"), ("at", "<u8"), ("span", "<u4")]
PARTS = "part int, kind int, packed binary"
#: Kinds of packed rows, and of marks: for SURE ones a batch has told that the anchor repeats.
MARKS, TEXTS, STRIPS, RANGES, HOTS = range(5)
CHUNKS, ANCHORS, SETTLED, SURE = range(4)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def home(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """What a text's part comes from: its doc_id, and its tie where doc_ids repeat."""
    return mix(doc.astype(np.uint64) ^ (tie.astype(np.uint64) * _M1))


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` numbers that hash partitioning in ``n`` parts puts in a part each."""
    rows = spark.range(64 * n).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part"))
    return np.array([r.id for r in rows.groupBy("part").agg(F.min("id").alias("id")).collect()])


def spread(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The part of each number."""
    return names[(x % np.uint64(len(names))).astype(np.int64)]


def packed(columns: dict, kinds: list, tail: bytes = b"") -> bytes:
    n = len(columns[kinds[0][0]])
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(n).tobytes(), *(np.asarray(columns[k]).astype(t).tobytes() for k, t in kinds), tail]))


def unpacked(blobs: list[bytes], kinds: list) -> tuple[dict, bytes]:
    parts, tails = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at, one = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
        for k, t in kinds:
            one[k] = np.frombuffer(raw, t, n, at)
            at += n * np.dtype(t).itemsize
        parts.append(one)
        tails.append(raw[at:])
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in kinds}, b"".join(tails)


def dealt(columns: dict, kinds: list, part: np.ndarray, kind: int, out: dict, pieces: list[bytes] | None = None) -> None:
    """Add a packed row to ``out`` for each part that ``part`` names; pieces: bytes of each record."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = order[a:b]
        out["part"].append(int(part[a]))
        out["kind"].append(kind)
        out["packed"].append(packed({k: np.asarray(columns[k])[rows] for k, _ in kinds}, kinds, b"".join([pieces[i] for i in rows.tolist()]) if pieces is not None else b""))


def fresh() -> dict:
    return {"part": [], "kind": [], "packed": []}


def words(data: bytes, order: str) -> np.ndarray:
    """The 8 bytes from each place on as a number, zeros behind the end."""
    raw, n = data + bytes(8), len(data)
    out = np.empty(n, np.uint64)
    for i in range(min(8, n)):
        v = np.frombuffer(raw, order + "u8", (len(raw) - i) // 8, i)
        q = out[i::8]
        q[:] = v[: len(q)]
    return out


def grams(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    w = words(data, "<")
    n = len(data) - GRAM + 1
    h = w[:n] * _M1
    for i in range(8, GRAM, 8):
        h ^= w[i : n + i] * _M2
        h ^= h >> np.uint64(29)
        h *= _M3
    h *= _M1
    return h ^ (h >> np.uint64(32))


def anchors(h: np.ndarray, windows: int, span: int) -> np.ndarray:
    """For each of ``windows`` starts, the leftmost place of the smallest of ``span`` hashes."""
    y = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    w = 1
    while 2 * w <= span:
        y = np.minimum(y[:-w], y[w:])
        w *= 2
    if span > w:
        y = np.minimum(y[: w - span], y[span - w :])
    return (y[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal neighbours."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    return cut[:-1], cut[1:]


def first_of(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, doc, at; whether each ordered record is the first of its keys)."""
    order = np.lexsort((at, doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    new[:1] = True
    return order, new


def mark(ids: list, texts: list[bytes], ties: list[int], width: int, names: np.ndarray) -> dict:
    """Step 1 and 2 of a batch: records of its chunks and anchors, by part of their hash."""
    found = {k: [] for k in (CHUNKS, ANCHORS)}
    seen = set()
    for doc, text, tie in zip(ids, texts, ties, strict=True):
        n = len(text) - width + 1
        if n <= 0 or (doc, tie, text) in seen:
            continue
        seen.add((doc, tie, text))
        h = grams(text)
        cut = np.flatnonzero((h[:n] & np.uint64(CHUNK - 1)) == 0)
        start = np.concatenate([[0], cut[cut > 0]])
        end = np.append(start[1:], n)
        base = np.uint64(tie << 32)
        hashes = [xxhash.xxh3_128_intdigest(text[s : e + width - 1]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        found[CHUNKS].append((np.array([x & 0xFFFFFFFFFFFFFFFF for x in hashes], np.uint64), np.array([x >> 64 for x in hashes], np.uint64), np.full(len(start), doc), start.astype(np.uint64) | base, end - start))
        place = anchors(h, n, width - GRAM + 1)
        start, end = runs(place)
        found[ANCHORS].append((h[place[start]], np.zeros(len(start), np.uint64), np.full(len(start), doc), start.astype(np.uint64) | base, end - start))
    out = fresh()
    if not found[CHUNKS]:
        return out
    h, g, doc, at, span = (np.concatenate(x) for x in zip(*found[CHUNKS], strict=True))
    order, new = first_of([h, g], doc, at)
    made = [{"h": h, "g": g, "doc": doc, "at": at, "span": span, "n": np.ones(len(h)), "kind": np.where(new, CHUNKS, SETTLED)[np.argsort(order)]}]
    h, g, doc, at, span = (np.concatenate(x) for x in zip(*found[ANCHORS], strict=True))
    order = np.argsort(h, kind="stable")
    start, end = runs(h[order])
    new = np.zeros(len(h), bool)
    new[start] = True
    made.append({"h": h[order], "g": g, "doc": doc[order], "at": at[order], "span": span[order], "n": np.repeat(end - start, end - start), "kind": np.where(new, ANCHORS, SURE)})
    one = {k: np.concatenate([m[k] for m in made]) for k, _ in MARK}
    to_hash = (one["kind"] == CHUNKS) | (one["kind"] == ANCHORS)
    dealt(one, MARK, spread(np.where(to_hash, one["h"] >> np.uint64(20), home(one["doc"], one["at"] >> np.uint64(32))), names), MARKS, out)
    return out


def of_kind(columns: dict, kind: int) -> dict:
    rows = columns["kind"] == kind
    return {k: v[rows] for k, v in columns.items()}


def met(rows: dict[int, list[bytes]], names: np.ndarray, hot: int) -> dict:
    """Steps 1 and 2 of a part: settled chunks and anchors with several places, by part of doc_id.

    Anchors with over ``hot`` places get a row as well, with their places as its part.
    """
    out = fresh()
    every, _ = unpacked(rows.get(MARKS, []), MARK)
    c = of_kind(every, CHUNKS)
    order, new = first_of([c["h"], c["g"]], c["doc"], c["at"])
    lead = order[new][np.cumsum(new) - 1]
    # a record at the first one's place is the same document twice and no repeat
    again = order[~new & ((c["doc"][order] != c["doc"][lead]) | (c["at"][order] != c["at"][lead]))]
    settled = {k: v[again] for k, v in c.items()} | {"kind": np.full(len(again), SETTLED)}
    a = of_kind(every, ANCHORS)
    order = np.argsort(a["h"], kind="stable")
    start, end = runs(a["h"][order])
    total = np.add.reduceat(a["n"][order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    for h, n in zip(a["h"][order][start][total > hot].tolist(), total[total > hot].tolist(), strict=True):
        out["part"].append(min(n, 2**31 - 1))
        out["kind"].append(HOTS)
        out["packed"].append(h.to_bytes(8, "little"))
    total = np.repeat(total, end - start)
    several = {k: v[order[total > 1]] for k, v in a.items()} | {"n": total[total > 1]}
    parted = [settled, several, of_kind(every, SETTLED), of_kind(every, SURE)]
    one = {k: np.concatenate([x[k] for x in parted]) for k, _ in MARK}
    dealt(one, MARK, spread(home(one["doc"], one["at"] >> np.uint64(32)), names), MARKS, out)
    return out


def text_rows(ids: list, texts: list[bytes], ties: list[int], names: np.ndarray) -> dict:
    """The batch's texts by part of doc_id."""
    out = fresh()
    doc = np.array(ids, np.int64)
    dealt({"doc": doc, "tie": np.array(ties, np.uint64), "size": np.array([len(t) for t in texts])}, TEXT, spread(home(doc, np.array(ties, np.uint64)), names), TEXTS, out, texts)
    return out


def texts_of(blobs: list[bytes]):
    """(doc, tie, text) of packed texts."""
    for blob in blobs:
        t, raw = unpacked([blob], TEXT)
        ends = np.cumsum(t["size"].astype(np.int64))
        for doc, tie, a, b in zip(t["doc"].tolist(), t["tie"].tolist(), (ends - t["size"]).tolist(), ends.tolist(), strict=True):
            yield doc, tie, raw[a:b]


def by_document(columns: dict) -> dict:
    """Records of each (doc, tie), with ``s``: their starts."""
    tie = columns["at"] >> np.uint64(32)
    order = np.lexsort((columns["at"], columns["doc"]))
    doc, tie = columns["doc"][order], tie[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]), [True]])) if len(doc) else np.zeros(1, np.int64)
    sorted_ = {k: v[order] for k, v in columns.items()} | {"s": (columns["at"][order] & np.uint64(0xFFFFFFFF)).astype(np.int64)}
    return {(int(doc[a]), int(tie[a])): {k: v[a:b] for k, v in sorted_.items()} for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)}


def inside(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(end, n), -1)
    return np.cumsum(d[:n]) > 0


def strips(rows: dict[int, list[bytes]], width: int, names: np.ndarray, hot: frozenset) -> dict:
    """Step 3, by part of doc_id: the stretches of anchors with several places, by part of their hash.

    Strings of hot anchors are stretches of their own; only the first of equal ones goes on.
    """
    every, _ = unpacked(rows.get(MARKS, []), MARK)
    settled = by_document(of_kind(every, SETTLED))
    several = by_document({k: v[every["kind"] != SETTLED] for k, v in every.items()})
    cut, done = [], set()
    columns = {k: [] for k, _ in STRIP}
    single = []
    for doc, tie, text in texts_of(rows.get(TEXTS, [])):
        a = several.get((doc, tie))
        if a is None or (doc, tie, text) in done:
            continue
        done.add((doc, tie, text))
        n = len(text) - width + 1
        key = np.full(n, -1, np.int64)
        span = a["span"].astype(np.int64)
        at = np.repeat(a["s"] - np.cumsum(span) + span, span) + np.arange(span.sum())
        key[at] = np.repeat(np.arange(len(span)), span)
        if (s := settled.get((doc, tie))) is not None:
            key[inside(n, s["s"], s["s"] + s["span"])] = -1
        start, end = runs(key)
        which = key[start]
        start, end, which = start[which >= 0], end[which >= 0], which[which >= 0]
        for s, e, h in zip(start.tolist(), end.tolist(), a["h"][which].tolist(), strict=True):
            own = h in hot
            for k, i, j in ((xxhash.xxh3_64_intdigest(text[i : i + width], h), i, i + 1) for i in range(s, e)) if own else ((h, s, e),):
                columns["h"].append(k)
                columns["doc"].append(doc)
                columns["at"].append(tie << 32 | i)
                columns["size"].append(j - i + width - 1)
                cut.append(text[i : j + width - 1])
                single.append(own)
    out = fresh()
    arrays = {k: np.array(columns[k], t) for k, t in STRIP}
    keep = np.ones(len(single), bool)
    one = np.flatnonzero(np.array(single, bool))
    if len(one):
        order, new = first_of([arrays["h"][one]], arrays["doc"][one], arrays["at"][one])
        again = one[order[~new]]
        keep[again] = False
        gone = {"doc": arrays["doc"][again], "at": arrays["at"][again], "span": np.ones(len(again))}
        dealt(gone, RANGE, spread(home(gone["doc"], gone["at"] >> np.uint64(32)), names), RANGES, out)
    keep = np.flatnonzero(keep)
    arrays = {k: v[keep] for k, v in arrays.items()}
    dealt(arrays, STRIP, spread(arrays["h"] >> np.uint64(20), names), STRIPS, out, [cut[i] for i in keep.tolist()])
    return out


def suffix_order(data: bytes, depth: int, w: np.ndarray) -> np.ndarray:
    """All places of ``data`` in the order of their suffixes, by the first ``depth`` bytes at least.

    Two stages: suffixes smaller than their successors are sorted directly, eight bytes at
    a time among those still equal; then a scan of the buckets of first bytes, from the
    smallest on, puts each larger suffix behind those of its bucket that came before.
    ``w``: ``words(data, ">")`` with ``depth`` + 8 zeros behind.
    """
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    rise = t[:-1].astype(np.int16) - t[1:]
    turn = np.minimum.accumulate(np.where(rise != 0, np.arange(n - 1), n)[::-1])[::-1]
    small = np.zeros(n, bool)  # smaller than its successor
    small[:-1] = np.append(rise, 1)[np.minimum(turn, n - 1)] < 0
    s = np.flatnonzero(small)
    s = s[np.argsort(w[s])]
    tied = w[s]
    new = np.ones(len(s), bool)
    new[1:] = tied[1:] != tied[:-1]
    live = np.arange(len(s))
    for d in range(8, depth, 8):
        group = np.cumsum(new) - 1
        held = np.bincount(group, minlength=1)[group] > 1
        live, group = live[held], group[held]
        if not len(live):
            break
        key = w[s[live] + d]
        order = np.lexsort((key, group))
        s[live] = s[live][order]
        key = key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
    size = np.bincount(t, minlength=256)
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(n, np.int64)
    count = np.bincount(t[s], minlength=256)
    of_small = np.concatenate([[0], np.cumsum(count)])
    head = start[:-1].copy()

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[(before >= 0)]
        before = before[~small[before]]
        c = t[before]
        order = np.argsort(c, kind="stable")
        c, before = c[order], before[order]
        counts = np.bincount(c, minlength=256)
        out[head[c] + np.arange(len(c)) - np.repeat(np.cumsum(counts) - counts, counts)] = before
        np.add(head, counts, out=head)

    induce(np.array([n]))
    for c in np.flatnonzero(size).tolist():
        at = start[c]
        while at < head[c]:
            found, at = out[at : head[c]], head[c]
            induce(found)
        own = s[of_small[c] : of_small[c + 1]]
        out[start[c + 1] - len(own) : start[c + 1]] = own
        induce(own)
    return out


def equal_neighbours(order: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    """Whether each place but the first has a common prefix of ``width`` bytes with the one before."""
    same = np.arange(1, len(order))
    for d in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        same = same[w[order[same] + d] == w[order[same - 1] + d]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[same - 1] = True
    return out


def repeats(data: bytes, size: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, at) of the strings in a text of stretches that occur earlier in it."""
    w = np.concatenate([words(data, ">"), np.zeros(width + 16, np.uint64)])
    order = suffix_order(data, width, w)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    start = end - size
    own = owner[order]
    order = order[order + width <= end[own]]
    same = equal_neighbours(order, w, width)
    run = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    held = np.bincount(run, minlength=1)[run] > 1 if len(run) else np.zeros(0, bool)
    place, run = order[held], run[held]
    own = owner[place]
    d, p = doc[own], at[own] + (place - start[own]).astype(np.uint64)
    ranked = np.lexsort((p, d, run))
    later = np.concatenate([[False], run[ranked][1:] == run[ranked][:-1]])[: len(ranked)]
    d, p = d[ranked], p[ranked]
    return d[later], p[later]


def sorted_part(rows: dict[int, list[bytes]], width: int, names: np.ndarray) -> dict:
    """Step 3, by part of hash: ranges of starts that repeat, by part of doc_id."""
    s, raw = unpacked(rows.get(STRIPS, []), STRIP)
    told, _ = unpacked(rows.get(RANGES, []), RANGE)
    out = fresh()
    size = s["size"].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    digest = xxhash.xxh3_64_intdigest
    g = np.array([digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)
    order, new = first_of([s["h"], g], s["doc"], s["at"])
    lead = order[new][np.cumsum(new) - 1]
    again = order[~new & ((s["doc"][order] != s["doc"][lead]) | (s["at"][order] != s["at"][lead]))]
    docs, ats, spans = [told["doc"], s["doc"][again]], [told["at"], s["at"][again]], [told["span"], size[again] - width + 1]
    keep = order[new]
    start, stop = runs(s["h"][keep])
    bytes_of = np.concatenate([[0], np.cumsum(size[keep])])
    piece, held = [], 0

    def sort() -> None:
        rows_ = np.array(piece)
        d, p = repeats(b"".join([raw[a:b] for a, b in zip(begin[rows_].tolist(), end[rows_].tolist(), strict=True)]), size[rows_], s["doc"][rows_], s["at"][rows_], width)
        if len(d):
            o = np.lexsort((p, d))
            d, p = d[o], p[o]
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + np.uint64(1)), [True]]))
            docs.append(d[cut[:-1]])
            ats.append(p[cut[:-1]])
            spans.append(np.diff(cut))

    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        if b - a < 2:
            continue  # all its places have the same stretch
        piece += keep[a:b].tolist()
        held += int(bytes_of[b] - bytes_of[a])
        if held >= STRETCH:
            sort()
            piece, held = [], 0
    if piece:
        sort()
    found = {"doc": np.concatenate(docs), "at": np.concatenate(ats), "span": np.concatenate(spans)}
    dealt(found, RANGE, spread(home(found["doc"], found["at"] >> np.uint64(32)), names), RANGES, out)
    return out


def cleaned(rows: dict[int, list[bytes]], width: int, as_text: bool) -> dict:
    """Of a part of doc_id: what is left of each text, and the spans that go."""
    a = of_kind(unpacked(rows.get(MARKS, []), MARK)[0], SETTLED)
    b, _ = unpacked(rows.get(RANGES, []), RANGE)
    ranges = by_document({k: np.concatenate([a[k], b[k]]) for k, _ in RANGE})
    out = {k: [] for k in ("doc_id", "tie", "n_bytes", "n_removed", "n_spans", "spans", "kept")}
    for doc, tie, text in texts_of(rows.get(TEXTS, [])):
        r, spans, kept = ranges.get((doc, tie)), [], text
        if r is not None:
            gone = inside(len(text), r["s"], r["s"] + r["span"] + width - 1)
            start, end = runs(gone)
            spans = [[x, y] for x, y, g in zip(start.tolist(), end.tolist(), gone[start].tolist(), strict=True) if g]
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        for k, v in zip(out, (None if doc == NONE else doc, tie, len(text), len(text) - len(kept), len(spans), spans, kept.decode("utf-8", "ignore") if as_text else kept), strict=True):
            out[k].append(v)
    return out


def _grouped(table: pa.Table):
    """Packed rows of each part, by kind."""
    part, kind, blob = (table[c].to_pylist() for c in ("part", "kind", "packed"))
    by: dict[int, dict[int, list[bytes]]] = {}
    for p, k, x in zip(part, kind, blob, strict=True):
        by.setdefault(p, {}).setdefault(k, []).append(x)
    return by.values()


def deduplicated(docs: DataFrame, width: int = 100, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """Each row's doc_id, tie, n_bytes, n_removed, n_spans, spans (byte ranges) and kept (bytes).

    With ``as_text`` kept is a string; what is left of characters that are cut goes.

    tie is 0 unless doc_ids repeat; then it tells texts of one doc_id apart (``text_tie``).
    """
    if width < GRAM + 8:
        raise ValueError(f"width must be {GRAM + 8} or more")
    spark = docs.sparkSession
    texts = doc_texts(docs)
    tied = not texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    names = even_keys(spark, partitions(spark, 4))

    def batch_of(batch: pa.RecordBatch):
        ids = [NONE if x is None else x for x in batch["doc_id"].to_pylist()]
        data = batch["text"].cast(pa.binary()).to_pylist()
        return ids, data, [text_tie(t) if tied else 0 for t in data]

    def over(df: DataFrame, fn) -> DataFrame:
        return partition_map(df.repartition("part"), lambda t: (x for rows in _grouped(t) if (x := fn(rows))["part"]), PARTS)

    marks = arrow_map(texts, lambda b: mark(*batch_of(b), width, names), PARTS)
    marks = stored(over(marks, lambda rows: met(rows, names, hot)), "marks")
    most = marks.where(F.col("kind") == HOTS).orderBy(F.desc("part"), "packed").limit(MOST_HOT).select("packed").collect()
    hottest = frozenset(int.from_bytes(r.packed, "little") for r in most)
    marks = marks.where(F.col("kind") == MARKS)
    whole = arrow_map(texts, lambda b: text_rows(*batch_of(b), names), PARTS)
    cut = over(marks.union(whole), lambda rows: strips(rows, width, names, hottest))
    found = stored(over(cut, lambda rows: sorted_part(rows, width, names)), "repeats")
    last = marks.union(found).union(whole)
    schema = "doc_id long, tie long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept " + ("string" if as_text else "binary")
    return partition_map(last.repartition("part"), lambda t: (cleaned(rows, width, as_text) for rows in _grouped(t)), schema)


def text_tie(text: bytes) -> int:
    """Tells texts of one doc_id apart: their CRC-32."""
    return crc32(text)
