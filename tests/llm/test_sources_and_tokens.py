"""op11, op12 and op13 against loops over all rows, by the tokenizers' own libraries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment, divergence, token_files
from plumbline.llm.queries import BPE, PIECE

ODD = [None, "", " ", "  ", "a", " a", "a ", "  two  spaces  ", "tab\tand\nlines\r\n\n", "<|endoftext|> <s></s> <0x41> <unk>", "naïve façade — 東京 北京大学 😀😃👨‍👩‍👧", "a▁b", "x" * 700, "ab " * 900, "１２３ ﬁ é", "# hash #", "  x", "it's we'll 123,456.78 !!!???"]


def rows(spark, texts, **more):
    fields = "doc_id long, text string" + "".join(f", {k} string" for k in more)
    return spark.createDataFrame([(i * 7 - 20, x, *more.values()) for i, x in enumerate(texts)], fields).repartition(3)


@pytest.fixture(scope="module")
def texts():
    import random

    deal = random.Random(5)
    alphabet = ["the", "of", "Zug", "où", "123", "\n", "  ", "é", "東京", "!", "<s>", "😀", "tion", "un", "'s", "\t", "ß"]
    return ODD + ["".join(deal.choice(alphabet) + deal.choice(["", " ", " ", " "]) for _ in range(deal.randint(1, 60))) for _ in range(150)]


def groups_by_offsets(first, second):
    """Groups from the byte offsets at which both runs of tokens end."""
    ends = []
    for run in (first, second):
        at, found = 0, []
        for _, b in run:
            at += len(b)
            found.append(at)
        ends.append(found)
    both, made = sorted(set(ends[0]) & set(ends[1])), []
    for lo, hi in zip([0, *both], both):
        made.append([[i for (i, _), e in zip(run, es, strict=True) if lo < e <= hi] for run, es in zip((first, second), ends, strict=True)])
    return made


def loops(texts):
    """op12's rows but for doc_id, from all tokens' offsets."""
    one, two = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    one.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
    out = []
    for text in texts:
        a = [(i, bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        fine = text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        out.append((a, b, groups_by_offsets(a, b)) if fine else ([], [], []))
    links = [[(g[0][-1], g[1][-1]) for g in groups] for _, _, groups in out]
    count = Counter(x for pairs in links for x in pairs)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    found = []
    for (a, b, groups), pairs in zip(out, links, strict=True):
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((len(a), len(b), len(groups), len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return found


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 0])
def test_alignment_equals_loops(spark, texts, broadcast):
    got = alignment.alignments(rows(spark, texts, row="x", pairs="y", n_a="z"), BPE, PIECE, broadcast)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == [(i * 7 - 20, *x) for i, x in enumerate(loops(texts))]


def test_alignment_of_no_and_repeated_rows(spark):
    assert alignment.alignments(rows(spark, []), BPE, PIECE).collect() == []
    got = alignment.alignments(spark.createDataFrame([(None, "same text"), (None, "same text"), (1, None)], "doc_id long, text string"), BPE, PIECE).collect()
    assert len(got) == 3 and len({tuple(r) for r in got}) == 2


def test_transducer_forgets_and_checks():
    small = alignment.Transducer([b"a", b"ab", b"c"], [b"b", b"abc", b"a"], most=0)
    for _ in range(3):
        assert small.groups([1, 2, 0], [1, 2]) == ([2, 3], [1, 2])
    with pytest.raises(ValueError, match="different bytes"):
        small.groups([2], [0])
    with pytest.raises(ValueError, match="no bytes"):
        alignment.Transducer([b""], [b"a"])


def test_pieces_by_chunks(texts):
    pieces, whole = alignment.Pieces(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert pieces.apart
    for text in filter(None, texts):
        assert np.frombuffer(pieces.encode(text), "<u4").tolist() == whole.encode(text)


def test_token_files_equal_library(spark, texts, tmp_path):
    whole = Tokenizer.from_file(BPE)
    files = token_files.write(rows(spark, texts, ids="x", _row="y", start="z"), BPE, f"file://{tmp_path}/out", length=64, parts=5)
    got = sorted(token_files.documents(files).collect())
    at, stream = 0, []
    for i, (row, text) in enumerate(zip(got, texts, strict=True)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start) == (i * 7 - 20, at)
        assert zlib.crc32(bytes(row.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
        stream += ids
    # random access: all sequences, in any order, give the stream; ids are views of the map
    rows_of = files.collect()
    s, found = token_files.Sequences(rows_of, most=2), {}
    for k in np.random.default_rng(0).permutation(len(s)).tolist():
        ids, mask = s[k]
        assert len(ids) == len(mask) == 64 and not ids.flags.owndata and not ids.flags.writeable and ids.dtype == np.uint16
        assert not ids[~mask].any()
        found[k] = ids[mask].tolist()
    assert [i for k in range(len(s)) for i in found[k]] == stream
    assert len(s) == sum(-(-r.n_tokens // 64) for r in rows_of)
    with pytest.raises(IndexError):
        s[len(s)]


def test_token_files_of_odd_tables(spark, tmp_path):
    none = token_files.write(rows(spark, []), BPE, f"file://{tmp_path}/none")
    assert none.collect() == [] and token_files.documents(none).collect() == [] and len(token_files.Sequences(none.collect())) == 0
    same = spark.createDataFrame([(None, "b"), (3, "same"), (None, "a"), (3, "same"), (3, None)], "doc_id long, text string").coalesce(1)
    got = token_files.documents(token_files.write(same, BPE, parts=2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3]
    assert [len(r.ids) // 4 for r in got] == [2, 2, 2, 2, 1] and [r.start for r in got] == [0, 2, 4, 6, 8]


def test_token_files_with_wide_ids(tmp_path):
    import pyarrow as pa

    with pa.OSFile(f"{tmp_path}/x", "wb") as sink:
        out = token_files._Writer(sink, 4, True)
        out.put(np.arange(70_000, 70_000 + 4 * token_files.AT_ONCE + 3, dtype=np.uint32))
        out.close()
    assert out.sequences == token_files.AT_ONCE + 1
    with pa.memory_map(f"{tmp_path}/x") as source:
        flow = token_files._Flow(source)
        assert flow.take(5).tolist() == [*range(70_000, 70_005)] and flow.take(4 * token_files.AT_ONCE - 2)[-1] == 70_000 + 4 * token_files.AT_ONCE + 2


def audited(table, least=3, most=200):
    """op11's rows by loops over all terms of all groups."""
    docs = [tuple(x or "" for x in r) for r in table]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {r[0] for r in docs}:
        of = [(s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for x, s, t in docs if x == lang]
        kept = [t for t, n in Counter(w for _, ws in of for w in set(ws)).items() if n >= least]
        v = len(kept)
        groups = {s: Counter() for s, _ in of}
        for s, ws in of:
            groups[s].update(w for w in ws if w in kept)
        total = sum(groups.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept} for s, c in groups.items()}
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(total.values()) + v) for t in kept}
        for a in groups:
            pairs = [(-sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b.encode()) for b in groups if b != a]
            terms = [(-((p[a][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[a][t] and p[a][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, a, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def test_divergence_equals_loops(spark):
    deal = np.random.default_rng(3)
    some = ["alpha", "Beta", "été", "naïve", "x1y", "don't", "東京", "😀", "ΑΒΓ", "once", "Ärger", "ÄRGER", "z"]
    table = [(lang, f"s{k % n}", " ".join(deal.choice(some, deal.integers(0, 30)))) for lang, n in (("en", 6), ("de", 2), ("one", 1)) for k in range(40)]
    table += [("en", None, None), (None, "s1", "alpha"), (None, "s2", "beta beta"), ("xx", "a", "rare"), ("xx", "b", "words"), ("en", "s1", "alpha " * 5000)] + [("en", "hot", "alpha Beta\x7fgamma")] * 30
    docs = spark.createDataFrame([(*r, "c") for r in table], "lang string, source string, text string, term string").repartition(5)
    for least, most in ((3, 200), (1, 2)):
        got = divergence.audit(docs, least, most)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == audited(table, least, most)


def test_divergence_of_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_messages_of_one_turn_have_links_of_their_own(spark):
    from plumbline.llm import quotes

    rows = [(1, 0, "user", "a question that is long enough to quote", 7), (1, 1, "user", "> a question that is long enough to quote\n\nan answer", 7), (1, 1, "user", "no quote here at all", 7), (1, None, "user", "> a question that is long enough to quote", 7), (2, 1, "user", "another conversation", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _row int").repartition(3)
    got = {(r.conv_id, r.turn, r.own_text): (r.original_turn, r.parent_turn, r.thread_turn) for r in quotes.linked(df).collect()}
    assert len(got) == 5
    assert got[1, 1, "an answer"] == (0, 0, 0) and got[1, 1, "no quote here at all"] == (None, None, 0)
    assert got[1, None, ""][1] is None and got[2, 1, "another conversation"] == (None, None, 1)
