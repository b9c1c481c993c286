import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from matchloom.llm import bpe, lines
from matchloom.llm.lines import line_classes, within, without_repeats
from matchloom.llm.minhash import near_duplicates
from matchloom.llm.packing import TextEncoder, are_ranks, best_fit_decreasing, pack, plan, sequences, tokenized_pieces
from matchloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, sequence_id string, line long"  # the last two clash with added names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def mutated(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + rng.choice("abé") + text[i:], text[:i] + text[i + 1 :], text[:i] + "z" + text[i + 1 :]])
    return text


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_banded_distance(tau):
    rng = random.Random(tau)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = mutated(rng, a, rng.randrange(5)) if rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        assert within(a, b, tau) == (edits(a, b) <= tau), (a, b)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_segments_lose_no_pair(tau):
    rng = random.Random(tau)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(8, 40)))
        b = mutated(rng, a, tau)
        if min(len(a), len(b)) < 8:
            continue
        row, key, index = lines.segment_keys([a, b], tau, 8)
        short, long = (0, 1) if len(a) <= len(b) else (1, 0)
        assert set(key[(row == short) & index]) & set(key[(row == long) & ~index])
        apart = np.abs(lines.bags([a]).astype(int) - lines.bags([b]).astype(int))
        assert np.minimum(apart, 16 - apart).sum() <= 2 * tau


def line_rows(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\n"), (3, "short\nshort\nshorx")]
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(40)).strip().ljust(30, "x") for _ in range(6)]
    for i in range(4, 40):
        rows.append((i, "\n".join(mutated(rng, rng.choice(bases), rng.randrange(4)) for _ in range(rng.randrange(5)))))
    return rows


def brute_classes(rows):
    space = " \t\n\r\x0b\x0c"
    places = [(i, n, x.strip(space)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(space)]
    texts = sorted({p[2] for p in places})
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and min(len(a), len(b)) >= 25 and edits(a, b) <= 2:
                parent[find(a)] = find(b)
    first = {}
    for i, n, t in places:
        first[find(t)] = min(first.get(find(t), (i, n)), (i, n))
    return {(i, n): first[find(t)] for i, n, t in places}


@pytest.mark.parametrize("small", [1 << 22, 1])
def test_line_classes_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "FEW", 10 if small == 1 else 500_000)
    monkeypatch.setattr(lines, "BLOCK", 3 if small == 1 else 4096)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", small != 1)
    rows = line_rows(5)
    got = line_classes(spark.createDataFrame([(i, t, "s", 9) for i, t in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.line): (r.class_doc, r.class_line) for r in got} == brute_classes(rows)
    assert all(r.kept == ((r.doc_id, r.line) == (r.class_doc, r.class_line)) for r in got)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_lines_with_one_beginning(spark):
    """20,000 lines share their first segment; every tenth has a copy with one edit."""
    rng = random.Random(4)
    tail = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(24))
    base = ["the same twelve " + tail() for _ in range(20_000)]
    rows = [(i, "\n".join(base[i : i + 100]), None, 0) for i in range(0, 20_000, 100)]
    rows += [(100_000 + i, base[i][:-1] + "#", None, 0) for i in range(0, 20_000, 10)]
    rows += [(200_000, "x" * 3_000_000, None, 0), (200_001, "x" * 2_999_999 + "y", None, 0)]  # very long lines
    got = {(r.doc_id, r.line): (r.class_doc, r.class_line) for r in line_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(100_000 + i, 0): (i - i % 100, i % 100) for i in range(0, 20_000, 10)} | {(200_001, 0): (200_000, 0)}
    assert len(got) == 22_002 and {k: v for k, v in got.items() if k != v} == want


def test_repeats_go_and_copies_stay(spark):
    a, b, c = ("first passage " * 4).strip(), ("another one " * 9).strip(), ("third of them " * 8).strip()
    rows = [(1, f"{a}\n{b}"), (2, f"{b}x\n{c}"), (3, f"{a}\n{b}"), (None, None)]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame([(i, t, "s", 9) for i, t in rows], SCHEMA)).collect()}
    assert got == {1: f"{a}\n{b}", 2: c, 3: f"{a}\n{b}", None: None}
    assert line_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_near_copies_of_one_document_keep_repeats(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    a, b, c, d = ([line() for _ in range(6)] for _ in range(4))
    own, word = line(), "some words of its own that are not found anywhere else"
    texts = {
        1: a, 2: b,
        3: [*a[:3], *b[:3], own],  # of two documents
        4: [*c, *d, *(line() for _ in range(20))],
        5: [*c[:4], word],  # around one passage of a long document
        6: [own + " end of it"] * 4,  # repeats itself
        7: [*b, line()],  # a near copy of document 2
        8: [*a[:2], *(x + " new" for x in d)], 9: [*a[:2], *(x + " new" for x in d)],  # the first one is cut, too
    }
    rows = [(i, "\n".join(t), "s", 9) for i, t in texts.items()]
    out = without_repeats(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.doc_id: r.text.split("\n") for r in out.collect()}
    whole = {i: texts[i] for i in (1, 2, 4, 7)}
    assert got == whole | {3: [own], 5: [word], 6: texts[6][:1], 8: texts[8][2:], 9: texts[8][2:]}
    assert {r.doc_id for r in near_duplicates(out).where("not kept").collect()} == {7, 9}


def test_plan_fills_sequences_without_gaps():
    rng = np.random.default_rng(1)
    for size, n in ((16, 500), (64, 3000), (32, 1), (8, 0)):
        lengths = np.minimum(size, 1 + rng.geometric(3 / size, n))
        histogram = {int(v): int(c) for v, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        made = plan(histogram, size)
        spans = {}
        for v, c in histogram.items():
            sequence, offset = made.places(np.full(c, v), np.arange(c))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                spans.setdefault(s, []).append((o, v))
        assert len(spans) == made.sequences
        for s in spans.values():
            s.sort()
            assert [o for o, _ in s] == np.cumsum([0, *[v for _, v in s[:-1]]]).tolist() and sum(v for _, v in s) <= size
        assert made.sequences <= -(-int(lengths.sum()) // size) + 1 + n // 100
    assert best_fit_decreasing({}, 8) == []


def test_text_encoder_equals_the_library():
    encode = TextEncoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    bits = ["the", "Ünï", "'s", "don't", " ", "  ", "\n", "\t", ".", ",", "x1", "<|endoftext|>", " ", "\0", "漢字", "...", "É,"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert encode(text) == np.array(encode.direct(text), "<u4").tobytes(), text
    assert encode.ranked is not None


def test_only_true_rank_tables_are_taken():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    merges = [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c")]
    assert are_ranks(merges, ranks)
    assert not are_ranks([*merges[:2], (b"a", b"bc")], ranks)  # "abc" is "ab", "c" by ranks
    assert not are_ranks([merges[1], merges[0], merges[2]], ranks)
    assert not are_ranks(merges[:2], ranks)  # a token that no merge makes
    assert are_ranks([], {b"a": 0})


def test_registered_packing_and_bpe_match_the_libraries(spark):
    import hashlib

    import tiktoken
    from tiktoken.load import load_tiktoken_bpe
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: [*own.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    at, sequences_, tokens = {}, {}, 0
    for r in QUERIES["op1_best_fit_packing"](spark, folder).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and len(ids) == r.length
        at.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences_.setdefault(r.sequence_id, []).append((r.offset, r.length))
        tokens += r.length
    assert set(at) == set(want)
    for d, pieces in at.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 1024 for _, _, n in pieces[1:])
        assert [s for _, s, _ in pieces] == np.cumsum([0, *(n for _, _, n in pieces[:-1])]).tolist() and sum(n for _, _, n in pieces) == len(want[d])
    for spans in sequences_.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist() and sum(n for _, n in spans) <= 1024
    assert len(sequences_) <= 1.02 * -(-tokens // 1024) + 1
    ranks = load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = QUERIES["op8_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, text = plain.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_packed_pieces_round_trip(spark):
    rows = [(i, "word " * (i % 37), "s", 1) for i in range(60)] + [(100, None, None, None), (101, "long text, " * 400, "s", 1)] + [(5, "word " * 5, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = 64
    pieces = tokenized_pieces(docs, P.path("byte_bpe_50k.json"), 2, size)
    pieces = pieces.withColumn("sequence_id", F.lit(1)).withColumn("base", F.lit(2)).withColumn("row", F.lit(3))  # clash
    placed = pack(pieces, size).cache()
    encode = TextEncoder(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t, _, _ in rows:
        want[i] = encode(t or "") + np.array([2], "<u4").tobytes()
    by_doc = {}
    for r in placed.collect():
        assert r.length == size or r.piece == 0
        assert want[r.doc_id][4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids)
        by_doc.setdefault(r.doc_id, []).append(r.length)
    assert {d: sum(x) for d, x in by_doc.items()} == {d: len(w) // 4 * (2 if d == 5 else 1) for d, w in want.items()}
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(placed).collect()}
    for r in placed.withColumn("c", F.crc32("ids")).collect():
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.c
    assert pack(pieces.limit(0), size).count() == 0


def test_bpe_parts_and_round_trip(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = bpe.encoding(path, P.PATTERN)
    rng = random.Random(4)
    bits = ["the ", "Ünï", "don't", "  ", "\n\n", "\t", "?! ", "x1 ", "<|endoftext|>", " ", "漢字", "'s", " \n", "a"]
    for _ in range(200):
        text = "".join(rng.choice(bits) for _ in range(300))
        assert "".join(bpe.parts(text, 50)) == text
        assert [i for p in bpe.parts(text, 50) for i in e.encode_ordinary(p)] == e.encode_ordinary(text)
    rows = [(1, "été " * 30000, "s", 1), (2, None, "s", 1), (3, "", None, None), (None, "a\0b", "s", 1), (2, None, "s", 1)]
    got = bpe.decoded(bpe.encoded(spark.createDataFrame(rows, SCHEMA), path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in got) == sorted((t or "").encode() for _, t, _, _ in rows)
