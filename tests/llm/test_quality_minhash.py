import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchloom.llm.components import components
from matchloom.llm.minhash import BANDS, ROWS, _across, near_duplicates
from matchloom.llm.quality import quality_filter, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Ab", "é#", "x", "ÑU", "w|", "lo", "q9", "zz"]
    out = [None, "", " \n\t", "a", "a b a b a b", "x\r\nx\x0bx", "a b c d a b c"]
    for _ in range(n):
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " ", "\n\n"]) for _ in range(rng.randrange(120))))
    return out


def test_base_counts_match_brute_force(spark):
    rows = [(i, t, "en", "h", 0) for i, t in enumerate(texts(1, 80))]
    rows += [(500, "w " * 30000 + "v", None, None, None), rows[9]]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("kept", "n_words", "host", "id", "key", "_key", "lines", "text_"):  # clashing columns play no part
        docs = docs.withColumn(name, F.lit(1))
    got = quality_rules(docs).collect()
    assert len(got) == len(rows)
    want = {r[0]: base(r[1]) for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def normal(line):
    return re.sub(r"[\W_]+", " ", re.sub("[1-9]", "0", line.lower())).strip()


def verdicts(rows):
    """(words_removed, kept, text left) of every row, by brute force."""
    held, at_host = {}, Counter()
    for _, t, _, host, _ in rows:
        lines = {normal(x) for x in (t or "").split("\n")} - {""}
        at_host[host or ""] += 1
        for x in lines:
            held.setdefault((host or "", x), set()).add(frozenset(lines))
    out = []
    for i, t, _, host, _ in rows:
        lines = (t or "").split("\n")
        often = lambda x: len(held.get((host or "", normal(x)), ())) > max(20, min(0.02 * at_host[host or ""], 200))  # noqa: B023, E731
        gone, b = sum(len(WORD.findall(x)) for x in lines if often(x)), base(t)
        left = "\n".join(x for x in lines if not often(x))
        out.append((i, gone, not b[5] and b[0] - gone >= 0.3 * b[0], left))
    return out


def test_verdicts_match_brute_force_on_a_hot_host(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    often = [" ".join(rng.sample(words, 30)) for _ in range(6)]
    rows = []
    for i in range(1500):
        host = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        lines = [" ".join(rng.sample(words, rng.randrange(1, 40))) for _ in range(rng.randrange(3))]
        lines += [f"{x}, {rng.randrange(10)}!" for j, x in enumerate(often) if rng.random() < (0.3, 0.1, 0.05, 0.03, 0.02, 0.01)[j]]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", host, 0))
    rows += [(5000 + i, rows[0][1], "en", "hot", 0) for i in range(60)] + [(9000 + i, often[5], "en", "hot", 0) for i in range(40)]
    rows += [rows[3], (9999, None, None, None, None)]
    docs, want = spark.createDataFrame(rows, SCHEMA), verdicts(rows)
    got = quality_rules(docs)
    assert sorted((r.doc_id, r.words_removed, r.kept) for r in got.collect()) == sorted(w[:3] for w in want)
    assert sum(w[1] > 0 for w in want) > 100 and any(w[1] and not w[2] and not base(r[1])[5] for w, r in zip(want, rows))
    assert got.where("kept and n_words > 60").count() == sum(w[2] and base(r[1])[0] > 60 for w, r in zip(want, rows))
    clash = docs.withColumn("row", F.lit(1)).withColumn("_rest", F.lit(2)).withColumn("kept", F.lit(3)).withColumn("a.b", F.lit(4))
    left = quality_filter(clash)
    assert left.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted((w[0], w[3]) for w in want if w[2])


def test_frequent_lines_deplete_junk_but_not_copies(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    rng = random.Random(3)
    line = " ".join(words[:80])
    clean = " ".join(rng.sample(words, 70)) + "\n" + " ".join(rng.sample(words, 40))
    rows = []
    for i in range(60):
        rows.append((i, line + "\n" + " ".join(rng.sample(words, 8)), "en", "host", 0))  # mostly the frequent line
        rows.append((100 + i, " ".join(rng.sample(words, 90)) + "\n" + " ".join(rng.sample(words, 9)), "en", "host", 0))
        rows.append((200 + i, clean, "en", "host", 0))  # copies of a clean text
        rows.append((300 + i, line + "\n" + " ".join(rng.sample(words, 90)), "en", "host", 0))  # enough is left
    left = {r.doc_id: r.text for r in quality_filter(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(left) == {k + i for k in (100, 200, 300) for i in range(60)}
    assert line not in left[300] and left[200] == clean


def test_lines_shared_by_many_documents_are_frequent_whatever_else_they_share(spark):
    line = lambda i: f"line {chr(97 + i // 26)}{chr(97 + i % 26)} of a template"
    shared, clean = "\n".join(map(line, range(20))), "\n".join(map(line, range(600, 610)))
    rows = [(i, f"{shared}\n{line(100 + i)}", "en", "host", 0) for i in range(100)]
    rows += [(200 + i, clean.upper() + "\n" * (i % 3), "en", "host", 0) for i in range(100)]  # copies
    got = {r.doc_id: r.words_removed for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: 100 for i in range(100)} | {200 + i: 0 for i in range(100)}


def test_quality_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules(empty).count() == 0 and quality_filter(empty).count() == 0


def jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, n = [(0, None), (1, ""), (2, " "), (3, "one two"), (4, "ONE  two"), (5, "one two three")], 10
    for _ in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([12, 80, 300]))]
        for _ in range(12):
            edited = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in text]
            rows.append((n, " ".join(edited)))
            n += 1
            if rng.random() < 0.3:
                rows.append((n, "\n".join(edited).upper().replace("V", "v")))
                n += 1
    return rows


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr("matchloom.llm.minhash.BLOCK", 3)
    rows = variants(3)
    got = near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_first_shared_band_is_that_of_full_minima():
    low = np.arange(ROWS * BANDS, dtype="<u4").reshape(BANDS, ROWS)
    other = low.copy()
    other[:5] += 1
    other[2] = low[2] + 256  # last bytes agree by chance, minima don't
    rows = pd.DataFrame({"id": [1, 2], "comp": [1, 2], "band": 5, "i": 0, "j": 0, "block": 0, "n_shingles": 40})
    rows["sig"] = [x.tobytes() for x in (low, other)]
    rows["tiny"] = [x.astype(np.uint8).tobytes() for x in (low, other)]
    rows["hashes"] = [np.arange(40, dtype=np.uint64).tobytes()] * 2
    assert _across(rows, 75).values.tolist() == [[1, 2]]
    assert _across(rows.assign(band=6), 75).empty


def test_near_duplicates_edges(spark):
    text = " ".join(map(str, range(40)))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, "only here"), (9, "only there"), (9, text + " more")]
    got = near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted(
        [("7", "3", False)] * 2 + [("3", "3", True), ("None", "3", False), ("None", "None", True)] + [("9", "3", False)] * 2
    )
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_on_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}
