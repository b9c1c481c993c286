import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from matchloom.llm import ann, chat, sharding, urls, warc
from matchloom.llm.queries import QUERIES
from matchloom.llm.storage import new_path

TOKENIZER = P.path("byte_bpe_50k.json")
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/f", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"] or [len(tail)])]
    best = None
    for entry, _ in RULES:
        at, start = entry.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(entry) > len(best)):
            best = entry
    return host, path, best


def test_urls_match_brute_force(spark):
    given = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://a.example.com/en/2", "http://example.com/EN/3", "ftp://x.net/es/",
        "http://x.net/fr/a#b", "http://notexample.com/en/", "http://net/es/q", "a://b://c.com/", "http://x.org/p?q", "http://com?x/en/", "http://x.org/listed",
        "http://x.org/listed?again", "http://example.com./en/", "http://ünï.example.com/en/é", "http://a.b/c\nd",
    ]
    rows = [(i, u, "clash") for i, u in enumerate(given)] + [(4, given[4], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("x.org/listed",), ("x.org/other",), (None,)], "url string")
    got = urls.judge(pages, urls.rules(spark, RULES), page_list=listed).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (dict(RULES)[rule] if rule else "block" if host + path == "x.org/listed" else "allow")
    assert urls.judge(pages.limit(0), urls.rules(spark, RULES)).count() == 0
    assert {r.verdict for r in urls.judge(pages, urls.rules(spark, [])).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    blocks = 3000 * urls.BITS // 256
    made = urls.bloom(keys, "key", blocks).cache()
    assert urls.passes(keys, "key", made, blocks).count() == 3000
    others = spark.range(20000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("key"))
    assert urls.passes(others, "key", made, blocks).count() < 100


def test_escape_is_reversible():
    rng = random.Random(1)
    bits = [*chat.MARKS, chat.ESCAPE, "[", "INST]", "<", "s>", "/", "a", "", "[" + chat.ESCAPE + "INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(m in safe for m in chat.MARKS)


def test_chat_round_trip(spark):
    long = "é [INST] " * 5000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "assistant", None), (2, 5, "", "x"), (2, 1, "tool", chat.ESCAPE), (None, 0, "assistant", "z")]
    rows += [(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))] + [(3, None, None, "last"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    made = chat.segments(turns, TOKENIZER)
    got = {r.conv_id: r for r in chat.read_back(made, TOKENIZER).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = {r.conv_id: r for r in chat.conversations(made).collect()}[-1]
    ids = np.frombuffer(bytes(one.ids), "<i4").tolist()
    text = "".join(chat.decode(ids[s.start : s.start + s.length], TOKENIZER) for s in one.loss_spans)
    assert chat.unescape(text) == "</s>[INST] ok [/INST]"
    assert chat.read_back(chat.segments(turns.limit(0), TOKENIZER), TOKENIZER).count() == 0


def test_shards(spark):
    tree = sharding.balanced(16)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot"), F.lit(1).alias("_note"))
    docs = docs.unionByName(docs.limit(40)).unionByName(spark.createDataFrame([(None, "x", 1)] * 3, "doc_id long, slot string, _note int"))
    got = sharding.shard(docs, tree, more=sharding.grown(tree)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert all(150 < len(s) < 360 for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in got) / len(got)
    assert 0.03 < moved < 0.09
    other = sharding.shard(docs, sharding.reweighted(tree, 3, 0.0)).collect()
    stays = {r.doc_id: r.shard for r in got}
    assert all(r.shard != 3 for r in other)
    assert all(r.shard == stays[r.doc_id] or stays[r.doc_id] // 8 == 0 for r in other if r.doc_id is not None)
    assert sharding.shard(docs.limit(0), tree).count() == 0


def test_registered_shards_match_brute_force(spark):
    import math

    import xxhash

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}

    def draw(path, weight, key):
        seed = xxhash.xxh64_intdigest(path.encode(), seed=42)
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=seed)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    def place(doc, tree):
        key = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), seed=42)
        left, path = list(tree), ""
        for level in ("region", "rack", "shard"):
            names = sorted({str(getattr(x, level)) for x in left})
            if len(names) > 1:
                weigh = lambda n, members=left, by=level: sum(x.weight for x in members if str(getattr(x, by)) == n)
                names = [min(names, key=lambda n, p=path: draw(f"{p}/{n}", weigh(n), key))]
            left, path = [x for x in left if str(getattr(x, level)) == names[0]], f"{path}/{names[0]}"
        return left[0].shard

    tree, slots = sharding.balanced(16), {}
    got = QUERIES["op5_sharding"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert (r.shard, r.grown_shard) == (place(r.doc_id, tree), place(r.doc_id, sharding.grown(tree)))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_tasks_roll_over_to_new_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "WRITERS", 2)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    path = new_path(spark, "test-roll")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).select("record_id", "path").collect()
    assert len({r.record_id for r in got}) == len(got) == 3000 and len({r.path for r in got}) > 20


def test_chain_rejects_what_it_does_not_reach():
    offset, successor = np.array([0, 10, 25, 30, 50, 70]), np.array([10, 30, 50, 70, 60, 99])
    assert warc.reached(offset, successor).tolist() == [True, True, False, True, False, True]
    assert warc.reached(np.array([5]), np.array([9])).tolist() == [False]


def test_warc_round_trip(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    big = "é" * 700
    rows = [(1, "http://a b", fake * 20), (2, None, None), (3, "u\n", ""), (4, "x", big), (5, "x", big), (9, "x", big), (9, "x", big), (None, "x", big)]
    rows += [(6, "x", fake * 20), (7, "x", "short"), (8, "x", "short"), (10, "x", "z" * 300_000)]
    path = new_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, size int"), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        r = by[f"<urn:page:{'null' if i is None else i}>"][0]
        revisit = {4: 9, 5: 9, None: 9, 1: 6}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", f"<urn:page:{revisit}>") if revisit else ("response", None))
        assert r.size == len(data) and r.digest == "sha1:" + hashlib.sha1(data).hexdigest()
        assert bytes(r.payload) == (b"" if revisit else data)
    empty = new_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 20))
    x[100:160] = x[7]  # a common vector
    x[200:230] = x[7] + rng.normal(size=(30, 20)) * 0.01
    rows = [(i, v.tolist(), 0.5) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0.5)]
    rows += [(900, None, 0.0), (901, [0.0] * 20, 0.0), (902, [float("nan")] * 20, 0.0), (903, [1.0] * 5, 0.0), (904, [None] * 20, 0.0), (None, [1.0] * 20, 0.0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    asked = spark.createDataFrame([(i,) for i in (0, 7, 100, 200, 399, 901)], "vec_id long")
    got = {}
    for r in ann.nearest(vectors, asked, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 7, 100, 200, 399}
    hits = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in found)
        hits += len(set(order) & {i for _, i, _ in found})
        if q in (7, 100):
            assert [i for _, i, _ in found] == order
    assert hits >= 45
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, few.where("vec_id = 1"), 10).collect()] == [(1, 2)]
    assert ann.nearest(vectors.limit(0), asked, 10).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in QUERIES["op7_approximate_nearest_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (f[2], f[1]))
        assert all(abs(d[ids == i][0] - s) < 1e-9 for _, i, s in found)
        hits += len(set(order) & {i for _, i, _ in found})
    assert hits >= 0.95 * 10 * len(got)


def test_hashes_lengthen_with_the_table():
    sizes = [np.prod([2 * a for a in ann.axes(n, 64)]) for n in (1, 1000, 10_000, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] == 8192 < sizes[3] < sizes[4]
    x = ann.unit(np.random.default_rng(1).normal(size=(20, 50)))
    for n in (1, 300, 10**5, 10**8):  # the combination that loses least is the row's own
        each = ann.axes(n, x.shape[1])
        first, rest = ann.probes(x, 3, each, 64)
        own = ann.hashes(x, 3, each)
        assert (first[:, 0] == own[0]).all() and (rest[:, 0] == own[1]).all()
        assert all(len(set(zip(a, b))) == len(a) for a, b in zip(first.tolist(), rest.tolist()))


def test_few_rows_are_found_whatever_the_probes(spark, monkeypatch):
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "TABLES", 1)
    x = np.random.default_rng(2).normal(size=(40, 32))
    vectors = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, gid int")
    got = ann.nearest(vectors, vectors.where("vec_id < 5").select("vec_id"), 10).collect()
    assert len(got) == 50
    y = x.astype(np.float32).astype(float)
    for r in got:
        d = np.sqrt(((y - y[r.query_id]) ** 2).sum(axis=1))
        assert [i for i in np.lexsort((np.arange(40), d)) if i != r.query_id][r.rank - 1] == r.vec_id


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["w" + "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [text(80) + "\n" + text(40) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[0], "en", "s1", 0) for i in range(5)]  # exact copies
    rows += [(200, clean[1].replace(" ", "  ", 5).upper(), "en", "s1", 0), (300, "too short", "en", "s1", 0), (301, None, None, None, None)]
    shared = text(60)
    rows += [(400 + i, f"{text(90)}\n{shared}", "en", "s2", 0) for i in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.dtypes == docs.dtypes
        docs, after[name] = out, {r.doc_id: r.text for r in out.collect()}
    assert set(after["quality_rules"]) == {r[0] for r in rows} - {300, 301}
    assert shared in after["line_dedup"][400] and shared not in after["line_dedup"][401]
    assert set(after["minhash_near_dedup"]) == set(range(12)) | {400, 401}
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == set(after["minhash_near_dedup"])
    assert all(0 <= r.offset and r.offset + r.length <= 1024 for r in placed)


def test_pipeline_stages_take_any_columns_and_empty_tables(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = ["w" + "".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(3000)]
    long, other = (" ".join(rng.sample(words, n)) for n in (3000, 300))
    rows = [(1, long * 20, "en", "a", 1), (2, other, None, None, None), (2, other, None, None, None), (3, other, "en", "a", 3), (None, other, "en", "a", 3)]
    rows += [(None, None, None, None, None), (5, "", "en", "a", 0), (6, other + "\n" + " ".join(rng.sample(words, 120)), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "key", "id", "doc", "of", "part", "lines", "line", "kept", "h", "c", "length", "sequence_id", "a.b", "component_id"):
        docs = docs.withColumn(name, F.lit(7))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        left[name] = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert [x for x, _ in left["quality_rules"]] == [0, 2, 2, 3, 6]  # the long text repeats its windows
    assert [x for x, _ in left["line_dedup"]] == sorted(r[0] or 0 for r in rows)
    assert [x for x, _ in left["minhash_near_dedup"]] == [0, 0, 1, 2, 5, 6]
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()) > len(rows)
