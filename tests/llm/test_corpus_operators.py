"""Archives, shards, classifier, language model, syncmers, pipeline."""

import gzip
import hashlib
import math
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from waymark.llm import lm, sharding, syncmers, toxicity, warc

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "u5", big), (3, "u\n3", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (3, "u\n3", big), (None, "n", "é" * 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).withColumn("digest", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_normaliser_handles_breaks_and_members(tmp_path):
    recs = [warc.record_bytes(str(k), "http://a", b"payload %d" % k * 50, "d", "response", None, 10) for k in range(5)]
    whole = gzip.compress(b"".join(recs[:3])) + gzip.compress(b"".join(recs[3:]))
    (tmp_path / "a.gz").write_bytes(whole)
    index = warc.normalise_file(f"file://{tmp_path}/a.gz", f"file://{tmp_path}/b.gz")
    assert [x["status"] for x in index] == ["ok"] * 5
    with open(tmp_path / "b.gz", "rb") as f:
        for k in (4, 0, 2):
            head, payload = warc.read_member(f, index[k]["offset"], index[k]["length"])
            assert payload == b"payload %d" % k * 50 and head["warc-page-id"] == str(k)
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"".join(recs))[:-60])
    index = warc.normalise_file(f"file://{tmp_path}/c.gz", f"file://{tmp_path}/d.gz")
    assert index[-1]["status"] == "truncated" and all(x["status"] == "ok" for x in index[:-1])


def test_warc_faults(spark, tmp_path):
    """Streams that cannot be inflated get a status; wrong digests and lost responses raise."""
    rec = warc.record_bytes("1", None, b"p" * 50, "d", "response", None, 50)
    whole = bytearray(gzip.compress(rec))
    whole[-8] ^= 255  # the check sum
    (tmp_path / "e.gz").write_bytes(bytes(whole))
    (tmp_path / "f.gz").write_bytes(gzip.compress(b"no record at all\r\n\r\n"))
    for name in "ef":
        assert warc.normalise_file(f"file://{tmp_path}/{name}.gz", f"file://{tmp_path}/{name}2.gz")[-1]["status"] == "corrupt"
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, checked boolean"
    good = [("1", 200, "x", "response", None, True), ("2", 9, "x", "revisit", "1", True)]
    assert {r.page_id: r.payload_bytes for r in warc.resolved(spark.createDataFrame(good, schema)).collect()} == {"1": 200, "2": 200}
    for bad in ([("1", 5, "x", "response", None, False)], [("2", 9, "y", "revisit", "1", True), good[0]]):
        with pytest.raises(Exception, match="page"):
            warc.resolved(spark.createDataFrame(bad, schema)).collect()


def test_sharding(spark):
    texts = [f"text {k}" for k in range(150)] + [f"copy {k // 4}" for k in range(80)] + ["hot"] * 90 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("shard", F.lit("clash"))
    rows = sharding.assign(df, shards=6).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and set(sizes) == set(range(6)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "rows", None)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(where[f"copy {k}"]) == 1 for k in range(20)) >= 20 - 5  # a border between two shards cuts one group at most
    assert len(where["hot"]) < 6  # 90 rows, and 53 or 54 a shard
    assert sharding.assign(df.limit(0)).count() == 0
    assert sharding.assign(df.filter("doc_id < 3")).count() == 3


@pytest.mark.parametrize("hot", [2000, 1])
def test_sharding_cuts_few_groups(spark, monkeypatch, hot):
    """Groups of five over 24 shards: as many cuts as borders, at most twice; also with hot keys joined apart and split buckets; texts of any kind."""
    monkeypatch.setattr(sharding, "HOT_KEYS", hot)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    texts = [f"group {k // 5}" for k in range(2000)] + ["big"] * 1100 + ["x" * 3_000_000, None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = sharding.assign(df).collect()
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(where[f"group {k}"]) > 1 for k in range(400)) <= 46
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


@pytest.mark.parametrize("shape", ["cliques", "stars"])
def test_propagation_cuts_links(spark, shape):
    """From hashed shards, with nearly all links cut: nodes move in every round while cuts fall, at most a tenth stays cut, and shards keep to their capacity or their start."""
    if shape == "cliques":
        count, size = 60, 8
        links = [(c * size + a, c * size + b) for c in range(count) for a in range(size) for b in range(a)] + [(c * size, (c + 1) % count * size) for c in range(count)]
    else:
        count, size = 150, 5
        links = [(c * size + a, c * size) for c in range(count) for a in range(1, size)]
    total, shards = count * size + 300, 6
    nodes = spark.range(total).withColumnRenamed("id", "nid")
    edges = spark.createDataFrame([(max(e), min(e)) for e in links], "src long, dst long")
    members = sharding.pair_groups(edges) if shape == "cliques" else spark.createDataFrame([(n, n // size) for n in range(count * size)], "nid long, group long")
    report = []
    labels = sharding.propagate(nodes, members, total, shards, report=report)
    before, after = report[0][1], min(c for _, c in report)
    assert report[0][0] == 0 and before >= 0.5 * (len(links) if shape == "cliques" else count * (size - 1)) and after <= 0.1 * before
    assert all(m > 0 for m, _ in report[1:3]) and report[1][1] < before
    started, found = sharding.cut_links(sharding.propagate(nodes, members, total, shards, 0), edges).first(), sharding.cut_links(labels, edges).first()
    assert found.links == len(links) and started.cut >= 0.7 * len(links) and found.cut <= 0.1 * started.cut and labels.count() == total == labels.select("nid").distinct().count()
    own = labels.filter(F.col("nid") < count * size).groupBy("shard").count().collect()
    assert max(r["count"] for r in own) <= total / shards * (1 + sharding.SLACK) + size


def test_propagation_breaks_ties(spark):
    """A node with one neighbour in each of two shards proposes the one of smaller number; a full shard is not proposed."""
    at = spark.createDataFrame([(0, 7, 5), (1, 7, 3), (0, 8, 5), (2, 8, 1)], "nid long, group long, now int")
    none = spark.createDataFrame([], "group long")
    for full, want in ((None, {1}), (1, {3})):
        sizes = spark.createDataFrame([(s, 10 if s == full else 1) for s in (1, 3, 5)], "shard int, size long")
        heard = sharding._heard(at, sizes, 10.0)
        assert {r.target for number in range(12) for r in sharding._wishes(at, heard, none, number).filter("nid = 0").collect()} == want


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    """One id with very many rows does not enlarge the fit."""
    rows = [(1, f"awful words number {k}") for k in range(3000)] + [(k, f"kind words {k}") for k in range(2, 60)] + [(k, f"awful idiots {k}") for k in range(60, 90)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, int(i == 1 or i >= 60)) for i in {r[0] for r in rows}], "doc_id long, toxic int")
    sizes = spark.sparkContext.accumulator(0)
    real = toxicity.fit_weights

    def counted(rows, *a):
        sizes.add(len(rows))
        return real(rows, *a)

    monkeypatch.setattr(toxicity, "fit_weights", counted)
    toxicity.train(docs, labels, sample_per_class=10)
    assert 0 < sizes.value <= 20


def test_toxicity_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0)], d.schema)
    got = toxicity.scored_documents(d.union(extra).withColumn("score", F.lit("clash")), labels).cache()
    assert got.count() == d.count() + 2 and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert len({r.score for r in got.filter("doc_id < 0").collect()}) == 1
    j = got.filter("held_out").join(labels, "doc_id").collect()
    wrong = sum(r.predicted != r.toxic for r in j)
    assert len(j) > 80 and wrong <= 0.08 * len(j)
    none = toxicity.scored_documents(d.limit(20), labels.limit(0))
    assert {r.predicted for r in none.collect()} == {0}
    assert toxicity.without_toxic(d, labels).columns == d.columns
    assert toxicity.scored_documents(d.limit(0), labels).count() == 0


def brute_scores(texts, remainder):
    """Deleted interpolation from its definition: dictionaries of counts, EM over single held-out tokens. texts: one of each document."""
    tokens = [[*(t or "").lower().split(), "\n"] for t in texts]
    grams = lambda w: list(zip(["\t", *w], w))

    def counts(docs):
        one, two = Counter(w for i in docs for w in tokens[i]), Counter(p for i in docs for p in grams(tokens[i]))
        return one, two, len(docs), sum(one.values()), len(one)

    def mix(p, c):
        one, two, starts, n, v = c
        ctx = starts if p[0] == "\t" else one[p[0]]
        bucket = min(lm.BUCKETS - 1, int(math.log2(ctx)) + 1) if ctx else 0
        return bucket, (two[p] / ctx if ctx else 0.0, one[p[1]] / max(n, 1), 1 / (v + 1))

    train = [i for i in range(len(texts)) if remainder[i] != lm.TEST_REMAINDER]
    kept, every = counts([i for i in train if remainder[i] != lm.HELD_REMAINDER]), counts(train)
    seen = {}
    for i in train:
        if remainder[i] == lm.HELD_REMAINDER:
            for p in grams(tokens[i]):
                b, q = mix(p, kept)
                seen.setdefault(b, []).append(q)
    weights = {}
    for b, qs in seen.items():
        w, gain, before = [0.5, 0.4, 0.1], 1.0, -math.inf
        while gain >= lm.EM_TOLERANCE:
            parts = [[x * y for x, y in zip(q, w)] for q in qs]
            w = [sum(r[k] / sum(r) for r in parts) / len(parts) for k in range(3)]
            now = sum(math.log(sum(r)) for r in parts) / len(parts)
            gain, before = now - before, now
        weights[b] = w
    out = []
    for w in tokens:
        mixed = [mix(p, every) for p in grams(w)]
        out.append((len(w), sum(every[0][x] > 0 for x in w), every[3], sum(math.log10((every[0][x] + 1) / (every[3] + every[4] + 1)) for x in w), sum(math.log10(sum(x * y for x, y in zip(q, weights.get(b, [0.5, 0.4, 0.1])))) for b, q in mixed)))
    return out


@pytest.mark.parametrize("fanout", [256, 2])
def test_lm_against_brute_force(spark, fanout):
    """All columns, with one level and with many: null, empty, repeated and long texts, clashing columns."""
    import random

    rng = random.Random(7)
    words = ["the", "cat", "Sat", "on", "a", "mat", "dog", "ran", "été", "x1"]
    texts = [" ".join(rng.choices(words, range(10, 0, -1), k=rng.randrange(1, 30))) for _ in range(150)] + [None, "", "the cat " * 3000, "A\tb\x0cc"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("score", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("block", F.lit(1))
    rows = {r.doc_id: r for r in lm.score(df, block_bytes=2500, fanout=fanout).collect()}
    remainder = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]
    assert sorted(rows) == list(range(len(texts)))
    for i, (n, known, total, base, score) in enumerate(brute_scores(texts, remainder)):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder[i] == 2, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=5e-3)
    assert lm.score(df.limit(0)).count() == 0
    twice = lm.score(df.union(df.filter("doc_id = 3")), block_bytes=2500, fanout=fanout).filter("doc_id = 3").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_lm_levels():
    assert lm.levels_for(2, 256) == (1, 2) and lm.levels_for(256, 256) == (1, 256)
    for blocks in (257, 10_000, 70_000, 10**7):
        levels, f = lm.levels_for(blocks, 256)
        assert f <= 256 and f**levels >= blocks > (f - 1) ** levels


def test_lm_deals_out_copies(spark):
    """Rows of one id and text, a third of all and more, go to all blocks; each row is scored once, copies alike."""
    df = spark.range(0, 3000, 1, 6).selectExpr("if(id % 3 = 0, id, 77) as doc_id", "if(id % 3 = 0, concat('word', id % 50, ' and more'), 'the same text again') as text")
    rows = df.selectExpr("doc_id as __id", "0 as __part", "text as __text")
    sizes = lm._pack(rows, 20, 2).groupBy("block").count().collect()
    assert {r.block for r in sizes} == set(range(2, 20))
    packed = lm._pack(rows.filter("__id = 77"), 20, 2).toPandas()
    held = [sum(1 for _ in lm._unpack(b["docs"])) for _, b in packed.groupby("block")]
    assert sum(held) == 2000 and len(held) == 18 and max(held) < 3 * min(held)
    got = lm.score(df, block_bytes=5000).collect()
    assert len(got) == 3000 and len({r.score for r in got if r.doc_id == 77}) == 1


def test_em_converges():
    """No weights near the fitted ones have a higher likelihood."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    m = rng.integers(1, 50, 40)
    cells = pd.DataFrame({"bucket": 4, "g2": range(40), "g1": 0, "m": m, "p2": m * rng.random(40) * 0.3, "p1": m * rng.random(40) * 0.01})
    w = lm.fit_weights(cells, 0.001)[4]
    p = np.stack([cells["p2"] / m, cells["p1"] / m, np.full(40, 0.001)], axis=1)
    value = lambda l: (m * np.log(p @ l)).sum() / m.sum()
    for step in rng.normal(0, 0.01, (200, 3)):
        near = np.abs(w + step)
        assert value(near / near.sum()) <= value(w) + 1e-5
    assert value(w) >= value(lm.fit_weights(cells, 0.001, 0, 40)[4])


def test_em_recovers_weights():
    import pandas as pd

    cells = pd.DataFrame({"bucket": [1, 1], "g2": [0, 1], "g1": [0, 0], "m": [80, 20], "p2": [80 * 0.9, 0.0], "p1": [80 * 0.1, 20 * 0.1]})
    w = lm.fit_weights(cells, 0.0001)[1]
    grid = [(x, 1 - x) for x in (k / 1000 for k in range(1, 1000))]
    best = max(grid, key=lambda l: 80 * math.log(l[0] * 0.9 + l[1] * 0.1) + 20 * math.log(l[1] * 0.1))
    assert w[0] == pytest.approx(best[0], abs=0.01)


def brute_sketch(text):
    """Closed syncmers from their definition, with the hash library."""
    import xxhash

    x = xxhash.xxh64_intdigest
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    raw = lambda v: (v & (2**64 - 1)).to_bytes(8, "little")
    if len(text) < syncmers.K:
        return [x(text.encode(), 42) & 0x7FFFFFFF] if text else []
    c = [ch.encode() for ch in text]
    p = [x(b, x(a, 42)) for a, b in zip(c, c[1:])]
    h = [signed(x(raw(b), x(raw(a), 42))) for a, b in zip(p, p[2:])]
    last = syncmers.K - syncmers.S
    ids = {x(raw(h[i + last]), x(raw(h[i]), 42)) & 0x7FFFFFFF for i in range(len(h) - last) if min(h[i], h[i + last]) <= min(h[i + 1 : i + last])}
    return sorted(ids)[: syncmers.SKETCH]


def brute_likeness(a, b):
    union = sorted({*a, *b})[: syncmers.SKETCH]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_syncmers(spark, monkeypatch, limit):
    """All columns against brute force: null and equal ids, repeated rows, null, empty and short texts, and texts of many chunks."""
    import random

    import xxhash

    monkeypatch.setattr(syncmers, "CHUNK", 100)
    rng = random.Random(1)
    texts = ["the quick brown fox jumps over the lazy dog " * 6, "short", None, "", "été 😀 " * 20, "pack my box", "short", "x" * 200]
    texts += ["".join(rng.choice("abcdé fgh") for _ in range(rng.randrange(400))) for _ in range(40)]
    given = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(5, "another five"), (4, texts[4])]
    df = spark.createDataFrame(given, DOCS)
    got = syncmers.compare_edited(df.withColumn("fingerprint", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("n", F.lit(1)), broadcast_rows=limit)
    own_hash = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted({(i, t or "") for i, t in given}, key=lambda r: (r[0] is None, -(r[0] or 0), own_hash(r[1])))
    text = lambda s: "".join(f"{x:08x}" for x in s)
    want = []
    for k, (i, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, e = brute_sketch(t), brute_sketch(edited)
        row = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(e), brute_likeness(a, e), brute_likeness(a, brute_sketch(nxt)))
        want += [row] * sum((j, u or "") == (i, t) for j, u in given)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert syncmers.compare_edited(df.limit(0)).count() == 0
    assert syncmers.compare_edited(df.filter("doc_id = 0")).first().near_next == 1.0


def test_syncmers_of_a_very_long_text(spark):
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300_000))
    row = syncmers.compare_edited(spark.createDataFrame([(1, long)], DOCS)).first()
    assert row.fingerprint == "".join(f"{x:08x}" for x in brute_sketch(long)) and row.n_chars == 300_000


def test_syncmers_are_context_free(spark):
    middle = "an anchor depends on its own letters alone"
    a = spark.createDataFrame([(0, middle), (1, "prefix... " + middle + " ...suffix")], DOCS)
    got = {}
    for r in syncmers.anchors(a).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.anchor
    shifted = {p + len("prefix... "): x for p, x in got[0].items()}
    assert shifted.items() <= got[1].items() and len(shifted) > 5


def test_pipeline_against_brute_force(spark):
    """run() on whole small tables: after the classifier, every stage is done again by brute force."""
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as cp
    from test_text_operators import brute_components, brute_hits
    from waymark.llm import pii, simhash
    from waymark.llm.queries import SURROGATE_KEY, RANK_FILE

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = {r.doc_id: r.text for r in cp.drop_toxic(spark, docs, d).select("doc_id", "text").collect()}
    assert text.items() <= {r.doc_id: r.text for r in docs.collect()}.items() and len(text) > 100
    ids = sorted(text)
    heads = brute_components([simhash.fingerprint(text[i]) for i in ids], ids)
    ids = [i for i, h in zip(ids, heads) if i == h]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    words = lambda t: set(t.lower().split())  # noqa: E731  every occurring window has a word of the document
    hits = {i: brute_hits(text[i], [x for x in items if words(x[1] or "") & words(text[i] or "")]) for i in ids}
    ids = [i for i in ids if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])]
    spans = {i: pii.detect(text[i]) for i in ids}
    genders = {}
    for ss in spans.values():
        for _, _, k, n in ss:
            if k.startswith("given"):
                genders.setdefault((k[8:], n), set()).add(k[6])
    kinds = {"".join(g & {"m", "f"}): None for g in genders.values()}
    final = lambda k, n: k if not k.startswith("given") else f"given:{g if len(g := ''.join(genders[k[8:], n] & {'m', 'f'})) == 1 else 'n'}:{k[8:]}"
    entities = {(final(k, n), n) for ss in spans.values() for _, _, k, n in ss}
    domain = lambda k: "given:" + k[8:] if k.startswith("given") else k
    real, taken, names, draw = {(domain(k), n) for k, n in entities}, set(), {}, 0
    while len(names) < len(entities):
        for k, n in sorted(entities - set(names), key=lambda e: (e[1], e[0])):
            c = (domain(k), pii.surrogate(SURROGATE_KEY.encode(), k, n, draw))
            if c not in real and c not in taken:
                taken.add(c)
                names[k, n] = c[1]
        draw += 1
    assert kinds is not None
    want = {}
    with open(public_tokenizers.path(RANK_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i in ids:
        t = text[i]
        for a, b, k, n in reversed(spans[i]):
            t = t[:a] + pii.render(t[a:b], final(k, n), names[final(k, n), n]) + t[b:]
        got = library.encode_ordinary(t or "")
        want[i] = (len(got), hashlib.sha256(np.asarray(got, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, d).collect()} == want


def test_stages_with_odd_rows(spark):
    """Every stage: null ids and texts, repeated rows, columns of clashing and dotted names, and an empty table."""
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    x, y = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(None, x, "en", "s", 1), (None, y, "en", "s", 1), (7, "Dr Ann Lee wrote " + x[:100], "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 1), (9, x, "en", "s", 1), (9, x, "en", "s", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = plain.withColumns({c: F.lit(c) for c in ("__id", "__rid", "__keep", "__h", "__text", "__spans", "row", "fp", "score", "a.b")})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, extra, d)
        assert out.columns == extra.columns, name
        got = out.collect()
        assert all(r["a.b"] == "a.b" and r["row"] == "row" and r["__id"] == "__id" for r in got), name
        ids = sorted((r.doc_id for r in got), key=str)
        assert ids == ([7, 7, 9, None] if "near" in name else [7, 7, 8, 9, 9, None, None]), (name, ids)
        assert stage(spark, extra.limit(0), d).count() == 0
    assert cp.encode(spark, extra, d).count() == len(rows) and cp.encode(spark, extra.limit(0), d).count() == 0


def test_entry_without_this_part(tmp_path):
    code = "import sys; sys.modules['waymark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
