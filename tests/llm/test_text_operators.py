"""Tokenizer, near-duplicates, decontamination, personal data: against brute force, with odd inputs."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, decontaminate, licenses, pii, simhash
from waymark.llm.queries import RANK_FILE

PATH = public_tokenizers.path(RANK_FILE)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def tiktoken_ids(text):
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch(text)


def test_bpe_forgets_words(monkeypatch):
    """Words kept from earlier texts, and those met again after the task has begun anew, give the same ids."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(30)] + ["very " * 50_000]
    want = [np.asarray(i, "<u4").tobytes() for i in tiktoken_ids(texts)]
    for kept in (200_000, 300, 1):
        monkeypatch.setattr(bpe, "WORDS_KEPT", kept)
        words, got = bpe._Words(bpe._load(PATH), bpe._split_pattern(public_tokenizers.PATTERN)), []
        for k in range(0, len(texts), 4):
            for t in texts[k : k + 4]:
                words.add(t)
            got += words.encoded()
        assert got == want


def test_bpe_equals_library(spark):
    rng = random.Random(3)
    texts = ["", "Hello  world\n\n it's 1234", "a" * 5000, "ab" * 2000, "\x1c\x1d a\x85b ", "été 東京 😀🏽 नमस्ते", *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(80)) for _ in range(300))]
    assert bpe.encode_texts(texts, PATH, public_tokenizers.PATTERN) == [np.asarray(i, "<u4").tobytes() for i in tiktoken_ids(texts)]
    df = docs(spark, [*texts[:8], None, texts[1]]).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert [bytes(got[i].decoded).decode() for i in range(10)] == [*texts[:8], "", texts[1]]
    assert got[1].ids == got[9].ids and bytes(got[8].ids) == b""
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def near_texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out[:n]


def brute_components(fps, ids):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = np.array(fps, dtype=np.uint64)
    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= 4):
            x, y = find(k), find(k + 1 + int(j))
            root[max(x, y)] = min(x, y)
    best = {}
    for k, i in enumerate(ids):
        best[find(k)] = min(best.get(find(k), i), i)
    return [best[find(k)] for k in range(len(ids))]


def test_simhash_components(spark):
    texts = [*near_texts(300), None, "", " \t", "one two", "One TWO"]
    df = docs(spark, texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    df = df.union(df.filter("doc_id = 5"))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts) + 1
    by = {r.doc_id: r for r in got}
    fps = [int(by[i].fingerprint, 16) for i in range(len(texts))]
    assert [by[i].component_id for i in range(len(texts))] == brute_components(fps, list(range(len(texts))))
    assert fps[300] == fps[301] == fps[302] == 0 and fps[303] == fps[304]
    kept = [r.doc_id for r in simhash.keep_one(df).select("doc_id").collect()]
    assert sorted(kept) == sorted({r.component_id for r in got})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_tells_components_apart(spark):
    """Unrelated texts without an id, or under one id, all stay; copies of them do not."""
    x, y, z, u, v = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyzuv")
    rows = [(None, x), (None, y), (None, x), (7, z), (7, u), (7, u), (8, z), (None, z), (None, None), (None, ""), (9, v)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")))
    assert kept.columns == ["doc_id", "text", "lang"]
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, x), (None, y), (7, z), (7, u), (None, ""), (9, v)], key=str)


def test_fingerprint_definition():
    import xxhash

    words = "A b c D e f".lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 3)
    assert simhash.fingerprint("A b\tc  D e f") == want


@pytest.mark.parametrize("cap", [3, 50])
def test_simhash_large_shards(spark, cap):
    """A dense cluster and random fingerprints with shards that must be split."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    ids = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in ids], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(df, cap=cap)).collect()}
    want = brute_components(ids, [v - (1 << 64) if v >= 1 << 63 else v for v in ids])
    for v, w in zip(ids, want, strict=True):
        s = v - (1 << 64) if v >= 1 << 63 else v
        assert roots.get(s, s) == w


def brute_hits(text, items):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w, hit, found = words.findall(low(text)), set(), set()
    for i, t in items:
        x = words.findall(low(t))
        for a in range(max(1, len(x) - 12) if x else 0):
            win = x[a : a + 13]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, limit):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gámma", "ÉTA", "x1", "y", "zeta"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, line(30)), (2, line(13)), (3, "one two three"), (4, "lone"), (5, None), (6, "..."), (7, "one two three"), (22, line(13)), (8, "a b c d e f")]
    texts = [items[0][1], "say One-two three! lone", items[1][1].upper() + " " + line(40), None, "", "!!", line(300), items[0][1][:60] + " " + items[1][1] + " " + items[1][1], "a b c d e f a b c d e f", "lone lone x"]
    df = docs(spark, texts).withColumn("n_words", F.lit("clash"))
    df = df.union(df.filter("doc_id = 1"))
    rows = decontaminate.scan(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r["__id"]], items), r
    assert decontaminate.report(df.limit(0), spark.createDataFrame(items, "item_id long, text string"), limit).count() == 0
    clean = decontaminate.report(df, spark.createDataFrame([], "item_id long, text string"), limit)
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(texts) + 1


def test_surrogates(spark):
    card = "4539 5787 6362 1486"
    texts = [
        "Write to Jane.Doe@mail.example.com or JANE.DOE@mail.example.com, call +1 (212) 555-0147 or 1 212 555 0147.", "Mrs Anna Smith and Mr Smith met Dr Ivanov; г-н Иванов came. MR SMITH left.",
        f"card {card} and {card.replace(' ', '-')}, host 10.1.2.3, ssn 123-45-6789, token = \"9f8e7d6c5b4a39281706\"", "nothing here", None, "", "iban DE89 3704 0044 0532 0130 00",
    ]
    df = docs(spark, texts).withColumn("spans", F.lit("clash"))
    df = df.union(df.filter("doc_id = 0"))
    out = pii.with_surrogates(df, b"k")
    assert out.columns == df.columns and out.count() == len(texts) + 1
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[3] == "nothing here" and got[4] is None and got[5] == ""
    emails = re.findall(r"[\w.]+@[\w.]+\w", got[0])
    assert len(emails) == 2 and emails[0].lower() == emails[1].lower() and emails[0] != emails[1] and "doe" not in emails[0].lower() and emails[1].split("@")[0].isupper()
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", got[0]) and "555-0147" not in got[0]
    a, b = re.findall(r"card ([\d ]+) and ([\d-]+)", got[2])[0]
    digits = a.replace(" ", "")
    assert digits == b.replace("-", "") and digits != card.replace(" ", "") and pii.luhn_digit(digits[:-1]) == digits[-1]
    assert re.search(r'token = "[0-9a-f]{20}"', got[2]) and "9f8e7d6c5b4a39281706" not in got[2] and "123-45-6789" not in got[2] and "10.1.2.3" not in got[2]
    m = re.match(r"Mrs (\w+) (\w+) and Mr (\w+) met Dr (\w+); г-н (\w+) came. MR (\w+) left", got[1])
    assert m[2] == m[3] and m[6] == m[3].upper() and "Smith" not in got[1] and re.fullmatch("[А-я]+", m[5])
    iban = got[6].removeprefix("iban ").replace(" ", "")
    assert iban[:2] == "DE" and pii.iban_check("DE", iban[4:]) == iban[2:4] and "3704" not in got[6][:12]
    assert {r.doc_id: r.text for r in pii.with_surrogates(df, b"k").collect()} == got
    assert pii.with_surrogates(df.limit(0), b"k").count() == 0


def test_whole_names(spark):
    """Later mentions without a title, initials, particles, three-part names, titles of one person, possessives."""
    texts = [
        "Mr John Smith called. Smith said that John left Smith's house to SMITH-Meyer; the smith stayed.",
        "Dr. J. R. Smith, Prof. Dr. A.B. Stone and Mrs Anna Maria Smith came.",
        "Dr Jane Doe and Ms Jane Doe; Herr Ludwig van Beethoven, Mr Brown Then Mrs Green.",
    ]
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs(spark, texts), b"k").collect()}
    m = re.fullmatch(r"Mr (\w+) (\w+) called\. (\w+) said that (\w+) left (\w+)'s house to (\w+)-Meyer; the smith stayed\.", got[0])
    assert m[1] == m[4] != "John" and m[2] == m[3] == m[5] == m[6].capitalize() != "Smith"
    n = re.fullmatch(r"Dr\. [A-Z]\. [A-Z]\. (\w+), Prof\. Dr\. [A-Z]\.[A-Z]\. (\w+) and Mrs (\w+) (\w+) (\w+) came\.", got[1])
    assert n[1] == n[5] == m[2] and not {"Stone", "Anna", "Maria"} & set(n.groups())
    d = re.fullmatch(r"Dr (\w+) (\w+) and Ms (\w+) (\w+); Herr (\w+) van (\w+), Mr (\w+) Then Mrs (\w+)\.", got[2])
    assert d[1] == d[3] and d[2] == d[4] and not {"Jane", "Doe", "Ludwig", "Beethoven", "Brown", "Green"} & set(d.groups())


def test_names_without_a_title(spark):
    """A well-known given name and a surname; words that only look like names stay."""
    texts = ["Later Smith and John Smith met Mary Ann Jones. Jones smiled.", "Mary had a lamb. John and Mary came. Marystown Hall, st.John Street", "Dr Mary Jones spoke."]
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs(spark, texts), b"k").collect()}
    m = re.fullmatch(r"Later (\w+) and (\w+) (\w+) met (\w+) (\w+) (\w+)\. (\w+) smiled\.", got[0])
    assert m[1] == m[3] and m[6] == m[7] and not {"Smith", "John", "Mary", "Ann", "Jones"} & set(m.groups())
    assert got[1] == texts[1]
    assert re.fullmatch(rf"Dr {m[4]} {m[6]} spoke\.", got[2])


def test_surnames_of_a_family(spark):
    """One surname has its two forms, and many entities of a text stay apart."""
    t = "Госпожа Анна Иванова и господин Пётр Иванов пришли. Иванова ушла. " + "; ".join(f"a{k}@mail{k}.example.org" for k in range(3000))
    got = pii.with_surrogates(docs(spark, [t]), b"k").first().text
    m = re.match(r"Госпожа (\w+) (\w+)а и господин (\w+) (\w+) пришли\. (\w+)а ушла", got)
    assert m[2] == m[4] == m[5] and m[2].endswith(pii.MASCULINE) and m[2] != "Иванов" and m[1] != "Анна"
    assert len(set(re.findall(r"[\w.]+@[\w.]+", got))) == 3000
    out = pii.with_surrogates(docs(spark, [t, "none"]).withColumn("a.b", F.lit(1)), b"k", count_col="n_chars")
    assert out.columns == ["doc_id", "text", "lang", "source", "a.b", "n_chars"] and sorted(r.n_chars for r in out.collect()) == [0, 3005]


def test_surrogates_stay_distinct(spark):
    """A domain so small that first draws collide."""
    entities = spark.createDataFrame([("secret", f"{k:x}") for k in range(16)], "kind string, norm string")
    rows = pii.assign_surrogates(entities, b"k").collect()
    assert len({r.surrogate for r in rows}) == len(rows) == 16
    assert not {r.surrogate for r in rows} & {r.norm for r in rows}


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = ["intro with some words\nReleased under the MIT license!\nend", mit, mit.replace(". ", ".\n"), "license", None, "", "Licensed under the Apache License", mit[: len(mit) // 2]]
    df = docs(spark, texts).withColumn("licenses", F.lit("clash"))
    df = df.union(df.filter("doc_id = 0"))
    rows = licenses.scan(df).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert [got[i].best_license for i in range(8)] == ["MIT notice", "MIT", "MIT", None, None, None, None, None]
    assert got[0].n_matches == 1 and got[1].best_dice == 1.0
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_spans(spark):
    """Wrapped licences in longer files and notices inside a long line, against every span by brute force."""
    import textwrap

    grams = lambda t: [*zip(w := re.findall(r"[^\W_]+", t.lower()), w[1:])]
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("of the in software to use under a copy river green any".split()) for _ in range(n))
    wrap = lambda t, lead: "\n".join(lead + x for x in textwrap.wrap(t, 70))
    known = licenses.TEMPLATES
    mit = known["MIT"].split()
    texts = [
        f"{prose(90)}\n\n{wrap(known['MIT'], ' * ')}\n\n{prose(200)}", f"{wrap(known['Apache-2.0 header'], '# ')}\nimport os\n{prose(150)}",
        f"{prose(60)} Released under the MIT License. {prose(60)}", f"{prose(40)}\n{wrap(' '.join(mit[:60] + mit[75:]), '// ')}\n{prose(40)}", prose(300), f"{prose(50)}\n{wrap(' '.join(mit[:70]), '')}\n{prose(50)}",
    ]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in licenses.scan(df.union(df.filter("doc_id = 0"))).collect()}
    for i, text in enumerate(texts):
        w, want = grams(text), {}
        for name, template in known.items():
            b, n = set(grams(template)), len(grams(template))
            for x in (k for k in range(len(w)) if w[k] in b):
                seen, both = set(), 0
                for g in w[x : x + int(1.5 * n)]:
                    both += g in b and g not in seen
                    seen.add(g)
                    want[name] = max(want.get(name, 0), 2 * both / (len(seen) + len(b)))
        want = {k: d for k, d in want.items() if d >= 0.8}
        assert got[i].licenses == ", ".join(sorted(want)) and got[i].n_matches == len(want)
        assert got[i].best_dice == (pytest.approx(max(want.values()), abs=1e-8) if want else None)
    assert [got[i].best_license for i in range(6)] == ["MIT", "Apache-2.0 header", "MIT notice", "MIT", None, None]


@pytest.mark.parametrize(
    "text,parts",
    [
        ("We walked along the Charles River. The River was cold; River water everywhere.", []), ("Paul Street is long. Elizabeth City has a port.", []), ("The Joseph Stalin Prize. Prize money.", []),
        ("Mr Will Young. Will you come? Young people know. So Young said, and Will left.", ["Will", "Young", "Young", "Will"]), ("Wei Zhang met Priya Natarajan. Zhang's car.", ["Wei", "Zhang", "Priya", "Natarajan", "Zhang"]),
        ("Mr John Smith called. Smith said yes. Smith Street is near.", ["John", "Smith", "Smith"]), ("Licensed under the Apache License, Version 2.0. Onou Onou Onou Onou said. Te Te Te.", []), ("Hot Chocolate is good. Both Golden Retriever dogs slept.", []), ("The New York Times reported it. Green Valley College met Tuesday. Table Mountain said nothing.", []),
    ],
)
def test_names_by_evidence(text, parts):
    assert [text[a:b] for a, b, _, _ in pii.detect(text)] == parts


NAMES = "Anna Schmidt|James Wilson|Maria Rossi|Wei Zhang|Priya Natarajan|Olu Adeyemi|Kenji Watanabe|Thomas Müller|Fatima Al-Sayed|Ngozi Okafor".split("|")
PERSON_SENTENCES = [
    "{} said that it was late.", "The report was written by {} in May.", "Yesterday {}, 34, came home.", "We asked {} about it.", "She met {} at noon.",
    "{} lives near the sea.", "Please contact {} today.", "Last week {} joined our team.", "I told {} the truth.", "In the end Dr {} was right.",
]
THINGS = [
    "Charles River", "Paul Street", "Elizabeth City", "Joseph Stalin Prize", "New York Times", "Green Valley College", "Table Mountain", "Henry County", "George Washington University", "Saint Marie Hospital",
    "Black Sea Fleet", "Golden Gate Bridge", "Royal Opera House", "Summer Olympic Games", "James Bay", "Anna Library", "Victoria Station", "Old Town Square", "First National Bank", "Laura Ashley Group",
    "Golden Retriever", "Big Data", "Apache License", "Hot Chocolate", "Deep Learning", "Black Friday", "Red Cross", "Tour Eiffel", "Windows Update", "Onou Onou",
]
THING_SENTENCES = ["{} was closed in May.", "They built it near {} last year.", "The {} is old.", "We read about {} and went home.", "It rained on {} all week."]


def test_names_precision_and_recall():
    """A hundred sentences with a name each and a hundred without: the figures that the README states."""
    hit = missed = wrong = 0
    for sentence in PERSON_SENTENCES:
        for name in NAMES:
            t = sentence.format(name)
            got, want = {(a, b) for a, b, _, _ in pii.detect(t)}, {(t.index(x), t.index(x) + len(x)) for x in name.split()}
            hit, missed, wrong = hit + len(got & want), missed + len(want - got), wrong + len(got - want)
    for sentence in THING_SENTENCES:
        for thing in THINGS:
            wrong += len(pii.detect(sentence.format(thing)))
    recall, precision = hit / (hit + missed), hit / (hit + wrong)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95
