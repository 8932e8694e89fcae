"""Operators on documents and pages against brute force, and on odd rows."""

import base64
import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tests.conftest import ROOT
from tests.llm.conftest import CLASHES, ODD

from sealframe.llm import decontaminate, licenses, pii, quality, simhash, url_filter, warc

WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# near-duplicates


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, distance=2):
    """Smallest id by row of rows (id, fp), by comparing all pairs of fingerprints."""
    root = {fp: fp for _, fp in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for name, fp in marks:
        if name is not None:
            least[find(fp)] = min(name, least.get(find(fp), name))
    return Counter((name, f"{fp:016x}", least.get(find(fp))) for name, fp in marks)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_simhash(spark, small, odd, table):
    docs = documents(spark, small) if table == "small" else odd
    marks = [(d, fingerprint(t)) for d, t in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, simhash.digests(docs).collect())) == components(marks)


def test_simhash_chains_and_balls(spark):
    random.seed(5)
    base, marks = random.getrandbits(64), []
    fp = base
    for i in range(30):  # a chain in which neighbours differ by two bits
        marks.append((1000 - i, fp))
        fp ^= 1 << (2 * i) | 1 << (2 * i + 1)
    marks += [(2000 + b, base ^ 1 << b) for b in range(64)] + [(5000 + i, random.getrandbits(64)) for i in range(50)] + [(1, base ^ 0b111 << 20)]
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in marks]
    got = simhash.classify(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got) == components(marks)
    got = simhash.classify(spark.createDataFrame(signed, "doc_id long, fp long"), 3).collect()
    assert Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got) == components(marks, 3)


def test_keep_one(spark, odd, nothing):
    assert simhash.keep_one(nothing).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == [1, 5, 7, 8] and got.count(None) == 2  # 2 is 1's copy, 6 is as empty as 5
    assert simhash.digests(nothing).collect() == []


# quality


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


@pytest.mark.parametrize("table", ["small", "odd"])
def test_quality(spark, small, odd, table):
    docs = documents(spark, small) if table == "small" else odd
    got = quality.digests(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((d, *measures(t)) for d, t in docs.select("doc_id", "text").collect())
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_against_sql(spark, small):
    bad = " ".join(f"#{i}" for i in range(80))
    own = spark.createDataFrame([(10_000 + i, bad, "spam") for i in range(60)] + [(20_000, None, None), (20_001, "", "x"), (20_002, bad, None), (20_003, "a b c " * 40 + "d", "x")], "doc_id long, text string, source string")
    docs = documents(spark, small).select("doc_id", "text", "source").unionAll(own)
    table = docs.toPandas()
    with duckdb.connect() as c:
        c.register("given", table)
        c.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from given")
        want = Counter(c.execute(quality.SQL).fetchall())
    got = quality.digests(docs).collect()
    assert Counter(map(tuple, got)) == want
    assert not any(r["kept"] for r in got if r["doc_id"] == 10_000) and any(not r["base_failed"] and not r["kept"] for r in got)


def test_bad_hosts_are_rejected_and_others_not(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), " ".join(f"#{i}" for i in range(80))
    rows = [(i, good, f"h{i % 20}") for i in range(400)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(200)] + [(2000, bad, "once"), (3000, good, None)]
    got = {r["doc_id"]: (r["kept"], r["host_rejected"]) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i][0] for i in range(400)) and not any(got[1000 + i][0] for i in range(200))
    assert got[2000] == (True, False)  # one document says little of its host
    assert got[3000][0]


def test_keep_good(spark, small, odd, nothing):
    docs = documents(spark, small)
    want = {r["doc_id"] for r in quality.digests(docs).where("kept").collect()}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == quality.digests(odd).where("kept").count()
    assert quality.keep_good(nothing).collect() == [] and quality.digests(nothing).collect() == []


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(kind, match):
    digits = [int(x) for x in match if x in "0123456789"]
    if kind == 1:
        return all(int(x) <= 255 for x in match.split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def base(text):
    return sorted(((*m.span(), k) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m.group())), key=lambda s: (s[0], s[2]))


def test_base_spans_on_random_texts():
    random.seed(7)
    parts = ["1", "12", "255", "4111111111111111", "@", ".", " ", "-", "+", "+1 ", "a", "b.c", "(", "\n", "5-5", "é"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(1, 25)))
        assert pii.base_spans(text) == base(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 60_000, "a@" * 60_000, "1 " * 100_000):
        pii.base_spans(text)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_pii(spark, small, odd, table):
    docs = documents(spark, small) if table == "small" else odd
    rows = docs.select("doc_id", "text").collect()
    got = pii.find_pii(docs).collect()
    digest = lambda s: hashlib.sha256(pii.write_spans(s).encode()).hexdigest()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *(sum(s[2] == k for s in base(t)) for k in range(4)), digest(base(t))) for d, t in rows)
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) >= sum(r[f"n_{k}"] for k in pii.KINDS)
        assert r["redacted"] is None or pii.base_spans(r["redacted"]) == [] or spans


def test_skip_chain_finds_other_forms_of_a_known_value(spark):
    rows = [(i, f"call {i} now +1 (555) {200 + i}-{4000 + i} or write u.s{i}x@mail{i}.example.com from 10.0.{i}.7 please, order {i} of 9 items") for i in range(200)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "Ask +1 (555) 234-5678 first. Later the number 234-5678 is given again, and 3 apples cost 7."
    own, spans = pii.find(text, model)
    assert own == base(text) and [text[s:e] for s, e, _ in spans] == ["+1 (555) 234-5678", "234-5678"]
    assert pii.find("3 apples cost 7, and 12 pears cost 40.", model) == ([], [])


def test_redaction(spark, odd, nothing):
    out = pii.redact_all(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and pii.redact_all(nothing).collect() == []
    (text,) = [r["text"] for r in out.where("text like 'mail%'").collect()]
    assert text == "mail [EMAIL] or [PHONE], card [CARD]"
    assert pii.redact("a 1.1.1.1 b", [(2, 9, 1), (4, 9, 2)]) == "a [IP] b"


def test_a_long_text_of_numbers_takes_little_memory():
    """In a process of its own: 10 MB of candidate words, most of them linked."""
    code = (
        "import random, resource; from sealframe.llm import pii; random.seed(1); import numpy as np;"
        "model = pii.Model(np.zeros((pii.FEATURES, 5)).tolist(), np.zeros((5, 5)).tolist(), 1.0);"
        "text = ' '.join(f'x{random.randrange(10**6):06d}' for _ in range(1_250_000));"
        "assert len(text) > 9_900_000; pii.find(text, model);"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 500 * 1024


def test_links_against_all_pairs():
    random.seed(2)
    for _ in range(300):
        text = " ".join(random.choice(["12345", "1234567", "123-4567", "ab12345@x.yz", "AB12345", "no", "+1 234567890"]) for _ in range(random.randint(1, 14)))
        w = pii.candidates(text, pii.base_spans(text))
        of = [set(pii.keys(text[a:b])) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        want = set()
        for i, own in enumerate(of):
            for key in own:
                like = [j for j in range(i) if key in of[j]]
                want |= {(j, i) for j in (like[:1] + like[-1:])}
        assert set(zip(w.earlier.tolist(), w.later.tolist(), strict=True)) == want


# benchmark


def test_decontamination_finds_verbatim_items(spark, small, odd, nothing):
    docs, bench = documents(spark, small), spark.read.parquet(f"{small}/benchmark.parquet")
    grams = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    items = {r["item_id"]: grams(r["text"]) for r in bench.collect()}
    of = [(d, grams(t)) for d, t in docs.select("doc_id", "text").collect()]
    want = {(d, i) for d, own in of for i, g in items.items() if g and len(g & own) >= 0.8 * len(g)}
    got = decontaminate.digests(docs, bench).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in got}
    assert {r["doc_id"] for r in got} == {d for d, _ in want}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in want})
    items = bench.unionByName(spark.createDataFrame([(None, None), (77, "too short")], "item_id long, text string"))
    assert decontaminate.keep_clean(odd, items).count() == odd.count()
    assert decontaminate.digests(nothing, bench).collect() == [] and decontaminate.digests(docs, bench.limit(0)).collect() == []


def test_reparameterised_questions_and_slots(spark):
    item = "Yesterday Tom bought 12 apples and 5 pears for Mary, and then Tom gave 12 apples back because 5 pears were quite enough for the week."
    other = "Intro. Yesterday Anna bought 30 apples and 7 pears for Paul, and then Anna gave 30 apples back because 7 pears were quite enough for the week. End."
    mixed = "Yesterday Anna bought 30 apples and 8 pears for Paul, and then Karl gave 99 apples back because 7 pears were quite enough for the week."
    docs = spark.createDataFrame([(1, other), (1, other), (2, mixed), (3, item.upper()), (None, item), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r["doc_id"], r["kind"]) for r in decontaminate.digests(docs, bench).collect()} == {(1, "reparameterised"), (None, "exact")}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()) == [2, 3, 5]


def test_names_at_sentence_starts_and_copies_in_other_case(spark):
    item = "Tom has 12 apples. Tom gives 5 apples to Mary. Tom then buys 7 more apples at the shop."
    named = "Yesterday Tom bought 12 apples and 5 pears for Mary, and then Tom gave 12 apples back because Mary had been with Paul."
    docs = spark.createDataFrame([(1, item.replace("Tom", "Anna")), (2, named.lower()), (3, named.upper()), (4, "Anna has 3 dogs. Paul gives 4 bones to Mary.")], "doc_id long, text string")
    bench = spark.createDataFrame([(8, item), (9, named)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.digests(docs, bench, capitals=True).collect()}
    assert got == {(1, 8, "reparameterised"), (2, 9, "exact"), (3, 9, "exact")}


def test_copies_after_inconsistent_passages_and_with_words_put_in(spark):
    item = "Yesterday Tom bought 12 apples and 5 pears for Mary, and then Tom gave 12 apples back because 5 pears were quite enough for the week."
    mixed = "Yesterday Anna bought 30 apples and 8 pears for Paul, and then Karl gave 99 apples back because 7 pears were quite enough for the week."
    put_in = item.replace("because", "at once because")
    docs = spark.createDataFrame([(1, f"{mixed} {item}"), (2, f"{mixed} {mixed}"), (3, f"{mixed} {put_in}"), (4, put_in)], "doc_id long, text string")
    got = decontaminate.digests(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(1, "exact"), (3, "exact"), (4, "exact")}


def test_slots_agree_both_ways(spark):
    item = "Yesterday Tom bought 12 apples and 5 pears for Mary, and then Tom gave 12 apples back because 5 pears were quite enough for the week."
    alike = "Yesterday Anna bought 7 apples and 7 pears for Anna, and then Anna gave 7 apples back because 7 pears were quite enough for the week."
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert decontaminate.digests(spark.createDataFrame([(1, alike)], "doc_id long, text string"), bench).count() == 0


def test_short_items_and_items_of_mostly_placeholders(spark):
    items = [(1, "Define entropy."), (2, "2 4 8 16 32 64 128"), (3, "5 km in miles?"), (4, "Anna 12, Paul 15, Mary 19, Tom 22: 1 2 3")]
    texts = ["Please define Entropy here", "Then 2, 4, 8, 16, 32, 64, 128 follow.", "What is 5 km in miles", "we saw anna 12, paul 15, mary 19, tom 22: 1 2 3 go", "Define the entropy", "4 8 16 32 64 2", "6 km in miles", "Anna 13, Paul 16, Mary 11, Tom 2: 5 6 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.digests(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i + 1, "exact") for i in range(4)}


def test_planted_copies_among_lookalikes(spark):
    """Copies with other values, in small letters, with look-alikes before them and repeats after: all are found, nothing else is."""
    random.seed(12)
    words = ["".join(random.choices("bcdfglmnprst", k=2)) + random.choice("aeiou") + random.choice("bdgmnst") for _ in range(400)]
    names = [w.capitalize() + "o" for w in words[:60]]

    def made(pattern, values):
        return " ".join(values[x] if isinstance(x, int) else x for x in pattern)

    items, docs, want = [], [], set()
    filler = lambda n: " ".join(random.choices(words[60:], k=n))
    for i in range(25):
        own = {**dict(enumerate(random.sample(names, 3))), **{3 + k: str(v) for k, v in enumerate(random.sample(range(2, 999), 3))}}
        pattern = ["so", *(random.choice([*own]) if k % 4 == 2 else random.choice(words[60:]) for k in range(28))]
        items.append((i, made(pattern, own)))
        other = {**dict(enumerate(random.sample(names, 3))), **{3 + k: str(v) for k, v in enumerate(random.sample(range(2, 999), 3))}}
        copy = made(pattern, other)
        loose = " ".join(random.choice(names) if x in (0, 1, 2) else str(random.randint(1, 999)) if isinstance(x, int) else x for x in pattern)
        kinds = [copy, copy.lower(), items[-1][1].lower(), f"{' '.join(loose.split()[:20])} {filler(7)} {copy}", f"{copy} {copy}", made(pattern[:14], other) + " " + random.choice(words[60:]) + " " + made(pattern[14:], other)]
        for text in kinds:
            want.add((len(docs), i))
            docs.append((len(docs), f"{filler(12)} {text} {filler(9)}"))
        for text in (filler(60), " ".join(copy.split()[:16]) + " " + filler(20)):
            docs.append((len(docs), text))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.digests(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_windows_of_unknown_words_are_left_out_and_no_others():
    random.seed(6)
    vocabulary = ["ann", "ben", "had", "gave", "apples", "to", "7", "8", "12", "miles", "kg"]
    flags = np.zeros(1 << 16, dtype=bool)
    for word in vocabulary:
        h = xxhash.xxh64_intdigest(word.encode()) >> 5
        flags[[h & (1 << 16) - 1, h >> 32 & (1 << 16) - 1]] = True
    forms = [*vocabulary, "Ann", "Ben", "Had", "apples.", "to,", "8", "12", "HAD", "kg"]
    item = " ".join(random.choices(forms, k=4000))
    text = " ".join(w if random.random() < 0.8 else random.choice(["zebra", "Zebra", "xylophone."]) for w in random.choices(forms, k=4000))

    def made(text, **options):
        *words, _ = decontaminate.template(text)
        return list(zip(*(x.tolist() for x in decontaminate.windows(*words, np.zeros(len(words[0]), dtype=np.int64), masks=[1, 3, 5, 16], **options)), strict=True))

    every, fewer, hashes = made(text), made(text, vocabulary=flags), {x[1] for x in made(item)}
    assert [x for x in fewer if x[1] in hashes] == [x for x in every if x[1] in hashes] != []
    assert len(fewer) < len(every) / 2


def test_decontamination_with_long_texts_and_clashing_names(spark):
    item = "Yesterday Tom bought 12 apples and 5 pears for Mary, and then Tom gave 12 apples back."
    docs = spark.createDataFrame([(1, "some words of no item " * 40_000 + item, "x"), (2, "some words of no item " * 4_000, "x")], "doc_id long, text string, hash string")
    bench = spark.createDataFrame([(1, item, "x", "y"), (1, item, "x", "y"), (2, None, None, None), (3, "", "", "")], "item_id long, text string, hash string, at string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.digests(docs, bench).collect()] == [(1, 1)]


# licenses


def test_license_versions_and_given_templates(spark):
    of = {a: b for a, b in licenses.NOTICES if len(b) > 100}
    texts = [of["BSD-2-Clause"], of["BSD-3-Clause"], "This program is free software: " + of["GPL-3.0"], "This library is free software; " + of["LGPL-2.1"], of["MIT"].replace("the Software", "the Program", 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert got == {(0, "BSD-2-Clause"), (1, "BSD-3-Clause"), (2, "GPL-3.0"), (3, "LGPL-2.1"), (4, "MIT")}
    own = spark.createDataFrame([("House", "all of this belongs to the house and to nobody else", 1), ("Empty", None, 2)], "license string, text string, template int")
    rows = spark.createDataFrame([(1, "Know: all of this belongs to the house and to nobody else!"), (2, "nothing")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan(rows, own).collect()] == [(1, "House", 1.0)]
    assert licenses.scan(rows, own.limit(0)).count() == 0


def test_licenses_against_sql(spark, small, odd, nothing):
    texts = ["x " * 30 + licenses.NOTICES[i][1].upper() + " y" * 40 for i in range(len(licenses.NOTICES))] + [licenses.NOTICES[5][1].replace("free of charge", "free"), "Released under the MIT license again. " * 3]
    made = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    assert licenses.digests(odd).collect() == licenses.digests(nothing).collect() == []
    for docs in (documents(spark, small), made):
        documents_table = docs.select("doc_id", "text").toPandas()
        with duckdb.connect() as c:
            c.register("given", documents_table)
            c.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text from given")
            assert Counter(map(tuple, licenses.digests(docs).collect())) == Counter(c.execute(licenses.SQL).fetchall())


# archives


def test_archives(spark, small, odd):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    some = spark.createDataFrame([(10_001, "u", "same"), (10_001, "u", "same"), (None, None, None), (None, "x", ""), (10_003, "y", "same"), (None, "z\r\nInjected: 1", "same"), (10_007, "q", "é" * 1000)], pages.schema)
    rows = [tuple(r) for r in pages.unionAll(some).collect()]
    least = {}
    for name, _, html in rows:
        if name is not None:
            least[html or ""] = min(name, least.get(html or "", name))
    got = warc.read_back(warc.write(pages.unionAll(some))).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r["name"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((n, len((h or "").encode()), digest(h)) for n, _, h in rows)
    of = {digest(h): n for h, n in least.items()}
    for r in got:
        original = of.get(r["payload_digest"])
        if r["record_type"] == "response":
            assert original in (None, r["name"]) and digest(r["payload"].decode()) == r["payload_digest"]
        else:
            assert r["refers_to"] == original and r["payload"] is None
    assert sum(r["record_type"] == "response" for r in got if r["name"] == 10_001) == 1
    assert warc.digests(pages.limit(0)).collect() == []
    # records are named once, and revisits name what they refer to
    whole, infos = [], 0
    for r in warc.write(pages.unionAll(some)).collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            for member in warc.members(f):
                head, _ = warc.parse_record(member)
                infos += head["WARC-Type"] == "warcinfo"
                whole.append(head)
    assert infos and len({h["WARC-Record-ID"] for h in whole}) == len(whole) == len(rows) + infos
    for h in whole:
        assert h["WARC-Block-Digest"] and h["WARC-Date"] >= "2025"
        if h["WARC-Type"] == "revisit":
            first = next(x for x in whole if x["WARC-Record-ID"] == h["WARC-Refers-To"])
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and first["WARC-Date"] == h["WARC-Refers-To-Date"] and first.get("WARC-Target-URI") == h.get("WARC-Refers-To-Target-URI")
    dated = spark.sql("select 1L as page_id, 'u' as url, 'x' as html, timestamp '2020-02-03 04:05:06' as at")
    with open(warc.write(dated, date="at", file_bytes=1).first()["path"].removeprefix("file://"), "rb") as f:
        assert [warc.parse_record(m)[0]["WARC-Date"] for m in warc.members(f)][1] == "2020-02-03T04:05:06Z"
    assert len(warc.write(pages.coalesce(1), file_bytes=2_000).collect()) > 1
    large = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000)], pages.schema)
    assert {(r["page_id"], r["record_type"]) for r in warc.digests(large).collect()} == {(1, "response"), (2, "revisit")}
    # with a least size all small payloads are responses
    assert {r["record_type"] for r in warc.read_back(warc.write(some, smallest=10_000)).collect()} == {"response"}
    clash = odd.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    assert warc.digests(clash).count() == odd.count()


def test_archives_against_sql(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html")
    pages = pages.unionAll(spark.createDataFrame([(10_001, "same"), (10_002, None), (10_003, "same"), (10_004, ""), (10_005, "é")], pages.schema)).selectExpr("page_id", "cast(page_id as string) as url", "html")
    table = pages.toPandas()
    with duckdb.connect() as c:
        c.register("given", table)
        c.execute("create table pages as select page_id::bigint as page_id, html::varchar as html from given")
        assert Counter(map(tuple, warc.digests(pages).collect())) == Counter(c.execute(warc.SQL).fetchall())


# urls


def test_url_rules(spark, small):
    urls = ["http://A.Example.COM/en/71?x", "https://sub.com/en/", "http://xcom/en/", "http://com/en/x#y", "http://d.example.net/de/8", "http://e.net/de/9/", "no scheme", None, "", "://h/p", "a://b://c/d", "http://q.org/es/1", "http://h?x/y", "http://h:80/en/"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, share string")
    labels = spark.createDataFrame([(None, None)], "doc_id long, toxic int")
    got = url_filter.digests(pages, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        url = urls[r["page_id"]] or ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups() if "://" in url else ("", "")
        host = host.lower()
        fits = [(k, x) for k, x in url_filter.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        kind, rule = max(fits, key=lambda x: len(x[1]), default=("allow", None))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, kind)
    assert url_filter.digests(pages.limit(0), labels).collect() == []


def test_template_tree_blocks_bad_branches_only(spark):
    url = lambda kind, i: f"http://h.test/{kind}/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}/{i}.html"
    pages = [(i, url("spam", i)) for i in range(300)] + [(1000 + i, url("news", i)) for i in range(300)] + [(2000, "http://other.test/spam/aa/1")]
    labels = [(url("spam", i), i % 10 > 0) for i in range(0, 300, 3)] + [(url("news", i), i % 10 == 0) for i in range(0, 300, 3)] + [(None, True), (url("news", 1), None)]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "url string, bad boolean"), []).collect()}
    assert {got[i]["verdict"] for i in range(300)} == {"block"} and {got[1000 + i]["verdict"] for i in range(300)} == {"allow"}
    assert got[2000]["verdict"] == "allow"
    assert {got[i]["template"] for i in range(300)} == {"/spam/*/*"}


def test_clashing_names_do_not_get_in_the_way(odd):
    assert set(CLASHES) <= set(odd.columns)
    assert quality.quality_rules(odd).count() == len(ODD)
    for out in (simhash.near_duplicates(odd), pii.find_pii(odd)):
        assert out.count() == len(ODD)
