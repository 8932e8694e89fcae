"""Ids of remembered chunks against the tokenizer's own; packing, token files and counts against brute force."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import ODD
from tokenizers import Tokenizer

from sealframe.llm import packing, token_counts, token_files, tokens

FILES = {"leading_space": P.path("byte_bpe_50k.json"), "words": P.path("word_bpe_49k.json")}


def plain(chunks):
    t = Tokenizer.from_file(FILES[chunks])
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return {k: (tokens.Encoder(p, k), plain(k)) for k, p in FILES.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0.,'!aAbBéÉßΣσİ1½一😀́ "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_give_the_tokenizers_ids(encoders, text):
    for chunks, (own, whole) in encoders.items():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole(text), (chunks, text)


WORDS = st.text(alphabet=st.one_of(st.sampled_from(".,'!*&_\x01aAbBéÉßΣσİ1½一́µ"), st.characters(exclude_categories=["Cs"])), max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.tuples(WORDS, st.sampled_from([" ", "\n", "  ", "\t", ""])), max_size=12)), max_size=6))
def test_texts_together_give_the_tokenizers_ids(encoders, texts):
    texts = [x if x is None else "".join(map("".join, x)) for x in texts]
    for chunks, (own, whole) in encoders.items():
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [whole(x) for x in texts], (chunks, texts)


def test_new_words_of_texts_go_to_the_model_together(monkeypatch):
    random.seed(5)
    texts = [" ".join("".join(random.choices("abcdeéü", k=9)) + random.choice(["", ",", "***"]) for _ in range(300)) for _ in range(5)]
    for limit in (tokens.REMEMBERED, 5):
        monkeypatch.setattr(tokens, "REMEMBERED", limit)
        for chunks, path in FILES.items():
            own, whole, calls = tokens.Encoder(path, chunks), plain(chunks), []
            word = own.word
            own.known.encode, own.spaced.encode = (lambda x, calls=calls, word=word, space=space: calls.append(x) or word(x, space) for space in ("", " "))
            for _ in range(2):
                assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [whole(x) for x in texts]
            assert set(calls) <= {",", "***"}


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    for chunks, whole in ((k, plain(k)) for k in FILES):
        own = tokens.Encoder(FILES[chunks], chunks)
        for text in ["the cat sat on the mat, the dog did not.", "The End. " * 7 + "the cat"] * 3:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == whole(text)


def test_added_tokens_in_texts():
    texts = ["one <|endoftext|> two", "<|startoftext|>The end<|endoftext|>", "<|ENDOFTEXT|> odd <|endoftext|", "x<|endoftext|>\n\nThe cat", "<|STARTOFTEXT|> the cat", "plain"]
    for chunks, path in FILES.items():
        own, library = tokens.Encoder(path, chunks), Tokenizer.from_file(path)
        for text in texts:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, (chunks, text)
            assert np.frombuffer(tokens.Encoder(path, chunks, plain=True).encode(text), "<u4").tolist() == plain(chunks)(text)


def pieces_of(rows, ids_of, capacity=2048):
    out = Counter()
    for name, text in rows:
        ids = [*ids_of(text), 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[name, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check_packed(rows, capacity=2048):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = packing.digests(docs, FILES["leading_space"]).collect()
    want = pieces_of(docs.select("doc_id", "text").collect(), plain("leading_space"))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    n, tokens_in = check_packed(got), sum(r["length"] for r in got)
    assert n <= -(-tokens_in // 2048) + 2


def test_packing_of_odd_rows(odd, nothing):
    got = packing.digests(odd, FILES["leading_space"]).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces_of([x[:2] for x in ODD], plain("leading_space"))
    check_packed(got)
    assert packing.digests(nothing, FILES["leading_space"]).collect() == []


def test_sequences_hold_their_pieces(odd):
    pieces, placement = packing.pack(odd, FILES["leading_space"], capacity=64)
    for r in packing.sequences(pieces, placement).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] == 4 * sum(p["length"] for p in r["parts"]) <= 4 * 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60))
def test_bin_completion_is_valid_and_no_worse_than_best_fit(lengths):
    have = Counter(lengths)
    plan, fit = packing.bin_completion(dict(have), 60), packing.best_fit(dict(have), 60)
    for found in (plan, fit):
        assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in found), Counter()) == have
        assert all(sum(p) <= 60 for p, _ in found)
    assert -(-sum(lengths) // 60) <= sum(n for _, n in plan) <= sum(n for _, n in fit)


def test_bin_completion_beats_best_fit_where_it_can():
    have = {6: 2, 4: 2, 3: 2, 5: 1, 7: 1}  # 10 = 6 + 4 twice, 7 + 3, 5 + 3
    assert sum(n for _, n in packing.bin_completion(have, 10)) == 4


def test_undominated_fillings_against_all_subsets():
    random.seed(3)
    for _ in range(200):
        gap, have = random.randint(3, 14), Counter(random.randint(1, 9) for _ in range(random.randint(1, 7)))
        every = {f for n in range(len(list(have.elements())) + 1) for f in itertools.combinations(sorted(have.elements(), reverse=True), n) if sum(f) <= gap}

        def beaten(f):
            """Whether none or some of its pieces can give way to one left-out piece that is larger, or as large as several."""
            left = have - Counter(f)
            return any(sum(s) <= x <= sum(s) + gap - sum(f) and (len(s) > 1 or x > sum(s)) for x in left for n in range(len(f) + 1) for s in itertools.combinations(f, n))

        waste = random.randint(0, gap)
        got = list(packing.undominated(dict(have), gap, waste))
        assert len(got) == len(set(got)) and [free for free, _ in got] == sorted(free for free, _ in got)
        assert set(got) == {(gap - sum(f), f) for f in every if gap - sum(f) <= waste and not beaten(f)}


def test_lower_bound_is_never_above_the_best_packing():
    random.seed(4)
    for _ in range(60):
        lengths = [random.randint(1, 12) for _ in range(random.randint(1, 7))]

        def least(rest, room):
            if not rest:
                return len(room)
            tried = {r for r in room if r >= rest[0]}
            ways = [least(rest[1:], (*room[: (i := room.index(r))], r - rest[0], *room[i + 1 :])) for r in tried]
            return min([*ways, least(rest[1:], (*room, 12 - rest[0]))])

        best = least(sorted(lengths, reverse=True), ())
        assert packing.lower_bound(Counter(lengths), 12) <= best == sum(n for _, n in packing.bin_completion(Counter(lengths), 12))


@pytest.mark.parametrize(("sequences", "capacity", "more"), [(20, 100, 0), (40, 1000, 1), (300, 2048, 1)])
def test_planted_triples(sequences, capacity, more):
    """Three pieces fill each sequence: best fit needs a sixth more sequences than that."""
    random.seed(sequences)
    lengths = []
    for _ in range(sequences):
        a = random.randint(int(capacity * 0.38), int(capacity * 0.49))
        b = random.randint(capacity // 4, (capacity - a) // 2)
        lengths += [a, b, capacity - a - b]
    have = Counter(lengths)
    plan = packing.bin_completion(have, capacity, effort=4_000)
    assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in plan), Counter()) == have
    assert sequences <= sum(n for _, n in plan) <= sequences + more < sum(n for _, n in packing.best_fit(have, capacity))


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(0,)], "length long"), 10)


def test_one_length_in_many_groups(spark):
    got = packing.place(spark.range(1000).selectExpr("id", "cast(7 as long) as length"), 16).collect()
    assert check_packed(got, 16) == 500


@pytest.mark.parametrize("table", ["small", "odd", "nothing"])
def test_token_files_round_trip(spark, small, odd, nothing, table):
    docs = {"small": spark.read.parquet(f"{small}/documents.parquet"), "odd": odd, "nothing": nothing}[table]
    ids_of, want, at = plain("words"), Counter(), 0
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(text), 1]
        want[name, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    got = token_files.digests(docs, FILES["words"]).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    end = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == end
        end += r["n_tokens"]
    assert end == at
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))


def test_least_doc_id_and_many_without(spark):
    rows = [(-(2**63), "least")] + [(None, f"none {i % 3}") for i in range(200)] + [(7, "same")] * 200
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), FILES["words"], "words", 1, files=4)
    assert manifest.count() == 4 and max(r["n_docs"] for r in manifest.collect()) < 200
    got = [r["doc_id"] for r in token_files.read_back(manifest).orderBy("start").collect()]
    assert got == [None] * 200 + [-(2**63)] + [7] * 200


def test_reader_takes_only_what_is_asked_and_finds_damage(spark, odd, monkeypatch):
    manifest = token_files.write(odd, FILES["words"], "words", 1, files=1).collect()
    path = manifest[0]["path"].removeprefix("file://")
    read = []
    monkeypatch.setattr(token_files.Reader, "read", lambda self, k, f=token_files.Reader.read: (read.append(k), f(self, k))[1])
    got = list(token_files.read_documents(path, [2, 5]))
    assert [d for d, _ in got] == [2, 5] and len(read) == 2
    import zstandard

    whole = open(path, "rb").read()
    assert b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True): r.read(1 << 20), b""))  # a common reader takes it
    damaged = bytearray(whole)
    damaged[20] ^= 1
    bad = path + ".bad"
    open(bad, "wb").write(damaged)
    with pytest.raises(ValueError):
        list(token_files.read_documents(bad, [d for d in (1, 2, 5, 6, 7, 8, token_files.NO_ID)]))
    os.unlink(bad)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_token_counts(spark, small, odd, nothing, block):
    ids_of = plain("leading_space")
    some = spark.createDataFrame([(i, "ab " * (i % 4)) for i in range(12)], "doc_id long, text string") if block < 10 else odd
    got = token_counts.count_tokens(some, FILES["leading_space"], "leading_space", 50256, block=block).collect()
    assert Counter(map(tuple, got)) == Counter((d, len(ids_of(t))) for d, t in some.select("doc_id", "text").collect())
    assert token_counts.count_tokens(nothing, FILES["leading_space"], "leading_space", 50256, block=block).count() == 0


def test_scan_of_a_file_without_a_last_separator(spark, tmp_path):
    f = tmp_path / "x.tokens"
    np.array([9, 9, 0, 0, 5], "<u2").tofile(f)
    got = token_counts.scan(spark.createDataFrame([(str(f),)], "path string"), 0, block=2).select("ordinal", "start", "n_tokens").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 2), (1, 3, 0), (2, 4, 1)]
    (tmp_path / "y.tokens").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        token_counts.scan(spark.createDataFrame([(str(tmp_path / "y.tokens"),)], "path string"), 0).collect()


def test_separator_in_a_text_is_an_error(spark):
    with pytest.raises(Exception, match="separator"):
        token_counts.write_flat(spark.createDataFrame([(1, "!")], "doc_id long, text string"), FILES["leading_space"], "leading_space", 0)
