"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. A conditional random field over a document's candidate words (those with a digit or an @, or
inside a base span) adds to them: neighbours in the text share transition potentials, and distant words that repeat or
resemble each other share skip potentials, so that what a pattern knows in one place carries over to another form of the
same value. Beliefs come from loopy sum-product message passing; base words are clamped to their kind.

Word potentials are a softmax regression on shapes, transition and skip weights come from counts. All are fitted to the
patterns' own labels on a bounded sample (SAMPLE documents of at most SAMPLE_CHARS characters, those of the smallest text
hashes); every text is then read whole. Words, links and messages of a document are arrays, and messages are passed in
blocks of links, so that memory is some 200 bytes a candidate word whatever the text's length.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealframe.llm.shared import by_rows, slices

KINDS = ("email", "ip", "card", "phone")
#: Documents with candidate characters that the model is fitted on, at most; their characters, each; words that they yield, at most.
SAMPLE, SAMPLE_CHARS, SAMPLE_WORDS = 1_000, 50_000, 40_000
#: Rounds of message passing, share of the old message that a new one keeps, least belief of an added word.
ROUNDS, DAMPING, BELIEF = 12, 0.3, 0.6
#: Links whose messages are computed at a time.
BLOCK = 1 << 16

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, and a run that fails once fails from each of its digits
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[A-Za-z0-9._%+-]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = ".,;:!?()[]{}<>\"'|*#"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base matches, by start, then kind; leftmost and not overlapping within a kind."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _RUN.match(text, start - 1):
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            end = m.end()
            found.append((start, end, 0))
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no match runs over this sign
            at = text.find("@", at + 1)
    found += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))] if "." in text else []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= sum(x.isdigit() for x in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Words(NamedTuple):
    """Candidate words of a document, in order, as arrays.

    start, end: places in the text; labels: 0 none, else kind + 1 of a base span; shapes: features as bits; chain: whether
    the word before is a neighbour; earlier, later: words that a skip link joins.
    """

    start: Any
    end: Any
    labels: Any
    shapes: Any
    chain: Any
    earlier: Any
    later: Any


def shape(word: str) -> int:
    """Features of a word by itself, as bits; the lowest is always set."""
    digits = "".join(x for x in word if "0" <= x <= "9")
    n, letters = len(digits), sum(x.isalpha() for x in word)
    flags = [True, "@" in word, word[:1] == "+", letters > 0, "-" in word, "(" in word, word.count(".") == 3, n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n >= 20, 14 <= n <= 19 and luhn(digits), n > 0 and letters > n]
    return sum(1 << k for k, flag in enumerate(flags) if flag)


FEATURES = 16


def features(shapes):
    """A row of 0 and 1 for each shape."""
    import numpy as np

    return (np.asarray(shapes)[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)


def keys(word: str) -> list[str]:
    """What words have in common that may stand for the same value: all letters and digits, the digits, an address' name."""
    low = word.lower()
    whole, digits = "".join(x for x in low if x.isalnum()), "".join(x for x in low if "0" <= x <= "9")
    found = [f"w{whole}"] if len(whole) >= 5 else []
    found += [f"d{digits}"] if len(digits) >= 6 else []
    name = "".join(x for x in low.partition("@")[0] if x.isalnum())
    return found + ([f"w{name}"] if "@" in low and len(name) >= 5 and any(x.isdigit() for x in name) else [])


def candidates(text: str, base: list[tuple[int, int, int]]) -> Words:
    import numpy as np
    from xxhash import xxh64_intdigest

    starts, ends, labels, shapes, chain, likes, of = array("q"), array("q"), array("b"), array("H"), array("b"), array("Q"), array("i")
    spans, b, order, previous = sorted(base), 0, 0, -9
    for m in _WORD.finditer(text):
        order += 1
        raw, start, end = m.group(), *m.span()
        while b < len(spans) and spans[b][1] <= start:
            b += 1
        label = next((k + 1 for s, e, k in spans[b : b + 4] if s < end and e > start), 0)
        if not label and raw.isalpha() or not (label or "@" in raw or _DIGIT.search(raw)):
            continue
        core = raw.strip(_MARKS) or raw
        start += raw.find(core)
        for key in keys(core):
            likes.append(xxh64_intdigest(key))
            of.append(len(starts))
        starts.append(start)
        ends.append(start + len(core))
        labels.append(label)
        shapes.append(shape(core))
        chain.append(len(starts) > 1 and order - previous <= 2)
        previous = order
    like, word = np.array(likes, dtype=np.uint64), np.array(of, dtype=np.int32)
    del likes, of
    at = np.argsort(like, kind="stable")  # words of one key in order
    like, word = like[at], word[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = like[1:] != like[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
    later = np.flatnonzero(~new)
    # each word is linked to the first and the last of its like before it
    pairs = np.concatenate([word[begin[later]].astype(np.int64) << 32 | word[later], word[later - 1].astype(np.int64) << 32 | word[later]])
    pairs = np.unique(pairs[pairs >> 32 != pairs & 0xFFFFFFFF])
    return Words(np.array(starts), np.array(ends), np.array(labels, dtype=np.int8), np.array(shapes, dtype=np.uint16), np.array(chain, dtype=bool), (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))


class Model(NamedTuple):
    """Weights: features x labels; log potentials of neighbours' labels; log potential of equal labels over a skip."""

    words: list[list[float]]
    chain: list[list[float]]
    skip: float


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Fit the potentials on a bounded sample; without candidates in it, words are never labelled beyond the base."""
    import numpy as np

    t = F.col(text)
    hashed = docs.select(t.alias("text"), F.xxhash64(t).alias("h"))
    # a share of all hashes in which ten times the sample is expected, so that what one task sorts doesn't grow with the corpus
    share = min(1.0, 10 * SAMPLE / max(1, docs.count()))
    chosen = hashed.where((F.col("h") <= min(int(share * 2**64), 2**64 - 1) - 2**63) & (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")).dropDuplicates(["h"])
    sample = chosen.orderBy("h").limit(SAMPLE).select("text")

    def rows(batches):
        for (texts,) in by_rows(batches, "text"):
            for x in texts:
                w = candidates(x, base_spans(x))
                labels, after, like = w.labels.astype(np.int32), np.full(len(w.start), -1, dtype=np.int32), np.full(len(w.start), -1, dtype=np.int32)
                linked = np.flatnonzero(w.chain)
                after[linked - 1] = labels[linked]
                like[w.later] = labels[w.earlier]
                yield pa.RecordBatch.from_arrays([pa.array(w.shapes.astype(np.int32)), pa.array(labels), pa.array(after), pa.array(like)], ["x", "y", "next", "like"])

    got = sample.mapInArrow(rows, "x int, y int, next int, like int").limit(SAMPLE_WORDS).collect()
    labels = len(KINDS) + 1
    weights = np.zeros((FEATURES, labels))
    pair = np.full((labels, labels), 0.5)
    agree = np.array([1.0, 1.0])
    if got:
        x, y = features([r["x"] for r in got]), np.array([r["y"] for r in got])
        target = np.eye(labels)[y]
        for _ in range(400):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights += 2.0 * (x.T @ (target - p) / len(x) - 1e-4 * weights)
        for r in got:
            if r["next"] >= 0:
                pair[r["y"], r["next"]] += 1
            if r["like"] >= 0 and (r["y"] or r["like"]):
                agree[int(r["y"] == r["like"])] += 1
    chain = np.log(pair * pair.sum() / (pair.sum(axis=1, keepdims=True) * pair.sum(axis=0, keepdims=True))).clip(-2, 2)
    return Model(weights.tolist(), chain.tolist(), float(np.log(agree[1] / agree[0]).clip(1, 4)))


def passed(total, back, potential):
    """Messages over links: what the sources believe without what came back from the targets, through the potential."""
    import numpy as np

    out = total - back
    out = np.log(np.exp(out - out.max(axis=1, keepdims=True)) @ potential + np.float32(1e-30))
    return out - out.max(axis=1, keepdims=True)


def beliefs(words: Words, model: Model):
    """Marginals of each word's labels by loopy sum-product over chain and skip links."""
    import numpy as np

    n, labels = len(words.start), len(KINDS) + 1
    kinds, of = np.unique(words.shapes, return_inverse=True)
    unary = (features(kinds) @ np.array(model.words)).astype(np.float32)[of]
    base = np.flatnonzero(words.labels)
    unary[base] = -50.0
    unary[base, words.labels[base]] = 50.0
    unary -= unary.max(axis=1, keepdims=True)
    linked = np.flatnonzero(words.chain).astype(np.int32)
    # links of a kind: sources, targets, potential, messages to the targets and back
    kinds_of_links = [(linked - 1, linked, np.exp(np.array(model.chain))), (words.earlier, words.later, np.exp(np.eye(labels) * model.skip))]
    links = [(a, b, p.astype(np.float32), np.zeros((len(a), labels), dtype=np.float32), np.zeros((len(a), labels), dtype=np.float32)) for a, b, p in kinds_of_links if len(a)]

    def total():
        out = unary.copy()
        for a, b, _, to, back in links:
            for k in range(labels):
                for i in range(0, len(a), BLOCK):
                    at = slice(i, i + BLOCK)
                    np.add.at(out[:, k], b[at], to[at, k])
                    np.add.at(out[:, k], a[at], back[at, k])
        return out

    for _ in range(ROUNDS if links else 0):
        now, change = total(), 0.0
        for a, b, p, to, back in links:
            for i in range(0, len(a), BLOCK):
                at = slice(i, i + BLOCK)
                new = passed(now[a[at]], back[at], p), passed(now[b[at]], to[at], p.T)
                change = max(change, float(np.abs(new[0] - to[at]).max()), float(np.abs(new[1] - back[at]).max()))
                for old, x in zip((to, back), new, strict=True):
                    old[at] = DAMPING * old[at] + (1 - DAMPING) * x
        if change < 1e-3:
            break
    unary = total()
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True) if n else p


def find(text: str | None, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a whole text; added spans overlap no base span."""
    import numpy as np

    if not text or not ("@" in text or _DIGIT.search(text)):
        return [], []
    base = base_spans(text)
    words = candidates(text, base)
    if not len(words.start):
        return base, base
    p, added = beliefs(words, model), []
    kinds = p.argmax(axis=1)
    for i in np.flatnonzero((words.labels == 0) & (kinds > 0) & (p.max(axis=1) >= BELIEF)).tolist():
        start, end, kind = int(words.start[i]), int(words.end[i]), int(kinds[i]) - 1
        if added and added[-1][2] == kind and added[-1][3] == i - 1 and words.chain[i] and not text[added[-1][1] : start].strip():
            added[-1] = (added[-1][0], end, kind, i)
        else:
            added.append((start, end, kind, i))
    return base, sorted([*base, *(x[:3] for x in added)], key=lambda s: (s[0], s[2]))


_DIGIT = re.compile("[0-9]")


def write_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, in the place of its kind in brackets."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, redacted of every row.

    Null and empty texts have no spans; a null text stays null in redacted. Offsets count code points. doc_ids may be
    null or repeat; other columns are ignored; an empty table gives no rows. Very long texts are read whole, a document at a
    time. Of labels that a word may equally have, it takes the first in the order of KINDS; none comes before them.
    """
    kind, model = docs.schema[doc_id].dataType.simpleString(), model or fit(docs, text)

    def search(batches):
        for batch in slices(batches):
            rows = []
            for t in batch.column("text").to_pylist():
                base, spans = find(t, model)
                rows.append((*(sum(k == s[2] for s in base) for k in range(len(KINDS))), hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(spans), redact(t, spans) if spans else t))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(search, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string")


def redact_all(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with redacted texts, and n_chars, if it is there, counted anew; other columns and all rows stay."""
    model = model or fit(docs, text)

    def rewrite(batches):
        for batch in slices(batches):
            i = batch.schema.get_field_index(text)
            new = [redact(t, spans) if (spans := find(t, model)[1]) else t for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(docs: DataFrame) -> DataFrame:
    return find_pii(docs.select("doc_id", "text")).drop("redacted")
