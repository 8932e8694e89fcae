"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question and its copies with other figures, people or measures
have one template. Windows of five template words of all documents are joined by hash with those of the benchmark, in
these forms:

* typed: with placeholders. A capitalised word that opens a sentence may be a name or not, so its windows have both forms.
* folded: where a window has no capitals, its words may be names too, at the places where the benchmark has names.
* exact: the words in lower case with their own values. They find verbatim copies in other case, and are the only form of
  windows of mostly placeholders, whose typed forms say nothing, and of items of fewer words than a window, which have one
  window of their whole length.

A document holds an item if it has at least 0.8 of the item's windows with their own values, or 0.8 of those with a typed
form and the values in the placeholders agree: each value of the item stands for one value throughout the copy, and the
other way round. All places of a window count, and a document is judged by its best copy.

Windows that no benchmark item can have are dropped before the shuffle by filters of fixed size, made of all the
benchmark's words and windows; the join that follows is exact. Windows with a literal that no item has are not even hashed.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import cut, slices, small

#: Words in a window, windows of an item that a copy has at least, share of placeholders that agree.
WINDOW, COVERAGE, CONSISTENCY = 5, 0.8, 0.8
#: Of a window's words, so many are not placeholders at least, or it has no typed form.
LITERALS = 2
#: Bits of the filter (a power of two): its size doesn't depend on any table.
FILTER_BITS = 1 << 22

#: Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees kph mph"

LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
TYPED, EXACT, FOLDED = range(3)
#: Words that a worker remembers.
REMEMBERED = 250_000
_TRIM = ".,;:!?\"'()[]{}|*#&_-–—…“”‘’«»¿¡"


def classify(word: str) -> tuple[int, str, bool, bool]:
    """Kind of a word by itself, its trimmed form, whether it is capitalised, whether it ends a sentence."""
    if word.isalpha():  # most words
        low = word.lower()
        if low in _UNITS or low in _NUMBERS:
            return NUMBER if low in _NUMBERS else UNIT, low, False, False
        return LITERAL, low, word[0].isupper() and not word.isupper(), False  # a text in capitals has no names
    core, ends = word.strip(_TRIM), word.rstrip("\"')]}”’»").endswith(_ENDS)
    low = core.lower()
    if not core:
        return NOTHING, "", False, ends
    letters = core.isalpha()
    if low in _NUMBERS or not letters and any(map(str.isdigit, core)) and not any(map(str.isalpha, core)):
        return NUMBER, low, False, ends
    if low in _UNITS:
        return UNIT, low, False, ends
    return LITERAL, low, core[0].isupper() and not core.isupper(), ends


_ENDS = (".", "!", "?", ":")
_NUMBERS, _UNITS = frozenset(NUMBER_WORDS.split()), frozenset(UNITS.split())


class _Codes(dict):
    """Word to code: hash of the trimmed form, with the kind and flags in the low bits. Bounded; forgets all beyond that."""

    def __missing__(self, word: str) -> int:
        kind, core, upper, ends = classify(word)
        code = xxhash.xxh64_intdigest(core.encode()) & ~31 | kind << 2 | upper << 1 | ends
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_codes = _Codes()


def template(text: str | None):
    """(exact, kinds, opens, upper, words): a text's template words, without those that are only marks.

    exact: codes of the words in lower case. A capitalised word inside a sentence is a name; one that begins the text or a
    sentence may be a name or not, which opens marks. upper: all capitalised words.
    """
    import numpy as np

    words = (text or "").split()
    raw = np.fromiter(map(_codes.__getitem__, words), dtype=np.uint64, count=len(words))
    kinds = (raw >> np.uint64(2) & np.uint64(7)).astype(np.int8)
    starts = np.ones(len(words), dtype=bool)
    starts[1:] = raw[:-1] & np.uint64(1) == 1
    upper = (raw & np.uint64(2) > 0) & (kinds == LITERAL)
    kinds[upper & ~starts] = NAME
    exact, opens = raw & np.uint64(~31 & (1 << 64) - 1), upper & starts
    if (kinds == NOTHING).any():
        left = np.flatnonzero(kinds != NOTHING)
        return exact[left], kinds[left], opens[left], upper[left], [words[j] for j in left.tolist()]
    return exact, kinds, opens, upper, words


def mixed(codes, place: int):
    """A word's part of the hash of a window in which it stands at this place; a window's hash is the sum of its words'."""
    import numpy as np

    h = (codes + np.uint64(0x9E3779B97F4A7C15 * (place + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def exact_windows(exact, of, window: int):
    """(at, hash) of the windows of so many words within a text, by their words in lower case."""
    import numpy as np

    n = len(exact) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.full(n, window, dtype=np.uint64)
    for k in range(window):
        h += mixed(exact[k : k + n], k)
    at = np.flatnonzero(of[:n] == of[window - 1 :])
    return at, h[at]


def has(bits, hashes):
    """Whether each hash (unsigned) may be in the filter: an array of flags that `bitmap` packs."""
    import numpy as np

    last = np.uint64(len(bits) - 1)
    return bits[hashes & last] & bits[hashes >> np.uint64(32) & last]


def windows(exact, kinds, opens, upper, of, window: int = WINDOW, masks=(), vocabulary=None):
    """(at, hash, holes, names, form) arrays of the windows of many texts, laid end to end; of: the text of each word.

    masks: the places of names, as bits, that folded forms have. vocabulary: a filter of words; windows with a literal that
    is not in it are left out. holes, names: bits of the words that are placeholders, or names, in this form.
    """
    import numpy as np

    n, full = len(exact) - window + 1, (1 << window) - 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none, np.zeros(0, dtype=np.int8)
    literal, inside = kinds == LITERAL, of[:n] == of[window - 1 :]
    known = np.ones(len(exact), dtype=bool) if vocabulary is None else has(vocabulary, exact >> np.uint64(5))
    typed = np.where(literal, exact, kinds.astype(np.uint64))

    def bits(flags):
        out = np.zeros(n, dtype=np.uint8 if window <= 8 else np.int64)
        for k in range(window):
            out |= flags[k : k + n].astype(out.dtype) << k
        return out

    holes, names, openers, capitals, own, fit = map(bits, (~literal, kinds == NAME, opens, upper, known, known | ~literal))
    name, found = [mixed(np.array([NAME], dtype=np.uint64), k)[0] for k in range(window)], []

    def add(these, chosen: int, form: int) -> None:
        """The windows `these` with names at the chosen places, if enough words are literal."""
        if form != EXACT:
            these = these[window - np.bitwise_count(holes[these] | chosen).astype(np.int64) >= LITERALS]
        if len(these):
            h = np.full(len(these), window if form == EXACT else 0, dtype=np.uint64)
            for k in range(window):
                h += name[k] if chosen >> k & 1 else mixed((exact if form == EXACT else typed)[these + k], k)
            found.append((these, h, holes[these].astype(np.int64) | chosen, names[these].astype(np.int64) | chosen, form))

    add(np.flatnonzero(inside & (own == full)), 0, EXACT)
    add(np.flatnonzero(inside & (fit == full)), 0, TYPED)
    some = np.flatnonzero(inside & (openers > 0))
    for chosen in range(1, 1 << window):
        if len(some):
            add(some[(openers[some] & chosen == chosen) & (fit[some] | chosen == full)], chosen, TYPED)
    if masks:
        small_ = np.flatnonzero(inside & (capitals == 0) & (np.bitwise_count(fit) >= LITERALS))
        empty, fits = holes[small_], fit[small_]
        for chosen in masks:
            add(small_[(empty & chosen == 0) & (fits | chosen == full)], chosen, FOLDED)
    if not found:
        return none, none, none, none, np.zeros(0, dtype=np.int8)
    at, h, holes, names = (np.concatenate(x) for x in list(zip(*found, strict=True))[:4])
    return at, h.view(np.int64), holes, names, np.repeat(np.array([f[4] for f in found], dtype=np.int8), [len(f[0]) for f in found])


def template_windows(df: DataFrame, key: list[str], text: str, chosen=None, window: int = WINDOW, capitals: bool = True, masks=(), short=None, vocabulary=None) -> DataFrame:
    """key columns, hash, at (place of the first word), words, holes, names, form of each window at each of its places.

    chosen: a filter of hashes to keep; vocabulary: one of the words that literals must be among. capitals: whether texts without small letters have exact and folded forms. short:
    window lengths under `window` that exact windows have too; None: a text of fewer words has one window of its length.
    """
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)

    def groups(texts):
        """Texts with about so many words together that arrays are worth their calls, and memory stays small."""
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= 1 << 19:
                yield at, texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield at, texts[at:]

    def cut_up(batches):
        import numpy as np

        keep, words = (None if x is None else np.unpackbits(np.frombuffer(x, dtype=np.uint8), bitorder="little").astype(bool) for x in (chosen, vocabulary))
        for batch in slices(batches):
            rows, out = [], [[] for _ in range(6)]
            for first, texts in groups(batch.column(text).to_pylist()):
                made = [template(t) for t in texts]
                sizes = np.array([len(m[0]) for m in made])
                of, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum([0, *sizes])
                exact, kinds, opens, upper = (np.concatenate([m[k] for m in made]) for k in range(4))
                pieces = [(*windows(exact, kinds, opens, upper, of, window, masks, words), window)]
                for n in range(1, window) if short is None else short:
                    at, h = exact_windows(exact, of, n)
                    if short is None:
                        whole = sizes[of[at]] == n
                        at, h = at[whole], h[whole]
                    none = np.zeros(len(at), dtype=np.int64)
                    pieces.append((at, h.view(np.int64), none, none, np.full(len(at), EXACT, dtype=np.int8), n))
                for at, h, holes, names, form, n in pieces:
                    good = np.arange(len(at))
                    if keep is not None:
                        good = np.flatnonzero(has(keep, h.view(np.uint64)))
                    if not capitals and len(good):
                        shouted = np.fromiter(((t or "").isupper() for t in texts), dtype=bool, count=len(texts))
                        good = good[(form[good] == TYPED) | ~shouted[of[at[good]]]]
                    for j in good.tolist():
                        i = int(of[at[j]])
                        place = int(at[j] - begin[i])
                        rows.append(first + i)
                        values = (int(h[j]), place, [w.strip(_TRIM).lower() for w in made[i][4][place : place + n]], int(holes[j]), int(names[j]), int(form[j]))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
            of = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in key), *map(pa.array, out, kinds)], [*key, "hash", "at", "words", "holes", "names", "form"])

    return df.select(*key, text).mapInArrow(cut_up, f"{types}, hash long, at int, words array<string>, holes int, names int, form int")


def bitmap(hashes: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A filter of the column hash, two bits a hash; made of at most bits / 64 rows, whatever the table's size."""
    import numpy as np

    place = F.explode(F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftright("hash", 32).bitwiseAND(bits - 1)))
    places = hashes.select(place.alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).limit(bits // 64).collect()
    out = np.zeros(bits // 64, dtype=np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.astype("<i8").tobytes()


def word_hashes(known: DataFrame) -> DataFrame:
    """The column hash of the distinct words of the benchmark's windows, as codes have it above kind and flags."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x.encode()) >> 5 for x in batch.column("word").to_pylist()], pa.int64())], ["hash"])

    return known.select(F.explode("of").alias("word")).distinct().mapInArrow(hashed, "hash long")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, consistency: float = CONSISTENCY, capitals: bool = False) -> DataFrame:
    """A row for each document and item that it holds: doc_id, text_hash, item_id, n_windows, coverage, consistency, kind.

    kind is "exact" if all placeholders have the item's own values, else "reparameterised". Null and empty texts have no
    windows, so they neither contaminate nor are contaminated; empty tables give no rows. Rows are told apart by doc_id
    (null too) and a hash of the text, so repeated rows count once; other columns are ignored. Of copies that are equally
    good the measures are the same. Very long texts are read whole. Copies in other case count; capitals: also those in
    texts that are all in capitals.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.xxhash64(item_text).alias("item_hash"), F.col(item_text).alias("text")).distinct()
    known = template_windows(items, ["item_id", "item_hash"], "text")
    item = Window.partitionBy("item_id", "item_hash")
    places = lambda which: F.array_distinct(F.collect_list(F.when(which, F.col("at"))).over(item))
    known = known.withColumn("typed", places(F.col("form") == TYPED)).withColumn("every", places(F.lit(True)))
    known = cut(known.select("item_id", "item_hash", "hash", F.col("at").alias("place"), F.col("words").alias("of"), "holes", "names", "form", F.size("typed").alias("n"), F.size("every").alias("m"), F.array_contains("typed", F.col("at")).alias("typed")))
    # at most 2 ** WINDOW and WINDOW values
    masks = sorted(r[0] for r in known.where(f"form = {TYPED} and names > 0").select("names").distinct().limit(1 << WINDOW).collect())
    short = sorted(r[0] for r in known.select(F.size("of")).distinct().limit(WINDOW).collect() if r[0] < WINDOW)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    found = template_windows(rows, ["doc_id", "text_hash"], "text", bitmap(known), capitals=capitals, masks=masks, short=short, vocabulary=bitmap(word_hashes(known)))
    found = found.select("doc_id", "text_hash", "hash", "at", F.col("words").alias("is"))
    met = found.join(small(known.drop("names", "form")), "hash").where(F.size("of") == F.size("is"))
    pair = ["doc_id", "text_hash", "item_id"]
    met = met.groupBy(*pair).agg(F.collect_set(F.struct("item_hash", "at", "place", "of", "is", "holes", "n", "m", "typed")).alias("hits"))
    types = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in pair)

    def judged(batches):
        for batch in batches:
            rows, out = [], []
            for i, hits in enumerate(batch.column("hits").to_pylist()):
                best = judge(hits, coverage, consistency)
                if best:
                    rows.append(i)
                    out.append(best)
            of = pa.array(rows, pa.int64())
            made = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in pair), *made], [*pair, "n_windows", "coverage", "consistency", "kind"])

    return met.mapInArrow(judged, f"{types}, n_windows long, coverage double, consistency double, kind string")


def judge(hits: list[dict], coverage: float, consistency: float) -> tuple[int, float, float, str] | None:
    """(n_windows, coverage, consistency, kind) of the best copy that a document has of an item, or None."""
    texts: dict = {}
    for x in hits:
        texts.setdefault(x["item_hash"], []).append(x)
    found = [r for of in texts.values() for r in copies(of, coverage, consistency)]
    return max(found, key=lambda r: (r[3] == "exact", r[1], r[2]), default=None)


def copies(hits: list[dict], coverage: float, consistency: float):
    """Measures of a document's copies of one text.

    Windows of one distance between the places in document and item are a run. Each run is filled up by the nearest windows
    that it lacks and agrees with, so that copies with words put in or left out are whole. The first places of all windows
    are tried too, those with the item's own values before others.
    """
    runs: dict[int, dict[int, dict]] = {}
    first: dict[int, dict] = {}
    places: dict[int, list[int]] = {}
    for x in sorted(hits, key=lambda x: (x["at"], x["is"] != x["of"], x["holes"].bit_count())):
        if x["place"] not in runs.setdefault(x["at"] - x["place"], {}):
            runs[x["at"] - x["place"]][x["place"]] = x
            places.setdefault(x["place"], []).append(x["at"])
        if x["place"] not in first or x["is"] == x["of"] and first[x["place"]]["is"] != x["of"]:
            first[x["place"]] = x
    whole = measured(first, coverage)
    if whole[1] < coverage:
        return  # nor has any run more
    if good(whole, coverage, consistency):
        yield whole
    for offset, run in runs.items():
        run, near = dict(run), []
        for place in places.keys() - run.keys():
            i = bisect.bisect(places[place], offset + place)
            at = min(places[place][max(i - 1, 0) : i + 1], key=lambda at: abs(at - place - offset))
            near.append((abs(at - place - offset), at - place, place))
        measures = measured(run, coverage)
        if good(measures, coverage, consistency):
            yield measures
        for _, group in itertools.groupby(sorted(near), key=lambda x: x[:2]):
            more = run | {place: runs[other][place] for _, other, place in group}
            measures = measured(more, coverage)
            if measures[2] >= consistency:
                run = more
                if good(measures, coverage, consistency):
                    yield measures


def good(measures: tuple[int, float, float, str], coverage: float, consistency: float) -> bool:
    return measures[1] >= coverage and measures[2] >= consistency


def measured(run: dict[int, dict], coverage: float) -> tuple[int, float, float, str]:
    """Measures of the windows of a run, by their places in the item.

    Enough windows with the item's own values are an exact copy; else those with a typed form are measured.
    """
    n, m = (next(iter(run.values()))[k] for k in "nm")
    own, typed = [x for x in run.values() if x["is"] == x["of"]], [x for x in run.values() if x["typed"]]
    if len(own) >= coverage * m or not n:
        return len(own), len(own) / m, 1.0, "exact"
    slots = [(of, x["is"][k]) for x in typed for k, of in enumerate(x["of"]) if x["holes"] >> k & 1]
    return len(typed), len(typed) / n, agreement(slots), "exact" if all(a == b for a, b in slots) else "reparameterised"


def agreement(slots: list[tuple[str, str]]) -> float:
    """Share of (of, is) pairs that have the most frequent `is` of their `of`, or the most frequent `of` of their `is`.

    The smaller of the two shares; 1 without pairs.
    """
    shares = [1.0]
    for side in (0, 1) if slots else ():
        most: dict[str, int] = {}
        for pair, count in Counter(slots).items():
            most[pair[side]] = max(most.get(pair[side], 0), count)
        shares.append(sum(most.values()) / len(slots))
    return min(shares)


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the contaminated rows."""
    found = cut(contaminated(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct())
    return docs.join(small(found), docs[doc_id].eqNullSafe(F.col("__gone")) & (F.xxhash64(docs[text]) == F.col("__hash")), "left_anti")


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id and measures of every document that holds an item."""
    return contaminated(docs, benchmark, **options).drop("text_hash")
