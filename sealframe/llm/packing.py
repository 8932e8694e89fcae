"""Best-fit packing of documents into fixed-size sequences by bin completion.

Only lengths decide how a sequence is filled, and there are at most `capacity` different ones. So the corpus is reduced
to a histogram of piece lengths (bounded by the capacity, whatever the corpus' size), a branch-and-bound search over the
undominated fillings of that histogram makes a plan with multiplicities, and each piece finds its place in the plan by its rank
among pieces of its length. Ranks come from counts by (length, group) and a window within a group, so a length that a
third of all pieces has is spread over many tasks.
"""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealframe.llm.shared import as_table, by_rows, cut

#: Effort of the search: fillings looked at by the branch-and-bound, then rounds of rearrangement, if the bound isn't met
#: before. It bounds the driver's time; all pieces are packed whatever it is.
EFFORT = 2_000


def encode_pieces(docs: DataFrame, tokenizer: str, chunks: str = "leading_space", capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole documents: doc_id, piece, start, length, ids (binary, little-endian unsigned 32 bit).

    A document is its ids and end_id (a null or empty text: end_id alone). One of more than `capacity` ids is cut from
    its end into pieces of `capacity`; the first piece takes what is left. Rows are independent: null and repeated
    doc_ids stay as they are, other columns are ignored, an empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType

    def encode(batches):
        from sealframe.llm.tokens import encoder

        ids_of, end = encoder(tokenizer, chunks), end_id.to_bytes(4, "little")
        for names, texts in by_rows(batches, "doc_id", "text"):
            rows = []
            for name, ids in zip(names, ids_of.encode_all(texts), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    to = first if k == 0 else at + capacity
                    rows.append((name, k, at, to - at, ids[4 * at : 4 * to]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(encode, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths of a sequence, how many such sequences)."""
    room: dict[int, Counter] = {}  # free space -> fillings with that much of it
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                k = capacity // length
                full, rest = divmod(left, k)
                for size, times in ((k, full), (rest, 1)):
                    if size and times:
                        room.setdefault(capacity - size * length, Counter())[(length,) * size] += times
                break
            pattern, n = next(iter(room[free].items()))
            k = free // length  # as many as fit, as the fullest one that still has room is filled first
            used, rest = divmod(min(left, n * k), k)
            for size, times in ((k, used), (rest, 1 if used < n else 0)):
                if size and times:
                    room[free][pattern] -= times
                    room.setdefault(free - size * length, Counter())[pattern + (length,) * size] += times
                    left -= size * times
            room[free] = +room[free]
            if not room[free]:
                del room[free]
    return [(p, n) for fillings in room.values() for p, n in fillings.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: of all ids, and by a threshold of size, the better of the two.

    For a threshold, pieces that leave less than it free stand alone, others over half the capacity each need a sequence,
    and what pieces of at least the threshold exceed the room beside those needs further ones.
    """
    best = -(-sum(k * v for k, v in counts.items()) // capacity)
    small = sorted((k for k, v in counts.items() if v and 2 * k <= capacity), reverse=True)
    big = sorted(k for k, v in counts.items() if v and 2 * k > capacity)
    most = sum(counts[k] for k in big)
    room = sum(counts[k] * (capacity - k) for k in big)  # beside the pieces that leave the threshold free
    rest = 0
    best = max(best, most)
    for threshold in reversed(small):
        while big and capacity - big[-1] < threshold:
            room -= counts[big[-1]] * (capacity - big[-1])
            big.pop()
        rest = sum(k * counts[k] for k in small if k >= threshold) if not rest else rest - below
        best = max(best, most + max(0, -(-(rest - room) // capacity)))
        below = threshold * counts[threshold]
    return best


def up_to(bits: int, n: int) -> int:
    """The bits, each also set in the n places above it."""
    done = 0
    while done < n:
        step = min(done + 1, n - done)
        bits |= bits << step
        done += step
    return bits


def undominated(have: dict[int, int], gap: int, waste: int):
    """(free, filling): all undominated fillings of a gap that leave at most `waste` free, fullest first, large pieces first.

    A filling is dominated if a piece that is left out fits beside it, or could take the place of one smaller piece of it
    or of several pieces: what it sets free fits wherever that piece would have been. So where the largest piece fits, nothing that is
    less full than it alone counts. Sets of sums, as bits, keep the branches on which a filling can still be reached and
    in which no such piece is left out; pieces come in descending order, so such a piece would never be taken later.
    """
    lengths = sorted((x for x, n in have.items() if n and x <= gap), reverse=True)
    largest = lengths[0] if lengths else 0
    if gap - largest <= waste and (largest == gap or not lengths):
        yield gap - largest, (largest,) * bool(lengths)
        return
    reach, inside = [1] * (len(lengths) + 1), (2 << gap) - 1
    for i in range(len(lengths) - 1, -1, -1):
        sums, left, part = reach[i + 1], min(have[lengths[i]], gap // lengths[i]), 1
        while left:
            part = min(part, left)
            sums |= sums << part * lengths[i] & inside
            left, part = left - part, 2 * part
        reach[i] = sums

    def exact(i: int, rest: int, free: int, one: int, many: int, out: int):
        """Ways to go on from length i to the sum `rest`; one, many: sums of one piece taken, of two or more; out: lengths left."""
        if not rest:
            if not out & (2 << free) - 1:
                yield ()
            return
        while i < len(lengths) and reach[i] >> rest & 1:
            x, single, several, ways = lengths[i], one, many, []
            for k in range(1, min(have[x], rest // x) + 1):
                several |= (several | single) << x
                single |= 1 << x
                unused = out if k < have[x] else out & ~(1 << x)
                if (up_to(several, free) | (up_to(single, free - 1) << 1 if free else 0)) & unused:
                    continue  # a piece that is taken again may be the one that was left out
                if reach[i + 1] >> rest - k * x & 1:
                    ways.append((k, single, several, unused))
            for k, single, several, unused in reversed(ways):
                for more in exact(i + 1, rest - k * x, free, single, several, unused):
                    yield (x,) * k + more
            i += 1

    there = sum(1 << x for x in lengths)
    for free in range(min(waste, gap - largest) + 1):
        if free == gap - largest:
            if lengths[-1] > free or len(lengths) == 1 and have[largest] == 1:
                yield free, (largest,)
        elif reach[0] >> gap - free & 1:
            yield from ((free, f) for f in exact(0, gap - free, free, 0, 0, there))


def without(have: dict[int, int], filling: tuple[int, ...], times: int = 1) -> dict[int, int]:
    left = dict(have)
    for x in filling:
        left[x] -= times
    return {x: n for x, n in left.items() if n}


def bin_completion(counts: dict[int, int], capacity: int, effort: int = EFFORT) -> list[tuple[tuple[int, ...], int]]:
    """A plan of fillings: (lengths, times), of as few sequences as the search finds.

    The incumbent is best-fit decreasing. A node takes the largest length left and branches on the undominated
    fillings around it, each as often as the counts allow, half as often, and so on down to once. What free space a plan
    with one sequence less may have prunes fillings, and the sum of what is left prunes nodes. Once `effort` fillings
    have been looked at without an end, `effort` rounds complete the sequences of small parts of the incumbent anew.
    Both end as soon as the incumbent meets the lower bound, as it mostly does before the search begins.
    """
    counts = {k: v for k, v in counts.items() if v}
    total, bound = sum(k * v for k, v in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)

    def branches(have: dict[int, int], wasted: int):
        big = max(have)
        for free, filling in undominated(without(have, (big,)), capacity - big, (size - 1) * capacity - total - wasted):
            whole = (big, *filling)
            times = min(have[k] // n for k, n in Counter(whole).items())
            while times:
                yield free, whole, times
                times //= 2

    stack = [(counts, [], 0, 0, branches(counts, 0))] if size > bound else []
    tried = 0
    while stack and tried < effort and size > bound:
        have, plan, used, wasted, options = stack[-1]
        found = next(options, None)
        tried += 1
        if found is None:
            stack.pop()
            continue
        free, whole, times = found
        left, used, wasted = without(have, whole, times), used + times, wasted + free * times
        if used + -(-sum(k * v for k, v in left.items()) // capacity) >= size:
            continue
        if left:
            stack.append((left, [*plan, (whole, times)], used, wasted, branches(left, wasted)))
        else:
            best, size = [*plan, (whole, times)], used
    return rearranged(best, capacity, bound, effort) if stack and size > bound else best


def rearranged(plan: list[tuple[tuple[int, ...], int]], capacity: int, bound: int, rounds: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan after rounds that complete a few of its sequences anew, with free space gathered in ever fewer of them.

    A round takes one to six sequences, at least one with free space, and fills them again, largest length first, by one
    of the fullest fillings. It is kept if it needs no more sequences and they are no more alike (sum of squares). What
    occurs several times is changed as often.
    """
    dice, now = random.Random(0), Counter()
    for whole, n in plan:
        now[tuple(sorted(whole))] += n
    size = now.total()
    for _ in range(rounds):
        if size <= bound:
            break
        every = list(now)
        open_ = [x for x in every if sum(x) < capacity]
        taken = Counter({dice.choice(open_), dice.choice(open_), *(dice.choice(every) for _ in range(dice.randint(1, 5)))})
        if len(taken) == 1 and now[next(iter(taken))] > 1:
            taken += taken
        have, new = dict(Counter(x for whole, n in taken.items() for x in whole * n)), Counter()
        while have:
            big = max(have)
            ways = undominated(without(have, (big,)), capacity - big, capacity)
            free, filling = next(ways)
            others = itertools.takewhile(lambda x, free=free: x[0] == free, ways) if free == 0 else ()
            filling = dice.choice([filling, *(f for _, f in itertools.islice(others, 3))])
            new[tuple(sorted((big, *filling)))] += 1
            have = without(have, (big, *filling))
        squares = [sum(sum(whole) ** 2 * n for whole, n in x.items()) for x in (new, taken)]
        if new.total() < taken.total() or new.total() == taken.total() and squares[0] >= squares[1]:
            times = min(now[whole] // n for whole, n in taken.items())
            for whole, n in taken.items():
                now[whole] -= n * times
            for whole, n in new.items():
                now[whole] += n * times
            now = +now
            size += (new.total() - taken.total()) * times
    return list(now.items())


def place(pieces: DataFrame, capacity: int = 2048, length: str = "length", effort: int = EFFORT) -> DataFrame:
    """pieces with sequence_id and offset (long): where each piece stands; sequences are gapless from offset 0.

    pieces: any columns and a whole-number `length` from 1 to capacity (others raise an error), stored so that reading
    it twice gives the same rows (a table or a checkpoint). Rows may repeat or hold nulls elsewhere. An empty table
    gives an empty one. Columns sequence_id and offset of the input are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    kept = list(pieces.columns)
    # at most `capacity` rows, whatever the corpus' size
    histogram = {r[0]: r[1] for r in pieces.groupBy(F.col(length).cast("long")).count().limit(capacity + 2).collect()}
    if any(k is None or not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    plan = bin_completion(histogram, capacity, effort)
    starts, rules, taken, sequences = [], [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for size, k in sorted(Counter(pattern).items(), reverse=True):
            starts.append((size, taken[size]))
            rules.append((taken[size], k, sequences, offset))
            taken[size] += k * times
            offset += k * size
        sequences += times
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum(histogram.values())
    groups = max(1, math.ceil(max(histogram.values(), default=0) * 8 * tasks / max(total, 1)))
    # groups by place in the stored table, as rows of one length may be equal in all columns
    dealt = pieces.withColumn("__row", F.monotonically_increasing_id()).withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    counted = dealt.groupBy(F.col(length).alias("__length"), F.col("__group").alias("__of")).count()
    before = Window.partitionBy("__length").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = dealt.join(bases, (F.col(length) == F.col("__length")) & (F.col("__group") == F.col("__of")))
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("__length", "__of").orderBy("__row")) - 1 + F.col("__base"))
    order = sorted(range(len(starts)), key=starts.__getitem__)
    keys, rules = [starts[i] for i in order], [rules[i] for i in order]

    def locate(batches):
        import numpy as np

        key = np.array([(a << 44) + b for a, b in keys], dtype=np.int64)
        rule = np.array(rules, dtype=np.int64).reshape(-1, 4)
        for batch in batches:
            sizes = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False).astype(np.int64)
            first, k, sequence, offset = rule[np.searchsorted(key, (sizes << 44) + rank, "right") - 1].T
            q = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence + q // k), pa.array(offset + q % k * sizes)], [*kept, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*kept, "__rank").mapInArrow(locate, schema)


def pack(docs: DataFrame, tokenizer: str, chunks: str = "leading_space", capacity: int = 2048, end_id: int = 0, **columns) -> tuple[DataFrame, DataFrame]:
    """(pieces, placement): stored pieces with their ids and a piece_id, and piece_id, sequence_id, offset.

    Joined on piece_id they make sequences(); what a caller doesn't need of the ids is not moved.
    """
    pieces = as_table(encode_pieces(docs, tokenizer, chunks, capacity, end_id, **columns).withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    return pieces, place(pieces.select("piece_id", "length"), capacity)


def sequences(pieces: DataFrame, placement: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary), parts (doc_id, piece, offset, length)."""
    parts = pieces.join(placement.drop("length"), "piece_id")
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    out = parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return out.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("parts"))


def digests(docs: DataFrame, tokenizer: str, chunks: str = "leading_space", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Where each piece stands and a checksum of its ids, instead of the ids."""
    pieces = as_table(encode_pieces(docs, tokenizer, chunks, capacity, end_id), "pieces")
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(cut(narrow), capacity)
