"""Brown class-based bigrams: words get classes by exchange clustering; a text's probability is the product of class
transitions and of words within their class.

Classes are: the end of a text; CLASSES clusters of words; and one class of rare words, which also holds all unknown
words as one event (as the base score does). Every frequent word is in a cluster. The SEEDS most frequent ones start
them: they are exchanged one at a time in the driver. All further ones are put where the bigram likelihood is highest,
and then all words are exchanged in rounds: tasks count which classes stand before and after each word, blocks of words
meet in one task each, which finds every word's best class against the small table of classes, and of several sets of
these moves the one with the highest likelihood is made, if it is higher than before. Transitions are smoothed towards
the classes' own frequencies, rare words are discounted in favour of unknown ones.

Word counts are gathered from every training text and stay in a table; only the MOST_FREQUENT words that occur at
least LEAST_COUNT times, their classes, and sums over classes (all bounded by those parameters) go to the driver and to
tasks. Rare words of a text meet their counts in a join.

Defined cases: a null or empty text is the end token alone; a null id belongs to the training texts; repeated rows
count each; with no training text at all every count is zero and N = V = 0; an empty table gives no rows; a very long
text is coded and scored whole; equally good classes go to the lower number; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import documents_text, written

MOST_FREQUENT, LEAST_COUNT, LONGEST_WORD = 131_072, 3, 256
SEEDS, CLASSES, SEED_ROUNDS, ROUNDS = 512, 48, 8, 3
FOLDS, HELD_OUT = 7, 2
PRIOR = 4.0
STEPS = 64
FLUSH = 1 << 20
BLOCK = 128
RARE_CLASS, END_CLASS = CLASSES, CLASSES + 1
ALL_CLASSES = END_CLASS + 1


def words_of(text: str) -> list[bytes]:
    """The words with A-Z in lower case: for bytes, lower() and split() know just the ASCII letters and blanks."""
    return text.encode().lower().split()


def prepared(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select("doc_id", documents_text(docs).alias("text"), held_out.alias("held_out"))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) of the training texts, each task's counts added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for k in range(0, len(words), 100_000):
                part = words[k : k + 100_000]
                yield pa.record_batch([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield from flushed()
        yield from flushed()

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def coded(training: DataFrame, units) -> DataFrame:
    """Each text as 32-bit numbers: its words' places among the frequent ones (rare words share the place after
    them), then the end (the place after that). units: broadcast of the frequent words' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = units.value
        rare = len(unit)
        for batch in batches:
            codes = [np.array([*[unit.get(w, rare) for w in words_of(t)], rare + 1], dtype="<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(codes, pa.binary())], names=["codes"])

    return written(training.select("text").mapInArrow(run, "codes binary"))


def neighbours(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and the places after them, a quarter of a million at a time. Each text begins after an end."""
    held: list[bytes] = []
    size = 0

    def pair() -> tuple[np.ndarray, np.ndarray]:
        stream = np.concatenate([[end], np.frombuffer(b"".join(held), dtype="<i4")]).astype(np.int64)
        return stream[:-1], stream[1:]

    for batch in batches:
        for codes in batch.column(0).to_pylist():
            held.append(codes)
            size += len(codes)
            if size > FLUSH:
                yield pair()
                held, size = [], 0
    if held:
        yield pair()


def summed_pairs(codes: DataFrame, maps: list[np.ndarray], width: int) -> np.ndarray:
    """For each map of places to fewer groups: how often a group follows a group."""
    shared = codes.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        total = np.zeros((len(maps), width * width), dtype=np.int64)
        for a, b in neighbours(batches, len(maps[0]) - 1):
            for k, group in enumerate(maps):
                total[k] += np.bincount(group[a] * width + group[b], minlength=width * width)
        total = total.ravel()
        cell = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    # At most len(maps) x width x width sums.
    sums = codes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(maps) * width * width, dtype=np.int64)
    out[sums.cell.to_numpy(dtype=np.int64)] = sums.n.to_numpy(dtype=np.int64)
    return out.reshape(len(maps), width, width)


def entropy_terms(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def table_likelihood(table: np.ndarray) -> float:
    """Of the classes' bigrams: the part that depends on the assignment."""
    return float(entropy_terms(table).sum() - entropy_terms(table.sum(axis=0)).sum() - entropy_terms(table.sum(axis=1)).sum())


def likelihood(pairs: np.ndarray, of: np.ndarray, classes: int) -> float:
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    return table_likelihood(table)


def move_gains(table: np.ndarray, out: np.ndarray, into: np.ndarray, loop: float, classes: int) -> np.ndarray:
    """What a word adds to the likelihood in each of the first classes. table: the classes' bigrams without the word;
    out, into: the classes after and before it, `loop` more pairs being the word twice."""
    # The word's neighbours count in their own classes' sums wherever it goes.
    rows, columns = table.sum(axis=1)[:classes] + into[:classes], table.sum(axis=0)[:classes] + out[:classes]
    o, i = out.sum() + loop, into.sum() + loop
    after, before = np.nonzero(out)[0], np.nonzero(into)[0]  # other classes add nothing
    ahead, behind = table[:classes, after], table[before, :classes].T
    row_gain = (entropy_terms(ahead + out[after]) - entropy_terms(ahead)).sum(axis=1)
    column_gain = (entropy_terms(behind + into[before]) - entropy_terms(behind)).sum(axis=1)
    corner, c_out, c_into = table.diagonal()[:classes], out[:classes], into[:classes]
    both, neither, one, other, rows_with, rows_now, columns_with, columns_now = entropy_terms(np.array([
        corner + c_out + c_into + loop, corner, corner + c_out, corner + c_into, rows + o, rows, columns + i, columns]))
    return row_gain + column_gain + both + neither - one - other - (rows_with - rows_now + columns_with - columns_now)


def block_gains(table: np.ndarray, out: np.ndarray, into: np.ndarray, loop: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """move_gains of many words (a row each), every one alone taken out of a table that still holds them all in their
    own classes. The work grows with the words' neighbouring classes: most words have a few only."""
    movable = np.nonzero(own < classes)[0]  # words whose own class is one of those tried
    gain = np.zeros((len(own), classes))
    sides = ((table[:classes].T, out, into), (table[:, :classes], into, out))
    for bigrams, near, far in sides:  # bigrams[k, c]: of class c with its neighbour k
        word, k = np.nonzero(near)
        if not len(word):
            continue
        count, to = near[word, k], own[word]
        now = bigrams[k]
        same = to == k
        now[same] -= far[word[same], :classes]
        within = np.nonzero(to < classes)[0]
        now[within, to[within]] -= count[within] + np.where(same[within], loop[word[within]], 0)
        terms = entropy_terms(now + count[:, None]) - entropy_terms(now)
        first = np.append(0, np.nonzero(np.diff(word))[0] + 1)
        gain[word[first]] += np.add.reduceat(terms, first)
    o, i = out.sum(axis=1) + loop, into.sum(axis=1) + loop
    corner = np.repeat(table.diagonal()[None, :classes], len(own), axis=0)
    rows, columns = (np.repeat(table.sum(axis=a)[None, :classes], len(own), axis=0) for a in (1, 0))
    at = movable, own[movable]
    corner[at] -= (out[at] + into[at] + loop[movable])
    rows[at] -= o[movable]
    columns[at] -= i[movable]
    c_out, c_into = out[:, :classes], into[:, :classes]
    gain += entropy_terms(corner + c_out + c_into + loop[:, None]) + entropy_terms(corner) - entropy_terms(corner + c_out) - entropy_terms(corner + c_into)
    return gain - (entropy_terms(rows + o[:, None]) - entropy_terms(rows) + entropy_terms(columns + i[:, None]) - entropy_terms(columns))


def exchange(pairs: np.ndarray, movable: int, classes: int, fixed: np.ndarray, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """Classes of the units: the first `movable` units move between the first `classes` classes, each to where the
    bigram likelihood is highest, until a round moves none; the other units keep their fixed classes."""
    of = np.concatenate([np.arange(movable) % classes, fixed])
    total = int(max(of.max() + 1, classes))
    left = np.zeros((len(of), total))  # from a unit to a class
    right = np.zeros((len(of), total))  # from a class to a unit
    for k in range(total):
        left[:, k] = pairs[:, of == k].sum(axis=1)
        right[:, k] = pairs[of == k].sum(axis=0)
    table = np.array([left[of == k].sum(axis=0) for k in range(total)])
    active = [w for w in range(movable) if pairs[w].sum() + pairs[:, w].sum() > 0]
    for _ in range(rounds):
        moved = 0
        for w in active:
            own, loop = of[w], float(pairs[w, w])
            out, into = left[w].copy(), right[w].copy()
            out[own] -= loop
            into[own] -= loop
            # Without the word.
            table[own] -= out
            table[:, own] -= into
            table[own, own] -= loop
            gain = move_gains(table, out, into, loop, classes)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table[best] += out
            table[:, best] += into
            table[best, best] += loop
            if best != own:
                moved += 1
                of[w] = best
                for side, source in ((left, pairs[:, w]), (right, pairs[w])):
                    side[:, own] -= source
                    side[:, best] += source
        if not moved:
            break
    return of


def best_moves(codes: DataFrame, of: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frequent word the class where the likelihood is highest, all others staying, and how much it gains."""
    words = len(of) - 2
    width = 2 * ALL_CLASSES + 1
    shared = codes.sparkSession.sparkContext.broadcast((of, table.astype(float)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value[0]
        # For each word: the classes after it, those before it, and how often it follows itself.
        total = np.zeros(words * width, dtype=np.int64)
        for a, b in neighbours(batches, words + 1):
            first, second = a < words, b < words
            cells = [a[first] * width + of[b[first]], b[second] * width + ALL_CLASSES + of[a[second]], a[first & (a == b)] * width + 2 * ALL_CLASSES]
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            total[cell] += n
        cell = np.nonzero(total)[0]
        n = total[cell]
        block, start = np.unique(cell // (BLOCK * width), return_index=True)
        ends = pa.array(np.append(start, len(cell)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cell - cell // (BLOCK * width) * BLOCK * width).astype(np.int32), n)]
        yield from pa.Table.from_arrays([pa.array(block, pa.int64()), *lists], names=["block", "cell", "n"]).to_batches(max_chunksize=256)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shared.value
        filled = table.sum(axis=1)[:CLASSES] > 0

        def chosen(block: int, sums: np.ndarray) -> pa.RecordBatch:
            found = sums.reshape(BLOCK, width)[: words - block * BLOCK].astype(float)
            k = np.nonzero(found.any(axis=1))[0]
            word, found = block * BLOCK + k, found[k]
            own, loop, rank = of[word], found[:, -1], np.arange(len(k))
            out, into = found[:, :ALL_CLASSES].copy(), found[:, ALL_CLASSES:-1].copy()
            out[rank, own] -= loop
            into[rank, own] -= loop
            gain = block_gains(table, out, into, loop, own, CLASSES)
            placed = own < CLASSES
            if filled.any():
                gain[np.ix_(~placed, ~filled)] = -np.inf  # all new words at once would meet in an empty class
            best = np.argmax(gain, axis=1)
            more = np.where(placed, gain[rank, best] - gain[rank, np.where(placed, own, 0)], np.inf)
            return pa.record_batch([pa.array(word), pa.array(best.astype(np.int32)), pa.array(more)], schema=MOVES)

        now, sums = -1, np.zeros(BLOCK * width, dtype=np.int64)
        for block, cell, n in ((b.as_py(), c.values.to_numpy(), n.values.to_numpy()) for batch in batches for b, c, n in zip(*batch.columns)):
            if block != now:
                if now >= 0:
                    yield chosen(now, sums)
                now, sums = block, np.zeros(BLOCK * width, dtype=np.int64)
            sums[cell] += n
        if now >= 0:
            yield chosen(now, sums)

    blocks = codes.mapInArrow(count, "block long, cell array<int>, n array<long>").repartition("block").sortWithinPartitions("block")
    moves = blocks.mapInArrow(choose, "word long, best int, gain double").toPandas()  # a row for each frequent word
    best, gain = of[:words].copy(), np.zeros(words)
    best[moves.word.to_numpy(dtype=np.int64)] = moves.best
    gain[moves.word.to_numpy(dtype=np.int64)] = moves.gain
    return best, gain


MOVES = pa.schema([("word", pa.int64()), ("best", pa.int32()), ("gain", pa.float64())])


def clustered(codes: DataFrame, words: int, seeds: int = SEEDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the places, the classes' bigrams, and the likelihood once all words have a class and after each round."""
    seeds = min(seeds, words)
    place = np.arange(words + 2)
    few = np.where(place < seeds, place, np.where(place == words + 1, seeds + 1, seeds))
    pairs = summed_pairs(codes, [few], seeds + 2)[0]
    of = exchange(pairs, seeds, CLASSES, np.array([RARE_CLASS, END_CLASS]))[few]
    if words > seeds:
        best, gain = best_moves(codes, of, summed_pairs(codes, [of], ALL_CLASSES)[0])
        of[seeds:words] = best[seeds:]
    table = summed_pairs(codes, [of], ALL_CLASSES)[0]
    climb = [table_likelihood(table)]
    for _ in range(rounds if words else 0):
        best, gain = best_moves(codes, of, table)
        better = gain > 1e-6
        if not better.any():
            break
        # Moves at the same time may spoil each other: try all, every other one, and the few that gain most.
        few_best = [better & (gain >= np.quantile(gain[better], q)) for q in (0.75, 0.97)]
        sets = [better, better & (place[:words] % 2 == len(climb) % 2), *few_best]
        tried = [np.append(np.where(x, best, of[:words]), of[words:]) for x in sets]
        tables = summed_pairs(codes, tried, ALL_CLASSES)
        reached = [table_likelihood(t) for t in tables]
        k = int(np.argmax(reached))
        if reached[k] <= climb[-1]:
            break
        of, table = tried[k], tables[k]
        climb.append(reached[k])
    return of, table, climb


class Model:
    """What tasks need: for each frequent word its class, and the logs of its emission and base probability."""

    def __init__(self, words: list[bytes], counts: np.ndarray, of: np.ndarray, table: np.ndarray, facts: dict):
        self.index = {w: k for k, w in enumerate(words)}
        self.classes = of[: len(words)]
        own = table.sum(axis=0)
        overall = (own + 1) / (own.sum() + ALL_CLASSES)
        self.transitions = np.log10((table + PRIOR * overall) / (table.sum(axis=1, keepdims=True) + PRIOR))
        sizes = np.bincount(self.classes, weights=counts, minlength=ALL_CLASSES)
        self.emission = np.log10(counts / sizes[self.classes]) if len(words) else np.zeros(0)
        self.tokens, self.distinct = facts["tokens"], facts["distinct"]
        self.base_floor = float(np.log10(max(self.tokens + self.distinct + 1, 1)))
        self.base = np.log10(counts + 1.0) - self.base_floor
        self.end_base = float(np.log10(facts["texts"] + 1) - self.base_floor)
        once, twice = facts["once"], facts["twice"]
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        self.climb = facts["climb"]
        self.rare_tokens, self.rare_words = facts["rare_tokens"], facts["rare_words"]
        unknown = self.discount * self.rare_words / self.rare_tokens if self.rare_tokens else 1.0
        self.unknown = float(np.log10(unknown))


def most_frequent(counts: DataFrame) -> DataFrame:
    """At most MOST_FREQUENT words, those above a count. The limit is found from counts in STEPS steps an octave, so
    that no task sends its own top words to the driver."""
    usual = counts.filter((F.col("c") >= LEAST_COUNT) & (F.octet_length("word") <= LONGEST_WORD)).withColumn("step", F.floor(F.log2("c") * STEPS))
    total, least = 0, 0
    for step, n in sorted(usual.groupBy("step").count().collect(), reverse=True):  # some 64 x STEPS rows at most
        if total + n > MOST_FREQUENT:
            least = step + 1
            break
        total += n
    return usual.filter(F.col("step") >= least).select("word", "c")


def trained(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all training words' counts."""
    spark = rows.sparkSession
    training = rows.filter(~F.col("held_out"))
    counts = written(word_counts(training))
    frequent = most_frequent(counts).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, numbers = [bytes(w) for w in frequent.word], frequent.c.to_numpy(dtype=np.int64)
    sums = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    texts = training.count()
    facts = {"texts": texts, "tokens": (sums[0] or 0) + texts, "distinct": sums[1] + (texts > 0), "once": sums[2], "twice": sums[3],
             "rare_tokens": (sums[0] or 0) - int(numbers.sum()), "rare_words": sums[1] - len(words)}
    lookup = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    of, table, climb = clustered(coded(training, lookup), len(words))
    return Model(words, numbers, of, table, {**facts, "climb": climb}), counts


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()),
                    ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])
SCORED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, score double, words array<binary>, times array<long>"


def scored(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = shared.value, TaskContext.get().partitionId() << 40
        # The last place of each array serves words without an index.
        classes, base, emission = np.append(model.classes, RARE_CLASS), np.append(model.base, 0.0), np.append(model.emission, 0.0)
        for batch in batches:
            out: list[list] = [[] for _ in SCORED]
            for doc_id, text, held_out in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                found = np.array([model.index.get(w, -1) for w in words], dtype=np.int64)
                path = np.concatenate([[END_CLASS], classes[found], [END_CLASS]])
                rare = Counter([words[k] for k in np.nonzero(found < 0)[0]])
                row = (number, doc_id, held_out, len(words) + 1, int((found >= 0).sum()), float(base[found].sum() + model.end_base),
                       float(emission[found].sum() + model.transitions[path[:-1], path[1:]].sum()), list(rare), list(rare.values()))
                number += 1
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(out, SCORED)], schema=SCORED)

    texts = written(rows.select("doc_id", "text", "held_out").mapInArrow(run, SCORED_DDL))
    rare = texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("t"))
    # A rare word's rows: one for each text that has it. Rare words of training texts are bounded by the frequent ones' counts.
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    emission = F.when(F.col("c") > 0, F.log10((F.col("c") - model.discount) / float(max(model.rare_tokens, 1)))).otherwise(model.unknown)
    sums = rare.groupBy("row").agg(
        F.sum(F.col("t") * (F.log10(F.col("c") + 1.0) - model.base_floor)).alias("rare_base"), F.sum(F.col("t") * emission).alias("rare_score"),
        F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("rare_known"))
    out = texts.drop("words", "times").join(sums, "row", "left")
    zero = F.lit(0.0)
    out = out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(model.tokens > 0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", zero)).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the training texts among the documents, and score all of them."""
    rows = prepared(docs)
    model, counts = trained(rows)
    return scored(rows, model, counts)
