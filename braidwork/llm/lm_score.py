"""Cross-entropy difference of each document under two n-gram models.

The target and the background model are bigram models of the same order and
smoothing (Dirichlet prior on the unigrams) over one shared vocabulary: every
word of either corpus, and one unseen word.  Every text of both corpora is
counted.  A document's score is the mean over its words of its target loss less
its background loss; lower means more like the target.

Words and bigrams are far too many to broadcast, and grow with the corpus.  They
are therefore scored where they are counted.  The loss of a bigram is a term of
its count and its second word's probability, and a term of its first word's
count.  Each block of texts sends every occurrence of a word outside the
``core`` most frequent ones, with the words before and after it, to the
partition of the word's hash.  That partition so holds all occurrences of its
words and all bigrams that end with them or lead from them to the core; it
counts both under both models and returns a sum for each document, packed by
block.  No word can be hot there, because the core is counted apart: its words'
counts and its pairs, two dense ``core x core`` tables, are of fixed size and
broadcast, and any other word is at most ``1 / core`` of all words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._counts import KIND, pack, total
from ._work import Workspace

_BLOB = "part int, flag int, block long, uids binary, owners binary, words binary, before binary, after binary, far binary"
_SUMS = "block long, uids binary, target binary, background binary"
#: Numbers that stand for no word and for a word outside the core.
_NONE, _FAR = 65535, 65534
_PART = "uid long, doc_id long, n_tokens long, target double, background double"


def _blocks(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``i`` to ``j``, the words' hashes, and each word's row less ``i``."""
    data, offsets = tx.buffers(array)
    for i, j in tx.slices(offsets):
        hashes, _, owner = tx.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, j, hashes, owner


def _word_counts(texts: DataFrame) -> DataFrame:
    """``word, background, target``: occurrences of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(0).to_numpy()
            held: list[list[np.ndarray]] = [[], []]
            for i, _, hashes, owner in _blocks(batch.column(2)):
                of = flags[i + owner]
                for k in (0, 1):
                    held[k].append(hashes[of == k])
            for k in (0, 1):
                words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held[k]]), return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(x) for x in ((n, zero) if k == 0 else (zero, n)))], names=["word", "background", "target"])

    rows = texts.mapInArrow(run, "word long, background long, target long")
    return rows.groupBy("word").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Lexicon:
    """The core's words, numbered from 0 with the most frequent first, and the size of the whole vocabulary."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, size: int):
        order = np.argsort(words)
        self.sorted, self.number = words[order], order.astype(np.uint16)
        self.words, self.counts = words, counts.astype(float)
        self.mass = totals + size + 1  # one more for the unseen word
        self.small = np.zeros(1 << 20, bool)
        self.small[self.sorted >> np.uint64(44)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), _FAR, np.uint16)
        maybe = np.flatnonzero(self.small[hashes >> np.uint64(44)])
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes[maybe]
            out[maybe[hit]] = self.number[at[hit]]
        return out

    def unigrams(self, counts: np.ndarray) -> np.ndarray:
        """Background and target probability of words, whose ``counts`` have these two columns."""
        return (counts + 1) / self.mass


def _sides(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the word before and of the word after each word in its text."""
    before, after = np.full(len(ids), _NONE, np.uint16), np.full(len(ids), _NONE, np.uint16)
    inner = owner[1:] == owner[:-1]
    before[1:][inner] = ids[:-1][inner]
    after[:-1][inner] = ids[1:][inner]
    return before, after


def _core_pairs(ids: np.ndarray, before: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Second words of the pairs within the core, and the pairs' places in a dense table."""
    second = np.flatnonzero((ids < core) & (before < core))
    return second, before[second].astype(np.int64) * core + ids[second]


def _numbered(values: np.ndarray) -> np.ndarray:
    """A number for each distinct value."""
    order = np.argsort(values)
    held = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.r_[False, held[1:] != held[:-1]][: len(held)])
    return out


def _bigrams(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return tx.mix(tx.mix(first) + second * tx._BASE)


def _score_part(table: pa.Table, lexicon: Lexicon, prior: float) -> pa.Table:
    flags = table["flag"].to_numpy()
    get = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name].combine_chunks()]
    hashes, owners, uids = get("words", np.uint64), get("owners", np.uint32), get("uids", np.int64)
    size = [len(k) for k in hashes]
    flag = np.repeat(flags, size)
    hashes, before, after, far = (np.concatenate(x) for x in (hashes, get("before", np.uint16), get("after", np.uint16), get("far", np.uint64)))

    def counted(which: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(which, weights=of == k) for k in (0, 1)], axis=1)

    which = _numbered(hashes)
    counts = counted(which, flag)
    unigrams = lexicon.unigrams(counts)
    ends, leads = np.flatnonzero(before != _NONE), np.flatnonzero(after < _FAR)
    first = np.empty(len(hashes), np.uint64)
    first[before == _FAR] = far
    near = before < _FAR
    first[near] = lexicon.words[before[near]]
    keys = np.concatenate([_bigrams(first[ends], hashes[ends]), _bigrams(hashes[leads], lexicon.words[after[leads]])])
    pairs = _numbered(keys)
    pair_counts = counted(pairs, np.concatenate([flag[ends], flag[leads]]))
    loss = np.zeros((len(hashes), 2))
    head = before == _NONE
    loss[head] = -np.log(unigrams[which[head]])
    loss[ends] = -np.log(pair_counts[pairs[: len(ends)]] + prior * unigrams[which[ends]])
    loss[leads] -= np.log(pair_counts[pairs[len(ends) :]] + prior * lexicon.unigrams(lexicon.counts[after[leads]]))
    some = after != _NONE
    loss[some] += np.log(counts[which[some]] + prior)
    at, out = 0, []
    for k, (own, docs) in enumerate(zip(owners, uids, strict=True)):
        if flags[k] == 0:
            mine = loss[at : at + size[k]]
            sums = [np.bincount(own, weights=mine[:, c], minlength=len(docs)).tobytes() for c in (1, 0)]
            out.append((table["block"][k].as_py(), docs.tobytes(), *sums))
        at += size[k]
    block, *packed = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in zip(("uids", "target", "background"), packed, strict=True)}})


def _add_block(table: pa.Table) -> pa.Table:
    """The sums that a block's texts got from all partitions."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name].combine_chunks()])
    docs, place = np.unique(get("uids", np.int64), return_inverse=True)
    sums = [np.bincount(place, weights=get(c, np.float64), minlength=len(docs)) for c in ("target", "background")]
    n = len(docs)
    return pa.table({"uid": docs, "doc_id": pa.nulls(n, pa.int64()), "n_tokens": np.zeros(n, np.int64), "target": sums[0], "background": sums[1]})


def score(docs: DataFrame, target: DataFrame, *, core: int = 1024, prior: float = 50.0, part_words: int = 2_000_000) -> DataFrame:
    """Losses of each document of ``docs``, which is the background corpus too.

    Takes ``docs(doc_id, text)`` and ``target(text)``; other columns are ignored.
    Returns ``doc_id, n_tokens, h_target, h_background, score``, one row for
    each input row: mean losses in nats and their difference.  A null or blank
    text has no words and null losses.  Repeated rows get equal scores.  With an
    empty target its model is uniform.  An empty table gives an empty result.
    """
    if not 1 <= core <= _FAR:
        raise ValueError(f"core must be from 1 to {_FAR}")
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    text, ident = F.col("text").cast("string"), F.col("doc_id").cast("long")
    own = docs.select(F.lit(0).alias("flag"), F.xxhash64(ident, text).alias("uid"), text.alias("text"), ident.alias("doc_id"))
    aim = work.save(target.select(F.lit(1).alias("flag"), F.lit(0).cast("long").alias("uid"), text.alias("text")).where("text is not null"), "target")
    both = own.select("flag", "uid", "text").unionByName(aim)
    words = work.save(_word_counts(both), "words")
    totals = words.agg(F.sum("background").alias("b"), F.sum("target").alias("t"), F.count("*").alias("n")).first()
    distinct = totals["n"]
    totals = np.array([totals["b"] or 0, totals["t"] or 0])
    top = words.orderBy((F.col("background") + F.col("target")).desc(), "word").limit(core).toArrow()
    lexicon = Lexicon(top["word"].to_numpy().astype(np.int64).view(np.uint64), np.stack([top["background"].to_numpy(), top["target"].to_numpy()], axis=1), totals, distinct)
    work.drop(words)
    core = max(len(lexicon.counts), 1)
    shared = spark.sparkContext.broadcast(lexicon)
    parts = max(math.ceil(int(totals.sum()) / part_words), 1)

    def core_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, core * core), np.int64)
        for batch in batches:
            flags = batch.column(0).to_numpy()
            for i, _, hashes, owner in _blocks(batch.column(2)):
                ids = shared.value.ids(hashes)
                second, place = _core_pairs(ids, _sides(ids, owner)[0], core)
                of = flags[i + owner[second]]
                for k in (0, 1):
                    seen[k] += np.bincount(place[of == k], minlength=core * core)
        yield from pack("pairs", seen.ravel())

    size = 2 * core * core
    dense = total(both.mapInArrow(core_pairs, KIND), size).get("pairs", np.zeros(size, np.int64)).reshape(2, core, -1)
    known = lexicon.unigrams(lexicon.counts)
    pair_loss = -np.log(np.moveaxis(dense, 0, -1) + prior * (known if len(known) else np.ones((1, 2)))).reshape(-1, 2)
    table = spark.sparkContext.broadcast(pair_loss.astype(np.float32))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32  # each block has a number of its own
        for batch in batches:
            flags, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, hashes, owner in _blocks(batch.column(2)):
                ids = shared.value.ids(hashes)
                before, after = _sides(ids, owner)
                rest = np.flatnonzero(ids == _FAR)
                to = ((hashes[rest] >> np.uint64(8)) % np.uint64(parts)).astype(np.int64) + flags[i + owner[rest]].astype(np.int64) * parts
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(2 * parts + 1))
                rows, block = [], block + 1
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = rest[order[bounds[p] : bounds[p + 1]]]
                    # texts of the target are only counted
                    docs_here, at = np.unique(owner[mine], return_inverse=True) if p < parts else (np.zeros(0, np.int64),) * 2
                    far = hashes[mine[before[mine] == _FAR] - 1]
                    rows.append((p % parts, p // parts, block, uids[i + docs_here].tobytes(), at.astype(np.uint32).tobytes(), hashes[mine].tobytes(), before[mine].tobytes(), after[mine].tobytes(), far.tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * 6, strict=True))], names=["part", "flag", "block", "uids", "owners", "words", "before", "after", "far"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        first, lead = -np.log(lexicon.unigrams(lexicon.counts)), np.log(lexicon.counts + prior)
        for batch in batches:
            for i, j, hashes, owner in _blocks(batch.column(2)):
                n = np.bincount(owner, minlength=j - i)
                ids = lexicon.ids(hashes)
                before, after = _sides(ids, owner)
                second, place = _core_pairs(ids, before, core)
                loss = table.value[place]
                head, some = np.flatnonzero((before == _NONE) & (ids < core)), np.flatnonzero((after != _NONE) & (ids < core))
                terms = ((second, loss), (head, first[ids[head]]), (some, lead[ids[some]]))
                sums = [sum(np.bincount(owner[at], weights=x[:, k], minlength=j - i) for at, x in terms) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i:j], batch.column(3)[i:j], pa.array(n.astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[0].astype(float))], names=["uid", "doc_id", "n_tokens", "target", "background"])

    sent = both.mapInArrow(send, _BLOB).groupBy("part").applyInArrow(lambda t: _score_part(t, shared.value, prior), _SUMS)
    sent = sent.groupBy("block").applyInArrow(_add_block, _PART)
    held = own.mapInArrow(near, _PART).withColumn("rows", F.lit(1)).unionByName(sent.withColumn("rows", F.lit(0)))
    sums = held.groupBy("uid").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), *(F.sum(c).alias(c) for c in ("rows", "n_tokens", "target", "background")))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.round(F.col(c) / F.col("n_tokens"), 9))
    each = sums.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"), (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"), mean("target").alias("h_target"), mean("background").alias("h_background"))
    return each.drop("row").withColumn("score", F.col("h_target") - F.col("h_background"))
