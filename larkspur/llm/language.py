"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree: for every context of up to ``ORDER``
bytes, how often each byte followed it.  With the counts frozen after training, a
byte costs -log2 of its probability in the longest context that has seen it, plus
the escapes from longer ones (method C: a context with n symbols, q of them
distinct, gives a symbol of count c the share c/(n+q) and escape q/(n+q); below
the empty context all 256 bytes are alike).  A text's code length under a
language is the sum over its bytes; the shortest code wins.

Frozen statistics make the cost of a byte a function of its context, so each
tree compiles into a table (context, byte class) -> cost, exact to float32, which
numpy gathers for all bytes of a batch at once.  The contexts of all languages
share one numbering; a language maps them to its own longest known suffix.

Learning takes a bounded sample: of each language ``TRAIN_DOCS`` documents by a
hash of their id and text, whole, as long as they fit ``TRAIN_BYTES`` together.
There is a tree for every language that has such a document, however many there
are; a tree is pruned to its ``CONTEXTS`` most frequent contexts, alike for any
number of languages, and stands in each worker with some 2 MB.  Trees are learnt
in tasks, a language each.  Prediction reads every byte.

Cases.  Null text, and text without a letter: und, score 0.  No labelled text to
learn from: und for all.  Ties go to the smaller language name.  Repeated rows
get equal results.  Null doc_id: not learnt from, not held out.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.staging import stage

UNKNOWN = "und"
#: Bytes of context; the sample of a language; contexts of its tree.
ORDER, TRAIN_DOCS, TRAIN_BYTES, CONTEXTS = 3, 400, 1_500_000, 4_000
#: Bytes scored at a time.
BLOCK = 1 << 19


class ContextTree:
    """Counts of the bytes that followed each context of 0 to ``order`` bytes."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {b"": {}}

    def learn(self, texts: list[bytes]) -> ContextTree:
        """Counts from texts; a context never reaches over the start of its text."""
        for k in range(self.order + 1):
            for text in texts:
                if len(text) <= k:
                    continue
                data = np.frombuffer(text, np.uint8).astype(np.int64)
                code = np.zeros(len(data) - k, np.int64)
                for j in range(k + 1):
                    code = code << 8 | data[j : len(data) - k + j]
                for gram, n in zip(*np.unique(code, return_counts=True), strict=True):
                    raw = int(gram).to_bytes(k + 1, "big")
                    into = self.counts.setdefault(raw[:-1], {})
                    into[raw[-1]] = into.get(raw[-1], 0) + int(n)
        return self

    def probability(self, context: bytes, byte: int) -> float:
        """Probability of ``byte`` after ``context``, of which the longest known suffix counts."""
        share, context = 1.0, context[-self.order :] if self.order else b""
        while True:
            seen = self.counts.get(context)
            if seen:
                total = sum(seen.values()) + len(seen)
                if byte in seen:
                    return share * seen[byte] / total
                share *= len(seen) / total
            if not context:
                return share / 256
            context = context[1:]

    def bits(self, text: bytes) -> float:
        """Code length of a text, byte by byte; the plain form of what the table sums."""
        return -sum(np.log2(self.probability(text[max(0, i - self.order) : i], b)) for i, b in enumerate(text))


@dataclass
class CompiledTrees:
    """langs; class of each byte (0: before the text; 1: never learnt); number of each context (a
    mixed-radix code of the classes of its ``order`` bytes); per language the row of each context
    in its own table, and the table of costs by row and class."""

    langs: list[str]
    classes: np.ndarray
    state: np.ndarray
    rows: list[np.ndarray]
    cost: list[np.ndarray]
    order: int

    @property
    def radix(self) -> int:
        return int(self.classes.max()) + 1 if len(self.classes) else 2


def prune(tree: ContextTree, keep: int = CONTEXTS) -> ContextTree:
    """Drop the rarest contexts of more than one byte; then the byte before stands for them."""
    ranked = sorted(tree.counts, key=lambda c: (len(c) > 1, -sum(tree.counts[c].values()), c))
    tree.counts = {c: tree.counts[c] for c in ranked[:keep]}
    return tree


def compile_trees(trees: dict[str, ContextTree], keep: int = CONTEXTS) -> CompiledTrees:
    langs = sorted(trees)
    for tree in trees.values():
        prune(tree, keep)
    order = next(iter(trees.values())).order
    apart = sorted({b for t in trees.values() for c, seen in t.counts.items() for b in (*c, *seen)})
    classes = np.ones(256, np.int64)
    classes[apart] = np.arange(len(apart)) + 2
    radix = len(apart) + 2
    contexts = sorted({c for t in trees.values() for c in t.counts}, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(contexts)}
    rows, cost = [], []
    for lang in langs:
        counts = trees[lang].counts
        own = sorted(counts, key=lambda c: (len(c), c))
        row = {c: i for i, c in enumerate(own)}
        table = np.empty((len(own), radix), np.float32)
        for context, i in row.items():
            # suffixes come before longer contexts: start from the shorter one's costs, and an escape
            seen, at = counts[context], table[i]
            at[:] = table[row[_longest_suffix(context, row)]] if context else 8.0
            if seen:
                total = sum(seen.values()) + len(seen)
                at += np.float32(np.log2(total / len(seen)))
                at[classes[list(seen)]] = np.log2(total / np.fromiter(seen.values(), np.float64, len(seen)))
        mapped = np.zeros(len(contexts), np.int32)
        for context, i in number.items():
            mapped[i] = row[context] if context in row else mapped[number[_longest_suffix(context, number)]]
        rows.append(mapped)
        cost.append(table)
    state = np.zeros(radix**order, np.int32)
    for context, i in number.items():  # longer contexts come later and win
        code = 0
        for byte in context:
            code = code * radix + int(classes[byte])
        state.reshape(-1, radix ** len(context))[:, code] = i
    return CompiledTrees(langs, classes, state, rows, cost, order)


def _longest_suffix(context: bytes, known: dict[bytes, int]) -> bytes:
    """The longest proper suffix that is known."""
    while context:
        context = context[1:]
        if context in known:
            break
    return context


def code_lengths(model: CompiledTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages) bits of the texts data[offsets[i]:offsets[i+1]] (uint8)."""
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    radix, order, size = model.radix, model.order, int(offsets[-1])
    for at in range(int(offsets[0]), size, BLOCK):
        end = min(at + BLOCK, size)
        back = max(at - order, 0)
        symbol = model.classes[data[back:end]]
        code = np.zeros(end - at, np.int64)
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, end, side="left"))
        starts = offsets[max(first - order, 0) : last]
        for j in range(order, 0, -1):  # the byte j places before
            before = np.zeros(end - at, np.int64)
            skip = max(0, back + j - at)
            before[skip:] = symbol[at - back - j + skip : end - back - j]
            code = code * radix + before
        # contexts end at the start of a text: recompute the first few bytes of each
        for j in range(order):
            place = starts + j
            place = place[(place >= at) & (place < end)]
            if not len(place):
                continue
            own = offsets[np.searchsorted(offsets, place, side="right") - 1]
            fixed = np.zeros(len(place), np.int64)
            for d in range(order, 0, -1):
                inside = place - d >= own
                fixed = fixed * radix + np.where(inside, model.classes[data[np.maximum(place - d, 0)]], 0)
            code[place - at] = fixed
        # a byte that was never learnt ends a known context just as the start of a text does
        state, last_byte = model.state[code], symbol[at - back :]
        lo = np.clip(offsets[first:last], at, end) - at
        hi = np.clip(offsets[first + 1 : last + 1], at, end) - at
        for k, (rows, cost) in enumerate(zip(model.rows, model.cost, strict=True)):
            bits = cost.ravel()[rows[state] * radix + last_byte]
            sums = np.concatenate([[0.0], np.cumsum(bits, dtype=np.float64)])
            out[first:last, k] += sums[hi] - sums[lo]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, order: int = ORDER, docs_per_lang: int = TRAIN_DOCS, bytes_per_lang: int = TRAIN_BYTES, contexts: int = CONTEXTS) -> dict[str, ContextTree]:
    """Trees of the languages of ``docs`` (doc_id, text, lang), from rows not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")).where(F.col("n").between(1, bytes_per_lang))
    counts = stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "langs")
    # a share of the hash range that holds about twice the documents wanted; few rows are then ranked
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_per_lang) / F.col("rows"))
    drawn = rows.join(counts.select("lang", share.alias("share")), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    by_hash = Window.partitionBy("lang").orderBy("h", "text")
    drawn = drawn.withColumn("nth", F.row_number().over(by_hash)).withColumn("so_far", F.sum("n").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
    sample = drawn.where((F.col("nth") <= docs_per_lang) & (F.col("so_far") <= bytes_per_lang)).select("lang", F.col("text").cast("binary").alias("text"))

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        own = prune(ContextTree(order).learn([b"\n".join(sorted(map(bytes, group["text"])))]), contexts)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "tree": [pickle.dumps(own.counts)]})

    trees = {}
    for lang, packed in sample.groupBy("lang").applyInPandas(tree, "lang string, tree binary").toLocalIterator():
        trees[lang] = ContextTree(order)
        trees[lang].counts = pickle.loads(bytes(packed))
    return trees


@lru_cache(maxsize=1)
def _compiled(_model: str, packed: bytes) -> CompiledTrees:
    """The tables of this process; the trees travel, they are smaller."""
    return compile_trees(pickle.loads(packed))


def predict(docs: DataFrame, trees: dict[str, ContextTree] | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row of (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pickle.dumps(trees)) if trees else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _compiled(*held.value) if held.value else None
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            texts = pa.concat_arrays([texts])  # one buffer, offsets from its start
            n = len(texts)
            known = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) & (model is not None)
            best, score, rate = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan)
            if n and model is not None:
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                bits = code_lengths(model, data, offsets)
                pick = bits.argmin(1)
                with np.errstate(under="ignore"):
                    share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000.0)).sum(1)
                best = np.where(known, np.array(model.langs, object)[pick], UNKNOWN)
                score = np.where(known, share, 0.0)
                rate = np.where(known, bits.min(1) / np.maximum(np.diff(offsets), 1), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out and predict all rows."""
    found = predict(docs, learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
