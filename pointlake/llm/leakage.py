"""Evaluation texts that leak into training text.

Test items are indexed by the grams of their reduced text with BM25 weights, postings come in blocks of items with the
block's highest weight per gram, and every document is a query against the index. The search is block-max WAND: cursors of
the query's grams move over the items in order, the highest weights of grams and then of blocks tell which items cannot reach
their threshold, and cursors leap over these. Each item that reaches its threshold is verified.

Nothing is lost: a document that contains a run of an item contains all grams of the run, and an item's threshold is the
least score that any run of the required length can have. For the same reason a document is no query at all unless the grams
that begin at every ``STRIDE``-th of its characters are met in the index as often as any run would make them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.plans import scratch

#: Characters of a gram, items of a block, items of an index, most items of a search (about 15 kB each in every worker), the
#: characters between two grams of the first look, and BM25's constants.
GRAM, BLOCK, INDEX_ITEMS, MOST_ITEMS, STRIDE = 8, 32, 5_000, 100_000, 16
K1, B = 1.2, 0.75
#: Characters of document text that are looked up at a time.
SLICE_CHARS = 1_000_000

_DROPPED = regex.compile(r"[^\p{L}\p{N}]+")
_kept: list[np.ndarray] = []


def reduced(text: str | None) -> str:
    """Letters and digits of a text: NFKD, case folding, then only categories L and N."""
    return _DROPPED.sub("", unicodedata.normalize("NFKD", text).casefold()) if text else ""


def reduced_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all reduced texts one after the other, and where each ends."""
    if not _kept:
        _kept.append(np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)]))
    folded = [(t.casefold() if t.isascii() else unicodedata.normalize("NFKD", t).casefold()) if t else "" for t in texts]
    codes = _codes("".join(folded))
    keep = _kept[0][codes]
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[np.cumsum([len(t) for t in folded])]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashed(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + codes[at + i] + np.uint64(1)
            out ^= out >> np.uint64(29)
    return out


def grams(codes: np.ndarray, size: int = GRAM, step: int = 1) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` characters that begin at every ``step``-th place."""
    return _hashed(codes, np.arange(0, max(0, len(codes) - size + 1), step), size)


class Index:
    """Block-max inverted index of test items, small enough to be handed to every task."""

    def __init__(self, ids: list[int], passages: list[str], run: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (len(passages[i]), ids[i]))  # like lengths, like bounds, share blocks
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.texts = [passages[i] for i in order]
        self.run = run
        own = [grams(_codes(t)) for t in self.texts]
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        flat = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
        self.terms, term = np.unique(flat, return_inverse=True)
        pair, times = np.unique(term.astype(np.int64) * max(1, len(own)) + item, return_counts=True)
        self.post_term, self.post_item = pair // max(1, len(own)), pair % max(1, len(own))
        frequency = np.bincount(self.post_term, minlength=len(self.terms))
        idf = np.log1p((len(own) - frequency + 0.5) / (frequency + 0.5))
        length = np.array([len(g) for g in own], dtype=float)
        relative = length / max(1.0, length.mean() if len(length) else 1.0)
        self.post_weight = idf[self.post_term] * times * (K1 + 1) / (times + K1 * (1 - B + B * relative[self.post_item]))
        self.post_start = np.searchsorted(self.post_term, np.arange(len(self.terms) + 1))
        self.threshold = np.array([self._least(i, g) for i, g in enumerate(own)])
        block = self.post_item // BLOCK
        self.blocks = -(-len(own) // BLOCK)
        pair, first = np.unique(self.post_term * max(1, self.blocks) + block, return_index=True)
        self.bound_block = pair % max(1, self.blocks)
        self.bound_weight = np.maximum.reduceat(self.post_weight, first) if len(first) else np.empty(0)
        self.bound_start = np.searchsorted(pair // max(1, self.blocks), np.arange(len(self.terms) + 1))
        padded = np.r_[self.threshold, np.full(self.blocks * BLOCK - len(own), np.inf)]
        self.block_least = padded.reshape(-1, BLOCK).min(axis=1) if self.blocks else np.empty(0)
        self.least = self.threshold.min(initial=np.inf)
        self.top = np.maximum.reduceat(self.post_weight, self.post_start[:-1]) if len(self.terms) else np.empty(0)
        self.post_key = self.post_term * max(1, len(own)) + self.post_item
        self.bound_key = pair
        order = np.lexsort((self.post_term, self.post_item))
        self.item_term, self.item_start = self.post_term[order], np.searchsorted(self.post_item[order], np.arange(len(own) + 1))
        # which leading bits occur among the terms: most grams of a text are ruled out by one look
        self.bits = max(16, int(len(self.terms)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[(self.terms >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _least(self, item: int, own: np.ndarray) -> float:
        """The least score of a document that contains some run of the item; infinite where the item is shorter than a run."""
        width = self.run - GRAM + 1
        if len(own) < width:
            return np.inf
        term = np.searchsorted(self.terms, own)
        weight = np.empty(len(own))
        for j, t in enumerate(term):
            a, b = self.post_start[t], self.post_start[t + 1]
            weight[j] = self.post_weight[a + np.searchsorted(self.post_item[a:b], item)]
        # a gram that repeats within a run counts once: only its first place in the run
        before = np.full(len(own), -1)
        last: dict[int, int] = {}
        for j, t in enumerate(term.tolist()):
            before[j] = last.get(t, -1)
            last[t] = j
        least = min(weight[s : s + width][before[s : s + width] < s].sum() for s in range(len(own) - width + 1))
        return least * (1 - 1e-9)

    def wand(self, terms: np.ndarray) -> list[int]:
        """Items that reach their threshold for a query of the terms given (places in ``terms``, each once)."""
        n = max(1, len(self.ids))
        at, ends = self.post_start[terms], self.post_start[terms + 1]
        top = self.top[terms]
        out: list[int] = []
        while len(terms):
            now = self.post_item[at]
            order = np.argsort(now, kind="stable")
            # the first item that the highest weights of all grams up to it could lift over any threshold
            place = int(np.searchsorted(np.cumsum(top[order]), self.least))
            if place >= len(terms):
                break
            pivot = int(now[order[place]])
            block = pivot // BLOCK
            after = (block + 1) * BLOCK
            near = order[: int(np.searchsorted(now[order], after))]
            # the same by the highest weights in the pivot's block
            key = terms[near] * max(1, self.blocks) + block
            found = np.minimum(np.searchsorted(self.bound_key, key), len(self.bound_key) - 1)
            bound = self.bound_weight[found][self.bound_key[found] == key].sum()
            stop = np.minimum(np.searchsorted(self.post_key, terms[near] * n + after), ends[near])
            if bound >= self.block_least[block]:
                # the items of the block, all at once
                start = np.minimum(np.searchsorted(self.post_key, terms[near] * n + block * BLOCK), stop)
                start = np.maximum(start, at[near])
                size = stop - start
                place = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                score = np.bincount(self.post_item[place] - block * BLOCK, weights=self.post_weight[place], minlength=BLOCK)
                reached = np.flatnonzero(score[: len(self.ids) - block * BLOCK] >= self.threshold[block * BLOCK : after])
                out += (reached + block * BLOCK).tolist()
            # every cursor before the block's end leaps over it
            at[near] = stop
            live = at < ends
            if not live.all():
                terms, at, ends, top = terms[live], at[live], ends[live], top[live]
        return out

    def _hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``found`` of the grams that the index holds, and their terms."""
        maybe = np.flatnonzero(self.seen[(found >> np.uint64(64 - self.bits)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, found[maybe]), len(self.terms) - 1)
        hit = self.terms[term] == found[maybe]
        return maybe[hit], term[hit]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """The same of reduced texts."""
        return self.search_codes(_codes("".join(texts)), np.cumsum([len(t) for t in texts]))

    def search_codes(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (place of the text, item id) of reduced texts, given as code points and ends, that share a run with an item."""
        if not len(self.terms) or not len(codes):
            return
        starts = np.concatenate([[0], ends[:-1]])
        # a run holds so many grams of the first look, wherever it lies
        least = (self.run - GRAM + 1) // STRIDE
        if least >= 1:
            hit, _ = self._hits(grams(codes, step=STRIDE))
            times = np.bincount(np.searchsorted(ends, hit * STRIDE, side="right"), minlength=len(ends))
            asked = np.flatnonzero((times[: len(ends)] >= least) & (ends - starts >= self.run))
        else:
            asked = np.flatnonzero(ends - starts >= self.run)
        wide = self.run - GRAM + 1
        for q in asked.tolist():
            own = codes[starts[q] : ends[q]]
            places, term = self._hits(grams(own))
            text = None
            for item in self.wand(np.unique(term)):
                # so many grams of the item one after the other, before the texts themselves are compared
                key = self.item_start[item] + np.searchsorted(self.item_term[self.item_start[item] : self.item_start[item + 1]], term)
                held = places[self.item_term[np.minimum(key, self.item_start[item + 1] - 1)] == term]
                if len(held) < wide or not (held[wide - 1 :] - held[: len(held) - wide + 1] == wide - 1).any():
                    continue
                text = own.tobytes().decode("utf-32-le", "surrogatepass") if text is None else text
                if self._shares(text, item):
                    yield q, int(self.ids[item])

    def _shares(self, text: str, item: int) -> bool:
        """The exact check: whether the text contains a run of the item."""
        passage, run = self.texts[item], self.run
        runs = {passage[j : j + run] for j in range(len(passage) - run + 1)}
        return any(text[j : j + run] in runs for j in range(len(text) - run + 1))


def leaked(documents: DataFrame, items: DataFrame, run: int = 60, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """``(key, item)``: each document whose reduced text contains ``run`` or more consecutive characters of an item's.

    Null, empty and short texts and passages leak nothing; copies of rows count once. Items, which are counted, come to the
    driver, that holds benchmarks and not corpora: more than ``MOST_ITEMS`` are an error that asks for several calls. They are
    split into indexes of at most ``INDEX_ITEMS`` items, all of which a document meets in one pass (BM25's counts are those of
    an index; what is found does not depend on them). Texts are processed whole; documents never leave their partition.
    """
    if run < GRAM:
        raise ValueError(f"run must be at least {GRAM}")
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((documents, key), (items, item))]
    rows = documents.select(F.col(key), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    passages = scratch.written(items.select(F.col(item).alias("i"), F.col(passage).cast("string").alias("p")).where("p IS NOT NULL").distinct(), "passages")
    n = passages.count()
    if n > MOST_ITEMS:
        raise ValueError(f"{n} test items; search at most {MOST_ITEMS} at a time")
    known = passages.orderBy("i").collect()
    spark = documents.sparkSession
    parts = [known[a : a + INDEX_ITEMS] for a in range(0, len(known), INDEX_ITEMS)]
    shared = [spark.sparkContext.broadcast(Index([r.i for r in part], [reduced(r.p) for r in part], run)) for part in parts]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop]) <= SLICE_CHARS):
                    held += len(texts[stop])
                    stop += 1
                codes, ends = reduced_codes(texts[start:stop])
                pairs = [p for index in shared for p in index.value.search_codes(codes, ends)]
                if pairs:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([start + p for p, _ in pairs])), pa.array([i for _, i in pairs], pa.int64())], names=[key, item])
                start = stop

    found = rows.mapInArrow(search, f"`{key}` {kinds[0]}, `{item}` bigint")
    return found.withColumn(item, F.col(item).cast(kinds[1])).distinct()


def _longest_run(text: str, passage: str) -> int:
    """Length of the longest common run, from matches of grams that follow each other on a diagonal; both texts are reduced."""
    a, b = grams(_codes(text)), grams(_codes(passage))
    if not len(a) or not len(b):
        return 0
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a), np.searchsorted(b[order], a, side="right")
    i = np.repeat(np.arange(len(a)), high - low)
    if not len(i):
        return 0
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
    rank = np.lexsort((i, i - j))
    i, d = i[rank], (i - j)[rank]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])
    return int(np.diff(np.r_[new, len(i)]).max()) + GRAM - 1


def leak_report(documents: DataFrame, items: DataFrame, run: int = 60) -> DataFrame:
    """``(doc_id, item_id, longest_run, passage_share, question_share, has_answer)`` of each leak that :func:`leaked` finds.

    ``longest_run`` is the longest common run of reduced characters, ``passage_share`` its share of the passage,
    ``question_share`` the share of the question's grams that the document holds, ``has_answer`` whether it holds the reduced
    answer. Null and empty questions and answers give 0 and false. Only leaking pairs are joined with their texts.
    """
    pairs = leaked(documents, items, run)
    texts = documents.select("doc_id", "text").dropDuplicates(["doc_id"])
    full = pairs.join(texts, "doc_id").join(items.select("item_id", "passage", "question", "answer").dropDuplicates(["item_id"]), "item_id")

    def describe(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for doc, item, text, passage, question, answer in b[["doc_id", "item_id", "text", "passage", "question", "answer"]].itertuples(index=False):
                t, p, q, a = reduced(text), reduced(passage), reduced(question), reduced(answer)
                grams_ = {q[i : i + GRAM] for i in range(len(q) - GRAM + 1)}
                longest = _longest_run(t, p)
                rows.append((doc, item, longest, longest / max(1, len(p)), sum(g in t for g in grams_) / len(grams_) if grams_ else 0.0, bool(a) and a in t))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest_run", "passage_share", "question_share", "has_answer"])

    return full.mapInPandas(describe, "doc_id bigint, item_id bigint, longest_run int, passage_share double, question_share double, has_answer boolean")
