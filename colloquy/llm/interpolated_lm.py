"""Language-model scores by deleted interpolation.

A word's probability after its predecessor mixes the maximum-likelihood bigram
estimate with an add-one unigram estimate.  The mixture weight depends on how
often the predecessor was seen (one bucket per power of two) and is learned by
expectation-maximisation on deleted counts: each training occurrence is judged
by the counts without itself.

Blocks of documents ask for corpus-wide counts of their distinct words and
bigrams (see :mod:`colloquy.llm.blocks`); what is gathered grows with the
corpus, and no task holds more than a block or a key range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import (
    blobs, block_count, hashed_block, pack, slices, squeeze, squeeze_keys, unsqueeze, unsqueeze_keys,
)
from colloquy.llm.rolling import Words, chunks, mix
from colloquy.session import cut_lineage

WORDS, PAIRS, FACTS = 0, 1, 2
END, START = np.uint64(1), np.uint64(2)
CONTEXT_BUCKETS = 48
RATIO_BINS, RATIO_SPAN = 4096, 60.0
EM_ROUNDS = 200


def _keys(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a chunk with the end of each document, their pair keys,
    predecessors' keys, and the place of each document's first token."""
    n_docs = len(words.first) - 1
    ends = words.first[1:] + np.arange(n_docs)
    tokens = np.full(len(words.hashes) + n_docs, END)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = words.hashes
    starts = words.first[:-1] + np.arange(n_docs)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(tokens))
    return tokens, pairs, before, np.append(starts, len(tokens))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts or [np.zeros(0)]), len(keys)).astype(np.int64)


class _Tally:
    """Distinct keys in order, with counts where wanted.  What waits is merged
    once it outweighs what is merged, so a key is sorted a few times at most."""

    def __init__(self, counted: bool):
        self.keys, self.counts, self.counted = [np.zeros(0, np.uint64)], [np.zeros(0)], counted

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.keys.append(keys)
        if self.counted:
            self.counts.append(counts)
        if sum(map(len, self.keys[1:])) > max(len(self.keys[0]), 1 << 18):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.counted:
            keys, counts = _merged(self.keys, self.counts)
            self.counts = [counts]
        else:  # a plain sort is several times as fast as one that keeps places
            keys = np.sort(np.concatenate(self.keys))
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        self.keys = [keys]
        return keys, self.counts[0]


def _block_keys(table: pa.Table, counted: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of a block in order, with their occurrences in training documents if wanted."""
    held = {WORDS: _Tally(counted), PAIRS: _Tally(counted)}
    for part in blobs(table):
        train = part["train"].to_numpy()
        for first, texts in chunks(_texts(part)):
            tokens, pairs, _, starts = _keys(Words(texts, lower=True))
            # START is asked for too, as the predecessor of every first token.
            tokens = np.concatenate([tokens, np.full(len(texts), START)])
            if not counted:
                held[WORDS].add(tokens)
                held[PAIRS].add(pairs)
                continue
            seen = train[first : first + len(texts)].astype(np.float64)
            inner = np.repeat(seen, np.diff(starts))
            held[WORDS].add(tokens, np.concatenate([inner, seen]))
            held[PAIRS].add(pairs, inner)
    return {kind: tally.settle() for kind, tally in held.items()}


def _texts(part: pa.Table):
    return (None if v is None else v.encode() for v in _strings(part["text"]))


def _strings(column: pa.ChunkedArray):
    for chunk in column.chunks:
        for start in range(0, len(chunk), 256):
            yield from chunk.slice(start, 256).to_pylist()


def _requests(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        rows = []
        for kind, (keys, counts) in _block_keys(table, counted=True).items():
            for bucket, s, e in slices(keys, buckets):
                rows.append((bucket, kind, block, squeeze_keys(keys[s:e]), squeeze(counts[s:e].astype(np.uint32))))
        return pa.Table.from_pylist(
            [dict(zip(("bucket", "kind", "block", "keys", "counts"), r)) for r in rows],
            pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]),
        )

    return ask


def _answers(table: pa.Table) -> pa.Table:
    """Totals for one key range, in the order in which each block asked; for
    words also how many there are and how often they occur in training."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    asked = [unsqueeze_keys(k.as_py()) for k in table["keys"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([unsqueeze(c.as_py(), np.uint32) for c in table["counts"]])
    total = np.bincount(at, counts, len(keys)).astype(np.int64)
    rows, place = [], 0
    for block, own in zip(table["block"].to_pylist(), asked):
        mine = total[at[place : place + len(own)]]
        place += len(own)
        rows.append((block, kind, bucket, squeeze(mine), 0, 0))
    if kind == WORDS:
        real = keys != START
        rows.append((-1, FACTS, bucket, b"", int((total[real] > 0).sum()), int(total[real].sum())))
    return pa.Table.from_pylist(
        [dict(zip(("block", "kind", "bucket", "totals", "n_kinds", "n_tokens"), r)) for r in rows],
        pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("n_kinds", pa.int64()), ("n_tokens", pa.int64())]),
    )


def _bucket_of(contexts: np.ndarray) -> np.ndarray:
    """0 for a predecessor never seen in training, else one more than the
    whole part of the binary logarithm of its frequency."""
    return np.minimum(np.frexp(contexts.astype(np.float64))[1], CONTEXT_BUCKETS - 1)


def _counted_chunks(docs: pa.Table, answers: pa.Table):
    """For each chunk: its part, the index of its first document, places of
    documents, and for every token the counts of word, pair and predecessor."""
    own = {kind: keys for kind, (keys, _) in _block_keys(docs, counted=False).items()}
    order = sorted(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), range(answers.num_rows)))
    totals = {
        kind: np.concatenate([unsqueeze(answers["totals"][i].as_py(), np.int64) for k, _, i in order if k == kind])
        for kind in (WORDS, PAIRS)
    }
    for part in blobs(docs):
        for first, texts in chunks(_texts(part)):
            tokens, pairs, _, starts = _keys(Words(texts, lower=True))
            look = lambda kind, keys: totals[kind][np.searchsorted(own[kind], keys)]
            word, opening = look(WORDS, tokens), look(WORDS, np.array([START]))[0]
            context = np.empty_like(word)  # a predecessor's count as a word is its count as a context
            context[1:] = word[:-1]
            context[starts[:-1]] = opening
            yield part, first, starts, word, look(PAIRS, pairs), context


def _deleted_histogram(n_tokens: int, n_kinds: int):
    """How often each (predecessor bucket, ratio of the two estimates) occurs
    among training tokens, each judged without itself.  The EM needs no more:
    a bounded table, whatever the corpus."""

    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        held = np.zeros(CONTEXT_BUCKETS * (RATIO_BINS + 1), np.int64)
        if docs.num_rows:
            for part, first, starts, word, pair, context in _counted_chunks(docs, answers):
                train = np.repeat(part["train"].to_numpy()[first : first + len(starts) - 1], np.diff(starts))
                word, pair, context = word[train] - 1, pair[train] - 1, context[train] - 1
                base = (word + 1) / (n_tokens - 1 + n_kinds + 1)
                ratio = np.where(context > 0, pair / np.maximum(context, 1), 0) / base
                with np.errstate(divide="ignore"):
                    place = np.log(ratio) / RATIO_SPAN + 0.5
                bins = np.where(ratio > 0, 1 + np.clip((place * RATIO_BINS), 0, RATIO_BINS - 1), 0).astype(np.int64)
                held += np.bincount(_bucket_of(context) * (RATIO_BINS + 1) + bins, minlength=len(held))
        some = np.flatnonzero(held)
        return pa.table({"cell": pa.array(some, pa.int32()), "n": pa.array(held[some], pa.int64())})

    return count


def mixture_weights(histogram: np.ndarray) -> np.ndarray:
    """EM for each predecessor bucket: the share of the bigram estimate."""
    weights = np.zeros(len(histogram))
    ratios = np.concatenate([[0.0], np.exp(((np.arange(RATIO_BINS) + 0.5) / RATIO_BINS - 0.5) * RATIO_SPAN)])
    for b in range(1, len(histogram)):  # bucket 0: an unseen predecessor has no bigram estimate
        n = histogram[b]
        if not n.sum():
            continue
        w = 0.5
        for _ in range(EM_ROUNDS):
            new = float((n * (w * ratios / (w * ratios + 1 - w))).sum() / n.sum())
            if abs(new - w) < 1e-9:
                break
            w = min(max(new, 1e-6), 1 - 1e-6)
        weights[b] = w
    return weights


def _scores(n_tokens: int, n_kinds: int, weights: list[float]):
    share = np.array(weights)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            for part, first, starts, word, pair, context in _counted_chunks(docs, answers):
                base = (word + 1) / (n_tokens + n_kinds + 1)
                w = share[_bucket_of(context)]
                mixed = w * pair / np.maximum(context, 1) + (1 - w) * base
                sums = lambda values: np.add.reduceat(values, starts[:-1])
                rows = part.slice(first, len(starts) - 1)
                out.append(pa.table([
                    rows["doc_id"].combine_chunks(), rows["train"].combine_chunks(),
                    pa.array(np.diff(starts), pa.int64()), pa.array(sums((word > 0).astype(np.int64)), pa.int64()),
                    pa.array(np.full(len(starts) - 1, n_tokens), pa.int64()),
                    pa.array(sums(np.log10(base))), pa.array(sums(np.log10(mixed))),
                ], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table(
            {"doc_id": pa.array([], pa.int64()), "train": pa.array([], pa.bool_())}
            | {c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}
            | {c: pa.array([], pa.float64()) for c in ("base_score", "score")}
        )

    return score


def score_documents(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, train, n_tokens, n_known, train_tokens,
    base_score, score`` (``score``: log10 probability of the whole text and its end).

    ``train`` says which rows the model learns from.  A null text is empty: one
    token, the end.  Repeated rows are each learned from and each scored.  With
    no training rows counts are zero and every estimate is the uniform one.  An
    empty table gives no rows.  Other columns of ``docs`` are not read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = block_count(rows, "text")
    packed = pack(rows.withColumn("block", hashed_block(blocks, "doc_id", "text")))
    answers = cut_lineage(
        packed.groupBy("block")
        .applyInArrow(_requests(blocks), "bucket int, kind int, block int, keys binary, counts binary")
        .groupBy("kind", "bucket")
        .applyInArrow(_answers, "block int, kind int, bucket int, totals binary, n_kinds long, n_tokens long")
    )
    facts = answers.filter(F.col("kind") == FACTS).agg(F.sum("n_kinds"), F.sum("n_tokens")).first()
    n_kinds, n_tokens = facts[0] or 0, facts[1] or 0
    told = answers.filter(F.col("kind") != FACTS).select("block", "kind", "bucket", "totals")
    both = packed.groupBy("block").cogroup(told.groupBy("block"))
    cells = both.applyInArrow(_deleted_histogram(n_tokens, n_kinds), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    histogram = np.zeros(CONTEXT_BUCKETS * (RATIO_BINS + 1))
    for row in cells.collect():  # at most CONTEXT_BUCKETS x (RATIO_BINS + 1) cells
        histogram[row.cell] = row.n
    weights = mixture_weights(histogram.reshape(CONTEXT_BUCKETS, -1))
    return both.applyInArrow(
        _scores(n_tokens, n_kinds, weights.tolist()),
        "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
