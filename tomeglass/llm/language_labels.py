"""Languages of words in code-switched text by a linear-chain conditional random field.

A word is described by its affixes, its character n-grams and its entry in a lexicon of common words; features are hashed into a table
of weights per language. Learned transitions join neighbouring words, and forward-backward gives every word its share of each
language. The language of a document is the one with the most words by those shares.

Distinct words of a batch are scored once. Chains are cut into blocks whose transfer matrices are multiplied over the whole
document first; then every block runs forward and backward by itself, all blocks side by side. So the result is that of one
long chain, and neither steps nor memory follow the longest document word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeglass.llm import shingles as sh
from tomeglass.operators.ranking import best_per_group

# A word is a letter with the letters and marks that follow it.
WORD = r"\p{L}[\p{L}\p{M}]*"
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample to learn from, and how to learn.

    The sample has at most ``lines`` runs of ``line_words`` words per language, the first by hash among ``lines`` documents of it, the
    first by hash too. All documents are read for the choice. ``slots`` weights per language hold all hashed features.
    """

    lines: int = 1500
    line_words: int = 48
    slots: int = 1 << 18
    lexicon_least: int = 4
    passes: int = 6
    batch: int = 64
    rate: float = 0.3
    penalty: float = 1e-6
    seed: int = 5


# Features of distinct words

EDGE = 1  # a code point that no word has stands for both ends of a word
AFFIXES = (1, 2, 3, 4)
GRAMS = (2, 3, 4)


@dataclass(frozen=True)
class Features:
    """Slots of all features of some words, word by word, and the first feature of each."""

    slots: np.ndarray
    first: np.ndarray


def features(words: list[str], lexicon: dict[str, int], slots: int) -> Features:
    """Affixes of up to four characters, n-grams of two to four with the word's ends, and the lexicon entry if there is one."""
    points = np.frombuffer("".join(f"{chr(EDGE)}{w}{chr(EDGE)}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(length)])
    word = np.repeat(np.arange(len(words)), length)
    found, of = [], []

    def add(kind: int, hashes: np.ndarray, which: np.ndarray) -> None:
        found.append((sh.mix(hashes * sh.STEP + np.uint64(kind)) % np.uint64(slots)).astype(np.int32))
        of.append(which)

    # ``runs`` holds the hash of the n characters from each place on.
    runs = np.zeros(len(points), np.uint64)
    for n in range(1, max(*AFFIXES, *GRAMS) + 1):
        runs = sh.mix(runs[: len(points) - n + 1] * sh.STEP + points[n - 1 :]) if len(points) >= n else runs[:0]
        if n in GRAMS:
            whole = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
            add(n, runs[whole], word[whole])
        if n in AFFIXES:
            some = np.flatnonzero(length - 2 >= n)
            add(16 + n, runs[begin[some] + 1], some)
            add(32 + n, runs[begin[some + 1] - 1 - n], some)
    entry = np.fromiter((lexicon.get(w, 0) for w in words), np.int64, len(words))
    known = np.flatnonzero(entry)
    add(48, entry[known].astype(np.uint64), known)
    add(49, np.zeros(len(words), np.uint64), np.arange(len(words)))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return Features(np.concatenate(found)[order], np.searchsorted(of[order], np.arange(len(words) + 1)))


@dataclass(frozen=True)
class Model:
    """Languages, weights (slot, language), transitions (from, to), and for each common word the number of the set of its languages."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int] = field(repr=False)

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word and one column per language; slices bound the memory."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for begin in range(0, len(words), 20_000):
            some = features(words[begin : begin + 20_000], self.lexicon, len(self.weights))
            if len(some.slots):
                for k in range(len(self.languages)):
                    out[begin : begin + 20_000, k] = np.add.reduceat(self.weights[some.slots, k], some.first[:-1])
        return out


# Chains

BLOCK = 32
BLOCKS_AT_ONCE = 16_384


def _normal(values: np.ndarray) -> np.ndarray:
    """Scaled to a greatest entry of 1 in every row of the first axis; only ratios matter."""
    axes = tuple(range(1, values.ndim))
    return values / np.maximum(values.max(axis=axes, keepdims=True), 1e-300)


def _block_factors(scores: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """exp(score) of each place of some blocks, as (places, blocks, languages); places past a block's end are 1."""
    place = np.arange(BLOCK)[:, None]
    inside = place < sizes[None, :]
    rows = scores[word[np.minimum(starts[None, :] + place, len(word) - 1)]].astype(np.float64)
    rows = np.exp(rows - rows.max(axis=2, keepdims=True))
    return np.where(inside[:, :, None], rows, 1.0)


def marginals(scores: np.ndarray, word: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Posterior shares of all languages for the words of chains, some blocks at a time: (places in ``word``, shares).

    ``scores`` has a row per distinct word, ``word`` the row of every word, and chain c goes from ``first[c]`` to ``first[c + 1]``.
    """
    step = np.exp(transitions - transitions.max())
    L = len(step)
    per_chain = np.diff(first)
    blocks = -(-per_chain // BLOCK)
    chain = np.repeat(np.arange(len(blocks)), blocks)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    in_chain = np.arange(len(chain)) - first_block[chain]
    starts = first[:-1][chain] + in_chain * BLOCK
    sizes = np.minimum(BLOCK, first[1:][chain] - starts)
    # What a block does to a row of forward values: a step into each place, then the factor of that place.
    transfer = np.empty((len(chain), L, L))
    for a in range(0, len(chain), BLOCKS_AT_ONCE):
        some = slice(a, a + BLOCKS_AT_ONCE)
        factor = _block_factors(scores, word, starts[some], sizes[some])
        product = np.broadcast_to(np.eye(L), (factor.shape[1], L, L))
        for place in range(BLOCK):
            inside = (place < sizes[some])[:, None, None]
            product = np.where(inside, (product @ step) * factor[place][:, None, :], product)
            if place % 8 == 7:
                product = _normal(product)
        transfer[some] = _normal(product)
    # Values that reach each block from its left and from its right, chain by chain, all chains side by side.
    forward, backward = np.ones((len(chain), L)), np.ones((len(chain), L))
    order = np.argsort(-blocks, kind="stable")
    for depth in range(1, int(blocks.max(initial=0))):
        longer = order[: np.searchsorted(-blocks[order], -depth, "left")]  # chains with more blocks than ``depth``
        here = first_block[longer] + depth
        forward[here] = _normal((forward[here - 1][:, None, :] @ transfer[here - 1])[:, 0])
        there = first_block[longer + 1] - 1 - depth
        backward[there] = _normal((transfer[there + 1] @ backward[there + 1][:, :, None])[:, :, 0])
    begins = in_chain == 0
    for a in range(0, len(chain), BLOCKS_AT_ONCE):
        some = slice(a, a + BLOCKS_AT_ONCE)
        size, factor = sizes[some], _block_factors(scores, word, starts[some], sizes[some])
        alpha, value = np.empty_like(factor), forward[some]
        for place in range(BLOCK):
            arrives = value @ step if place else np.where(begins[some][:, None], 1.0, value @ step)
            value = _normal(arrives * factor[place])
            alpha[place] = value
        beta = backward[some]
        for place in range(BLOCK - 1, -1, -1):
            inside = (place < size)[:, None]
            alpha[place] *= np.where(inside, beta, 1.0)
            beta = np.where(inside, _normal((beta * factor[place]) @ step.T), beta)
        shares = alpha / np.maximum(alpha.sum(axis=2, keepdims=True), 1e-300)
        inside = np.arange(BLOCK)[:, None] < size[None, :]
        at = (starts[some][None, :] + np.arange(BLOCK)[:, None])[inside]
        yield at, shares[inside]


# Learning


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def sample(labelled: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(lang, words): some lines of each language, whichever come first by hash; none longer than ``line_words``."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    hashed = rows.withColumn("hash", F.xxhash64("text", F.lit(how.seed)))
    least = best_per_group(hashed.select("lang", "hash").distinct(), ["lang"], [F.asc("hash")], how.lines)
    bound = F.broadcast(least.groupBy("lang").agg(F.max("hash").alias("bound")))  # one row per language
    chosen = hashed.join(bound, "lang").where("hash <= bound").dropDuplicates(["lang", "hash"])
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(how.line_words))
    cut = chosen.withColumn("words", _words(F.col("text"))).where("size(words) > 0")
    lines = cut.select("lang", F.explode(F.transform(starts, lambda i: F.slice("words", i, how.line_words))).alias("words"))
    lines = lines.where("size(words) > 0").withColumn("order", F.xxhash64("words", "lang", F.lit(how.seed + 1)))
    return best_per_group(lines, ["lang"], [F.asc("order"), F.asc("words")], how.lines).select("lang", "words")


def fit(labelled: DataFrame, how: Settings = Settings()) -> Model:
    """Learn from ``labelled`` (text, lang); rows without either are left out.

    The driver gets at most ``lines`` lines of ``line_words`` words per language. Pieces of lines of different languages are strung
    together into code-switched lines, so that transitions are learned too. Without labelled words there are no languages, and every
    text is "und".
    """
    lines = sorted((r.lang, r.words) for r in sample(labelled, how).collect())
    languages = sorted({lang for lang, _ in lines})
    number = {lang: i for i, lang in enumerate(languages)}
    lexicon = _lexicon(lines, number, how)
    empty = Model(languages, np.zeros((how.slots, len(languages)), np.float32), np.zeros((len(languages),) * 2), lexicon)
    return _learn(empty, _switched(lines, number, how), how) if lines else empty


def _lexicon(lines: list[tuple[str, list[str]]], number: dict[str, int], how: Settings) -> dict[str, int]:
    """Common words, each with a number for the set of languages in which it is common."""
    counts: dict[str, np.ndarray] = {}
    for lang, words in lines:
        for word in words:
            counts.setdefault(word, np.zeros(len(number), np.int64))[number[lang]] += 1
    sets: dict[tuple, int] = {}
    return {w: sets.setdefault(tuple(n >= how.lexicon_least), len(sets) + 1) for w, n in sorted(counts.items()) if n.max() >= how.lexicon_least}


def _switched(lines: list[tuple[str, list[str]]], number: dict[str, int], how: Settings) -> list[tuple[list[str], np.ndarray]]:
    """Lines in random order; every second one is strung together from pieces of two others."""
    rng = np.random.default_rng(how.seed)
    order, out = rng.permutation(len(lines)), []
    for i, (a, b) in enumerate(zip(order, np.roll(order, 1))):
        (lang, words), (other, more) = lines[a], lines[b]
        if i % 2 and len(words) > 1 and len(more) > 1:
            x, y = rng.integers(1, len(words)), rng.integers(1, len(more))
            words, labels = words[:x] + more[:y], [number[lang]] * int(x) + [number[other]] * int(y)
        else:
            labels = [number[lang]] * len(words)
        out.append((words[: how.line_words], np.array(labels[: how.line_words])))
    return out


def _learn(model: Model, lines: list[tuple[list[str], np.ndarray]], how: Settings) -> Model:
    """Adagrad on the negative log-likelihood of whole lines; the gradient is expected minus observed features."""
    words = sorted({w for line, _ in lines for w in line})
    at = {w: i for i, w in enumerate(words)}
    known = features(words, model.lexicon, how.slots)
    weights, transitions = model.weights.astype(np.float64), model.transitions.copy()
    square_w, square_t = np.full(weights.shape, 1e-6), np.full(transitions.shape, 1e-6)
    L = len(model.languages)
    rng = np.random.default_rng(how.seed)
    for _ in range(how.passes):
        order = rng.permutation(len(lines))
        for begin in range(0, len(lines), how.batch):
            some = [lines[i] for i in order[begin : begin + how.batch]]
            word = np.array([at[w] for line, _ in some for w in line])
            labels = np.concatenate([l for _, l in some])
            sizes = np.array([len(l) for _, l in some])
            used, back = np.unique(word, return_inverse=True)
            n = known.first[used + 1] - known.first[used]
            owner = np.repeat(np.arange(len(used)), n)
            slot = known.slots[np.repeat(known.first[used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            scores = np.stack([np.bincount(owner, weights[slot, k], len(used)) for k in range(L)], axis=1)
            share, pairs = expected(scores, back, sizes, transitions)
            share[np.arange(len(labels)), labels] -= 1
            last = np.cumsum(sizes) - 1
            inner = np.setdiff1d(np.arange(len(labels)), last)
            np.add.at(pairs, (labels[inner], labels[inner + 1]), -1)
            by_word = np.stack([np.bincount(back, share[:, k], len(used)) for k in range(L)], axis=1) / len(labels)
            slots, where = np.unique(slot, return_inverse=True)
            gradient = np.stack([np.bincount(where, by_word[owner, k], len(slots)) for k in range(L)], axis=1) + how.penalty * weights[slots]
            square_w[slots] += gradient**2
            weights[slots] -= how.rate * gradient / np.sqrt(square_w[slots])
            pairs /= len(labels)
            square_t += pairs**2
            transitions -= how.rate * pairs / np.sqrt(square_t)
    return Model(model.languages, weights.astype(np.float32), transitions, model.lexicon)


def expected(scores: np.ndarray, word: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of all words and expected pairs of labels, for some short chains."""
    step, L, n = np.exp(transitions), len(transitions), len(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    longest = int(sizes.max(initial=0))
    factor = np.exp(scores - scores.max(axis=1, keepdims=True))[word]
    alpha, beta = np.ones((longest, n, L)), np.ones((longest, n, L))
    live = np.arange(longest)[:, None] < sizes[None, :]
    at = np.minimum(first[:-1][None, :] + np.arange(longest)[:, None], len(word) - 1)
    local = np.where(live[:, :, None], factor[at], 1.0)
    for t in range(longest):
        alpha[t] = _normal((alpha[t - 1] @ step if t else 1.0) * local[t])
    for t in range(longest - 2, -1, -1):
        beta[t] = np.where(live[t + 1][:, None], _normal((beta[t + 1] * local[t + 1]) @ step.T), 1.0)
    both = alpha * beta
    share = (both / both.sum(axis=2, keepdims=True))
    pairs = np.zeros((L, L))
    for t in range(1, longest):
        joint = alpha[t - 1][:, :, None] * step[None] * (local[t] * beta[t])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs += joint[live[t]].sum(axis=0)
    return share.transpose(1, 0, 2)[live.T], pairs


# Labelling


def _chains(words: pa.ListArray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of distinct words, the row of every word, and the first word of each text."""
    n = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False)
    return model.scores(coded.dictionary.to_pylist()), word, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _slices(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has about ``most`` words, more only if one text has."""
    n = pc.fill_null(batch.column("words").value_lengths(), 0).to_numpy(zero_copy_only=False)
    total, begin = np.concatenate([[0], np.cumsum(n)]), 0
    while begin < len(batch):
        end = min(len(batch), max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1))
        yield batch.slice(begin, end - begin)
        begin = end


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, lang_pred, score, n_words, n_switches), one row for every row.

    ``lang_pred`` is the language with the greatest share of the words, of equal ones the first by name; ``score`` is that share, from
    0 to 1. ``n_switches`` counts neighbouring words whose likeliest languages differ. A text that is missing, empty or without a
    letter, and every text if nothing was learnt, is "und" with score 0. Rows that repeat or lack a doc_id are labelled one by one.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages numbers, and the lexicon of the bounded sample

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for some in _slices(batch):
                scores, word, first = _chains(some.column("words"), model)
                n, L = np.diff(first), len(model.languages)
                sums, best = np.zeros((len(n), L)), np.zeros(len(word), np.int8 if L < 128 else np.int32)
                if L:
                    text = np.repeat(np.arange(len(n)), n)
                    for at, share in marginals(scores, word, first, model.transitions):
                        sums += np.stack([np.bincount(text[at], share[:, k], len(n)) for k in range(L)], axis=1)
                        best[at] = share.argmax(axis=1)
                changes = np.concatenate([[0], np.cumsum(np.concatenate([[0], best[1:] != best[:-1]])[: len(word)])])
                switches = np.where(n > 0, changes[first[1:]] - changes[np.minimum(first[:-1] + 1, len(word))], 0)
                found = (n > 0) & (L > 0)
                winner = np.where(found, np.round(sums, 9).argmax(axis=1) if L else 0, L)
                score = np.where(found, sums.max(axis=1, initial=0) / np.maximum(n, 1), 0.0)
                columns = [some.column("doc_id"), pa.array(names[winner], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(n), pa.array(switches)]
                yield pa.record_batch(columns, ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _words(F.col("text").cast("string")).alias("words"))
    return rows.mapInArrow(label, "doc_id bigint, lang_pred string, score double, n_words bigint, n_switches bigint")


def word_runs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, first, n_words): runs of neighbouring words of one language, in order; ``first`` counts words from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            for some in _slices(batch):
                scores, word, first = _chains(some.column("words"), model)
                best = np.zeros(len(word), np.int64)
                if len(names):
                    for at, share in marginals(scores, word, first, model.transitions):
                        best[at] = share.argmax(axis=1)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first)) if len(names) else np.zeros(0, np.int64)
                opens = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])])[: len(text)])
                ends = np.append(opens[1:], len(text))
                ids = some.column("doc_id").take(pa.array(text[opens]))
                columns = [ids, pa.array(names[best[opens]], pa.string()), pa.array(opens - first[text[opens]]), pa.array(ends[: len(opens)] - opens)]
                yield pa.record_batch(columns, ["doc_id", "lang", "first", "n_words"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _words(F.col("text").cast("string")).alias("words"))
    return rows.mapInArrow(label, "doc_id bigint, lang string, first bigint, n_words bigint")
