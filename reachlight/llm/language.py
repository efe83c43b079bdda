"""Language identification of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlight.llm import frame
from reachlight.llm.words import Words, mix

#: Places of feature weights, 2 ** BITS, and the greatest length of an n-gram of bytes.
BITS, LONGEST = 16, 4
#: Words of a sequence that are stepped through one by one.
CHUNK = 1024
#: Steps after which messages are rescaled; a step makes the largest smaller by a bounded factor only.
RESCALE = 8
#: Documents that the field is trained on at most, those with the least hashes of doc_id.
SAMPLE = 1500
#: Training: sequences in a step, words in each, steps, rate, and the share of words whose lexicon feature is hidden.
BATCH, WORDS, STEPS, RATE, HIDDEN = 48, 48, 160, 0.25, 0.5
#: A document stays if so large a share of its words is in its main language, and it has so many words.
SHARE, LEAST_WORDS = 0.5, 1


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) of the features of each word: all n-grams of up to LONGEST bytes of ^word$ and the word itself.

    N-grams that hold ^ or $ are the word's prefixes and suffixes, so affixes have weights of their own. The last
    feature of each word is its lexicon feature.
    """
    n = ends - starts
    total = n + 2
    first = np.cumsum(total) - total
    flat = np.zeros(int(total.sum()), np.uint64)
    word = np.repeat(np.arange(len(n)), total)
    offset = np.arange(len(flat)) - first[word]
    inner = (offset > 0) & (offset <= n[word])
    flat[inner] = raw[(starts[word] + offset - 1)[inner]].astype(np.uint64) + np.uint64(3)
    flat[offset == 0], flat[offset > n[word]] = 1, 2
    places, words = [], []
    h = np.zeros(len(flat), np.uint64)
    lexicon = np.zeros(len(n), np.uint64)
    np.add.at(lexicon, word, mix(flat * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64)))
    for k in range(LONGEST):
        if len(flat) <= k:
            break
        h = h[: len(flat) - k] * np.uint64(257) + flat[k:]
        ok = word[: len(flat) - k] == word[k:]
        places.append((mix(h + np.uint64(k << 58)) >> np.uint64(64 - BITS)).astype(np.int64)[ok])
        words.append(word[: len(flat) - k][ok])
    places.append((mix(lexicon + np.uint64(7)) >> np.uint64(64 - BITS)).astype(np.int64))
    words.append(np.arange(len(n)))
    return np.concatenate(places), np.concatenate(words)


def word_scores(weights: np.ndarray, words: Words) -> np.ndarray:
    """(words, labels): the sum of each word's weights over its number of features. Alike words are scored once."""
    _, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    place, word = word_features(words.raw, words.starts[at], words.ends[at])
    count = np.bincount(word, minlength=len(at))
    sums = np.stack([np.bincount(word, weights=weights[place, k], minlength=len(at)) for k in range(weights.shape[1])], axis=1)
    return (sums / np.sqrt(np.maximum(count, 1))[:, None])[back]


def _live(lengths: np.ndarray) -> np.ndarray:
    """For each step how many sequences still run, when they are ordered by falling length."""
    longest = int(lengths[0]) if len(lengths) else 0
    return np.searchsorted(-lengths, -np.arange(longest), "left")


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward: probabilities of each word's labels, the log of each sequence's normaliser, forward messages.

    scores holds the sequences one after the other. Each is cut into chunks of CHUNK words that all take their steps
    together. Where a sequence has several, each chunk's product of matrices is made first, and gives the messages at
    the chunks' ends exactly. Messages are rescaled at every step, so that any length keeps its precision.
    """
    k = scores.shape[1]
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    local, step = np.exp(scores - top), np.exp(moves)
    parts = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    base = (np.cumsum(lengths) - lengths)[owner] + nth * CHUNK
    size = np.minimum(CHUNK, lengths[owner] - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    owner, nth, base, size = owner[order], nth[order], base[order], size[order]
    start = np.tile(np.exp(begin), (len(owner), 1))  # what the first step's scores are multiplied by
    end = np.ones((len(owner), k))
    at = np.full((len(lengths), int(parts.max(initial=0))), -1)
    at[owner, nth] = np.arange(len(owner))
    many = np.flatnonzero(parts > 1)
    if len(many):
        long = np.flatnonzero(parts[owner] > 1)
        product = np.tile(np.eye(k), (len(long), 1, 1))
        live = _live(size[long])
        for t, m in enumerate(live):
            product[:m] = (product[:m] @ step) * local[base[long[:m]] + t][:, None, :]
            product[:m] /= product[:m].sum(axis=(1, 2))[:, None, None]
        slot = np.full(len(owner), -1)
        slot[long] = np.arange(len(long))
        # the first chunk begins with the first word's own message, so it is run once as a vector
        chunk = at[many, 0]
        message = np.tile(np.exp(begin), (len(many), 1))
        for t in range(CHUNK):
            message = (message if t == 0 else message @ step) * local[base[chunk] + t]
            message /= message.sum(axis=1)[:, None]
        for c in range(1, at.shape[1]):
            on = at[many, c] >= 0
            many, message = many[on], message[on]
            chunk = at[many, c]
            start[chunk] = message @ step
            message = np.einsum("ni,nij->nj", message, product[slot[chunk]])
            message /= message.sum(axis=1)[:, None]
        for c in range(at.shape[1] - 1, 0, -1):
            own = np.flatnonzero(at[:, c] >= 0)
            chunk = at[own, c]
            back = np.einsum("nij,nj->ni", product[slot[chunk]], end[chunk])
            end[at[own, c - 1]] = back / back.sum(axis=1)[:, None]
    # by step and then chunk, so that each step's rows lie side by side
    live = _live(size)
    edge = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
    place = np.concatenate([base[:m] + t for t, m in enumerate(live)]) if len(live) else np.zeros(0, np.int64)
    mine = local.T[:, place]
    ahead, both, log_z = np.empty_like(mine), np.empty_like(mine), np.zeros(len(lengths))
    message, step_t = start.T.copy(), step.T.copy()
    for t, m in enumerate(live):
        here = mine[:, edge[t] : edge[t + 1]]
        message = (message[:, :m] if t == 0 else step_t @ message[:, :m]) * here
        if t % RESCALE == 0 or t + 1 == len(live) or live[t + 1] < m:
            total = message.sum(axis=0)
            message /= total
            log_z += np.bincount(owner[:m], weights=np.log(total), minlength=len(lengths))
        ahead[:, edge[t] : edge[t + 1]] = message
    log_z += np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=top[:, 0], minlength=len(lengths)) if len(scores) else 0
    behind = end.T.copy()
    for t in range(len(live) - 1, -1, -1):
        m, here = live[t], slice(edge[t], edge[t + 1])
        np.multiply(ahead[:, here], behind[:, :m], out=both[:, here])
        if t:
            back = step @ (mine[:, here] * behind[:, :m])
            if t % RESCALE == 0:
                back /= back.sum(axis=0)
            behind[:, :m] = back
    out, first = np.empty((len(scores), k)), np.empty((len(scores), k))
    out[place] = (both / both.sum(axis=0)).T
    first[place] = (ahead / ahead.sum(axis=0)).T
    return out, log_z, first


def fit(texts: list[str], langs: list[str], seed: int = 5) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(labels, weights, moves, begin) learned from texts of one language each.

    Training sequences are code-switched on purpose: runs of words from texts of different languages are strung
    together, so the transitions learn how likely a switch is. The lexicon feature is often hidden, so that affixes
    and n-grams must carry unseen words. No texts give no labels.
    """
    labels = sorted(set(langs))
    k = len(labels)
    weights, moves, begin = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)
    words = Words(texts)
    pools = [[(int(words.first[i]), int(words.first[i + 1])) for i in range(len(texts)) if langs[i] == label and words.count[i]] for label in labels]
    if not labels or not all(pools):
        keep = [i for i in range(k) if pools[i]]
        if not keep:
            return [], weights[:, :0], moves[:0, :0], begin[:0]
        return fit([t for t, lang in zip(texts, langs) if lang in {labels[i] for i in keep}], [lang for lang in langs if lang in {labels[i] for i in keep}], seed)
    if k == 1:
        return labels, weights, moves, begin
    rng = np.random.default_rng(seed)
    squares, move_squares = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    lengths = np.full(BATCH, WORDS)
    for _ in range(STEPS):
        picked, gold = [], []
        for _ in range(BATCH):
            at, truth = [], []
            while len(at) < WORDS:
                label = int(rng.integers(k))
                lo, hi = pools[label][int(rng.integers(len(pools[label])))]
                n = min(int(rng.geometric(1 / 16)), hi - lo, WORDS - len(at))
                begin_at = int(rng.integers(lo, hi - n + 1))
                at += range(begin_at, begin_at + n)
                truth += [label] * n
            picked += at
            gold += truth
        picked, gold = np.array(picked), np.array(gold)
        place, word = word_features(words.raw, words.starts[picked], words.ends[picked])
        hide = rng.random(len(picked)) < HIDDEN
        shown = np.ones(len(place), bool)
        shown[-len(picked) :] = ~hide
        place, word = place[shown], word[shown]
        norm = np.sqrt(np.bincount(word, minlength=len(picked)))
        scores = np.stack([np.bincount(word, weights=weights[place, j], minlength=len(picked)) for j in range(k)], axis=1) / norm[:, None]
        p, _, ahead = marginals(scores, lengths, moves, begin)
        error = p.copy()
        error[np.arange(len(gold)), gold] -= 1
        used = np.unique(place)
        slot = np.searchsorted(used, place)
        scaled = error / norm[:, None]
        g = np.stack([np.bincount(slot, weights=scaled[word, j], minlength=len(used)) for j in range(k)], axis=1)
        squares[used] += g * g
        weights[used] -= RATE * g / np.sqrt(squares[used])
        # expected transitions: forward message, move, and what follows
        steps = np.flatnonzero(np.arange(len(gold)) % WORDS != WORDS - 1)
        follows = p[steps + 1] * np.exp(scores[steps + 1] - scores[steps + 1].max(axis=1, keepdims=True)) / np.maximum(ahead[steps + 1], 1e-300)
        pair = ahead[steps][:, :, None] * np.exp(moves)[None] * follows[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        g = pair.sum(axis=0)
        np.add.at(g, (gold[steps], gold[steps + 1]), -1)
        move_squares += g * g
        moves -= RATE * g / np.sqrt(move_squares)
        begin -= RATE / BATCH * error[::WORDS].sum(axis=0)
    return labels, weights.astype(np.float32), moves, begin


def train(docs: DataFrame, sample: int = SAMPLE):
    """A field from at most ``sample`` documents whose lang is known, chosen by a hash of the row.

    Null ids, texts and languages are left out, rows alike in all three count once, and rows that only share a doc_id
    each. Without such rows there are no labels.
    """
    rows = frame.plain(docs, doc_id="long", text="string", lang="string").where("text IS NOT NULL AND lang IS NOT NULL")
    few = frame.sampled(rows, "doc_id", sample).toPandas()
    few = few.sort_values(["doc_id", "text"])
    return fit(few["text"].tolist(), few["lang"].tolist())


def documents(texts: list[str | None], model) -> pd.DataFrame:
    """For each text: n_words, the main language, its share of the words' probability, and how often the label switches."""
    labels, weights, moves, begin = model
    words = Words(texts)
    n = words.count
    out = pd.DataFrame({"n_words": n, "language": np.array([None] * len(n), object), "share": np.zeros(len(n)), "switches": np.zeros(len(n), np.int64)})
    if not labels or not len(words.hashes):
        return out
    p, _, _ = marginals(word_scores(weights, words), n, moves, begin)
    doc = words.document()
    sums = np.stack([np.bincount(doc, weights=p[:, j], minlength=len(n)) for j in range(len(labels))], axis=1)
    best = sums.argmax(axis=1)
    has = n > 0
    out.loc[has, "language"] = np.array(labels, object)[best[has]]
    out["share"] = sums.max(axis=1) / np.maximum(n, 1)
    top = p.argmax(axis=1)
    change = (top[1:] != top[:-1]) & (doc[1:] == doc[:-1])
    out["switches"] = np.bincount(doc[1:][change], minlength=len(n))
    return out


def accepted(found: pd.DataFrame) -> np.ndarray:
    return ((found["n_words"] >= LEAST_WORDS) & found["language"].notna() & (found["share"] >= SHARE)).to_numpy()


SCHEMA = "doc_id long, language string, share double, n_words long, switches long"


def identified(docs: DataFrame, model) -> DataFrame:
    """(doc_id, language, share, n_words, switches) of every document; all of its words are labelled.

    A null text, and one without words, has null language and share 0. Ties go to the language first in the alphabet.
    Repeated rows give repeated rows; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, 1):
                f = documents(part.column(1).to_pylist(), sent.value)
                yield pa.record_batch([part.column(0), pa.array(f["language"], pa.string()), pa.array(f["share"], pa.float64()), pa.array(f["n_words"], pa.int64()), pa.array(f["switches"], pa.int64())], ["doc_id", "language", "share", "n_words", "switches"])

    return frame.plain(docs, doc_id="long", text="string").mapInArrow(frame.trimmed(run), SCHEMA)


def known(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of docs that are mainly in one language that the field knows, with all columns. Null and wordless texts go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return frame.keep_rows(docs, lambda texts: accepted(documents(texts.to_pylist(), sent.value)), text=text)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Of all documents those with a main language, with its share."""
    docs = frame.read(spark, folder, "documents")
    return identified(docs, train(docs)).where((F.col("share") >= SHARE) & (F.col("n_words") >= LEAST_WORDS))
