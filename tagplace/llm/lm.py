"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of a text with A-Z lower-cased, and one end. Every word that the training texts hold at
least ``least_count`` times has vectors, so the vocabulary grows with the corpus (as the root of its tokens); all
other words share the output "rare". Within it a word's probability is (its count + d) / (all rare counts + d for
each rare word and for one share of words never seen); d is the addend that predicts each rare token best from the
others (leaving one out). So probabilities of all next tokens sum to one.

    logit(w | u, v) = q_w . (r_u C1 + r_v C2) + b_w        (v, u: the two tokens before)

Each word has one context vector r and one output vector q; C1 and C2 are matrices of the model, one for each
place before the word. Outputs are arranged in classes, as many as the root of their number:
P(w) = P(class of w) P(w | its class), both softmaxes of such logits, so normalising a token takes two short
batched matrix products. Training: the corpus is counted and encoded by Spark; in each of ``ROUNDS`` rounds every
task runs noise-contrastive estimation in numpy over its whole share of one part of the training texts, starting
from the common parameters; changes of the rows it touched are sent in blocks and averaged by the number of
tokens. All training tokens are used, once. Only the parameters, the words with vectors, the head and totals reach
the driver.

Counting: about the ``HEAD`` most frequent words, and all with vectors, are looked up in the tasks; other words of a
text go through a join with the counts of all words. Very long texts are whole streams like any others.

Edge cases: a null text is empty and consists of one end. A null doc_id is a training row. With no training
rows every probability comes from smoothing. Repeated rows are scored alike. Empty tables give empty results.
Further input columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_crc, small_batches, written

END, HEAD, DIM = b"", 60_000, 16
ROUNDS, BATCH, NOISE, RATE = 3, 2048, 8, 3.0
#: Noise classes that a minibatch shares; rows of parameters in a block that is sent.
NOISE_CLASSES, BLOCK = 16, 1024
#: Tokens that are scored at a time; tokens of one class whose noise words are met by one small product in training.
TOKENS, CHUNK = 1 << 18, 16
#: Reserved ids: rare words, end of text (also what stands before a text's first word).
RARE, STOP = 0, 1


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(all words as bytes, one text's after the other's; number of words of each text); a null is empty."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)).cast(pa.binary()), np.diff(before[offsets - offsets[0]])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text); tasks send counts, never single words."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            found = words_of(batch.column("text"))[0].dictionary_encode()
            for word, c in zip(found.dictionary.to_pylist(), np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).tolist(), strict=True):
                seen[word] += c
            seen[END] += batch.num_rows
            if len(seen) > 300_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def least_count(total: int) -> int:
    """Occurrences among ``total`` tokens that give a word vectors: a share of the root, as the words then grow."""
    return max(2, math.isqrt(total) // 40)


def best_addend(kinds: dict[int, int]) -> float:
    """The addend with which rare tokens, ``kinds`` words of each count, are predicted best from all the others."""
    rare, n = sum(c * k for c, k in kinds.items()), sum(kinds.values())
    made = lambda d: sum(c * k * math.log((c - 1 + d) / (rare - 1 + d * (n + 1))) for c, k in kinds.items())
    return max((2.0**i for i in range(-4, 9)), key=made) if rare > 1 else 1.0


def shares(total: int) -> int:
    """Parts of a round's training tokens, each a task's: by the corpus alone, so that the model does not depend on the
    cluster. Each sends a change of the model, so a part grows with the root of the corpus, as the model does."""
    return max(1, total // ROUNDS // max(500_000, 200 * math.isqrt(total)))


@dataclass
class Params:
    """r: context vectors by id; c1, c2: matrices of the places before a word; q, b: outputs; qc, bc: their classes."""

    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    qc: np.ndarray
    bc: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def words(self) -> np.ndarray:
        return np.hstack([self.r, self.q, self.b[:, None]])

    def classes(self) -> np.ndarray:
        """Classes, then the rows of both matrices."""
        none = np.zeros((DIM, 1), np.float32)
        return np.vstack([np.hstack([self.qc, self.bc[:, None]]), np.hstack([self.c1, none]), np.hstack([self.c2, none])])

    @classmethod
    def of(cls, words: np.ndarray, classes: np.ndarray) -> Params:
        r, q, b = (np.array(x, np.float32) for x in np.split(words, [DIM, 2 * DIM], axis=1))
        own, c1, c2 = (np.array(x, np.float32) for x in np.split(classes, [-2 * DIM, -DIM]))
        return cls(r, c1[:, :DIM].copy(), c2[:, :DIM].copy(), own[:, :DIM].copy(), own[:, DIM].copy(), q, b.ravel())

    @classmethod
    def start(cls, counts: np.ndarray, cls_of: np.ndarray, classes: int) -> Params:
        rng, n = np.random.default_rng(5), len(counts)
        mass = np.bincount(cls_of, counts + 0.5, classes) + 0.5
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        turn = lambda: np.linalg.qr(rng.standard_normal((DIM, DIM)))[0].astype(np.float32)
        return cls(draw(n, DIM), np.eye(DIM, dtype=np.float32), turn(), draw(classes, DIM), np.log(mass / mass.sum()).astype(np.float32), draw(n, DIM), np.log((counts + 0.5) / mass[cls_of]).astype(np.float32))


def make_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each output: by frequency, of about equal mass, none larger than twice the mean size."""
    out, order = np.zeros(len(counts), np.int64), np.argsort(-counts, kind="stable")
    total, mass, at, size, most = counts.sum() + len(counts), 0.0, 0, 0, -(-2 * len(counts) // classes)
    for i, w in enumerate(order):
        # a class ends early only if the others can still take all further words
        room = (classes - 1 - at) * most >= len(order) - i
        if size and at < classes - 1 and (size >= most or room and mass >= (at + 1) * total / classes):
            at, size = at + 1, 0
        out[w] = at
        mass, size = mass + counts[w] + 1, size + 1
    return out


def _spread(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices in order, and the sums of the rows of ``values`` by them."""
    # narrow integers are sorted by radix
    order = np.argsort(index.astype(np.uint16) if len(index) and index.max() < 1 << 16 else index, kind="stable")
    rows, width = index[order], values.shape[1]
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    place = np.empty(len(rows), np.int64)
    place[order] = (np.cumsum(first) - 1) * width
    n = int(first.sum())
    sums = np.bincount((place[:, None] + np.arange(width)).ravel(), values.ravel(), n * width)
    return rows[first], sums.reshape(n, width).astype(values.dtype)


def train_share(p: Params, ids: np.ndarray, cls_of: np.ndarray, counts: np.ndarray, rate: float = RATE) -> Params:
    """Noise-contrastive estimation over a stream of token ids (texts end with STOP), in minibatches.

    Noise classes are drawn from class frequencies and shared by a minibatch; the ``NOISE`` noise words of a class
    are drawn from the word frequencies there and shared by its tokens of the minibatch. Only touched rows are updated.
    All noise words of a class of one are its word, so these tokens need no product with noise.
    """
    classes = len(p.bc)
    rng = np.random.default_rng(len(ids))
    mass = np.bincount(cls_of, counts + 0.5, classes) + 0.5
    noise_c = mass / mass.sum()
    log_c, log_w = np.log(noise_c).astype(np.float32), np.log((counts + 0.5) / mass[cls_of]).astype(np.float32)
    by_class = np.argsort(cls_of, kind="stable")
    ends = np.cumsum((counts + 0.5)[by_class])
    cuts = np.searchsorted(cls_of[by_class], np.arange(classes + 1))
    low = np.concatenate([[0.0], ends])[cuts[:-1]]
    wide = np.concatenate([[0.0], ends])[cuts[1:]] - low
    v, u = np.concatenate([[STOP, STOP], ids[:-2]])[: len(ids)], np.concatenate([[STOP], ids[:-1]])[: len(ids)]
    v = np.where(u == STOP, STOP, v)
    squares = {k: np.full(getattr(p, k).shape, 1e-3, np.float32) for k in ("r", "c1", "c2", "qc", "bc", "q", "b")}
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def step(names, index, values, m):
        """Rows of the table ``names[0]`` and, where there are two, the last column for its biases."""
        rows, sums = _spread(index, values)
        sums /= m
        for name, g in zip(names, (sums[:, :DIM], sums[:, -1])):
            s = squares[name][rows]
            s += g * g
            squares[name][rows] = s
            np.divide(g, np.sqrt(s, out=s), out=s)
            s *= rate * 0.3
            getattr(p, name)[rows] += s

    def turn(name, g, m):
        squares[name] += (g / m) ** 2
        getattr(p, name)[:] += rate * 0.02 * (g / m) / np.sqrt(squares[name])

    ln_k, ln_w = np.float32(np.log(NOISE_CLASSES)), np.float32(np.log(NOISE))
    several = np.diff(cuts) > 1
    for a in range(0, len(ids), BATCH):
        # tokens in order of their classes
        order = np.argsort(cls_of[ids[a : a + BATCH]].astype(np.int32), kind="stable")
        y, h1, h2 = ids[a : a + BATCH][order], u[a : a + BATCH][order], v[a : a + BATCH][order]
        c, m = cls_of[y], len(y)
        r1, r2 = p.r[h1], p.r[h2]
        h = np.ones((m, DIM + 1), np.float32)
        h[:, :DIM] = r1 @ p.c1 + r2 @ p.c2
        x = h[:, :DIM]
        # class: one true and NOISE_CLASSES noise classes for each token
        kc = rng.choice(classes, NOISE_CLASSES, p=noise_c)
        own_c, noise_q = p.qc[c], p.qc[kc]
        e1 = 1 - sig(np.einsum("md,md->m", x, own_c) + p.bc[c] - log_c[c] - ln_k)
        e0 = -sig(x @ noise_q.T + (p.bc[kc] - log_c[kc] - ln_k))
        gh = e1[:, None] * own_c + e0 @ noise_q
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        there, sizes = c[first], np.diff(np.concatenate([first, [m]]))
        # word within its class: one true and NOISE noise words for each token
        own_q = p.q[y]
        logit = np.einsum("md,md->m", x, own_q) + p.b[y] - log_w[y] - ln_w
        d1 = 1 - sig(logit)
        alone = ~several[c]
        d1[alone] -= NOISE * sig(logit[alone])
        gh += d1[:, None] * own_q
        # noise where a class has several words: its tokens go in chunks, padded with zeros, all in one stacked product
        own = np.flatnonzero(~alone)
        many = several[there]
        met, n = there[many], sizes[many]
        at = np.searchsorted(ends, low[met, None] + rng.random((len(there), NOISE))[many] * wide[met, None], side="right")
        kw = by_class[np.clip(at, cuts[met, None], cuts[met + 1, None] - 1)]
        chunks = -(-n // CHUNK)
        of = np.repeat(np.arange(len(met)), chunks)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(chunks) - chunks) * CHUNK, n)
        held = np.zeros((len(of) * CHUNK, DIM + 1), np.float32)
        held[place] = h[own]
        held = held.reshape(-1, CHUNK, DIM + 1)
        q0 = np.concatenate([p.q[kw], (p.b[kw] - log_w[kw] - ln_w)[:, :, None]], axis=2)[of]
        d0 = -sig(held @ q0.transpose(0, 2, 1))
        gh[own] += (d0 @ q0[:, :, :DIM]).reshape(-1, DIM)[place]
        noise = d0.transpose(0, 2, 1) @ held
        g1, g2 = r1.T @ gh, r2.T @ gh
        step(("r",), np.concatenate([h1, h2]), np.concatenate([gh @ p.c1.T, gh @ p.c2.T]), m)
        turn("c1", g1, m)
        turn("c2", g2, m)
        step(("qc", "bc"), np.concatenate([there, kc]), np.concatenate([np.add.reduceat(e1[:, None] * h, first, axis=0), e0.T @ h]), m)
        step(("q", "b"), np.concatenate([y[first][~many], y[own], kw[of].ravel()]), np.concatenate([np.add.reduceat(d1[:, None] * h, first, axis=0)[~many], d1[own, None] * h[own], noise.reshape(-1, DIM + 1)]), m)
    return p


def _exact(x: np.ndarray, bits: int) -> np.ndarray:
    """Multiples of 2 ** -bits. Sums of products of two have no rounding, in any order, in single precision for 9 bits
    (below 64) and in doubles for 16 (below 2 ** 20)."""
    return np.round(x.astype(np.float64) * 2**bits) / 2**bits


class Scorer:
    """Normalised log-probabilities; logits of classes and of words in a class by matrix products.

    Parameters are rounded so that the products are exact: a matrix product may add up a row in another order when
    other rows stand beside it, and a text's score must not depend on its batch.
    """

    def __init__(self, p: Params, cls_of: np.ndarray):
        self.cls_of = cls_of
        self.groups = [np.flatnonzero(cls_of == c) for c in range(len(p.bc))]
        self.several = np.bincount(cls_of, minlength=len(p.bc)) > 1
        self._round(p, 9, np.float32)
        if self.large:
            self._round(p, 16, np.float64)

    def _round(self, p: Params, bits: int, kind: type) -> None:
        # what each token before a word adds to the hidden state
        self.r1, self.r2 = (_exact(p.r @ c, bits).astype(kind) for c in (p.c1, p.c2))
        qc, q = _exact(p.qc, bits), _exact(p.q, bits)
        # biases stand beside a one, so they keep as many bits as a product has
        bc, b = _exact(p.bc, 2 * bits), _exact(p.b, 2 * bits)
        # biases as one more row of each matrix
        self.top = np.vstack([qc.T, bc]).astype(kind)
        self.within = [np.vstack([q[g].T, b[g]]).astype(kind) for g in self.groups]
        # the same in rows, to look up single classes and words
        self.classes, self.words = self.top.T.copy(), np.hstack([q, b[:, None]]).astype(kind)
        longest = lambda x: math.sqrt(np.einsum("md,md->m", x, x, dtype=np.float64).max(initial=0.0))
        # logits that may be too large to exponentiate are brought down first, and doubles have them exactly: a matter of
        # the model, not of the rows
        self.large = math.hypot(longest(self.r1) + longest(self.r2), 1) * max(longest(self.classes), longest(self.words)) > 60

    def _log_sum(self, h: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Logarithm of the sum of exponentials of each row's logits. Blocks stay in the processor's
        cache. A column is a row's and is added up from top to bottom, so its result does not depend on its block; a
        single column would be added up in pairs, so it stands twice."""
        out, step = np.empty(len(h)), max(64, 100_000 // max(1, q.shape[1]))
        for a in range(0, len(h), step):
            own = h[a : a + step] if len(h) - a > 1 else np.repeat(h[a:], 2, axis=0)
            logits = (q.T @ own.T).astype(np.float32, copy=False)
            most = logits.max(0) if self.large else np.float32(0)
            if self.large:
                logits -= most
            np.exp(logits, out=logits)
            out[a : a + step] = (np.log(logits.sum(0)) + most.astype(np.float64))[: len(h) - a]
        return out

    def log_probs(self, ids: np.ndarray) -> np.ndarray:
        """Natural log-probability of each id of a stream of texts that each end with STOP."""
        u = np.concatenate([[STOP], ids[:-1]])
        v = np.where(u == STOP, STOP, np.concatenate([[STOP, STOP], ids[:-2]])[: len(ids)])
        out = np.zeros(len(ids))
        for a in range(0, len(ids), TOKENS):
            y, own = ids[a : a + TOKENS], slice(a, a + TOKENS)
            c = self.cls_of[y]
            # the sum over classes is the context's alone
            met = pa.array(u[own] * len(self.cls_of) + v[own]).dictionary_encode()
            context, at = np.divmod(met.dictionary.to_numpy(), len(self.cls_of)), met.indices.to_numpy()
            h = np.ones((len(context[0]), DIM + 1), self.top.dtype)
            h[:, :DIM] = self.r1[context[0]] + self.r2[context[1]]
            part = np.einsum("md,md->m", h[at], self.classes[c]) - self._log_sum(h, self.top)[at]
            # a word that is alone in its class is certain there
            some = np.flatnonzero(self.several[c])
            some = some[np.argsort(c[some].astype(np.uint16) if len(self.groups) < 1 << 16 else c[some], kind="stable")]
            hs, ys, cs = h[at[some]], y[some], c[some]
            within = np.einsum("md,md->m", hs, self.words[ys]).astype(np.float64)
            first = np.flatnonzero(np.concatenate([[True], cs[1:] != cs[:-1]])) if len(cs) else []
            for s, t in zip(first, [*first[1:], len(cs)]):
                within[s:t] -= self._log_sum(hs[s:t], self.within[cs[s]])
            part[some] += within
            out[own] = part
        return out


def _encoded(rows: DataFrame, head: list[tuple[bytes, int]], outputs: int, total: int, distinct: int, addend: float) -> DataFrame:
    """Per row: number, doc_id, held_out, ids of the stream, sums over head words, counts of all other words."""
    sent = rows.sparkSession.sparkContext.broadcast(head)
    log_n = np.log10(total + distinct + 1)

    def run(batches):
        from pyspark import TaskContext

        known, logs, rare, row = {}, np.zeros(len(sent.value) + 1), np.zeros(len(sent.value) + 1), TaskContext.get().partitionId() << 40
        for i, (word, c) in enumerate(sent.value):
            known[word], logs[i], rare[i] = i, np.log10(c + 1) - log_n, np.log10(c + addend)
        none, end, names = len(sent.value), known.get(END, len(sent.value)), {w: i + 2 for i, w in enumerate([w for w, _ in sent.value if w != END][: outputs - 2])}
        to_id = np.zeros(none + 1, np.uint32)
        for w, i in names.items():
            to_id[known[w]] = i
        for batch in batches:
            words, size = words_of(batch.column("text"))
            n, found = batch.num_rows, words.dictionary_encode()
            kind = np.fromiter((known.get(w, none) for w in found.dictionary.to_pylist()), np.int64, len(found.dictionary))
            code, doc = found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), size)
            at = kind[code]
            there, ids = at != none, to_id[at]
            sums = lambda x: np.bincount(doc, x, n).astype(float)
            base = sums(np.where(there, logs[at], 0.0)) + (logs[end] if end != none else -log_n)
            # rare words of the head; the end is an output of its own
            rare_head = sums(np.where(there & (ids == RARE), rare[at], 0.0))
            ends = np.cumsum(size)
            stream = np.insert(ids, ends, STOP).astype("<u4").tobytes()
            cuts = np.concatenate([[0], 4 * (ends + np.arange(1, n + 1))]).tolist()
            own, k = np.unique(doc[~there] * len(kind) + code[~there], return_counts=True)
            tail = pa.StructArray.from_arrays([found.dictionary.take(pa.array(own % max(1, len(kind)))), pa.array(k, pa.int64())], names=["word", "k"])
            offsets = np.searchsorted(own // max(1, len(kind)), np.arange(n + 1))
            made = [pa.array(np.arange(row, row + n)), pa.array(size + 1), pa.array(sums(there).astype(np.int64) + (end != none)), pa.array(base), pa.array(rare_head), pa.array(sums(ids == RARE).astype(np.int64)), pa.array([stream[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)]
            row += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "rare_head", "n_rare", "ids", "tail"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, rare_head double, n_rare long, ids binary, tail array<struct<word:binary,k:long>>")


def _train(encoded: DataFrame, counts: np.ndarray, cls_of: np.ndarray) -> Params:
    spark, parts = encoded.sparkSession, shares(int(counts.sum()))
    p = Params.start(counts, cls_of, int(cls_of.max()) + 1)
    shape = {True: (len(counts), 2 * DIM + 1), False: (len(p.bc) + 2 * DIM, DIM + 1)}
    for turn in range(ROUNDS):
        # dealt and ordered by the rows themselves, not by where they were read
        key = F.xxhash64("doc_id", "ids")
        share = encoded.where(~F.col("held_out") & (F.pmod(key, F.lit(ROUNDS)) == turn)).select("doc_id", "ids", key.alias("key"))
        share = share.repartitionById(parts, F.pmod(F.floor(F.col("key") / ROUNDS), F.lit(parts)).cast("int")).sortWithinPartitions("key", "doc_id").select("ids")
        sent = spark.sparkContext.broadcast((p.words(), p.classes()))

        def run(batches, sent=sent, turn=turn):
            from pyspark import TaskContext

            part, own, n, held, size = TaskContext.get().partitionId(), Params.of(*sent.value), 0, [], 0

            def train():
                return train_share(own, np.concatenate(held).astype(np.int64), cls_of, counts, RATE / (1 + turn))

            for batch in batches:
                held += [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("ids")]
                size = sum(map(len, held))
                if size >= 1_000_000:
                    own, n, held = train(), n + size, []
            if held:
                own, n = train(), n + sum(map(len, held))
            for word, new, old in ((True, own.words(), sent.value[0]), (False, own.classes(), sent.value[1])) if n else ():
                for a in range(0, len(new), BLOCK):
                    d = new[a : a + BLOCK] - old[a : a + BLOCK]
                    at = np.flatnonzero(d.any(1)).astype("<i4")
                    # a block without a change is sent too: its tokens count
                    yield pa.RecordBatch.from_pylist([{"word": word, "block": a, "part": part, "at": at.tobytes(), "x": d[at].tobytes(), "n": float(n)}], schema=sends)

        def merge(key, table):
            word, block = (k.as_py() for k in key)
            rows, cols = shape[word]
            x = np.zeros((min(BLOCK, rows - block), cols))
            table = table.sort_by("part")
            for at, d, n in zip(*(table.column(c).to_pylist() for c in ("at", "x", "n")), strict=True):
                x[np.frombuffer(at, "<i4")] += n * np.frombuffer(d, np.float32).reshape(-1, cols)
            x /= sum(table.column("n").to_pylist())
            return pa.Table.from_pylist([{"word": word, "block": block, "x": x.astype(np.float32).tobytes()}], schema=merged)

        sends = pa.schema([("word", pa.bool_()), ("block", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("x", pa.binary()), ("n", pa.float64())])
        merged = pa.schema([("word", pa.bool_()), ("block", pa.int32()), ("x", pa.binary())])
        changes = share.mapInArrow(run, "word boolean, block int, part int, at binary, x binary, n double")
        words, classes = p.words(), p.classes()
        for r in changes.groupBy("word", "block").applyInArrow(merge, "word boolean, block int, x binary").toLocalIterator():
            table = words if r.word else classes
            d = np.frombuffer(r.x, np.float32).reshape(-1, table.shape[1])
            table[r.block : r.block + len(d)] += d
        p = Params.of(words, classes)
    return p


def score_texts(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out`` is a boolean Column."""
    spark = docs.sparkSession
    small_batches(spark)
    held_out = held_out_crc(F.col(id_col), 7, 2) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    counts = written(count_words(rows.where(~F.col("held_out"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_count(total)
    # sizes by quarter powers of two: a head of about HEAD words is cut by its least count
    sizes = counts.groupBy(F.floor(4 * F.log2("c")).cast("int").alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect()
    reach = np.cumsum([r["n"] for r in sizes])
    cut = min([least, *(r["c"] for r, n in zip(sizes, reach.tolist(), strict=True) if n <= HEAD)])
    head = sorted(((bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= cut).collect()), key=lambda x: (-x[1], x[0]))
    chosen = [c for w, c in head if w != END and c >= least]
    stops = dict(head).get(END, counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    rare, kinds = total - stops - sum(chosen), distinct - (stops > 0) - len(chosen)
    addend = best_addend({r["c"]: r["n"] for r in counts.where((F.col("c") < least) & (F.length("word") > 0)).groupBy("c").agg(F.count("*").alias("n")).collect()})
    encoded = written(_encoded(rows, head, len(chosen) + 2, total, distinct, addend), "encoded")
    freq = np.array([rare, stops, *chosen], np.float64)
    cls_of = make_classes(freq, math.isqrt(len(freq) - 1) + 1)
    scorer = Scorer(_train(encoded, freq, cls_of), cls_of)

    def run(batches):
        for batch in batches:
            streams = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column("ids")]
            logs = scorer.log_probs(np.concatenate(streams)) if streams else np.zeros(0)
            sums = np.add.reduceat(logs, np.cumsum([0, *map(len, streams)])[:-1]) if streams else logs
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(sums / np.log(10))], names=[*own, "lm"])

    own = ["doc_id", "held_out", "row", "n_tokens", "known", "base", "rare_head", "n_rare"]
    scored = encoded.select(*own, "ids").mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, rare_head double, n_rare long, lm double")
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k")
    c = F.coalesce("c", F.lit(0))
    # whole numbers add up to the same sum in any order: whole parts, and the rest in units of 2 ** -34
    whole = lambda x: F.sum(F.floor(x)).cast("double") + F.sum(F.floor((x - F.floor(x)) * float(1 << 34) + 0.5)) / float(1 << 34)
    tails = tail.join(counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("k_known"), whole(F.col("k") * F.log10(c + 1)).alias("logs"), whole(F.col("k") * F.log10(c + addend)).alias("rares"))
    log_n, log_rare = float(np.log10(total + distinct + 1)), float(np.log10(rare + addend * (kinds + 1)))
    out = scored.join(tails, "row", "left")
    logs, rares, k = F.coalesce("logs", F.lit(0.0)), F.coalesce("rares", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs - k * log_n).alias("base_score"), (F.col("lm") + F.col("rare_head") + rares - F.col("n_rare") * log_rare).alias("score"))
