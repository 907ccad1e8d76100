"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.llm.common import broadcast_value, map_arrow, settle
from lawmesh.llm.langid import hash_mod

END = b""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, parted at the six ASCII white-space characters: what bytes do by themselves."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """word, n over all texts, END once a text; counted in the tasks first."""

    class Step:
        def __init__(self):
            self.counts: Counter = Counter()

        def __call__(self, batch):
            for text in batch.column(0).to_pylist():
                self.counts.update(words_of(text))
            self.counts[END] += batch.num_rows
            return self.finish() if len(self.counts) > flush else []

        def finish(self):
            out = {"word": list(self.counts.keys()), "n": list(self.counts.values())}
            self.counts = Counter()
            return out

    return map_arrow(docs.select("text"), Step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words with the highest counts, at most `most` of them, whole steps of a sixteenth of a power of 2 at a time."""
    step = F.floor(F.log2("n") * 16)
    by_step = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # at most 1024 rows
    taken, least = 0, None
    for r in by_step:
        if taken + r["count"] > most:
            break
        taken, least = taken + r["count"], r["step"]
    if least is None:
        return [], np.zeros(0, dtype="int64")
    got = counts.where(step >= least).toArrow()
    words, n = got["word"].to_pylist(), got["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order]


def count_pairs(docs: DataFrame, vocabulary: list[bytes], flush: int = 2_000_000) -> DataFrame:
    """context, word, n: how often each token follows each, over all texts; the last two tokens are END and "other".

    END also stands before a text. Pairs are counted in the tasks, about
    `flush` tokens at a time, and stay apart: a pass over them is weighted by n.
    """
    size = len(vocabulary) + 2
    end, other = size - 2, size - 1
    shipped = broadcast_value(docs, {w: i for i, w in enumerate(vocabulary)})

    class Step:
        def __init__(self):
            self.get = shipped.value.get
            self.held, self.n = [], 0

        def __call__(self, batch):
            ids = []
            for text in batch.column(0).to_pylist():
                ids += map(self.get, words_of(text), repeat(other))
                ids.append(end)
            after = np.array(ids, dtype="int64")
            before = np.concatenate(([end], after[:-1]))
            self.held.append(before * size + after)
            self.n += len(after)
            return self.finish() if self.n > flush else []

        def finish(self):
            pair, n = np.unique(np.concatenate(self.held or [np.zeros(0, dtype="int64")]), return_counts=True)
            self.held, self.n = [], 0
            return {"context": pair // size, "word": pair % size, "n": n}

    return settle(map_arrow(docs.select("text"), Step, "context int, word int, n long"))


class LogBilinear:
    """score(w | c) = (r_c C) . q_w + b_w; word vectors r and q, a matrix C for the context's place, biases b."""

    def __init__(self, size: int, dims: int, seed: int, dtype: str = "float64", start: float = 1e-2):
        rng = np.random.default_rng(seed)
        self.r, self.q = ((rng.standard_normal((size, dims)) * 0.1).astype(dtype) for _ in range(2))
        self.c = np.eye(dims, dtype=dtype)
        self.b = np.zeros(size, dtype=dtype)
        self.seen = [np.full_like(p, start) for p in (self.r, self.q, self.c, self.b)]

    def train(self, pairs: np.ndarray, steps: int, batch: int, noise: int, rate: float, seed: int) -> LogBilinear:
        """Noise-contrastive estimation over the pair counts, with Adagrad steps.

        Pairs are drawn by their counts; each batch shares its noise words,
        drawn from the smoothed counts of the words, so that all scores are
        matrix products. The biases begin at the words' log-probabilities.
        """
        rng = np.random.default_rng(seed)
        size = len(pairs)
        p_noise = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * size)
        log_kp = np.log(noise * p_noise)
        self.b = np.log(p_noise)
        if not pairs.sum():
            return self
        at = np.flatnonzero(pairs)
        cumulated = np.cumsum(pairs.ravel()[at])
        for _ in range(steps):
            pair = at[np.searchsorted(cumulated, rng.integers(0, cumulated[-1], batch), "right")]
            self.step(*np.divmod(pair, size), np.full(batch, 1 / batch), rng.choice(size, noise, p=p_noise), log_kp, rate)
        return self

    def step(self, context, word, weight, drawn, log_kp, rate: float) -> None:
        """One Adagrad step over a batch of pairs with weights and the noise words it shares."""

        def descend(k, p, g, rows=None):
            seen = self.seen[k]
            if rows is None:
                seen += g * g
                p -= rate * g / np.sqrt(seen)
            else:
                order = np.argsort(rows, kind="stable")
                rows, first = np.unique(rows[order], return_index=True)
                total = np.add.reduceat(g[order], first, 0)
                seen[rows] += total * total
                p[rows] -= rate * total / np.sqrt(seen[rows])

        rc = self.r[context]
        h = rc @ self.c
        q_true, q_false = self.q[word], self.q[drawn]
        true = (h * q_true).sum(1) + self.b[word] - log_kp[word]
        false = h @ q_false.T + self.b[drawn] - log_kp[drawn]
        g_true = (1 / (1 + np.exp(-true)) - 1) * weight
        g_false = weight[:, None] / (1 + np.exp(-false))
        g_h = g_true[:, None] * q_true + g_false @ q_false
        c = self.c.copy()
        both = np.concatenate((word, drawn))
        descend(1, self.q, np.concatenate((g_true[:, None] * h, g_false.T @ h)), both)
        descend(3, self.b, np.concatenate((g_true, g_false.sum(0))), both)
        descend(2, self.c, rc.T @ g_h)
        descend(0, self.r, g_h @ c.T, context)

    def state(self) -> list[np.ndarray]:
        """What tasks average: by context, by word, and of the whole model."""
        seen = self.seen
        return [np.hstack((self.r, seen[0])), np.hstack((self.q, seen[1], self.b[:, None], seen[3][:, None])), np.stack((self.c, seen[2])).reshape(1, -1)]

    def take(self, state: list[np.ndarray]) -> None:
        d = self.r.shape[1]
        self.r, self.q, self.b = state[0][:, :d].copy(), state[1][:, :d].copy(), state[1][:, 2 * d].copy()
        self.c, seen_c = (x.copy() for x in state[2].reshape(2, d, d))
        self.seen = [state[0][:, d:].copy(), state[1][:, d : 2 * d].copy(), seen_c, state[1][:, 2 * d + 1].copy()]

    def log10_table(self) -> np.ndarray:
        """log10 p(w | c), contexts by rows: batched matrix products, normalised over all words."""
        out = np.empty((len(self.r), len(self.q)), dtype="float32")
        for at in range(0, len(self.r), 256):
            s = (self.r[at : at + 256] @ self.c) @ self.q.T + self.b
            s -= s.max(1, keepdims=True)
            out[at : at + 256] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out


BLOCK = 64


def train_over(pairs: DataFrame, model: LogBilinear, counts: np.ndarray, passes: int, steps: int, batch: int, noise: int, rate: float, seed: int) -> None:
    """Passes over all counted pairs, split over tasks; what tasks learn is averaged after each pass.

    A task goes over all of its pairs in batches, each pair weighted by its
    count; where that makes fewer than steps / passes steps, again. A row of
    the model is averaged over the tasks that have it, by its counts there.
    Tasks tell blocks of BLOCK rows, which are averaged in Spark: the driver
    gets one model a pass.
    """
    size, floor = len(counts), -(-steps // passes)
    p_noise = (counts + 0.5) / (counts.sum() + 0.5 * size)
    log_kp = np.log(noise * p_noise).astype("float32")
    model.b = np.log(p_noise).astype("float32")
    widths = [x.shape[1] for x in model.state()]

    for k in range(passes):
        shipped = broadcast_value(pairs, (model, p_noise, log_kp))

        class Step:
            def __init__(self, k=k, shipped=shipped):
                self.k, self.shipped, self.held = k, shipped, []

            def __call__(self, got):
                self.held.append([got.column(i).to_numpy() for i in range(3)])
                return []

            def finish(self):
                if not self.held:
                    return []
                context, word, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
                self.held = []
                part = TaskContext.get().partitionId()
                start, p_noise, log_kp = self.shipped.value
                own = LogBilinear(1, start.r.shape[1], 0, "float32")
                own.take(start.state())
                weights = [np.bincount(x, n, size) for x in (context, word)] + [np.array([n.sum()], dtype="float64")]
                pieces = -(-n // 8)  # heavy pairs are spread over a pass
                at = np.repeat(np.arange(len(n)), pieces)
                weight = (n / pieces)[at]
                weight = (weight / weight.mean()).astype("float32")
                rng = np.random.default_rng((seed, self.k, part))
                cumulated, done = np.cumsum(p_noise), 0
                while done < floor or not done:
                    order = rng.permutation(len(at))
                    for i in range(0, len(at), batch):
                        some = order[i : i + batch]
                        drawn = np.minimum(np.searchsorted(cumulated, rng.random(noise), "right"), size - 1)
                        own.step(context[at[some]], word[at[some]], weight[some] / len(some), drawn, log_kp, rate)
                        done += 1
                out = {c: [] for c in ("kind", "block", "part", "rows")}
                for kind, (x, w) in enumerate(zip(own.state(), weights, strict=True)):
                    x = np.hstack((x * w[:, None], w[:, None])).astype("float32")
                    for block in range(-(-len(x) // BLOCK)):
                        rows = x[block * BLOCK : (block + 1) * BLOCK]
                        if rows[:, -1].any():
                            for c, value in (("kind", kind), ("block", block), ("part", part), ("rows", rows.tobytes())):
                                out[c].append(value)
                return out

        def average(pdf):
            total = sum(np.frombuffer(x, "<f4").astype("float64") for x in pdf.sort_values("part")["rows"])
            return pdf.iloc[:1][["kind", "block"]].assign(rows=[total.astype("<f4").tobytes()])

        told = map_arrow(pairs, Step, "kind int, block int, part int, rows binary", rows=1 << 20)
        state = model.state()
        for r in told.groupBy("kind", "block").applyInPandas(average, "kind int, block int, rows binary").toArrow().to_pylist():
            x = np.frombuffer(r["rows"], "<f4").reshape(-1, widths[r["kind"]] + 1)
            had = np.flatnonzero(x[:, -1])
            state[r["kind"]][r["block"] * BLOCK + had] = x[had, :-1] / x[had, -1:]
        model.take(state)
        shipped.unpersist()


def log_totals(docs: DataFrame, model: LogBilinear, rows: int = 64) -> np.ndarray:
    """For each context the log of what its words' scores sum up to: exact, over all words, split over tasks."""
    size = len(model.b)
    shipped = broadcast_value(docs, (model.r @ model.c, model.q.T.copy(), model.b))

    def make():
        rc, q, b = shipped.value

        def step(batch):
            out = {"context": [], "total": []}
            for at in batch.column(0).to_pylist():
                s = rc[at * rows : (at + 1) * rows] @ q + b
                most = s.max(1)
                total = most + np.log(np.exp(s - most[:, None]).sum(1, dtype="float64"))
                out["context"] += range(at * rows, at * rows + len(s))
                out["total"] += total.tolist()
            return out

        return step

    blocks = docs.sparkSession.range(0, -(-size // rows), 1, max(1, min(64, size // 512)))
    got = map_arrow(blocks, make, "context long, total double").toArrow()
    totals = np.empty(size)
    totals[got["context"].to_numpy()] = got["total"].to_numpy()
    return totals


def score_documents(
    docs: DataFrame,
    head: int = 300_000,
    vocabulary: int = 1000,
    dims: int = 24,
    steps: int = 300,
    batch: int = 4096,
    noise: int = 64,
    rate: float = 0.1,
    seed: int = 13,
    passes: int = 2,
    start: float = 1e-5,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Word counts and pair counts are taken over all training texts. The
    log-bilinear model has the most frequent words, twice the square root of
    the number of training tokens, at least `vocabulary` and at most `head`,
    END and "other", and learns from all counted pairs in whole passes; the probability of another word is that of "other" given the
    token before, times its share of the other words' smoothed counts, so that
    scores are those of whole texts. The counts of at most `head` words are
    broadcast; the rest of a text's words get theirs by a join on the word,
    which holds the rare words only and so no hot key.

    Null or empty text: END alone. Null doc_id: hashed as an empty text.
    Repeated rows: scored each. No training texts: probabilities by the
    smoothing alone. Empty input: no rows.
    """
    rows = docs.select(F.col("doc_id"), "text").withColumn("held_out", hash_mod("doc_id") == 1)
    training = rows.where("not held_out").select("text")
    counts = settle(count_words(training))
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    known, n_known = frequent(counts, head)
    own = [w for w in known if w != END][: max(vocabulary, int(2 * total**0.5))]
    index = {w: i for i, w in enumerate(known)}
    in_model = np.full(len(known) + 1, len(own) + 1)  # the last entry: words beyond the head
    in_model[[index[w] for w in own]] = np.arange(len(own))
    n_all = np.append(n_known, 0)
    n_end = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    in_total = int(n_known[[index[w] for w in own]].sum()) + n_end
    base_all = total + 0.5 * (distinct + 1)
    other_all = total - in_total + 0.5 * max(0, distinct - len(own) - (n_end > 0)) + 0.5
    log_base = np.log10((n_all + 0.5) / base_all)
    log_other = np.where(in_model > len(own), np.log10((n_all + 0.5) / other_all), 0.0)
    log_base[-1] = log_other[-1] = 0.0  # comes from the join
    end_base = float(np.log10((n_end + 0.5) / base_all))
    model = LogBilinear(len(own) + 2, dims, seed, "float32", start)
    tokens = np.append(n_known[[index[w] for w in own]], (n_end, total - in_total)).astype("float64")
    train_over(count_pairs(training, own), model, tokens, passes, steps, batch, noise, rate, seed)
    totals = log_totals(docs, model)
    shipped = broadcast_value(docs, (index, in_model, log_base, log_other, model.r @ model.c, model.q, model.b, totals))

    def make():
        index, in_model, log_base, log_other, contexts, words_q, biases, totals = shipped.value
        get, beyond, end = index.get, len(index), len(biases) - 2

        def log10(before, after):
            s = np.einsum("ij,ij->i", contexts[before], words_q[after])
            return float((s + biases[after] - totals[before]).sum(dtype="float64")) / math.log(10)

        def step(batch):
            out = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "rest")}
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                at = np.fromiter(map(get, words, repeat(beyond)), dtype="int64", count=len(words))
                after = np.append(in_model[at], end)
                before = np.concatenate(([end], after[:-1]))
                far = np.flatnonzero(at == beyond).tolist()
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(len(words) - len(far) + (n_end > 0))
                out["base_score"].append(float(log_base[at].sum()) + end_base)
                out["score"].append(sum(log10(before[i : i + 65536], after[i : i + 65536]) for i in range(0, len(after), 65536)) + float(log_other[at].sum()))
                out["rest"].append([{"word": w, "tf": n} for w, n in Counter(words[i] for i in far).items()])
            return {"doc_id": batch.column(0), "held_out": batch.column(1)} | out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, tf: long>>"
    scored = settle(map_arrow(rows.select("doc_id", "held_out", "text"), make, schema).withColumn("row", F.monotonically_increasing_id()))
    n = F.coalesce("n", F.lit(0))
    rest = (
        scored.select("row", F.explode("rest").alias("r"))
        .select("row", "r.word", "r.tf")
        .join(counts, "word", "left")
        .select(
            "row",
            F.when(n > 0, F.col("tf")).otherwise(0).alias("n_known"),
            (F.col("tf") * F.log10((n + 0.5) / F.lit(float(base_all)))).alias("base_score"),
            (F.col("tf") * F.log10((n + 0.5) / F.lit(float(other_all)))).alias("score"),
        )
        .groupBy("row")
        .agg(*(F.sum(c).alias(f"more_{c}") for c in ("n_known", "base_score", "score")))
    )
    more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    return scored.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", more("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), more("base_score"), more("score")
    )
