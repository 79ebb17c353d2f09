"""Masked pseudo-likelihood: a window network predicts every token from both sides, and its log-probabilities add up.

1. Documents become blocks of word numbers, written once. The blocks' words are dealt by word over the whole corpus, each
   once for a block, and their counts go back to the blocks: every word knows how often the corpus has it.
2. The most frequent words, VOCABULARY or the root of the number of tokens if that is more, are tokens of the network;
   other words share SHAPES tokens by first letter and ending. P(word | context) is the token's probability, and for
   words that share one times the word's share of the token's count, so each word keeps a probability of its own. A word
   that the corpus does not have counts as half an occurrence.
3. The network reads SIDE tokens on either side (embeddings, a hidden layer) and weighs EXPERTS distributions over all
   tokens with a softmax: P(token | context) = sum of weight x P(token | expert). These distributions are the last layer,
   learned with the weights: a token's count is shared out among the experts by how well each predicts it where it
   stands. Every token of every document is a target.
4. Training is in ROUNDS of parameter averaging. Documents are dealt to shards and rounds by a hash of doc_id and text,
   and a shard reads its documents in the order of that hash, so results do not depend on partitions. A shard descends
   LEAST_STEPS steps at least in a round, going over its tokens again where they are few.
5. A document's score is the mean conditional log-probability of its tokens; their sum is its pseudo-log-likelihood.

Cases: null and empty texts and those without words have no tokens, sum 0 and a null mean. An empty table gives an empty
result. Repeated rows are counted and scored alike; null doc_ids pass through; long texts are scored whole. Extra
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pack, _pack_words, _unpack, _unpack_words
from .common import checkpointed, durable, lean, row_sign
from .substrings import _unzip, _zip

VOCABULARY = 8192
ENDINGS = 32
SHAPES = 4 * ENDINGS
EXPERTS = 24
SIDE = 2
WIDTH = 4
HIDDEN = 16
ROUNDS = 2
RATES = (0.15, 0.05)
BATCH = 4096
LEAST_STEPS = 240
#: Tokens of a shard, about.
SHARD_TOKENS = 2_000_000
BLOCK_CHARS = 32 << 20
BLOCK_WORDS = 600_000
#: Words that one group of the word shuffle gets at most on average, counted once for each block.
PART_WORDS = 300_000
RUN = 1 << 15


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def shape(word: bytes) -> int:
    first = word[:4].decode("utf-8", "ignore")[:1]
    mark = word[-1] < 0x80 and not word[-1:].isalnum()
    return (first.isupper() * 2 + mark) * ENDINGS + xxhash.xxh32_intdigest(word[-2:]) % ENDINGS


# --- words and their counts


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block: its documents' ids and signs, their lengths in words, all their words' numbers, the word list
    and how often the block has each word."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        held, signs, seqs, chars = [], [], [], 0

        def flush() -> pa.RecordBatch:
            seq = np.concatenate([np.zeros(0, np.uint32), *seqs])
            often = np.bincount(seq, minlength=len(ids))
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([held], pa.list_(pa.int64())), pa.array([signs], pa.list_(pa.int64())),
                pa.array([[len(x) for x in seqs]], pa.list_(pa.int32())), pa.array([_pack(seq)], pa.binary()), pa.array([_pack_words(list(ids))], pa.binary()),
                pa.array([_pack(often)], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([len(seq)], pa.int64()),
            ], names=["block", "doc_ids", "signs", "sizes", "seq", "words", "often", "n_words", "n_tokens"])

        for batch in batches:
            for doc_id, text, sign in zip(*(c.to_pylist() for c in batch.columns)):
                words = tokens(text)
                seqs.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
                held.append(doc_id), signs.append(sign)
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_WORDS:
                    yield flush()
                    ids = defaultdict(count().__next__)
                    held, signs, seqs, chars, number = [], [], [], 0, number + 1
        if held:
            yield flush()

    schema = "block long, doc_ids array<long>, signs array<long>, sizes array<int>, seq binary, words binary, often binary, n_words long, n_tokens long"
    return docs.select(F.col("doc_id").cast("long"), "text", row_sign().alias("sign")).mapInArrow(run, schema)


def _asks(table: DataFrame, parts: int) -> DataFrame:
    """Each block's words dealt by their hash: (part, of, at, often, words), at being their numbers in the block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words, often = _unpack_words(packed.as_py()), _unpack(often.as_py())[0]
                part = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % parts
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                own = [order[cuts[p] : cuts[p + 1]] for p in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([_pack(np.diff(x, prepend=0)) for x in own], pa.binary()),
                    pa.array([_pack(often[x]) for x in own], pa.binary()), pa.array([_pack_words([words[i] for i in x.tolist()]) for x in own], pa.binary()),
                ], names=["part", "of", "at", "often", "words"])

    return table.select("block", "words", "often").mapInArrow(run, "part int, of long, at binary, often binary, words binary")


def _answers(asked: DataFrame, parts: int, size: int) -> DataFrame:
    """Rows (of, at, totals) for each row of asked, and for each part a row (words, totals, ends): its size most frequent
    words and the sums of all its words' counts by shape."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def row(*values) -> pa.RecordBatch:
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["of", "at", "totals", "words", "ends"])

        def finish() -> Iterator[pa.RecordBatch]:
            total: defaultdict[bytes, int] = defaultdict(int)
            said = [(of, at, _unpack_words(words), _unpack(often)[0].tolist()) for of, at, often, words in held]
            for _, _, words, often in said:
                for w, n in zip(words, often):
                    total[w] += n
            for of, at, words, _ in said:
                yield row(of, at, _zip(np.fromiter(map(total.__getitem__, words), np.int64, len(words))), None, None)
            ends = np.zeros(SHAPES, np.int64)
            np.add.at(ends, [shape(w) for w in total], np.fromiter(total.values(), np.int64, len(total)))
            top = sorted(total, key=lambda w: (-total[w], w))[:size]
            yield row(None, None, _zip(np.array([total[w] for w in top], np.int64)), _pack_words(top), ends.tobytes())

        for batch in batches:
            for part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield from finish()
                    held = []
                now = part
                held.append(rest)
        if held:
            yield from finish()

    met = asked.repartition(parts, "part").sortWithinPartitions("part", "of")
    return met.mapInArrow(run, "of long, at binary, totals binary, words binary, ends binary")


@dataclass
class Vocabulary:
    number: dict[bytes, int]
    counts: np.ndarray  # of each token; those of the shapes are what the words of the network leave

    @property
    def size(self) -> int:
        return len(self.counts)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get, base = self.number.get, len(self.number)
        return np.fromiter((i if (i := get(w)) is not None else base + shape(w) for w in words), np.int64, len(words))


def _vocabulary(answered: DataFrame, size: int) -> Vocabulary:
    """size words and SHAPES sums reach the driver."""

    @lean
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack_words(w), pa.binary()), pa.array(_unzip(n, np.int64))], names=["word", "n"])

    @lean
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHAPES, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), pa.array(total)], names=["shape", "n"])

    own = answered.where("words is not null")
    top = own.select("words", "totals").mapInArrow(words, "word binary, n long").orderBy(F.col("n").desc(), "word").limit(size).toArrow()
    listed, n = top.column(0).to_pylist(), top.column(1).to_numpy()
    sums = own.select("ends").mapInArrow(ends, "shape long, n long").groupBy("shape").agg(F.sum("n").alias("n")).toArrow()
    rest = np.zeros(SHAPES, np.int64)
    rest[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    np.subtract.at(rest, [shape(w) for w in listed], n)
    return Vocabulary({w: i for i, w in enumerate(listed)}, np.concatenate([n, rest]).astype(np.int64))


def read(docs: DataFrame, size: int | None = None) -> tuple[DataFrame, Vocabulary]:
    """The table (doc_id, sign, n_tokens, own, ids) of all rows of docs(doc_id, text), and the vocabulary.

    ids are token numbers as unsigned 32-bit integers; own is the sum of the logs of the shares that words which share a
    token have of its count.
    """
    table = durable(blocks(docs), "lm-blocks")
    n_words, n_tokens = table.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    parts = -(-(n_words or 1) // PART_WORDS)
    size = max(VOCABULARY, isqrt(n_tokens or 0)) if size is None else size
    answered = durable(_answers(_asks(table, parts), parts, size), "lm-counts")
    vocab = _vocabulary(answered, size)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["doc_id", "sign", "n_tokens", "own", "ids"]

    @lean
    def run(key, own: pa.Table, found: pa.Table) -> pa.Table:
        vocab, out = sent.value, []
        at = [np.cumsum(_unpack(x)[0].view(np.int32), dtype=np.int64) for x in found.column("at").to_pylist()]
        totals = [_unzip(x, np.int64) for x in found.column("totals").to_pylist()]
        at, totals = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, totals))
        for doc_ids, signs, sizes, seq, words in zip(*(own.column(c).to_pylist() for c in ("doc_ids", "signs", "sizes", "seq", "words"))):
            token = vocab.ids(_unpack_words(words))
            log = np.zeros(len(token))
            log[at] = np.log(totals)
            log[token < len(vocab.number)] = 0
            shared = token >= len(vocab.number)
            log[shared] -= np.log(vocab.counts[token[shared]])
            seq = _unpack(seq)[0]
            ids, bounds = token[seq].astype("<u4"), np.cumsum([0, *sizes])
            sums = np.diff(np.append(0, np.cumsum(log[seq]))[bounds])
            raw = ids.tobytes()
            cut = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            out.append(pa.table([pa.array(doc_ids, pa.int64()), pa.array(signs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(cut, pa.binary())], names=names))
        return pa.concat_tables(out)

    kept = table.select("block", "doc_ids", "signs", "sizes", "seq", "words")
    met = kept.groupBy("block").cogroup(answered.where("words is null").select("of", "at", "totals").groupBy("of"))
    return durable(met.applyInArrow(run, "doc_id long, sign long, n_tokens long, own double, ids binary"), "lm-ids"), vocab


# --- the network

STEPS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


@dataclass
class Net:
    """params: embeddings (a last row stands beyond a document's ends), hidden layer, weights of the experts; and
    P(token | expert), tokens x experts."""

    params: list[np.ndarray]
    dist: np.ndarray


def start(vocab: Vocabulary) -> Net:
    rng = np.random.default_rng(11)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    params = [draw(vocab.size + 1, WIDTH, scale=0.5), draw(2 * SIDE * WIDTH, HIDDEN, scale=2 / (2 * SIDE * WIDTH) ** 0.5), np.zeros(HIDDEN, np.float32),
              draw(HIDDEN, EXPERTS, scale=HIDDEN**-0.5), np.zeros(EXPERTS, np.float32)]
    return Net(params, distributions(vocab, np.zeros((vocab.size, EXPERTS), np.float32)))


def distributions(vocab: Vocabulary, taken: np.ndarray) -> np.ndarray:
    """P(token | expert), from the counts of each token that the experts have taken. Together the experts hold the
    corpus counts; a token shares its own out as taken says, smoothed by half a count in the shares of all tokens."""
    whole = taken.sum(0) + 1e-3
    share = taken + 0.5 * (whole / whole.sum())
    share *= (np.maximum(vocab.counts, 1e-3) / share.sum(1))[:, None].astype(np.float32)
    return np.append(share / share.sum(0), np.ones((1, EXPERTS)), axis=0).astype(np.float32)


def stream(docs: list[np.ndarray], end: int) -> np.ndarray:
    """Token numbers of documents in a row, SIDE times end between them and at both ends."""
    gap = np.full(SIDE, end, np.int64)
    return np.concatenate([gap, *(x for d in docs for x in (d, gap))])


def weigh(p: list[np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden layer and weights of the experts for all tokens of near but the SIDE at either end."""
    e = np.take(p[0], near, axis=0, mode="clip")
    n = len(near) - 2 * SIDE
    x = np.concatenate([e[SIDE + d : SIDE + d + n] for d in STEPS], axis=1)
    h = x @ p[1]
    h += p[2]
    np.tanh(h, out=h)
    g = h @ p[3]
    g += p[4]
    np.clip(g, -40, 40, out=g)
    np.exp(g, out=g)
    g /= g @ np.ones((EXPERTS, 1), g.dtype)
    return x, h, g


def gradients(p: list[np.ndarray], dist: np.ndarray, near: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the mean negative log-probability of near's tokens but for its ends: gradients, that of the embeddings by place
    of near; and how far each expert takes each of these tokens."""
    own = near[SIDE:-SIDE]
    x, h, g = weigh(p, near)
    take = np.take(dist, own, axis=0, mode="clip")
    take *= g
    take /= take @ np.ones((EXPERTS, 1), take.dtype)
    live = (own < len(dist) - 1).astype(g.dtype)[:, None]
    take *= live
    g *= live
    g -= take
    g *= g.dtype.type(1 / max(1.0, float(live.sum())))
    dh = g @ p[3].T
    dh *= 1 - h * h
    dx = dh @ p[1].T
    de = np.zeros((len(near), WIDTH), g.dtype)
    for k, d in enumerate(STEPS):
        de[SIDE + d : SIDE + d + len(own)] += dx[:, k * WIDTH : (k + 1) * WIDTH]
    return [de, x.T @ dh, dh.sum(0), h.T @ g, g.sum(0)], take


def _by_token(at: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of at and the sums of their values."""
    order = np.argsort(at.astype(np.uint16) if size < 1 << 16 else at, kind="stable")
    row = np.take(at, order)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return row[first], np.add.reduceat(np.take(values, order, axis=0), first, axis=0)


def descend(net: Net, vocab: Vocabulary, whole: np.ndarray, number: int) -> tuple[np.ndarray, int]:
    """Train net in place on all tokens of the stream whole in round number; counts taken by the experts, tokens read."""
    p, end = net.params, vocab.size
    rate, slack = np.float32(RATES[min(number, len(RATES) - 1)]), [np.full_like(a, 1e-8) for a in p]
    taken = np.zeros((end, EXPERTS), np.float32)
    n = len(whole) - 2 * SIDE
    starts = range(0, n, BATCH)
    step = 0
    for _ in range(-(-LEAST_STEPS // max(1, len(starts)))):
        for a in starts:
            near = whole[a : min(n, a + BATCH) + 2 * SIDE]
            grads, take = gradients(p, net.dist, near)
            rows, sums = _by_token(near, grads[0], end)
            slack[0][rows] += sums * sums
            p[0][rows] -= rate * sums / np.sqrt(slack[0][rows])
            for i in range(1, len(p)):
                slack[i] += grads[i] * grads[i]
                p[i] -= rate * grads[i] / np.sqrt(slack[i])
            rows, sums = _by_token(near[SIDE:-SIDE], take, end)
            real = rows < end
            taken[rows[real]] += sums[real]
            step += 1
            # In the first round the experts part, so they are renewed often and early counts fade.
            if number == 0 and (step & step - 1 == 0 or step % 16 == 0):
                net.dist = distributions(vocab, taken)
                if step < LEAST_STEPS:
                    taken *= 0.7
    return taken, n


def _row(key: int, shard: int, seen: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([a.ravel() for a in arrays]).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([shard]), pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], names=["part", "shard", "seen", "flat"])


PARAMS = "part long, shard long, seen long, flat binary"


def train(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Net:
    """The network, averaged over all shards, weighed by their tokens; what a shard sends has the size of the network."""
    spark, net = coded.sparkSession, start(vocab)
    shards = (coded.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS + 1
    groups = min(shards, isqrt(shards) + 3)
    sizes = [a.size for a in net.params] + [vocab.size * EXPERTS]
    taken = np.zeros((vocab.size, EXPERTS))
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((vocab.counts, net))

        @lean
        def run(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            counts, begun = sent.value
            vocab, held, now = Vocabulary({}, counts), [], None

            def finish() -> pa.RecordBatch:
                own = Net([a.copy() for a in begun.params], begun.dist)
                got, seen = descend(own, vocab, stream(held, vocab.size), number)
                return _row(now % groups, now, seen, [*(a * np.float32(seen) for a in own.params), got])

            for batch in batches:
                for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if shard != now and held:
                        yield finish()
                        held = []
                    now = shard
                    held.append(np.frombuffer(ids.as_py(), "<u4").astype(np.int64))
            if held:
                yield finish()

        own = coded.where((F.pmod("sign", F.lit(rounds)) == number) & (F.col("n_tokens") > 0))
        shard = F.pmod(F.shiftright("sign", 16), F.lit(shards)).alias("shard")
        dealt = own.select(shard, "ids", "sign").repartition(shards, "shard").sortWithinPartitions("shard", "sign").select("shard", "ids")
        summed = _summed(dealt.mapInArrow(run, PARAMS), groups)
        if groups > 4:
            summed = _summed(summed.withColumn("part", F.col("part") % 4), 4)
        rows = checkpointed(summed).orderBy("part").collect()  # 4 rows at most
        if rows:
            flat = sum(np.frombuffer(r["flat"], np.float32).astype(np.float64) for r in rows)
            cut = np.cumsum([0, *sizes])
            arrays = [flat[a:b] for a, b in zip(cut, cut[1:])]
            seen = sum(r["seen"] for r in rows)
            params = [(a / seen).astype(np.float32).reshape(q.shape) for a, q in zip(arrays, net.params)]
            taken += arrays[-1].reshape(taken.shape)
            net = Net(params, distributions(vocab, taken.astype(np.float32)))
    return net


def _summed(rows: DataFrame, parts: int) -> DataFrame:
    """Sums by part, in the order of shards."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, seen, shard = None, None, 0, 0
        for batch in batches:
            for part, own, n, flat in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and total is not None:
                    yield _row(now, shard, seen, [total])
                    total = None
                if total is None:
                    total, now, seen, shard = np.zeros(len(flat) // 4), part, 0, own
                total += np.frombuffer(flat, np.float32)
                seen += n
        if total is not None:
            yield _row(now, shard, seen, [total])

    return rows.repartition(parts, "part").sortWithinPartitions("part", "shard").mapInArrow(run, PARAMS)


# --- scores


def log_probabilities(net: Net, whole: np.ndarray) -> np.ndarray:
    """Of every token of a stream given its neighbours, 0 for the marks between documents and without those at its ends."""
    n = len(whole) - 2 * SIDE
    out = np.zeros(n)
    for a in range(0, n, RUN):
        near = whole[a : min(n, a + RUN) + 2 * SIDE]
        g = weigh(net.params, near)[2]
        g *= np.take(net.dist, near[SIDE:-SIDE], axis=0, mode="clip")
        out[a : a + RUN] = np.log(g @ np.ones(EXPERTS, g.dtype))
    out[whole[SIDE:-SIDE] == len(net.dist) - 1] = 0
    return out


def score(coded: DataFrame, net: Net) -> DataFrame:
    """doc_id, n_tokens, sum_logp and mean_logp of every row of coded, which read() has made."""
    sent = coded.sparkSession.sparkContext.broadcast(net)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        end = len(net.dist) - 1
        for batch in batches:
            docs = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(3)]
            sums, held, n = [], [], 0

            def finish() -> None:
                logs = np.append(np.zeros(1), np.cumsum(log_probabilities(net, stream(held, end))))
                ends = np.cumsum([len(d) + SIDE for d in held])
                sums.append(logs[ends - SIDE] - logs[ends - [len(d) + SIDE for d in held]])

            for d in docs:
                held.append(d)
                n += len(d)
                if n >= RUN:
                    finish()
                    held, n = [], 0
            if held:
                finish()
            total = np.concatenate([np.zeros(0), *sums]) + batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total)], names=["doc_id", "n_tokens", "sum_logp"])

    found = coded.select("doc_id", "n_tokens", "own", "ids").mapInArrow(run, "doc_id long, n_tokens long, sum_logp double")
    return found.withColumn("mean_logp", F.when(F.col("n_tokens") > 0, F.col("sum_logp") / F.col("n_tokens")))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    coded, vocab = read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(coded, train(coded, vocab))
