"""Language-model scores by a weighted backoff automaton.

The model is a hierarchical Dirichlet n-gram model over all training tokens:

    p1(t)     = (c(t) + 0.5) / (N + 0.5 * (V + 1))
    pk(t | h) = (c(h t) + MU * p(k-1)(t | h')) / (c(h) + MU)      h' is h without its first token

As an automaton: each history seen in training is a state; a seen n-gram is an
arc that holds its whole smoothed probability and leads to the state of its
longest suffix that can be one; where a state has no arc for a token, its
failure arc to the state of h' costs MU / (c(h) + MU); at the root, an unseen
token costs p1 and stays there.  A text is read from left to right, and each
token's log-probability is added up along failure arcs and arc.  All texts of a
bucket are read side by side, one token of each at a step.  Texts are cut for
that into segments; a segment is entered ``order - 1`` tokens early at the root
(or at the text's start), which leads to the state that the whole text's
traversal has there.

The n-gram table grows with the corpus and is never in one place.  Documents
are dealt to buckets by hash.  A bucket sends the distinct n-grams of its
texts, with their counts in its training texts, to shards by range of their
hash; a shard adds up the counts and answers each bucket for its own n-grams
only, along with the shard's share of N and V.  The bucket then builds the
automaton of just the n-grams that its texts can meet, which scores them as the
whole model would.  Messages are sorted hashes, in about as many bits as the
gaps between them need, with a byte for each count; a very common n-gram costs
one entry in each bucket.  A bucket is of ``BUCKET_BYTES`` of text on average.

With as many shards as buckets, messages grow with the square of the input, so
beyond ``MESSAGES`` of them they take two levels: a bucket sends to groups of
shards, the messages of a group of buckets are merged there and sent on to each
shard, and the answers come back the same way.  Groups have the square root of
the number of members; the results are the same.

Hashes keep 16 bits more than the input's bytes take (48 at least, 64 at most),
so of distinct n-grams about one in 2**17 is expected to share its count with
another one, whatever the input's size and the number of shards (up to 2**48
bytes, the share growing beyond).

Defined cases: null text is empty and has the end token alone; repeated rows
count and are scored each time; with no training document all counts are 0 and
the score is that of the smoothing; a very long text makes its bucket as large
as itself; an empty table gives none; more columns are dropped, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import _text
from attestry.llm.language import held_out

ORDER = 3
#: Weight of the shorter history, in tokens; of 20 to 20,000 the best of those tried on held-out documents.
MU = 200.0
BUCKET_BYTES = 6 << 20
MESSAGES = 1 << 26
#: Tokens of a text that one traversal reads.
SEGMENT = 512

_U = np.uint64
_END, _BEGIN = _U(0x51ED270B4D2F6A10), _U(0x2545F4914F6CDD1C)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Grams:
    """The n-grams of a bucket's texts: of each order the distinct keys, one place of each, and for each token the index of its key."""

    def __init__(self, table: pa.Table, order: int, bits: int):
        text = table.column("text").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
        self.order, self.bits = order, bits
        train = ~np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool)
        rows = len(train)
        pieces, lengths = [], []
        for _row, _end, buf, offs in _text.text_slices(text):
            starts, ends, first = _text.words(buf, offs, _text.SPACE_SEP)
            pieces.append(np.insert(_text.word_hashes(buf, starts, ends), first[1:], _END))
            lengths.append(np.diff(first) + 1)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        tokens = np.concatenate(pieces) if pieces else np.zeros(0, _U)
        row = np.repeat(np.arange(rows), self.length)
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.since = (np.arange(len(tokens)) - self.first[row]).astype(np.int32)
        taught = train[row]
        rolled, spare = tokens, _U(64 - bits)
        self.keys, self.places, self.index, self.counts = [], [], [], []
        for k in range(order):
            if k:
                back = np.empty_like(tokens)
                back[k:], back[:k] = tokens[: len(tokens) - k], _BEGIN
                back[self.since < k] = _BEGIN
                rolled = rolled * _U(0xD6E8FEB86659FD93) + _text.mix(back + _U(k))
            keys, places, index = np.unique(_text.mix(rolled) >> spare, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.places.append(places)
            self.index.append(index.astype(np.int32))
            self.counts.append(np.bincount(index[taught], minlength=len(keys)))


class Automaton:
    """States and arcs for the n-grams of one bucket, with the whole corpus' counts.

    State 0 is the root, states 1 to order - 1 are the histories of that many begin signs, then follow the n-grams of
    each order below the model's.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, distinct: int, texts: int):
        order = grams.order
        self.grams, self.tokens_known = grams, counts[0] > 0
        base = np.cumsum([order, *(len(k) for k in grams.keys[: order - 1])])  # the first state of each order
        self.failure = np.zeros(base[-1], np.int64)
        seen = np.zeros(base[-1], np.int64)
        seen[1:order], self.failure[1:order] = texts, np.arange(order - 1)
        for k in range(order - 1):
            seen[base[k] : base[k + 1]] = counts[k]
            if k:
                self.failure[base[k] : base[k + 1]] = base[k - 1] + grams.index[k - 1][grams.places[k]]
        self.failure_cost = np.log10(MU / (seen + MU))
        unit = 1.0 / (tokens + 0.5 * (distinct + 1))
        self.single = np.log10((counts[0] + 0.5) * unit)
        self.unseen = math.log10(0.5 * unit)
        self.width = max(1, len(grams.keys[0]))
        self.start = order - 1
        codes, costs, targets = [], [], []
        p = (counts[0] + 0.5) * unit
        for k in range(order):
            at = grams.places[k]
            if k:
                before = grams.index[k - 1][np.maximum(at - 1, 0)] + base[k - 1]
                source = np.where(grams.since[at] > 0, before, k)
                history = seen[source]
                p = (counts[k] + MU * p[grams.index[k - 1][at]]) / (history + MU)
            else:
                source = np.zeros(len(at), np.int64)
            if k < order - 1:
                target = base[k] + np.arange(len(at))
            else:
                target = base[k - 1] + grams.index[k - 1][at] if k else source
            real = counts[k] > 0
            codes.append((source.astype(np.int64) * self.width + grams.index[0][at])[real])
            costs.append(np.log10(p)[real])
            targets.append(target[real])
        flat = np.concatenate(codes)
        del codes
        by_code = np.argsort(flat)
        self.codes = np.append(flat[by_code], np.iinfo(np.int64).max)
        self.costs, self.targets = np.append(np.concatenate(costs)[by_code], 0.0), np.append(np.concatenate(targets)[by_code], 0)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the log10 probabilities of the tokens."""
        cost = np.zeros(len(state))
        following = np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            code = state * self.width + token
            arc = np.searchsorted(self.codes, code)
            hit = self.codes[arc] == code
            done = left[hit]
            cost[done] += self.costs[arc[hit]]
            following[done] = self.targets[arc[hit]]
            miss = ~hit
            left, state, token = left[miss], state[miss], token[miss]
            root = state == 0
            cost[left[root]] += self.unseen
            left, state, token = left[~root], state[~root], token[~root]
            cost[left] += self.failure_cost[state]
            state = self.failure[state]
        return following, cost

    def traverse(self, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of every token, from traversals of all texts' segments side by side."""
        g = self.grams
        out = np.zeros(len(g.since))
        parts = -(-g.length // segment)
        of = np.repeat(np.arange(len(g.length)), parts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = number * segment  # in its text
        early = np.where(number > 0, np.minimum(g.order - 1, begin), 0)
        length = np.minimum(segment, g.length[of] - begin) + early
        first = g.first[of] + begin - early
        state = np.where(begin > early, 0, self.start)
        longest = np.argsort(-length, kind="stable")
        length, first, early, state = length[longest], first[longest], early[longest], state[longest]
        for k in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -k, "left"))  # of those that are longer than k
            at = first[:active] + k
            state, cost = self.step(state[:active], g.index[0][at])
            counted = k >= early[:active]
            out[at[counted]] = cost[counted]
        return out


def _first_key(part: int, parts: int, bits: int) -> int:
    return (part << bits) // parts


def _bounds(keys: np.ndarray, parts: range, of: int, bits: int) -> np.ndarray:
    """Where each of these parts' (of so many) range of keys begins in sorted keys, and the end of the last."""
    edges = np.array([_first_key(p, of, bits) for p in parts[1:]], _U)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def pack_sorted(values: np.ndarray, span: int) -> bytes:
    """Rising numbers below span: their high parts in unary steps, their low parts as whole bytes and remaining bits."""
    n = len(values)
    if not n:
        return b""
    low = max(0, (span // n).bit_length() - 1)
    whole, rest = divmod(low, 8)
    steps = np.zeros(n + (span >> low) + 1, np.uint8)
    steps[(values >> _U(low)).astype(np.int64) + np.arange(n)] = 1
    small = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)
    bits = (small[:, whole, None] >> np.arange(rest, dtype=np.uint8)) & 1 if rest else np.zeros(0, np.uint8)
    head = np.array([n, low], "<u4").tobytes()
    return head + small[:, :whole].T.tobytes() + np.packbits(bits).tobytes() + np.packbits(steps).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, _U)
    n, low = np.frombuffer(raw, "<u4", 2).tolist()
    whole, rest = divmod(low, 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :whole] = np.frombuffer(raw, np.uint8, n * whole, 8).reshape(whole, n).T
    at = 8 + n * whole
    if rest:
        size = -(-n * rest // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * rest).reshape(n, rest)
        wide[:, whole] = bits @ (1 << np.arange(rest, dtype=np.uint8))
        at += size
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at)))[:n] - np.arange(n)
    return wide.view("<u8").ravel() | (high.astype(_U) << _U(low))


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte each; 255 stands for the next of the large counts that follow."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<u8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


class Routes:
    """How n-grams get to shards: straight, or by groups of shards and of buckets."""

    def __init__(self, order: int, buckets: int, bits: int, messages: int):
        self.order, self.bits, self.buckets = order, bits, buckets
        self.two_levels = buckets * buckets > messages
        self.groups = math.isqrt(buckets - 1) + 1 if self.two_levels else buckets
        self.each = -(-buckets // self.groups)  # shards of a group
        self.shards = self.groups * self.each
        self.fields = ", ".join(f"keys{k} binary, counts{k} binary" for k in range(order))
        self.totals = ", ".join(f"totals{k} binary" for k in range(order)) + ", tokens long, distinct long"

    def send(self, keys: list[np.ndarray], counts: list[np.ndarray], parts: range, of: int) -> dict[str, pa.Array]:
        """A message for each of these parts, of so many."""
        out = {}
        for k in range(self.order):
            cuts = _bounds(keys[k], parts, of, self.bits)
            packed = []
            for j, p in enumerate(parts):
                low, high = _first_key(p, of, self.bits), _first_key(p + 1, of, self.bits)
                packed.append(pack_sorted(keys[k][cuts[j] : cuts[j + 1]] - _U(low), high - low))
            out[f"keys{k}"] = pa.array(packed, pa.binary())
            out[f"counts{k}"] = pa.array([_pack_counts(counts[k][cuts[j] : cuts[j + 1]]) for j in range(len(parts))], pa.binary())
        return out

    def receive(self, table: pa.Table, k: int, part: int, of: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Keys and counts of each message to a part."""
        low = _U(_first_key(part, of, self.bits))
        keys = [unpack_sorted(x) + low for x in table.column(f"keys{k}").to_pylist()]
        return keys, [_unpack_counts(x, len(y)) for x, y in zip(table.column(f"counts{k}").to_pylist(), keys, strict=True)]

    def ask(self, table: pa.Table) -> pa.Table:
        """A bucket's messages."""
        grams = Grams(table, self.order, self.bits)
        bucket = table.column("bucket")[0].as_py()
        to = range(self.groups)
        place = {"bucket": pa.array(np.full(len(to), bucket, np.int32)), "part": pa.array(np.arange(len(to), dtype=np.int32)), "team": pa.array(np.full(len(to), bucket % self.groups, np.int32))}
        return pa.table(place | self.send(grams.keys, grams.counts, to, self.groups))

    def merge(self, table: pa.Table) -> pa.Table:
        """The messages of a team of buckets to a group of shards, added up and cut by shard."""
        team, group = table.column("team")[0].as_py(), table.column("part")[0].as_py()
        added = [_added(*self.receive(table, k, group, self.groups))[:2] for k in range(self.order)]
        to = range(group * self.each, (group + 1) * self.each)
        place = {"bucket": pa.array(np.full(len(to), team, np.int32)), "part": pa.array(np.array(to, np.int32)), "team": pa.array(np.full(len(to), group, np.int32))}
        return pa.table(place | self.send([a[0] for a in added], [a[1] for a in added], to, self.shards))

    def answer(self, table: pa.Table) -> pa.Table:
        """A shard's totals for each message."""
        shard = table.column("part")[0].as_py()
        out = {"bucket": table.column("bucket"), "part": table.column("part"), "team": table.column("team")}
        for k in range(self.order):
            keys, counts = self.receive(table, k, shard, self.shards)
            _distinct, total, inverse = _added(keys, counts)
            ends = np.cumsum([len(x) for x in keys])
            out[f"totals{k}"] = pa.array([_pack_counts(x) for x in np.split(total[inverse], ends[:-1])], pa.binary())
            if k == 0:
                n, v = int(total.sum()), int((total > 0).sum())
        out["tokens"] = pa.array(np.full(table.num_rows, n, np.int64))
        out["distinct"] = pa.array(np.full(table.num_rows, v, np.int64))
        return pa.table(out)

    def give_back(self, asked: pa.Table, answers: pa.Table) -> pa.Table:
        """A team's answers from a group of shards, taken apart by bucket."""
        group = asked.column("part")[0].as_py()
        answers = answers.sort_by("part")
        out = {"bucket": asked.column("bucket"), "part": asked.column("part"), "team": asked.column("team")}
        for k in range(self.order):
            keys, counts = self.receive(asked, k, group, self.groups)
            distinct, _sum, inverse = _added(keys, counts)
            cuts = np.diff(_bounds(distinct, range(group * self.each, (group + 1) * self.each), self.shards, self.bits))
            total = np.concatenate([_unpack_counts(x, int(n)) for x, n in zip(answers.column(f"totals{k}").to_pylist(), cuts, strict=True)])
            ends = np.cumsum([len(x) for x in keys])
            out[f"totals{k}"] = pa.array([_pack_counts(x) for x in np.split(total[inverse], ends[:-1])], pa.binary())
        for c in ("tokens", "distinct"):
            out[c] = pa.array(np.full(asked.num_rows, sum(answers.column(c).to_pylist()), np.int64))
        return pa.table(out)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all messages, the sums of their counts, and the index of each message's keys among them."""
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64), inverse


def _score(routes: Routes, texts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        rows = docs.num_rows
        grams = Grams(docs, routes.order, routes.bits)
        answers = answers.sort_by("part")
        counts = []
        for k in range(routes.order):
            sizes = np.diff(_bounds(grams.keys[k], range(routes.groups), routes.groups, routes.bits))
            counts.append(np.concatenate([np.zeros(0, np.int64), *(_unpack_counts(x, int(n)) for x, n in zip(answers.column(f"totals{k}").to_pylist(), sizes, strict=bool(rows)))]))
        n = sum(answers.column("tokens").to_pylist())
        automaton = Automaton(grams, counts, n, sum(answers.column("distinct").to_pylist()), texts)
        token = grams.index[0]
        per_row = [np.add.reduceat(x, grams.first) if rows else np.zeros(0) for x in (automaton.single[token], automaton.traverse(), automaton.tokens_known[token].astype(np.int64))]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(grams.length.astype(np.int64)),
                "n_known": pa.array(per_row[2].astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, n, np.int64)),
                "base_score": pa.array(np.round(per_row[0].astype(np.float64), 6)),
                "score": pa.array(np.round(per_row[1].astype(np.float64), 6)),
            }
        )

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, buckets: int | None = None, messages: int = MESSAGES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    marked = docs.select("doc_id", "text", held_out(5, 1).alias("held_out"))
    size, texts = marked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    if buckets is None:
        buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    routes = Routes(order, buckets, min(64, max(48, 16 + size.bit_length())), messages)
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    places = "bucket int, part int, team int"
    asked = dealt.groupBy("bucket").applyInArrow(lambda table: routes.ask(table), f"{places}, {routes.fields}")
    if routes.two_levels:
        merged = asked.groupBy("team", "part").applyInArrow(lambda table: routes.merge(table), f"{places}, {routes.fields}")
        totals = merged.groupBy("part").applyInArrow(lambda table: routes.answer(table), f"{places}, {routes.totals}")
        # a merged message's bucket is its team, and its team the group of shards
        back = totals.select(F.col("bucket").alias("team"), F.col("team").alias("group"), *(c for c in totals.columns if c not in ("bucket", "team")))
        answers = asked.groupBy("team", "part").cogroup(back.groupBy("team", "group")).applyInArrow(lambda mine, theirs: routes.give_back(mine, theirs), f"{places}, {routes.totals}")
    else:
        answers = asked.groupBy("part").applyInArrow(lambda table: routes.answer(table), f"{places}, {routes.totals}")
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score(routes, texts), SCORED)
