"""Chat formatting as a prefix tree of token ids.

A turn is formatted as ``[INST]role[/INST]text</s>``; in roles and texts a
backslash is doubled, and one follows the first character of every control
string, so control strings stand only where the template puts them, and the
escaping can be undone.  The head, the escaped text and the end of a turn are
encoded one by one (special strings as ordinary text), so the loss mask of an
assistant turn, which covers its escaped text, begins and ends between tokens.

Conversations are range-sorted by the path of their turns' hashes.  That order
is a depth-first walk of the prefix tree, so each partition emits a turn's ids
when it isn't on the path of the conversation before it, once for all
conversations that share it and all turns before it.  A turn's node has its
offset in the whole walk, the position id of its first token (tokens before it
in its conversation, whichever branch that is), and the offset intervals of its
ancestors, which are all that its tokens may attend to besides those before
them in the node itself; neighbouring intervals are merged.  All of these count
tokens.

A partition starts from the path at the end of the one before it.  Those paths
and one total for each partition are all that the driver sees; the sorted rows
are checkpointed, so that all passes see the same partitions.

Defined cases: null role or text is empty; turns are ordered by turn (null
first), then role, then text, so repeated rows are repeated turns; a null
conv_id is a conversation too; a very long turn is one node, escaped and read
in linear time and encoded in chunks; an empty table gives an empty tree; more
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import _bpe, _text

#: Strings that this and other chat templates reserve; fixed values.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"

_RESERVED = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _RESERVED.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped text and end of the formatted turn."""
    return f"{OPEN}{escape(role)}{CLOSE}", escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        middle = formatted.find(CLOSE, at)
        end = formatted.find(END, middle)
        if not formatted.startswith(OPEN, at) or middle < 0 or end < 0:
            raise ValueError("not a formatted conversation")
        out.append((unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(CLOSE) : end])))
        at = end + len(END)
    return out


#: Ids are little-endian unsigned 32-bit numbers.
_ID = np.dtype("<u4")
#: Bytes of text of a partition, whatever the input's size.
PARTITION_BYTES = 64 << 20
#: Conversations that share a node, above which they are read back in so many parts; and how many nodes can be such.
HOT_ROWS, HOT_NODES = 20_000, 1_000

SORTED = "path array<string>, conv_id long, roles array<string>, ids array<binary>, loss_starts array<int>, loss_ends array<int>"
TREE = (
    "kind string, conv_id long, node_offset long, length long, position long, depth int, role string, ids binary, loss_start int, loss_end int, "
    "attends array<struct<start: long, end: long>>, path array<long>"
)
_TREE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
_TREE_NAMES = ["kind", "conv_id", "node_offset", "length", "position", "depth", "role", "ids", "loss_start", "loss_end", "attends", "path"]


def _size(ids: bytes) -> int:
    return len(ids) // _ID.itemsize


def _chains(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(tokenizer, special_as_text=True)
        encode = lambda texts: [np.frombuffer(x, enc.dtype).astype(_ID) for x in enc.batch(texts)]
        types = [pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["path", "conv_id", "roles", "ids", "loss_starts", "loss_ends"]
        for batch in batches:
            rows = []
            rendered = [[render(t["role"], t["text"]) for t in turns] for turns in batch.column("turns").to_pylist()]
            encoded = iter(encode([text for parts in rendered for p in parts for text in p]))  # in one call: most texts are short
            for conv_id, turns, parts in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), rendered, strict=True):
                heads, bodies, ends = zip(*((next(encoded), next(encoded), next(encoded)) for _ in parts), strict=True)
                path = [hashlib.blake2b("".join(p).encode(), digest_size=16).hexdigest() for p in parts]
                starts = [len(h) for h in heads]
                stops = [len(h) + len(b) if t["role"] == "assistant" else len(h) for t, h, b in zip(turns, heads, bodies, strict=True)]
                rows.append((path, conv_id, [t["role"] for t in turns], [np.concatenate(x).tobytes() for x in zip(heads, bodies, ends, strict=True)], starts, stops))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _shared(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def prefix_tree(conversations: DataFrame, tokenizer: str, partitions: int | None = None) -> DataFrame:
    """Rows of kind "node" (a turn of the tree) and "leaf" (a conversation: the offsets of its nodes in ``path``)."""
    spark = conversations.sparkSession
    size = conversations.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("turns"))
    chains = _text.cut(whole.mapInArrow(_chains(tokenizer), SORTED))
    ordered = _text.cut(chains.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id"))

    found = sorted(ordered.select("path", "ids").mapInArrow(_edges, "part int, total long, first array<string>, heads array<int>, last array<string>, starts array<long>").collect(), key=lambda r: r.part)
    opening: dict[int, tuple[int, list[str], list[int]]] = {}
    base, path, offsets = 0, [], []
    for r in found:
        opening[r.part] = (base, path, offsets)
        shared = _shared(path, r["first"])
        again = sum(r.heads[:shared])  # tokens on the path already
        # a node still on the path of this partition's start was emitted before, the others in this partition
        offsets = [offsets[i] if i < shared and s == sum(r.heads[:i]) and r["last"][: i + 1] == r["first"][: i + 1] else base + s - again for i, s in enumerate(r.starts)]
        base, path = base + r.total - again, r["last"]
    start = spark.sparkContext.broadcast(opening)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at, last, offsets = start.value.get(part, (0, [], []))
        offsets = list(offsets)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = _shared(last, r["path"])
                del offsets[n:]
                position = sum(map(_size, r["ids"][:n]))
                attends: list[dict] = []
                for i in range(n):
                    _extend(attends, offsets[i], _size(r["ids"][i]))
                for i in range(n, len(r["path"])):
                    size = _size(r["ids"][i])
                    rows.append(("node", None, at, size, position, i, r["roles"][i], r["ids"][i], r["loss_starts"][i], r["loss_ends"][i], [dict(x) for x in attends], None))
                    _extend(attends, at, size)
                    offsets.append(at)
                    at, position = at + size, position + size
                rows.append(("leaf", r["conv_id"], None, position, None, len(r["path"]), None, None, None, None, [dict(x) for x in attends], list(offsets)))
                last = r["path"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TREE_TYPES, strict=True)], names=_TREE_NAMES)

    return ordered.mapInArrow(emit, TREE)


def _extend(intervals: list[dict], start: int, size: int) -> None:
    if intervals and intervals[-1]["end"] == start:
        intervals[-1]["end"] = start + size
    else:
        intervals.append({"start": start, "end": start + size})


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition taken alone: its new tokens, its first path with lengths, and its last path with the nodes' offsets."""
    from pyspark import TaskContext

    first: list[str] | None = None
    heads: list[int] = []
    last: list[str] = []
    starts: list[int] = []
    total = 0
    for batch in batches:
        for path, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if first is None:
                first, heads = path, [_size(x) for x in ids]
            n = _shared(last, path)
            del starts[n:]
            for x in ids[n:]:
                starts.append(total)
                total += _size(x)
            last = path
    if first is not None:
        names = ["part", "total", "first", "heads", "last", "starts"]
        types = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
        values = [TaskContext.get().partitionId(), total, first, heads, last, starts]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)


def read_back(tree: DataFrame) -> DataFrame:
    """Every conversation from the tree's rows: conv_id and its turns' ids with their mask's spans, in order.

    A node that very many conversations share is copied, and they are dealt to its copies; HOT_NODES rows at most are broadcast.
    """
    nodes = tree.filter(F.col("kind") == "node").select("node_offset", "ids", "loss_start", "loss_end")
    steps = tree.filter(F.col("kind") == "leaf").select("conv_id", F.posexplode("path").alias("step", "node_offset"))
    counted = steps.groupBy("node_offset").count().filter(F.col("count") > HOT_ROWS).orderBy(F.col("count").desc(), "node_offset").limit(HOT_NODES)
    hot = F.broadcast(counted.select("node_offset", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = steps.join(hot, "node_offset", "left").withColumn("copy", F.pmod(F.xxhash64("conv_id", "step"), copies).cast("int")).drop("copies")
    copied = nodes.join(hot, "node_offset", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return dealt.join(copied, ["node_offset", "copy"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("step", "ids", "loss_start", "loss_end"))).alias("steps"))


def digest(tree: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of query op9, from the tree's ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _bpe.encoder(tokenizer, special_as_text=True)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for conv_id, steps in zip(batch.column("conv_id").to_pylist(), batch.column("steps").to_pylist(), strict=True):
                ids = [np.frombuffer(s["ids"], _ID).tolist() for s in steps]
                whole = "".join(enc.decode(ids))
                turns = parse(whole)
                masked = "".join(map(unescape, enc.decode([x[s["loss_start"] : s["loss_end"]] for x, s in zip(ids, steps, strict=True)])))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(whole)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return read_back(_text.written(tree)).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
