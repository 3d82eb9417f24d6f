import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from attestry.llm import _bpe
from attestry.llm import chat as C
from attestry.llm.queries import tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string, path string"


@given(st.lists(st.tuples(st.text("<s>/[INST]\\us\n", max_size=12), st.text("<s>/[INST]\\é|im_end<>\n", max_size=40)), max_size=5))
def test_round_trip(turns):
    assert C.parse("".join("".join(C.render(r, t)) for r, t in turns)) == turns
    assert not any(c in C.escape(t) for _, t in turns for c in C.CONTROL)


def test_very_long_turns():
    text = "<s>\\ word [/INST] " * 200_000
    assert C.parse("".join(C.render("assistant", text))) == [("assistant", text)]
    with pytest.raises(ValueError):
        C.parse("[INST]user[/INST]no end")


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    res = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        res[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), sum(len("".join(C.render(r, t))) for r, t in turns))
    return res


def sample():
    rows = []
    for c in range(60):
        rows.append((c, 0, "system" if c % 3 else "user", "shared start" if c % 4 else "other </s> start"))
        for t in range(1, 1 + c % 5):
            rows.append((c, t, "assistant" if t % 2 else "user", f"turn {t} of {c % 7} [/INST] é"))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (100, None, None, None), (100, 1, "assistant", "x" * 50000), (101, 5, "user", "a"), (101, 5, "user", "a"), (102, 0, "assistant", "")]
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_tree(spark, partitions):
    rows = sample()
    tree = C.prefix_tree(spark.createDataFrame([(*r, "c") for r in rows], SCHEMA), tokenizer_path(), partitions)
    got = tree.collect()
    nodes = {r.node_offset: r for r in got if r.kind == "node"}
    leaves = [r for r in got if r.kind == "leaf"]
    # every shared start is there once, and the walk has no gaps
    want = set()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        texts = tuple("".join(C.render(r[2] or "", r[3] or "")) for r in turns)
        want |= {texts[: i + 1] for i in range(len(texts))}
    assert len(nodes) == sum(r.kind == "node" for r in got) == len(want)
    at = 0
    for offset in sorted(nodes):
        assert offset == at
        at += nodes[offset].length
    whole = [i for o in sorted(nodes) for i in ids(nodes[o])]
    library = _bpe.Encoder(tokenizer_path(), special_as_text=True)
    assert library.decode([ids(n) for n in nodes.values()]) and all(n.length == len(ids(n)) for n in nodes.values())
    assert {tuple(library.decode([ids(nodes[o]) for o in leaf.path])) for leaf in leaves} <= want
    for leaf in leaves:
        by_path = [i for o in leaf.path for i in ids(nodes[o])]
        by_intervals = [i for x in leaf.attends for i in whole[x.start : x.end]]
        assert by_path == by_intervals and leaf.length == len(by_path)
        for k, o in enumerate(leaf.path):
            assert nodes[o].position == sum(nodes[p].length for p in leaf.path[:k]) and nodes[o].depth == k
            assert [i for x in nodes[o].attends for i in whole[x.start : x.end]] == [i for p in leaf.path[:k] for i in ids(nodes[p])]
    assert {r.conv_id: tuple(r)[1:] for r in C.digest(tree, tokenizer_path()).collect()} == expected(rows)


def ids(node):
    return np.frombuffer(node.ids, "<u4").tolist()


def test_shared_nodes_are_read_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 4)
    monkeypatch.setattr(C, "HOT_NODES", 2)
    rows = sample()
    tree = C.prefix_tree(spark.createDataFrame([(*r, "c") for r in rows], SCHEMA), tokenizer_path(), 3)
    assert {r.conv_id: tuple(r)[1:] for r in C.digest(tree, tokenizer_path()).collect()} == expected(rows)


def test_empty(spark):
    assert C.digest(C.prefix_tree(spark.createDataFrame([], SCHEMA), tokenizer_path()), tokenizer_path()).count() == 0
