import random
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from attestry.llm import _bpe, pack, token_count
from attestry.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n_tokens string, sequence_id string"
HARD = [
    "",
    None,
    " ",
    "  ",
    "a  b   c\n  d \n e\t f ",
    "it's we'll 'tis  's x ' y",
    "end <|endoftext|> more<|endoftext|>x \n<|endoftext|> \n <|endoftext|>",
    "naïve Éréier 漢字   nbsp em \u0085 x \x1c y",
    "x" * 5000,
    "word " * 3000,
    "tail spaces   ",
    "\n\n a",
    "num 123 4567 8,9",
]


LIBRARY = Tokenizer.from_file(tokenizer_path())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (64, 8), (200, 16)])
def test_ids_equal_the_library(chunk, overlap):
    enc = _bpe.Encoder(tokenizer_path(), chunk, overlap)
    texts = [t or "" for t in HARD] + [" ".join(t or "" for t in HARD if len(t or "") < 4000)]
    for _ in range(2):
        for text, raw in zip(texts, enc.batch(texts), strict=True):
            assert np.frombuffer(raw, enc.dtype).tolist() == library_ids(text), text[:60]


def test_overlap_is_widened_without_a_boundary():
    enc = _bpe.Encoder(tokenizer_path(), 64, 8)
    text = "x" * 1000 + " then words " * 20
    assert np.frombuffer(enc.batch([text])[0], enc.dtype).tolist() == library_ids(text)
    assert enc.widened > 0 and enc.spliced > 0


def test_overlap_is_widened_where_its_encodings_differ():
    """A run of letters longer than the overlap is read otherwise from its middle: ids differ, and no word starts alike."""
    enc = _bpe.Encoder(tokenizer_path(), 100, 10)
    text = "lead words " * 8 + "abcdefghij" * 5 + " tail words" * 30
    left, right = enc._spans(text, 0, 100), enc._spans(text, 93, 193)
    assert left.ids[left.between(93, 100)].tolist() != right.ids[right.between(93, 100)].tolist()
    assert np.frombuffer(enc.batch([text])[0], enc.dtype).tolist() == library_ids(text)
    assert enc.widened > 0


def test_huge_texts_against_the_library():
    rng = random.Random(3)
    kinds = ["word", "Wörter", "漢字", "x" * 40, "12345", "...", "''s", "<|endoftext|>", "<|endof", "it's", "\u0085", "e\u0301"]
    gaps = [" ", "  ", "\n", " \n\n ", "", "\t", " " * 70]
    for chunk, overlap in ((60, 4), (150, 30), (1000, 100)):
        enc = _bpe.Encoder(tokenizer_path(), chunk, overlap)
        for _ in range(60):
            text = "".join(rng.choice(kinds) + rng.choice(gaps) for _ in range(rng.randint(20, 400)))
            assert np.frombuffer(enc.batch([text])[0], enc.dtype).tolist() == library_ids(text), text
        assert enc.spliced > 0


def test_proposals_are_proven_by_pairs():
    rng = random.Random(5)
    enc = _bpe.Encoder(tokenizer_path())
    letters = "abcdefghijklmnopqrstuvwxyzABCéüß0123456789.,;:'!?-\n"
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    pieces = [p for p in pieces if not p[0].isspace()]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc._spaced(pieces)] == [library_ids(" " + p) for p in pieces]
    assert any(enc.pairs.values()) and not all(enc.pairs.values())
    proposals = [enc.ranked.encode_ordinary(" the"), enc.ranked.encode_ordinary(" ") + enc.ranked.encode_ordinary("the"), enc.ranked.encode_ordinary(" it")]
    ids = np.array([i for p in proposals for i in p], np.uint32)
    assert enc._proven(ids, np.cumsum([0, *map(len, proposals)])[:-1]).tolist() == [True, False, True]


def test_known_pieces_are_no_python_objects():
    """Two or more objects for each piece made most of the packing's time."""
    rng = random.Random(11)
    parts = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 4))) for _ in range(30)]
    words = [a + b + c for a in parts for b in parts for c in parts]
    enc = _bpe.Encoder(tokenizer_path())
    enc.batch([" ".join(words[:100])])
    before = sys.getallocatedblocks()
    raw = enc.batch([" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)])
    assert sys.getallocatedblocks() - before < len(set(words)) / 2
    assert [np.frombuffer(x, enc.dtype).tolist() for x in raw] == [library_ids(" ".join(words[k : k + 5000])) for k in range(0, len(words), 5000)]


@pytest.mark.parametrize("entries,named", [(1 << 20, 1 << 20), (300, 1 << 20), (1 << 20, 200)])
def test_pieces_of_every_length_and_kind(monkeypatch, entries, named):
    """Keys end at 23 bytes; zero bytes, joined pieces and pieces too long to keep, while the cache is emptied again and again."""
    monkeypatch.setattr(_bpe, "MAX_ENTRIES", entries)
    monkeypatch.setattr(_bpe, "MAX_NAMED", named)
    rng = random.Random(7)
    kinds = ["a", "a\0", "a\0\0", "\0", "", "é", "×", "÷", "Àÿ", "漢字", "\n", "x\n", "\u0085y", "\u00a0", "\u3000z", "\x1cq", "<|endoftext|>", "<|endof", "a<|b", "a|<", "it's", "\ufffd", "😀"]
    enc = _bpe.Encoder(tokenizer_path())
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 12)):
            words = [rng.choice([rng.choice(kinds), "".join(rng.choice("abé") for _ in range(rng.randint(5, 26))), rng.choice("ab漢") * rng.choice([21, 22, 23, 24, 25, 85, 256, 257])]) for _ in range(rng.randint(0, 30))]
            texts.append(" ".join(words))
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.batch(texts)] == [library_ids(t) for t in texts]
    assert (enc.store.n < 600) == (entries == 300 or named == 200)  # emptied only where a bound is near


def test_store_tells_colliding_keys_apart(monkeypatch):
    monkeypatch.setattr(_bpe.Store, "_ODD", np.array([1 << 62, 1 << 62, 1 << 62], np.uint64))
    store = _bpe.Store(np.dtype("<u2"), 4)
    pieces = [b"", b"\0", *(f"{k:x}".encode() for k in range(300))]
    lengths = np.array([len(p) for p in pieces])
    keys = store.keys_of(np.frombuffer(b"".join(pieces) + bytes(24), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert not store.find(keys).any()
    added = np.concatenate([store.add(np.array([k], np.uint16), np.array([1]), [x[k : k + 1] for x in keys]) for k in range(len(pieces))])
    assert store.find(keys).tolist() == added.tolist() == list(range(1, len(pieces) + 1))
    assert store.flat[store.at[added]].tolist() == list(range(len(pieces)))


def test_texts_as_arrays():
    enc = _bpe.Encoder(tokenizer_path(), 64, 8)
    for texts in ([t or "" for t in HARD], ["one two", "", "three  four "], [""], []):
        raw = [t.encode() for t in texts]
        ids, places = enc.arrays(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [library_ids(t) for t in texts]


def test_other_files_get_whole_texts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("word_bpe_49k.json")
    library, enc = Tokenizer.from_file(path), _bpe.Encoder(path, 64, 8)
    texts = [t or "" for t in HARD]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, enc = sentencepiece.SentencePieceProcessor(model_file=path), _bpe.Encoder(path)
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.batch(texts)] == [model.encode(t) for t in texts]


def test_counts(spark):
    rows = [(i, t, "clash", "c") for i, t in enumerate(HARD)] * 2
    got = token_count.token_counts(spark.createDataFrame(rows, SCHEMA), tokenizer_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(library_ids(r.text)) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert token_count.token_counts(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def check_pieces(rows, texts, sequence=1024):
    ids = {i: [*library_ids(t), 0] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence
        padded += 0 if at & (at - 1) == 0 else sequence - at
    assert padded == 0


def test_pack(spark):
    texts = dict(enumerate(HARD))
    rows = [(i, t, "clash", "c") for i, t in texts.items()]
    check_pieces(pack.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), partitions=3).collect(), texts)
    assert pack.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_repeated_rows_are_each_packed(spark):
    rows = [(1, "same text here", "", "")] * 5
    got = pack.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path()).collect()
    assert sum(r.length for r in got) == 5 * (len(library_ids("same text here")) + 1)


def test_hilbert_is_a_curve():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = pack.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_packing_keeps_likeness(spark):
    a, b = "red green blue yellow colour " * 30, "one two three four number " * 30
    rows = [(i, (a if i % 2 else b) + f" {i}", "", "") for i in range(40)]
    got = pack.pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), partitions=1).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r.doc_id % 2 for r in got))
    flips = sum(x.doc_id % 2 != y.doc_id % 2 for x, y in zip(got, got[1:]))
    assert len(order) == 2 and flips <= 6
