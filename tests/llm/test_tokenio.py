import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from folioloom.llm import tokenio as K

from .helpers import LONG, clashing, docs, empty, odd

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "don't  we'll 12 34", "\u0301a b\u0301 e\u0301", "x\u00a0y\u2003z\x1cq\x85r", "<|endoftext|> <|startoftext|>x", "ΣΑΣ İı ﬁ ß", "🙂🙂 \u200d", "a\x0bb\x0cc\r\nd", "'s 'S it's\u2019s", "End. END, a.. 1. é. x.,", "İstanbul abc ǆabc ﬁn", "<|ENDOFTEXT|>. a<|endoftext|>, \u0130. ."]


def whole(texts, path=PATH):
    t = Tokenizer.from_file(path)
    return [[*e.ids, K.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    return [x.tolist() for ids, n in encoder.encode(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]


def test_pieces_encode_like_whole_texts(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encoder = K.WordEncoder(PATH)
    assert encoder.by_runs and encoder.kind == np.uint16
    assert encoded(encoder, texts) == whole(texts)
    assert encoded(encoder, [None, " ", "", " a  b "]) == whole([None, " ", "", " a  b "])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "changed", "wide"])
def test_other_tokenizers_get_whole_texts(tmp_path, name):
    path = str(tmp_path / "t.json")
    form = json.load(open(public_tokenizers.path("word_bpe_49k.json" if name == "changed" else "byte_bpe_50k.json")))
    if name == "changed":  # tokens may cross white space
        form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L} ]+|[^\\p{L} ]+"
    if name == "wide":
        form["added_tokens"].append(form["added_tokens"][0] | {"id": 70000, "content": "<|far|>"})
        form["model"]["vocab"]["<|far|>"] = 70000
    json.dump(form, open(path, "w"))
    encoder = K.WordEncoder(path)
    assert not encoder.by_runs and encoder.kind == (np.uint32 if name == "wide" else np.uint16)
    texts = [*ODD, "Two  words", "a <|far|> b"]
    assert encoded(encoder, texts) == whole(texts, path)
    if name == "wide":
        assert max(encoded(encoder, texts)[-1]) == 70000


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 3)
    monkeypatch.setattr(K, "CHUNK", 4)
    e, texts = K.WordEncoder(PATH), ["a b c", "d e", "a b c d e f", "f a. B", "z y x w v u", "a b"]
    assert [x for t in [texts, texts[::-1]] for x in encoded(e, t)] == whole(texts + texts[::-1])


def test_files_round_trip(tmp_path):
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "x" / "part.arrow")
    rng = np.random.default_rng(1)
    items = [(i if i != 3 else None, rng.integers(0, 49000, n).astype("<u2")) for i, n in enumerate([1, 5, 8, 16, 3, 40, 1, 1, 7])]
    some = [([i for i, _ in part], np.concatenate([x for _, x in part]), np.array([len(x) for _, x in part])) for part in (items[:4], items[4:])]
    assert K.write_file(fs, path, iter(some), 8, np.dtype("<u2"), rows=2) == (9, 82)
    assert [(i, x.tolist()) for i, x in K.read_file(fs, path)] == [(i, x.tolist()) for i, x in items]
    assert list(K.checked(fs, path)) == [(i, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in items]
    stream = np.concatenate([x for _, x in items])
    for i in range(11):
        ids, mask = K.sequence_at(path, i)
        own = stream[i * 8 : i * 8 + 8]
        assert len(ids) == 8 and (ids[: len(own)] == own).all() and mask.true_count == len(own)
        assert not ids.flags.owndata
    for i in (-1, 11, 1000):
        with pytest.raises(IndexError):
            K.sequence_at(path, i)
    opened = pa.memory_map(path)
    batch = pa.ipc.open_file(opened).get_batch(0)
    assert pa.types.is_fixed_size_list(batch.schema.field("ids").type)
    assert not [p for p in (tmp_path / "x").iterdir() if p.name != "part.arrow"]


def test_round_trip(spark):
    df = odd(spark)
    got = K.round_trip(clashing(df), PATH, length=16).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    start, want = 0, []
    for (doc_id, _), ids in zip(rows, whole([t for _, t in rows]), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert K.round_trip(empty(spark), PATH).count() == 0


def test_long_text(spark):
    (r,) = K.round_trip(docs(spark, [LONG]), PATH, length=128).collect()
    assert (r.start, r.n_tokens) == (0, len(whole([LONG])[0]))
