"""The encoder with made-up vocabularies: ids above 65,535 and special tokens of any spelling."""

import json
import struct
import zlib

import pytest

from plumbline.llm import bpe, packing

SPECIALS = ["[PAD]", "<s>", "<s>x", "#"]
TEXTS = ["low lower <s>lowest<s>x [PAD]", "", None, "#low#", "lo[PAD", "<s><s>xx", "newest widest é 東 12", "low " * 50]


def vocabulary(path, gap):
    """Merges of a few words over the byte alphabet; ids from 256 on start at ``gap``."""
    given = json.load(open(bpe.default_vocabulary(), encoding="utf-8"))
    alphabet = bpe._byte_alphabet()
    tokens = [*alphabet, *(a + "</w>" for a in alphabet)]
    merges = []
    for word in ("low", "lower", "newest", "widest"):
        parts = [*word[:-1], word[-1] + "</w>"]
        while len(parts) > 1:
            merges.append([parts[0], parts[1]])
            parts[:2] = [parts[0] + parts[1]]
            tokens.append(parts[0])
    tokens = list(dict.fromkeys(tokens))
    vocab = {t: i if i < 256 else gap + i for i, t in enumerate(tokens)}
    top = gap + len(tokens)
    vocab |= {s: top + i for i, s in enumerate(SPECIALS)}
    given["model"] |= {"vocab": vocab, "merges": [list(m) for m in dict.fromkeys(map(tuple, merges))], "unk_token": None}
    given["added_tokens"] = [{"id": top + i, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, s in enumerate(SPECIALS)]
    given["post_processor"] = None
    path.write_text(json.dumps(given), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("gap", [300, 70_000])
def test_ids_equal_the_library(spark, tmp_path, gap):
    from tokenizers import Tokenizer

    path = vocabulary(tmp_path / "v.json", gap)
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert max(map(max, filter(None, want))) > gap
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_rows(docs, vocabulary=path).collect()}
    assert [list(got[i]) for i in range(len(TEXTS))] == want
    pieces = packing.pack(docs, window=16, vocabulary=path).collect()
    for i, ids in enumerate(want):
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == struct.pack(f"<{len(ids) + 1}I", *ids, 2)
        assert all(p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) for p in own)


def test_unknown_features_are_refused(tmp_path):
    path = vocabulary(tmp_path / "v.json", 300)
    spec = json.load(open(path, encoding="utf-8"))
    spec["model"]["ignore_merges"] = True
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Encoder(str(odd))
