import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import bpe
from quillmill.llm.common import joined

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
EXACT = bpe.merger(PATH)
WORDS = [w.encode() for w in dict.fromkeys(EXACT.words("the cat sat on the mat, the cats sit on mats. Grüße an alle! 123 1234"))]
CODEC = bpe.Codec(EXACT, bpe.Lexicon(bpe.compile_lexicon(WORDS, [EXACT.merge(w) for w in WORDS])))


def check(texts):
    ids, at = CODEC.encode(texts)
    for i, text in enumerate(texts):
        expected = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == expected
        assert CODEC.decode(ids[at[i] : at[i + 1]]) == TOKENIZER.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(texts):
    check(texts)


def test_hard_texts():
    check(["", " ", "the cat", "  \n\n\t x ", "a\x1cb \x85 c\xa0", "x²³½ Ⅷ", "<|endoftext|>the<|endoftext|><|endoftext|> cat", "a" * 70_000, "don't I'LL we've", "日本 👍🏽 é", "ab" * 30, " " * 3000 + "x"])
    check([])


def test_transducer_shares_suffixes():
    words = [p + s for p in (b"walk", b"talk", b"jump") for s in (b"", b"s", b"ed", b"ing")]
    arrays = bpe.compile_lexicon(words, [(i,) for i in range(len(words))])
    lexicon = bpe.Lexicon(arrays)
    ranks = lexicon.ranks(*joined([*sorted(words), b"wal", b"walke", b"walkings", b""]))
    assert ranks.tolist() == [*range(12), -1, -1, -1, -1]
    ids = [int(lexicon.ids[lexicon.at[r]]) for r in lexicon.ranks(*joined(words))]
    assert ids == list(range(12))
    assert len(arrays["final"]) < 20  # a trie would need more than 30


def test_file_round_trip(tmp_path):
    arrays = bpe.compile_lexicon(WORDS, [EXACT.merge(w) for w in WORDS])
    bpe.Lexicon.write(arrays, f"{tmp_path}/lexicon")
    mapped = bpe.Lexicon.map(f"{tmp_path}/lexicon")
    assert all((getattr(mapped, n) == arrays[n]).all() for n in bpe.Lexicon.NAMES)
    assert (mapped.ranks(*joined(WORDS)) >= 0).all()


def test_scan_and_heap_agree():
    for word in ("internationalization", "zzzzqqqq" * 5, "aaaaaaaaaaaaaaaaa", "é" * 9):
        ids = [EXACT.single[b] for b in word.encode()]
        assert EXACT._merge_scan(list(ids)) == EXACT._merge_heap(list(ids))


def test_documents(spark):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (1, "the cat sat"), (None, "no id"), (4, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, token_ids string")
    out = bpe.encode_decode(docs, PATH).collect()
    assert sorted(((r["doc_id"], r["decoded"]) for r in out), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    for r in out:
        assert r["token_ids"] == TOKENIZER.encode(r["decoded"], add_special_tokens=False).ids
    digests = {r["doc_id"]: r for r in bpe.encode_decode(docs, PATH, then=bpe.digest, schema=bpe.DIGESTS).collect()}
    import hashlib

    import numpy as np

    assert digests[1]["ids_sha256"] == hashlib.sha256(np.array(TOKENIZER.encode("the cat sat").ids, "<u4").tobytes()).hexdigest()
    assert digests[2]["n_tokens"] == 0 and digests[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Merger(P.path("word_bpe_49k.json"))
