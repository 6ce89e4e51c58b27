import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from graphloom.llm.trie_bpe import TrieBpe, encode_documents, op8_trie_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
library = Tokenizer.from_file(PATH)
mine = TrieBpe(PATH, max_words=50, max_pairs=50, max_states=50)


def same(texts):
    ids = mine.encode_batch(texts)
    for t, x in zip(texts, ids):
        assert x.tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]
        assert mine.decode(x.tolist()) == library.decode(x.tolist(), skip_special_tokens=False)


def test_texts():
    same(["", " ", "\n\n  \t", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "it's WE'LL 'd", "日本語 🎉 é́", "x" * 3000])
    same(["²³¼ Ⅷ ª º µ", "a\x85b\xa0c d\x1c e\x1f", "÷×", "\x00\x7f", "Ünïcödé ÀÖØöøÿ", "1234567 89", "---- ==== ++"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("abeilnot 's'\n!12", max_size=80), max_size=5))
def test_any_text(texts):
    same(texts)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = op8_trie_bpe(spark, SMALL).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(back))


def test_edge_cases(spark):
    rows = [(1, "a b", 1), (1, "a b", 1), (None, "c", 1), (2, None, 1), (3, "", 1), (4, "long word " * 50_000, 1)]
    found = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, token_ids int"), PATH).collect()
    assert [(r.doc_id, r.decoded) for r in found] == [(d, t or "") for d, t, _ in rows]
    assert [len(r.token_ids) for r in found[3:5]] == [0, 0]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(none, PATH).count() == 0


def test_invalid_bytes_decode_to_replacements():
    ids = library.encode("é", add_special_tokens=False).ids + [library.token_to_id("Ã")]
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    with pytest.raises(KeyError):
        mine.decode([99_999])


def test_words_that_come_again_are_not_walked_again():
    bpe, walked = TrieBpe(PATH, max_words=50), []
    walk = bpe.walk
    bpe.walk = lambda words: walk(walked.append(len(words)) or words)
    texts = [" ".join(f"wa{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(start, start + 60)) for start in (0, 30, 40)]
    for text in texts:  # each batch alone is more than the memo holds
        assert bpe.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert walked[0] == 60 and sum(walked[1:]) <= 45
    assert len(bpe.words) + len(bpe.older) <= 2 * (50 + 60)
