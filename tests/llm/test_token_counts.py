"""Token counts against the tokenizer itself."""

import tracemalloc

import sentencepiece
from tokenizers import Tokenizer, models, normalizers

from clausework.llm.queries import VOCABULARY
from clausework.llm.token_counts import Counter, Vocabulary, read_vocabulary, token_counts

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b", "  a", "a ", "\n", "a\nb\n", "▁x", "x▁ ▁y", "日本語 テキスト", "😀😀 x", "\t x\t", "e" * 5000, "ß\x00ß"]


def tokenizer(pairs, unknown, byte_fallback):
    made = Tokenizer(models.Unigram(pairs, unknown, byte_fallback))
    made.normalizer = normalizers.Sequence([normalizers.Replace(" ", "▁"), normalizers.Prepend("▁")])
    return made


def test_against_the_tokenizer(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    exact = tokenizer([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, read_vocabulary(VOCABULARY)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(e) for e in exact.encode_batch(texts, add_special_tokens=False)]


def test_ties_and_pieces_across_words():
    pairs = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁", -1.0), ("b▁a", -2.5), ("ba", -2.0)]
    vocabulary = Vocabulary([p for p, _ in pairs], [s for _, s in pairs], False)
    assert not vocabulary.by_word
    exact = tokenizer([("<unk>", 0.0), *pairs], 0, False)
    counter = Counter(vocabulary)
    for text in ["ab", "aba", "abab", "ab ab", "b a", "xxab", "axxb x", "ba ba", "abba ab a"]:
        assert counter.text(text) == len(exact.encode(text, add_special_tokens=False)), text


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "in " * 50_000, 3), (2, "in " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = [(r.doc_id, r.n_tokens) for r in token_counts(docs, read_vocabulary(VOCABULARY)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0), (1, 0), (2, 50_001), (2, 50_001)], key=repr)
    assert token_counts(docs.limit(0), read_vocabulary(VOCABULARY)).collect() == []


def test_a_long_text_without_spaces_takes_little_memory():
    counter = Counter(read_vocabulary(VOCABULARY))
    text = "abcdefghij" * 30_000
    tracemalloc.start()
    n = counter.pieces(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 30_000 and peak < 8 * len(text)  # a copy of the text, no numbers per character
