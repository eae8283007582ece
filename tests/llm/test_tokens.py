"""Token counts, piece encoding and token files against plain loops and the public libraries."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cautela.llm.common import table, utf8, vocabulary_file, word_bounds
from cautela.llm.queries import BYTE_BPE, PIECE_BPE
from cautela.llm.sentence_pieces import PieceDecoder, PieceEncoder, decode_pieces, encode_pieces
from cautela.llm.token_counts import Automaton, byte_level_automaton, byte_level_vocabulary, count_tokens
from cautela.llm.token_files import WordEncoder, read_token_files, token_index, write_token_files


def greedy(word, initial, inner):
    count = at = 0
    while at < len(word):
        pieces = inner if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, count = end, count + 1
    return count


@pytest.mark.parametrize("seed", range(40))
def test_automaton_counts_like_greedy_matching(seed):
    pick = random.Random(seed)
    word = lambda most: bytes(pick.choice(b"abc") for _ in range(pick.randint(1, most)))
    initial, inner = ({word(5) for _ in range(pick.randint(1, 12))} for _ in range(2))
    words = [word(14) for _ in range(80)]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = Automaton(initial, inner).count(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    assert found.tolist() == [greedy(w, initial, inner) for w in words]


def test_automaton_with_one_byte_and_long_words():
    long = b"a" * 5_000
    found = Automaton({b"a", b"aaa"}).count(np.frombuffer(long, np.uint8), np.array([0]), np.array([5_000]))
    assert found.tolist() == [5_000 // 3 + 5_000 % 3]


def test_token_counts(spark, sf, odd, none):
    pieces = set(byte_level_vocabulary(BYTE_BPE))
    documents = table(spark, sf, "documents")
    counts = {r.doc_id: r for r in count_tokens(documents, BYTE_BPE).collect()}
    rows = documents.collect()
    assert len(counts) == len(rows)
    for r in rows[:40]:
        words = [b" " + w for w in r.text.encode().split()]
        assert counts[r.doc_id].n_words == len(words)
        assert counts[r.doc_id].n_tokens == sum(greedy(w, pieces, pieces) for w in words)
    found = count_tokens(odd, BYTE_BPE, keep=("doc_id", "row")).collect()
    assert len(found) == odd.count() and found[3].n_tokens == 0 == found[4].n_tokens == found[13].n_words
    assert found[5] == found[6] and found[5].row == "r"
    assert count_tokens(none, BYTE_BPE).count() == 0
    assert byte_level_automaton(BYTE_BPE).tail[0] == 0


def test_words_end_where_texts_end():
    import pyarrow as pa

    data, offsets = utf8(pa.array(["ab", "cd e", None, " ", "f"]))
    starts, ends, rows = word_bounds(data, offsets)
    assert [(bytes(data[a:b]), r) for a, b, r in zip(starts, ends, rows, strict=True)] == [
        (b"ab", 0), (b"cd", 1), (b"e", 1), (b"f", 4),
    ]


PARTS = [" ", "  ", "\n", "\t", "a", "bc", "1", ".", "'s", "é", "▁", "<s>", "\x00", "😀", "①", " the", "中", "　", "‍", " word,"]


def mixtures(n):
    pick = random.Random(n)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 12))) for _ in range(n)]
    return texts + ["", " " * 17 + "a" + " " * 9, "ab" * 700, "a" * 3_000]


def test_word_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(vocabulary_file(BYTE_BPE))
    texts = mixtures(1_500) + ["<|endoftext|> x", "abc <|endoftext|> def\na<|endoftext|>b", "one two\nthree, four."]
    expected = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = WordEncoder(BYTE_BPE)
    assert encoder.encode(texts) == expected and encoder.encode(texts) == expected


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    pick = random.Random(3)
    texts = [" ".join("".join(pick.choice("abcdef") for _ in range(6)) for _ in range(20)) for _ in range(300)]
    encoder = WordEncoder(BYTE_BPE)
    expected = encoder.encode(texts)
    monkeypatch.setattr(WordEncoder, "most", 20_000)
    small = WordEncoder(BYTE_BPE)
    for start in range(0, len(texts), 20):
        assert small.encode(texts[start : start + 20]) == expected[start : start + 20]
    assert small.held < 150_000 and 2 * (len(small.known) + len(small.older)) < len(encoder.known)


def test_words_and_their_marks_are_encoded_once_each():
    import pyarrow as pa

    pick = random.Random(7)
    parts = ["ab", "don't", "x's,", "fo\"o.)", "(bar)", "a1b2", "é,", "né's", "ab%%%", "'sa", "'", "A-Z", "zé1", "中a.", "a。b"]
    texts = [pick.choice([" ", "\n"]).join(pick.choices(parts, k=pick.randint(1, 9))) for _ in range(400)]
    texts += ["", "a  b", " xy", "<|endoftext|>ab"]
    encoder, tokenizer = WordEncoder(BYTE_BPE), Tokenizer.from_file(vocabulary_file(BYTE_BPE))
    ids, counts = encoder.column_ids(pa.array([None, *texts])[1:])
    expected = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]
    assert " ab" in encoder.known and "%%%" in encoder.known and not {" ab%%%", "ab%%%", "a  b"} & encoder.known.keys()


def test_piece_encoder_equals_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(PIECE_BPE))
    encoder, texts = PieceEncoder(PIECE_BPE), mixtures(1_500)
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert found == model.encode(texts)
    decoder = PieceDecoder(PIECE_BPE)
    assert [decoder.decode(x) for x in found] == [model.decode(x) for x in found]


def test_pieces_of_tables(spark, sf, odd, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(PIECE_BPE))
    for r in encode_pieces(table(spark, sf, "documents"), PIECE_BPE).collect():
        assert r.piece_ids == model.encode(r.text)
    found = decode_pieces(encode_pieces(odd, PIECE_BPE), PIECE_BPE)
    assert found.columns == [*odd.columns, "piece_ids", "decoded"]
    assert sorted(map(str, encode_pieces(odd, PIECE_BPE, decoded="decoded").collect())) == sorted(map(str, found.collect()))
    with pytest.raises(ValueError, match="named like"):
        encode_pieces(found, PIECE_BPE)
    rows = found.collect()
    assert [r.decoded for r in rows] == [r.text for r in rows] and rows[3].piece_ids == [] and rows[4].piece_ids is None
    assert encode_pieces(none, PIECE_BPE).count() == 0


def test_token_files_round_trip(spark, sf, odd, none, tmp_path):
    tokenizer = Tokenizer.from_file(vocabulary_file(BYTE_BPE))
    documents, path = table(spark, sf, "documents"), str(tmp_path / "ids")
    write_token_files(documents, path, BYTE_BPE)
    index, stored = {r.doc_id: r for r in token_index(spark, path).collect()}, read_token_files(spark, path)
    start = 0
    for r in documents.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        found = index[r.doc_id]
        assert (found.start, found.n_tokens) == (start, len(ids))
        assert found.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert stored.filter("doc_id = 17").count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in stored.filter("doc_id = 17")._jdf.queryExecution().toString()
    assert [r.doc_id for r in stored.orderBy("seq").collect()] == sorted(index)

    write_token_files(odd, str(tmp_path / "odd"), BYTE_BPE)
    found = token_index(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(found) == odd.count() and [r.doc_id for r in found[:2]] == [None, None]
    assert {r.doc_id: r.n_tokens for r in found}[4] == 1 == {r.doc_id: r.n_tokens for r in found}[5]
    write_token_files(none, str(tmp_path / "none"), BYTE_BPE)
    assert token_index(spark, str(tmp_path / "none")).count() == 0
