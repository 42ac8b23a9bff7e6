"""Pieces are looked up once a call and kept while they are in use; ids equal the library's where texts are cut before a tail."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from veridan.llm.common import Interned
from veridan.llm.token_files import Pieces, read_token_files, token_blocks, write_token_files

FILE = public_tokenizers.path("word_bpe_49k.json")


class Counted(Interned):
    lookups = 0

    def __getitem__(self, key):
        self.lookups += 1
        return super().__getitem__(key)


def test_one_lookup_for_each_distinct_piece():
    own, texts = Pieces(FILE), ["one two, three. " * 500, "three two one\n" * 300]
    own.index = Counted()
    ids = own.ids(texts)
    assert set(own.index) == {b"one", b"two", b"three", b",", b".", b""}  # Arrow finds an empty piece beside outer white space
    assert own.index.lookups == len(own.index)
    assert [i.tolist() for i in ids] == [e.ids for e in Tokenizer.from_file(FILE).encode_batch_fast(texts, add_special_tokens=False)]


def test_one_odd_full_stop_does_not_keep_the_others_in_their_words():
    own = Pieces(FILE)
    own.ids(["日. words, words.\nwords***", "\xe9t\xe9&&& \xc9t\xe9!"])
    assert {b"words", b".", b",", b"***", "\xe9t\xe9".encode()} <= set(own.index)
    assert not {b"words.", b"words,", b"words***"} & set(own.index)


def test_pieces_of_several_calls_are_kept():
    own = Pieces(FILE)
    own.limit = 3
    for text in ("often once", "often then", "last", "more words"):
        own.ids([text])
    assert set(own.index) == {b"often", b"last", b"more", b"words"}


def test_tails_and_rare_spaces_equal_the_library():
    own, library, rng = Pieces(FILE), Tokenizer.from_file(FILE), random.Random(7)
    letters = [*"aZ9\xc9\xdf\xf7\xd7\xaa\xff.,*#'<\xa7 \n\t\v\f\r\x1c\x1f\0", "\x85", "\xa0", " ", "́", "̸", ";", "ΐ", "а", "日", "\U0001f600"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(8000)]
    for t, ids, e in zip(texts, own.ids(texts, 1), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == [*e.ids, 1], repr(t)


def test_null_ids_and_texts_in_small_blocks(spark, tmp_path):
    rows = [(None, "no name."), (3, None), (1, ""), (2, "\v\xa0"), (2, "word. word")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    library = Tokenizer.from_file(FILE)
    want = sorted(([-1 if i is None else i, [*library.encode(t or "", add_special_tokens=False).ids, 1]] for i, t in rows), key=str)
    blocks = token_blocks(docs, FILE, block=2).collect()
    assert sorted(i if i is not None else -1 for b in blocks for i in b.doc_ids) == [-1, 1, 2, 2, 3]
    write_token_files(docs, f"{tmp_path}/files", FILE)
    got = read_token_files(spark, f"{tmp_path}/files").collect()
    assert sorted(([-1 if r.doc_id is None else r.doc_id, list(r.ids)] for r in got), key=str) == want
