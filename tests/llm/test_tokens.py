import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brasstide.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    model, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_what_the_library_gives(odd):
    rows = odd.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy("doc_id", "tie").collect()
    got = tokens.read(*tokens.write(odd, PATH))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute([(r.doc_id, r.text) for r in rows])


def test_documents(documents):
    rows = documents.orderBy("doc_id").collect()
    got = tokens.read(*tokens.write(documents.repartition(5), PATH)).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute([(r.doc_id, r.text) for r in rows])


def test_files_in_a_given_order(documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    folder, manifest = tokens.write(documents, PATH, order=-F.col("doc_id"))
    got = tokens.read(folder, manifest).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute([(r.doc_id, r.text) for r in rows])


def test_empty_table(nothing):
    assert tokens.read(*tokens.write(nothing, PATH)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", " a", "a ", "a\n b", "a \nb", "don't  stop now ", "x<|endoftext|> y", "\x00 z", "1 2 a1 !? 　k"])
def test_cutting_at_spaces_changes_no_id(text):
    model = tokens.encoder(PATH)
    plain = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(model.encode([text])[0], dtype="<u2").tolist() == plain


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    model = tokens.Encoder(PATH)
    texts = [f"some {i} words {i * 7} here" for i in range(20)]
    plain = Tokenizer.from_file(PATH)
    for t in texts:
        assert np.frombuffer(model.encode([t])[0], dtype="<u2").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(model.known) <= 10
