import hashlib
import random

import pytest
from tokenizers import Tokenizer as Library

from seqforge.llm import bpe

ODD = ["", "a", "  two  spaces ", "tabs\tand\nlines\r\n", "it's we'll I'M", "naïve café ÄÖÜ ß", "漢字かな交じり文 한국어", "🙂👩‍👩‍👧 é", "123 4567 8,9", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "a" * 3000, "  x​", "\x00\x01\x7f", "!?!?…—"]


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(bpe.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_ids_and_text_as_the_library(library):
    own = bpe.Tokenizer(open(bpe.tokenizer_path(), encoding="utf-8").read())
    rnd = random.Random(3)
    letters = "abcdefghij '\n\t .,éß漢🙂0123<|endoftext|>"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(300)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert got.tolist() == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_frame(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(99, None, None), (99, "twice", "y"), (None, "twice", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, bpe.tokenizer_path()).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), bpe.tokenizer_path()).count() == 0


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "some text\n"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, bpe.tokenizer_path()), bpe.tokenizer_path()).collect()
    assert [(r["text"], r["decoded"]) for r in back] == [("some text\n", "some text\n"), (None, "")]
