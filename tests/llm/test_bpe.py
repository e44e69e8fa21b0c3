import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from judgefuse.llm.bpe import Encoder, Vocabulary, digests, encode_text
from judgefuse.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(tokenizer_path())
with open(tokenizer_path(), encoding="utf-8") as f:
    ENCODER = Encoder(Vocabulary(json.load(f)))
ALPHABET = "ab cdeéÉü ñ'sStT!?.,<|>1 2²\n\t\x0b\x1c  ßΣσİ漢字🎉́e"


def encoded(text):
    rows = ENCODER.encode([text.encode()])[0]
    out = []
    for w in rows:
        raw = ENCODER.ids[w]
        out += [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60))
def test_equals_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert encoded(text) == ids
    assert ENCODER.vocab.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_every_code_point_equals_library():
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for low in range(0, len(points), 2000):  # letters, numbers, others and spaces beside each of them
        text = "".join(f"a{chr(c)}1 {chr(c)}! " for c in points[low:low + 2000])
        assert encoded(text) == LIBRARY.encode(text, add_special_tokens=False).ids, hex(points[low])
        ENCODER.reset()


@pytest.mark.parametrize("text", ["", " \n", "aaaaaaa aaa", "x<|endoftext|>y <|startoftext|><|endoftext|", "It's WE'LL",
                                  "ΑΣ ΣΑΣ", "hahahahahahaha", "a" * 5000])
def test_special_cases(text):
    assert encoded(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(spark, make_docs):
    texts = [None, "", "Hello world", "Hello world", "long " * 20000]
    df = make_docs([(i // 2, t) for i, t in enumerate(texts)]).withColumnRenamed("source", "Decoded")
    out = digests(encode_text(df, tokenizer_path()), "doc_id").collect()
    want = []
    for t in texts:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r)[1:] for r in out) == sorted(want)
    assert encode_text(df.limit(0), tokenizer_path()).count() == 0
