import hashlib
import random
import subprocess
import sys

import pytest
from tokenizers import Tokenizer

from burnish.llm.bpe import Encoder, Kept, Vocabulary, encoded, encoded_digests
from burnish.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(vocabulary_path()))


def same(encoder, library, text):
    n, ids, decoded = encoder.encode(text)
    wanted = library.encode(text, add_special_tokens=False).ids
    return (n, ids, decoded) == (len(wanted), " ".join(map(str, wanted)), library.decode(wanted, skip_special_tokens=False))


@pytest.mark.parametrize(
    "text",
    [
        "",
        "  ",
        "Hello, World! don't I'LL we've 12 345",
        "a<|endoftext|>b<|startoftext|><|endoftext|>",
        "<|endoftext|",
        "aaaaaaaaaaaaaaaaaaaaaaa",
        "x\x1cy\x1dz\x01 \x7f",
        "İstanbul ΑΣΣ ΌΣ. ß ﬁ é ̈́",
        "日本語テキスト 😀😀    x　y",
        "'s 'S ''s 're'",
        "é" * 3000,
    ],
)
def test_same_as_the_library(encoder, library, text):
    assert same(encoder, library, text)


def test_random_texts(encoder, library):
    draw = random.Random(5)
    letters = [chr(c) for c in [*range(32, 127), *range(0xA1, 0x180), 9, 10, 0x391, 0x3A3, 0x2028, 0x4E2D, 0x1F600]]
    for _ in range(400):
        assert same(encoder, library, "".join(draw.choices(letters, k=draw.randint(0, 60))))


def test_documents(encoder, library, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encoded(docs, vocabulary_path()).collect():
        assert r["ids"] == " ".join(map(str, library.encode(texts[r["doc_id"]], add_special_tokens=False).ids))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = encoded_digests(odd_docs, vocabulary_path()).collect()
    assert len(rows) == 9
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (2, 3, 5)} == {(0, empty, empty)}
    assert len([r for r in rows if r["doc_id"] == 1]) == 2
    assert encoded_digests(no_docs, vocabulary_path()).count() == 0


def test_what_a_worker_keeps_is_bounded_in_bytes(encoder):
    kept = Kept(100_000)
    for n in range(3000):
        text = "ä" * (n % 200) + str(n)
        assert kept.get(text, lambda t: (t, t * 2, 1)) == (text, text * 2, 1)
        assert kept.get(text, lambda t: (t, t * 2, 1)) == (text, text * 2, 1)
    for generation in (kept.young, kept.old):
        assert sum(300 + 4 * len(t) for t in generation) < 110_000 and max(map(len, generation)) <= 64


def test_many_long_pieces_do_not_pile_up():
    code = """
import random, resource
from burnish.llm.bpe import Encoder, Vocabulary
from burnish.llm.queries import vocabulary_path
encoder, draw = Encoder(Vocabulary(vocabulary_path())), random.Random(1)
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for n in range(1500):
    encoder.encode("".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=20_000)))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(run.stdout) < 450, run.stdout
