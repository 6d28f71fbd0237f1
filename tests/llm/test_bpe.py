import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossier.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return bpe.vocabulary_of(file.read())


@pytest.fixture(scope="module")
def known():
    return Tokenizer.from_file(PATH)


def test_agrees_with_the_library(vocabulary, known):
    random.seed(1)
    pool = [chr(c) for c in range(0x250)] + list("中文日本語한국어абв😀👩‍👩 　​٣Ⅷ①̀\x1c\x85\xa0")
    texts = ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(500)]
    texts += ["".join(random.choices(" \n\ta'sreb1.,", k=random.randint(0, 40))) for _ in range(500)]
    texts += ["a<|endoftext|> b<|endoftext|>", "the" * 5000, "a" * 9000, " " * 3000 + "x", "=" * 2000, "".join(random.choices("abeilnorst", k=5000))]
    for text in texts:
        ids = bpe.encode(text, vocabulary).tolist()
        assert ids == known.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids, vocabulary) == known.decode(ids, skip_special_tokens=False)


def test_decoder_keeps_unfinished_characters(vocabulary, known):
    ids = bpe.encode("🙂漢字 é", vocabulary).tolist()
    decoder = bpe.Decoder(vocabulary)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == "🙂漢字 é"
    for cut in range(len(ids)):
        assert bpe.decode(ids[cut:], vocabulary) == known.decode(ids[cut:], skip_special_tokens=False)


class Small:
    """A vocabulary over two letters with merges drawn at random."""

    def __init__(self, draws):
        self.token_bytes = [b"a", b"b"]
        self.pairs, self.rank, self.byte_id = [], {}, [0] * 256
        self.byte_id[97], self.byte_id[98] = 0, 1
        for x, y in draws:
            a, b = x % len(self.token_bytes), y % len(self.token_bytes)
            made = self.token_bytes[a] + self.token_bytes[b]
            if made not in self.token_bytes and len(made) < 9:
                self.rank[a, b] = len(self.pairs)
                self.pairs.append((a, b, len(self.token_bytes)))
                self.token_bytes.append(made)
        self.product = [c for _, _, c in self.pairs]
        self.lookahead = bpe.sufficient_lookahead(self.pairs, self.token_bytes)
        self.buffer = 2 * self.lookahead + 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=12), st.text("ab", min_size=1, max_size=120), st.text("ab", max_size=40))
def test_lookahead_is_sufficient(draws, text, more):
    small = Small(draws)
    whole = lambda t: bpe.merged([small.byte_id[x] for x in t.encode()], small)
    ends = lambda tokens: [sum(len(small.token_bytes[t]) for t in tokens[: k + 1]) for k in range(len(tokens))]
    one, two = whole(text), whole(text + more)
    stable = [e for e in ends(one) if e <= len(text) - small.lookahead]
    assert [e for e in ends(two) if e <= len(text) - small.lookahead] == stable and one[: len(stable)] == two[: len(stable)]
    streamed = [t for part in bpe.stream_tokens([text.encode()[i : i + 3] for i in range(0, len(text), 3)], small) for t in part]
    assert streamed == one


def test_rows(table, odd_rows, vocabulary, known):
    made = bpe.encode_texts(table(odd_rows), PATH)
    rows = made.collect()
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"] and len(rows) == len(odd_rows)
    by = {}
    for (i, text), row in zip(odd_rows, sorted(rows, key=lambda r: 0), strict=True):
        by.setdefault(i, []).append(text or "")
    for row in rows:
        assert row.decoded in by[row.doc_id] and row.ids == known.encode(row.decoded, add_special_tokens=False).ids
        assert row.n_tokens == len(row.ids) and row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in row.ids)).hexdigest()
    assert bpe.encode_texts(table([]), PATH, outputs=()).collect() == []
