"""op6, op8: pieces of texts encoded once per worker."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from annolens.llm import varint_ids
from annolens.llm._chunks import ChunkEncoder, encode_together

TEXT = "word word, été été, Été. x\nword  two-three don't 12 word;; ſtrange été! ünd so ÿ, " + "y" * 80 + ", end "


def test_a_word_is_encoded_once_and_kept_in_one_table():
    made = []

    def pretoken(match):
        made.append(match)
        return match.encode()

    encoder = ChunkEncoder(P.PATTERN, pretoken)
    for text in ("the word word, été, été", "a word. été;"):
        assert encoder.encode(text) == text.encode()
    assert made.count(" word") == made.count(" été") == 1
    assert {"word", "été"} <= set(encoder) and not any(t[1:] in encoder for t in encoder.tokens)


def test_ids_are_those_of_the_library():
    whole, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), varint_ids.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in (TEXT, TEXT.upper(), " " + TEXT, TEXT[::-1], "", " ", "\n", "\x00\x7f \x80", "漢字, 漢字 🙂!"):
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in whole.encode(text, add_special_tokens=False).ids)


def test_texts_together_have_each_match_encoded_once():
    made = []

    def encode(matches):
        made.extend(matches.to_pylist())
        return np.concatenate([np.frombuffer(m.encode(), np.uint8) for m in made]), np.array([len(m.encode()) for m in made])

    texts = ["the word word, été, été", "", " a  word. été;\n", "the word", TEXT, "\u3000 x", "y" * 80]
    ids, sizes = encode_together(pa.array(texts), regex.compile(P.PATTERN).findall, encode)
    assert ids.tobytes().decode() == "".join(texts) and sizes.tolist() == [len(t.encode()) for t in texts]
    assert len(made) == len(set(made)) and {" word", " été", "the"} <= set(made)


def test_ids_of_texts_together_are_those_of_the_library():
    whole, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), varint_ids.encoder(P.path("byte_bpe_50k.json"), P.PATTERN).encode
    texts = [TEXT, None, TEXT.upper(), "", " ", "a<|endoftext|>b  c", TEXT[::-1], "two  spaces", "\x1c \x85\xa0 x\x00\x7f \x80", "漢字, 漢字 🙂! it's 'tis", " \n lines \n\n end\n"]
    for some in (texts, texts[:0], texts[1:2], texts[5:6]):
        ids, sizes = encode(pa.array(some, pa.string()))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in some]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == list(map(len, want))
