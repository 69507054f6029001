"""Token ids of whole texts by a public tokenizer file, through a cache of white-space separated chunks."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

#: Chunks whose ids a Python worker keeps (about 25 MB, 70 MB at most), and bytes of one; what comes later, and longer ones,
#: are encoded each time.
CACHE, CACHED_BYTES = 120_000, 100
#: A longer text is split and encoded in runs of about so many bytes.
RUN_BYTES = 1 << 20
#: The characters that stand for bytes which are no printable Latin-1 character, in the order of these bytes.
UNPRINTABLE = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_CHARACTERS = {b: chr(256 + k) for k, b in enumerate(UNPRINTABLE)}

#: Letters, perhaps beyond ASCII, and then ASCII punctuation without apostrophes, which may begin a token with letters, and "<".
PARTED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:;=-@\[-`{-~]+)")
#: The first character after the Latin letters that this module treats by itself.
LATIN_END = "\u0250"
#: What a tokenizer file must declare for chunks to be encoded by themselves (fixed values); texts go whole to any other.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


@lru_cache(4)
def _tokenizer(path: str | None):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
    said = json.loads(tokenizer.to_str())
    return tokenizer, {}, said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """The chunks of text, in runs cut at white space."""
    while len(text) > RUN_BYTES:
        at = next((k for k in range(RUN_BYTES, len(text)) if text[k] in b" \t\n\r\x0b\x0c"), len(text))
        yield text[:at].split()
        text = text[at:]
    yield text.split()


def encoded(texts: list[str | None], path: str | None = None) -> list[bytes]:
    """The ids of each text (null: none) as little-endian unsigned 32-bit numbers, without special tokens around it.

    A tokenizer that drops white space and never joins what stands on two sides of it gives a text the ids of its chunks
    in order; chunks come back often and are encoded once. Other tokenizers get whole texts.
    """
    tokenizer, cache, by_chunks = _tokenizer(path)
    if not by_chunks:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    pieces = [list(_runs(_lowered(t.encode()))) if t else [] for t in texts]
    new = set().union(*(run for runs in pieces for run in runs)).difference(cache)
    # punctuation after letters is a token of its own, whatever the letters
    parted = {c: m.groups() for c in new if (m := PARTED.fullmatch(c)) and _plain_word(m[1].decode())}
    added = list(new.difference(parted).union(*parted.values()).difference(cache))
    cache.update(zip(added, _encoded_chunks(tokenizer, added), strict=True))
    cache.update({c: cache[word] + cache[end] for c, (word, end) in parted.items()})
    out = [b"".join([b"".join(map(cache.__getitem__, run)) for run in runs]) for runs in pieces]
    full = len(cache) > CACHE
    for chunk in (*added, *parted):
        if full or len(chunk) > CACHED_BYTES:
            cache.pop(chunk, None)
    return out


def _plain_word(word: str) -> bool:
    """Only letters, of the Latin blocks: such a word is one pre-token, and stays one beside punctuation.

    The dotted capital I is not meant: lower-cased, it ends with a mark that is no letter.
    """
    return word.isascii() or (word.isalpha() and max(word) < LATIN_END and "\u0130" not in word)


def _lowered(text: bytes) -> bytes:
    """A-Z lower-cased, as the tokenizer does; texts that may hold a special token, whose case counts, stay."""
    return text if b"<|" in text else text.lower()


def _encoded_chunks(tokenizer, chunks: list[bytes]) -> list[bytes]:
    """The ids of each chunk. Words of Latin letters alone are one pre-token and go straight to the tokenizer's model."""
    out: list[bytes] = []
    tokenize, rest = tokenizer.model.tokenize, []
    for chunk in chunks:
        if chunk.isalpha():
            word = chunk.decode().lower()  # texts that may hold a special token come as they are
        else:
            word = unicodedata.normalize("NFC", chunk.decode()).lower()
            if not (word.isalpha() and max(word) < LATIN_END):
                rest.append(len(out))
                out.append(b"")
                continue
            word = word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        out.append(array("I", [t.id for t in tokenize(word)]).tobytes())
    for k, e in zip(rest, tokenizer.encode_batch_fast([chunks[k].decode() for k in rest], add_special_tokens=False), strict=True):
        out[k] = array("I", e.ids).tobytes()
    return out


def grouped(texts, most: int = RUN_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) for runs of an Arrow column of about ``most`` bytes, so that little is expanded at a time."""
    first, run, held = 0, [], 0
    for k, text in enumerate(texts):
        run.append(text.as_py())
        held += len(run[-1] or "")
        if held >= most:
            yield first, run
            first, run, held = k + 1, [], 0
    if run:
        yield first, run
