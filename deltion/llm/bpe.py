"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that its encoding ends with. A token that matches at the
end of the prefix is that one if and only if it is compatible with the last token of what lies before it: the merges
inside the two never give way to a merge across their border. So one pass over the word, with an automaton that
names all tokens ending at each position, stores the last token of every prefix, and the ids follow from the end by
the back-pointers. No merge queue, and time linear in the word however long it is.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from deltion.llm.shared import lean

# Fixed values of the tokenizer format.
END = "</w>"
SPACE = "[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xa0  -     　\p{L}\p{N}]+"

NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: Latin-1 where printable, else from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class WordBpe:
    """Tokenizer with word ends, read from a `tokenizers` JSON file (the vocabulary stays where it is)."""

    def __init__(self, path: str, cache_words: int = 150_000):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.names: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.bytes = {b: c for b, c in enumerate(byte_characters())}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), rank)
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = (a, b), rank
        # The word end becomes one more character, so that a token is a string and the automaton can match it.
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token in self.special:
                continue
            text = token.removesuffix(END) + "\0" if token.endswith(END) and token != END else token
            if self.whole(i):
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[bytes, int, str]] = {}
        self.cache_words = cache_words

    def border(self, left: int, right: int, before: int = NEVER) -> bool:
        """No merge across the border of the two tokens comes before one inside them, up to rank `before`.

        While the tokens grow, the left one shows a chain of right halves and the right one a chain of left halves.
        A pair of them meets until one of the two is merged further; the merge across wins if it is earlier than that
        of the left part and not later than that of the right part (of equal merges the leftmost comes first).
        """
        until_left = until_right = before
        while True:
            across = self.rank.get((left, right), NEVER)
            if across < until_left and across <= until_right and across < before:
                return False
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right or made_left == made_right:
                until_left, left = made_left, self.halves[left][1]
            else:
                until_right, right = made_right, self.halves[right][0]

    def whole(self, token: int) -> bool:
        """The token's own string is encoded as the token."""
        if token not in self.halves:
            return True
        left, right = self.halves[token]
        return self.whole(left) and self.whole(right) and self.border(left, right, self.made[token])

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.border(left, right)
        return known

    def word(self, characters: str) -> list[int]:
        """Ids of one word, given as byte characters."""
        text = characters + "\0"
        last: list[tuple[int, int] | None] = [None] * len(text)
        for end, (token, size) in self.automaton.iter(text):
            if last[end] is not None:
                continue
            start = end - size
            if start < 0:
                last[end] = (token, start)
            elif (before := last[start]) is not None and self.compatible(before[0], token):
                last[end] = (token, start)
        ids, at = [], len(text) - 1
        while at >= 0:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def piece(self, piece: str) -> tuple[bytes, int, str]:
        """Ids as little-endian 32-bit integers, their number, and the decoded piece."""
        known = self.cache.get(piece)
        if known is None:
            characters = "".join(map(self.bytes.__getitem__, piece.encode("utf-8", "replace")))
            ids = self.word(characters)
            known = (b"".join(i.to_bytes(4, "little") for i in ids), len(ids), " ".join(map(self.names.__getitem__, ids)))
            if len(piece) <= 64:
                if len(self.cache) >= self.cache_words:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def parts(self, text: str) -> Iterator[tuple[bytes, int, str]]:
        at = 0
        for found in self.split_special.finditer(text):
            yield from map(self.piece, self.pieces(text[at : found.start()]))
            token = self.special[found.group()]
            yield token.to_bytes(4, "little"), 1, found.group()
            at = found.end()
        yield from map(self.piece, self.pieces(text[at:]))

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Normalised (NFC, white space, lower case letter by letter) and cut into words, digits and signs."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return PIECE.findall(text.lower())

    def encode(self, text: str) -> tuple[bytes, int, str]:
        parts = list(self.parts(text))
        return b"".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def decode(self, ids) -> str:
        """Tokens joined by blanks, as the format has no decoder; special tokens are kept, unknown ids left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


PIECE = regex.compile(PIECES)


@functools.cache
def tokenizer(path: str) -> WordBpe:
    """One instance per Python worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns the id, n_tokens, ids_sha256, decoded_sha256 (of the ids as little-endian 32-bit integers and of the decoded
    text in UTF-8) and, if asked for, the `ids`. Null and empty texts have no ids and decode to the empty text;
    repeated rows and null ids are kept as they are; other columns are not read. A narrow step: no shuffle.
    """
    fields = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def work(batches):
        import numpy as np

        bpe = tokenizer(path)
        for batch in batches:
            counts, id_hashes, text_hashes, lists = [], [], [], []
            for text in batch.column(1):
                packed, n, decoded = bpe.encode(text.as_py() or "")
                counts.append(n)
                id_hashes.append(hashlib.sha256(packed).hexdigest())
                text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    lists.append(np.frombuffer(packed, "<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(lists, pa.list_(pa.int32()))] * ids, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return docs.select(id_column, text_column).mapInArrow(lean(work), fields)
