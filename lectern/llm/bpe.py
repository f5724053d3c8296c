"""Operator 7, BPE encoding and decoding with a backtracking encoder.

For each pre-token an Aho-Corasick pass finds the longest vocabulary token at every position. The
encoder goes left to right with the longest token that is compatible with the token before it (the two
side by side are what the merges give for their text), takes shorter prefixes where it is not, and
steps back where none is; a position once left is never entered again, so the work is linear. Decoding
cuts each token's text out of one block of bytes by an offset table.

The vocabulary file's path is a parameter; the supported kind is BPE with an end-of-word suffix over
byte-level characters, whose token ids follow the order of the merges. Edge cases: a null text is
empty and gives no tokens; special tokens in a text are matched as such; texts are encoded whole; repeated rows are
encoded one by one; an empty table gives an empty result; further columns stay, but one named as a result is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.messages import spread

END = "￿"  # stands for the end-of-word suffix; never a byte-level character
#: Words and pairs of tokens that a worker remembers; of a word, its ids alone.
CACHE = 1 << 17
#: Longer words are encoded anew each time, so that the cache stays small.
CACHED_CHARS = 48


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        form = lambda s: s.removesuffix(suffix) + END if s.endswith(suffix) else s
        self.ids = {form(s): i for s, i in vocab.items()}
        self.pair, self.parts = {}, {}
        for a, b in model["merges"]:
            i, j = vocab[a], vocab[b]
            self.pair[i, j] = k = vocab[a + b]
            self.parts[k] = (i, j)
        atoms = len(vocab) - len(self.parts)
        if sorted(self.parts) != list(range(atoms, len(vocab))):
            raise ValueError("token ids must follow the order of the merges")
        self.size = {i: len(s) for s, i in self.ids.items()}
        self.fits = lru_cache(CACHE)(self._fits)
        # A token that its own text's merges do not give can never be part of an encoding.
        usable = {s: i for s, i in self.ids.items() if i not in self.parts or self._sound(i)}
        self.tree = ahocorasick.Automaton()
        for s, i in usable.items():
            self.tree.add_word(s, (len(s), i))
        self.tree.make_automaton()
        self.shorter = {i: next((usable[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in usable), None) for s, i in usable.items()}
        # One block of UTF-8 and an offset table.
        names = [s for s, _ in sorted(vocab.items(), key=lambda x: x[1])]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names += [s for s, _ in sorted(self.special.items(), key=lambda x: x[1])]
        encoded, at = [s.encode() for s in names], [0]
        for b in encoded:
            at.append(at[-1] + len(b))
        self.block, self.offset = b"".join(encoded), at
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.wide = regex.compile(pattern).findall
        # For texts of ASCII alone the same pattern with its classes written out, where it has no others.
        plain = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.narrow = self.wide if "\\p" in plain or "(?" in plain else re.compile(plain, re.ASCII).findall
        self.chars = byte_chars()
        self.usable, self.decimal = usable, [str(i) for i in range(len(names))]
        self.short_word = lru_cache(CACHE)(self._word)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the text of tokens a and b side by side leaves just these two."""
        limit, parts = len(self.ids), self.parts
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                if a in parts:
                    a = parts[a][1]
                    continue
                limit = b + 1
                if b not in parts:
                    return True
                b = parts[b][0]
            else:
                limit = b + 1
                if b in parts:
                    b = parts[b][0]
                    continue
                limit = a
                if a not in parts:
                    return True
                a = parts[a][1]

    def _sound(self, i: int) -> bool:
        a, b = self.parts[i]
        # Its last merge joins a and b, so without that merge the two must stand side by side.
        del self.pair[a, b]
        sound = self._fits(a, b)
        self.pair[a, b] = i
        return sound

    def _word(self, word: str) -> tuple[int, ...]:
        # Letters, digits and marks of ASCII stand for themselves.
        text = (word if word.isascii() and word.isalnum() else "".join([self.chars[b] for b in word.encode()])) + END
        if (whole := self.usable.get(text)) is not None:
            return (whole,)
        n = len(text)
        best = [None] * n
        longest = [0] * n
        for end, (size, i) in self.tree.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1], best[end - size + 1] = size, i
        open_at = [True] * (n + 1)
        open_at[n - 1] = False  # the last character and the end of the word are one symbol
        out: list[int] = []
        pos, token = 0, best[0]
        while pos < n:
            last = out[-1] if out else None
            while token is not None:
                end = pos + self.size[token]
                if open_at[end] and (last is None or self.fits(last, token)):
                    break
                token = self.shorter[token]
            if token is None:
                open_at[pos] = False
                token = out.pop()
                pos -= self.size[token]
            else:
                out.append(token)
                pos = end
                token = best[pos] if pos < n else None
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        return self.short_word(word) if len(word) <= CACHED_CHARS else self._word(word)

    def pieces(self, text: str):
        """The words of one stretch without special tokens."""
        if text.isascii():
            return self.narrow(text.lower())
        # Case is folded character by character, so a final sigma is not special.
        return self.wide(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> tuple[list[int], str]:
        """Token ids, and the same in decimal joined by spaces."""
        ids = self.token_ids(text)
        return ids, " ".join([self.decimal[i] for i in ids])

    def token_ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self.pieces(part):
                ids += self.word(word)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The texts of the tokens joined by spaces, as UTF-8."""
        block, at = self.block, self.offset
        return b" ".join([block[at[i] : at[i + 1]] for i in ids])


@lru_cache(2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with ``token_ids``."""
    path = path or vocabulary()

    # A batch's texts stay in Arrow but for the one encoded, and its ids are one flat array: no lists of a whole batch.
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe, flat, ends = loaded(path), array("i"), array("i", [0])
        for t in texts:
            flat.extend(bpe.token_ids(t.as_py() or ""))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.asarray(ends)), pa.array(np.asarray(flat)))

    return docs.withColumn("token_ids", ids(F.col(text)))


def decode_ids(rows: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """rows with ``decoded``."""
    path = path or vocabulary()

    @F.pandas_udf("string")
    def decoded(seqs: pd.Series) -> pd.Series:
        bpe = loaded(path)
        return pd.Series([bpe.decode([] if s is None else list(s)).decode() for s in seqs])

    return rows.withColumn("decoded", decoded(F.col(ids)))


def digest_texts(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with ``bpe``: token count and digests of the ids and of the text decoded from them.

    Encoding, decoding and hashing share one pass, so no ids or decoded texts leave the worker.
    """
    path = path or vocabulary()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = loaded(path), []
        for t in texts:
            ids, names = bpe.encode(t or "")
            rows.append((len(ids), hashlib.sha256(names.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("bpe", digest(F.col(text)))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return digest_texts(docs).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
