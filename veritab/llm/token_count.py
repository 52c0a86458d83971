"""Token counts of whole texts: pre-tokens that are a vocabulary string of their own count at once, the rest is merged."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritab.llm.bpe import byte_alphabet
from veritab.llm.common import Kept, texts_of

#: Letters, digits and white space below U+0180, where no Unicode version moved a character between these classes.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
_WHITE = "\t-\r \u0085 "
#: The byte-level vocabularies' pre-tokens in texts without characters from U+0180 on.
_PRE_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_WHITE}{_LETTERS}{_DIGITS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: A single space between two printable ASCII characters always begins a pre-token.
_CUT = re.compile("(?<=[!-~])(?= [!-~])")
#: Longer pre-tokens and pieces are not kept.
LONG = 256


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, as text, that merging alone turns into exactly one token: the proof made before any text is read.

    Strings that are no valid UTF-8 can't be a pre-token and are left out. At most as many strings as the vocabulary has.
    """
    model = Tokenizer.from_file(path).model
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    found = set()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    for shown, i in vocab.items():
        try:
            text = bytes([byte_of[c] for c in shown]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if [t.id for t in model.tokenize(shown)] == [i]:
            found.add(text)
    return frozenset(found)


class TokenCounter:
    """Counts equal to len(encode(text, add_special_tokens=False).ids) of the library, truncation and padding unused."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without a normalizer are counted this way")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.whole = whole
        self.merged, self.foreign = Kept(most), Kept(most)

    def _merge(self, word: str) -> int:
        """Tokens of a pre-token that is no whole token."""
        n = self.merged.young.get(word) or self.merged.again(word)
        if n is None:
            n = len(self.library.model.tokenize("".join([self.alphabet[b] for b in word.encode("utf-8")])))
            if len(word) <= LONG:
                self.merged.turn()
                self.merged.young[word] = n
        return n

    def _latin(self, text: str) -> int:
        words, whole = _PRE_TOKEN.findall(text), self.whole
        rest = [w for w in words if w not in whole]
        return len(words) - len(rest) + sum(map(self._merge, rest))

    def _foreign(self, piece: str) -> int:
        """Tokens of a piece with characters from U+0180 on: the library's own tables find its pre-tokens."""
        n = self.foreign.young.get(piece) or self.foreign.again(piece)
        if n is None:
            n = 0
            for shown, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece):
                n += 1 if piece[a:b] in self.whole else len(self.library.model.tokenize(shown))
            if len(piece) <= LONG:
                self.foreign.turn()
                self.foreign.young[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        n = 0
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            if part.isascii() or max(part) < "ƀ":
                n += self._latin(part)
            else:
                n += sum(self._latin(p) if p.isascii() or max(p) < "ƀ" else self._foreign(p) for p in _CUT.split(part))
        return n + len(parts) - 1


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text of docs (doc_id, text).

    Counts are the library's for a byte-level .json vocabulary, its special strings inside texts being one token each.
    Null and empty texts have 0 bytes and 0 tokens; a text of any length is counted whole; rows are independent, so
    repeated rows and ids, null ids and other columns (never read) change nothing; an empty table gives an empty result.
    The proven strings, at most the vocabulary's size, are broadcast; nothing is shuffled.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, whole.value)
        count = _COUNTERS[path].count
        for batch in batches:
            texts = batch.column("text")
            n = [count(t) for t in texts_of(texts)]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
