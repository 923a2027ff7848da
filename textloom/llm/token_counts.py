"""Token counts by the whole-token shortcut.

Which strings of a vocabulary encode alone as one token is proved once, by encoding each of them: the
merges need not reach every entry, and normalising may change it. A pre-token among the proved strings
counts one and is never merged; only the rest goes through the merges.

Texts are cut at white space, which such tokenizers drop and no token spans. A piece of ASCII is lower-cased
and cut into pre-tokens by the tokenizer's own rule; a piece with other signs, or with what may be a
special string, is counted by the tokenizer itself, since its normalising is not repeated here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import prepare, read, utf8

LIMIT = 2048
#: The tokenizer's rule for pre-tokens on lower-case ASCII (fixed value, as in its file, classes written out).
_PRE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    """The tokenizer of a file, if it is of the kind that the shortcut holds for: BPE with word ends, lower case, white
    space dropped, pre-tokens by the rule above; ValueError otherwise."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    steps = [p.get("pattern", {}).get("Regex") for p in (kind["pre_tokenizer"] or {}).get("pretokenizers", [])]
    lower = "Lowercase" in [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
    if kind["model"]["type"] != "BPE" or not kind["model"].get("end_of_word_suffix") or steps[:1] != [_SPLIT] or not lower:
        raise ValueError(f"the whole-token shortcut does not hold for {path}")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def _byte_of_sign() -> dict[str, int]:
    """The byte-level alphabet of such tokenizers: printable Latin-1 stands for itself, the other bytes
    for the code points from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def whole_tokens(path: str) -> list[bytes]:
    """The proof: all strings of the vocabulary (UTF-8, in order) that encode alone as the one token they name. At most as
    many as the vocabulary has entries, whatever the corpus."""
    tokenizer = load(path)
    byte, suffix = _byte_of_sign(), tokenizer.model.end_of_word_suffix
    own = []
    for entry, token in tokenizer.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(suffix):
            continue
        try:
            own.append((bytes(byte[c] for c in entry.removesuffix(suffix)).decode(), token))
        except (KeyError, UnicodeDecodeError):  # a part of a sign stands for no text
            continue
    encoded = tokenizer.encode_batch([s for s, _ in own], add_special_tokens=False)
    return sorted(s.encode() for (s, token), e in zip(own, encoded, strict=True) if e.ids == [token])


class PieceCounts(dict):
    """Tokens of pieces without white space. Whole tokens are entries from the start and stay; the others are a cache
    of bounded size, on which no result depends."""

    MOST = 60_000_000  # bytes of cached pieces, about

    def __init__(self, path: str, whole: list[bytes]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole = load(path), frozenset(whole)
        self.held = 0

    def __missing__(self, piece: bytes) -> int:
        if piece.isascii() and b"<|" not in piece:
            parts = _PRE.findall(piece.lower())
            n = self._merged(parts[0]) if parts == [piece] else sum(map(self.__getitem__, parts))
        else:
            n = len(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)
        if self.held > self.MOST:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
            self.held = 0
        self[piece] = n
        self.held += len(piece) + 120
        return n

    def _merged(self, pre_token: bytes) -> int:
        """Tokens of an ASCII pre-token that is no whole token."""
        if pre_token.isalnum():
            return len(self.tokenizer.model.tokenize(pre_token.decode()))
        return len(self.tokenizer.encode(pre_token.decode(), add_special_tokens=False).ids)

    def of(self, raw: bytes) -> int:
        return sum(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


_loaded: dict[str, PieceCounts] = {}
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text; other columns ignored) -> doc_id, n_bytes (UTF-8), n_tokens of each whole text, as the tokenizer
    gives them without special tokens added; special strings inside a text count as it counts them.

    Null and empty texts have no tokens. Rows are independent: null ids, ties and repeated rows each give their row,
    an empty table gives an empty result. ValueError for a tokenizer of another kind.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or default_tokenizer()
    proved = spark.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = PieceCounts(path, proved.value)
        known = _loaded[path]
        for b in batches:
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(known.of, raw), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("raw")).mapInArrow(run, COUNTS)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
