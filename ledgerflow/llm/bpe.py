"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of every prefix of a piece ends in exactly one token. With
``last[i]`` the last token of the prefix of i bytes, token t of n bytes is
``last[i]`` if it ends there (found by an automaton over the vocabulary that
reports every token that is a suffix of the text read so far) and the
encoding of the n bytes shorter prefix stays as it is next to t, which
depends on its last token alone: ``last[i - n]`` and t must be compatible,
that is, be the encoding of their own concatenation. Following ``last`` back
from the end gives the ids. The time is linear in the piece, however long.

Pieces are what the tokenizer's pattern cuts a text into; the added token's
own string is cut out first, as the tokenizers library does. Pieces recur, so
each worker keeps the ids of the pieces it has met (``CACHED_PIECES`` at
most, then it starts afresh). The tables are built from the tokenizer's file,
whose path is a parameter; only vocabularies of this kind (byte level, no
normaliser, no dropout, no prefix space) are taken.

Null text counts as empty; an empty text has no ids and decodes to the empty
text. Decoding joins the tokens' bytes and reads them as UTF-8; bytes that
are not UTF-8 become U+FFFD. An empty table gives an empty answer.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.llm.common import prepare, text_of

# Pieces whose ids a worker keeps: up to so many new ones, and as many of the time before.
CACHED_PIECES = 400_000
# Pairs of tokens whose compatibility a worker keeps.
CACHED_PAIRS = 1_000_000
# The byte-level pattern (a fixed value: what the vocabulary was made with).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as a visible character: itself, or the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


class Recent(dict):
    """Results of ``make`` by argument; at ``most`` entries the dict becomes the older one and starts afresh."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class PrefixBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and not before["add_prefix_space"]
        if not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        spelled = byte_characters()
        as_bytes = {word: bytes(spelled[c] for c in word) for word in model["vocab"]}
        self.token_bytes = {token: as_bytes[word] for word, token in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {token: text.encode() for text, token in self.added.items()}
        # Of a merged token: its two parts and when (by rank) they merge; of a pair: its rank.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (model["vocab"][left], model["vocab"][right]), model["vocab"][left + right]
            self.pair_rank.setdefault(pair, rank)
            if token not in self.parts:
                self.parts[token], self.rank_of[token] = pair, rank
        self.automaton = ahocorasick.Automaton()
        for word, token in model["vocab"].items():
            if token in self.parts or len(as_bytes[word]) == 1:  # others no merge can make
                self.automaton.add_word(as_bytes[word].decode("latin-1"), (token, len(as_bytes[word])))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.ids_of_piece = Recent(self.encode_piece, CACHED_PIECES)
        self.fits = Recent(lambda pair: self.compatible(*pair), CACHED_PAIRS)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes, one after the other, is just these two.

        Undoes merges on either side of the seam, latest first. While x and y
        face each other there, until x merges leftwards at rank ``x_until`` or
        y rightwards at ``y_until``, their own merge must not come first; of
        equal ranks the one further left comes first.
        """
        x, y, x_until, y_until = left, right, NEVER, NEVER
        while True:
            rank = self.pair_rank.get((x, y), NEVER)
            if rank < x_until and rank <= y_until and rank != NEVER:
                return False
            x_made, y_made = self.rank_of.get(x, -1), self.rank_of.get(y, -1)
            if x_made > y_made:
                x_until, x = x_made, self.parts[x][1]
            elif y_made >= 0:
                y_until, y = y_made, self.parts[y][0]
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        text = piece.encode("utf-8", "replace").decode("latin-1")
        last: list[tuple[int, int]] = [(-1, 0)] * (len(text) + 1)  # (token, its bytes)
        fits = self.fits
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end][1]:
                continue  # the one last token of this prefix is known
            before = end - size
            if before and not fits[last[before][0], token]:
                continue
            last[end] = (token, size)
        ids, at = [], len(text)
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        return tuple(reversed(ids))

    def _encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of_piece.__getitem__, self.pieces(text))))

    def encode(self, text: str) -> list[int]:
        if not self.added or not any(a in text for a in self.added):
            return self._encode_plain(text)
        ids: list[int] = []
        for part in self.cut_added(text):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                ids += self._encode_plain(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    """The encoder of a file, built once per process."""
    return PrefixBpe(path)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: array of ids, and the text they decode to."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        bpe = load(tokenizer)
        for batch in batches:
            for part in _slices(batch):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                texts = [bpe.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    schema = T.StructType(
        [given.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    return given.mapInArrow(run, schema)


def _slices(batch, rows: int = 256):
    """The batch in parts of few rows, so that what a part expands to stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encoded`` with the digests taken where the ids are made."""
    prepare(docs.sparkSession)

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        bpe = load(tokenizer)
        spelled = {token: str(token) for token in bpe.token_bytes}
        for batch in batches:
            counts, ids_sha, texts_sha = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                counts.append(len(ids))
                ids_sha.append(sha256(",".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                texts_sha.append(sha256(bpe.decode(ids).encode("utf-8", "replace")).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(texts_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return given.mapInArrow(run, T.StructType([given.schema["doc_id"], *[T.StructField(n, k) for n, k in kinds]]))
