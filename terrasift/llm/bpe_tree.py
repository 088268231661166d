"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The root of the tree gives the leftmost pair of the lowest rank. A merge changes three leaves and their
ancestors, in one walk up, so a piece of n bytes takes O(n log n) at most, also where it has no white space at all.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.common import keep_only, tune

#: Fixed value: the pattern by which byte-level BPE cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces are remembered up to this length, two generations of so many (some 50 MB a worker).
KEEP_LENGTH, KEEP_PIECES = 48, 75_000
#: Children of a node of the tree; the rank of a pair that does not merge.
FAN, NEVER = 16, 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class RankTree:
    """A segment tree in which each inner node holds the least of its FAN children.

    Leaf i holds rank * n + i of the pair that begins at symbol i, n being the number of symbols: the root is the
    lowest rank, and of equal ones the leftmost. NEVER * n and more stands for no pair. The root's children are
    the last of the rows, so a piece of up to FAN pairs is a root with its leaves.
    """

    __slots__ = ("rows",)

    def __init__(self, leaves: list[int]) -> None:
        self.rows = [leaves]
        while len(row := self.rows[-1]) > FAN:
            self.rows.append([min(row[i : i + FAN]) for i in range(0, len(row), FAN)])

    def changed(self, *at: int) -> None:
        """Bring the ancestors of leaves up to date, each of them once."""
        nodes, below = set(at), self.rows[0]
        for row in self.rows[1:]:
            nodes = {i // FAN for i in nodes}
            for i in nodes:
                row[i] = min(below[i * FAN : i * FAN + FAN])
            below = row


class Pieces(dict):
    """What is known of pieces, in two generations: once the young one is full it becomes the old one.

    Pieces that come again and again are carried over, so rare ones do not drive them out.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> tuple[str, bytes, int]:
        out = self.old.get(piece) or self.codec.entry(piece)
        if len(piece) <= KEEP_LENGTH:
            if len(self) >= KEEP_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def refuse_others(spec: dict) -> None:
    """Raise for what this encoder does not do: all but plain byte-level BPE with plain special tokens."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = {
        "a normalizer": spec.get("normalizer"),
        "a pre-tokenizer other than ByteLevel": cut.get("type") != "ByteLevel",
        "a space before the text": cut.get("add_prefix_space"),
        "another pattern of pieces": not cut.get("use_regex", True),
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "marks of words": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
        "dropout, byte fallback or unmerged words": model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"),
        "special tokens that take more than their text": any(x.get(k) for x in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")),
    }
    if found := [what for what, there in odd.items() if there]:
        raise ValueError(f"the tokenizer file asks for {', '.join(found)}")


class Codec:
    """A tokenizer file as tables: encodes and decodes whole texts."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        refuse_others(model)
        letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        vocab = model["model"]["vocab"]
        self.first = [vocab[c] for c in letters]
        #: Ranks of pairs of symbols, and what each rank's pair becomes.
        self.ranks: dict[int, int] = {}
        self.result: list[int] = []
        for rank, merge in enumerate(model["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.result.append(vocab[a + b])
        #: Ranks of pairs of bytes: what the leaves hold at first.
        self.byte_ranks = [self.ranks.get(a << 32 | b, NEVER) for a in self.first for b in self.first]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find = regex.compile(PIECES).findall
        self.known = Pieces(self)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        ranks, result, none = self.ranks.get, self.result, NEVER * n
        at_first = self.byte_ranks
        leaves = [at_first[a << 8 | b] * n + i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))]
        tree = RankTree(leaves)
        top, deep = tree.rows[-1], len(tree.rows) > 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := min(top)) < none:
            rank, i = divmod(least, n)
            j = after[i]
            h, k = before[i], after[j]
            ids[i] = new = result[rank]
            ids[j] = -1
            after[i] = k
            if k < n:
                before[k] = i
                leaves[i] = ranks(new << 32 | ids[k], NEVER) * n + i
                leaves[j] = none
            else:
                leaves[i] = none
                if j < n - 1:
                    leaves[j] = none
            if h >= 0:
                leaves[h] = ranks(ids[h] << 32 | new, NEVER) * n + h
            if deep:
                tree.changed(max(h, 0), i, min(j, n - 2))
        return [x for x in ids if x >= 0]

    def entry(self, piece: str) -> tuple[str, bytes, int]:
        """A piece's ids as text, the bytes that these ids decode to, and their number."""
        ids = self.merged(piece.encode())
        return ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)), len(ids)

    def entries(self, text: str) -> list[tuple[str, bytes, int]]:
        known = self.known.__getitem__
        if not self.cut:
            return list(map(known, self.find(text)))
        out: list[tuple[str, bytes, int]] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append((str(self.special[part]), part.encode(), 1))
            else:
                out += map(known, self.find(part))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _, _ in self.entries(text) for x in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; ids that the file does not have give nothing; broken UTF-8 gives U+FFFD."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec per worker and file."""
    keep_only("codecs", _codecs.clear)
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _spec(df: DataFrame, tokenizer: str):
    """The tokenizer file (a megabyte or two, whatever the input), read once on the driver and sent to each executor."""
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows with `ids` array<int> of their whole `text` added. A null text counts as empty and has no ids.

    A column `ids` that docs has already is replaced; all others stay. Repeated rows stay repeated.
    """
    tune(docs.sparkSession)
    spec, kept = _spec(docs, tokenizer), docs.drop("ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for b in it:
            ids = [own.encode(x or "") for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return kept.mapInArrow(work, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Rows with `decoded` string of their `ids` added; null ids give an empty text."""
    tune(encoded.sparkSession)
    spec, kept = _spec(encoded, tokenizer), encoded.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for b in it:
            out = [own.decode(x or []) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return kept.mapInArrow(work, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode, decode and hash in one pass over the text.

    Null texts count as empty (no tokens, hashes of nothing). Null ids stay null, repeated rows stay repeated, an
    empty table gives no rows, columns besides doc_id and text are not read. Pairs of equal rank merge from the left.
    The widest thing in memory is one Arrow batch of texts; a piece of any length takes time in proportion to its
    length times that length's logarithm.
    """
    tune(docs.sparkSession)
    spec = _spec(docs, tokenizer)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for b in it:
            n, ids_hash, text_hash = [], [], []
            for text in b.column(1).to_pylist():
                found = own.entries(text or "")
                n.append(sum(x[2] for x in found))
                ids_hash.append(hashlib.sha256(",".join([x[0] for x in found]).encode()).hexdigest())
                decoded = b"".join([x[1] for x in found]).decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
