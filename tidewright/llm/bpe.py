"""Byte-level BPE: an encoder that backtracks over Aho-Corasick matches, and decoding by an offset table.

A text is cut into pieces by the tokenizer's pattern. In a piece, one run of an Aho-Corasick automaton over the reversed
tokens gives the longest token that starts at each byte. Tokens are taken from left to right, longest first; one is
accepted if it is compatible with the token before it, that is, if merging by rank would leave the border between the two alone.
Where no token fits, the last one is taken back and its next shorter prefix tried; a place that was given up is not tried again,
so a piece takes linear time, whatever it holds. An encoding of which all neighbours are compatible is the one that
merges make. Compatible pairs and short pieces are kept in tables of bounded size in each Python worker.

Decoding is one gather: a table of offsets into the joined bytes of all tokens.

The driver reads the vocabulary file and broadcasts what it holds (some 50,000 tokens; a vocabulary does not grow with the data). Rows are
encoded where they lie, without a shuffle. A text is cut between a visible character and a space about each million characters,
where no piece can cross, so what is held is bounded besides the text itself and its ids.

Defined results: null and empty texts have no ids; the strings of added tokens become these tokens, as the file says; bytes
that are not UTF-8 are read as U+FFFD. Null ids decode to the empty text, ids that no token has to nothing, broken UTF-8 to U+FFFD. All columns are kept; those
that are written (``ids``, ``decoded``) replace columns of these names.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import Scratch, chunks, column, map_rows, table, texts_of

VOCABULARY = "byte_bpe_50k.json"
SHORT = 64  # characters of a piece whose ids are kept
PIECES = 1 << 17  # kept at most, in each Python worker
PAIRS = 1 << 20
CUT = 1 << 20  # characters of a text that are cut into pieces at once
#: What splits a text before merges; {L}, {N}, {S}: letters, numbers, white space. Words come first, as they are most pieces.
PATTERN = " ?(?:[{L}]+|[{N}]+)|'(?:[stmd]|re|ve|ll)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"


@lru_cache
def _classes() -> dict[str, list[tuple[int, int]]]:
    """Ranges of letters, numbers and white space, as the tokenizers library's own Unicode tables have them."""
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, found = "".join(map(chr, points)), {}
    for name, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        others = [span for _, span in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every)]
        at, ranges = 0, []
        for lo, hi in [*others, (len(points), len(points))]:
            if lo > at:
                ranges.append((points[at], points[lo - 1]))
            at = hi
        found[name] = ranges
    return found


def _pattern(pattern: str, classes: dict, top: int = 0x10FFFF):
    """``pattern`` for texts of characters up to ``top``."""
    sets = {name: "".join(f"\\U{lo:08x}-\\U{min(hi, top):08x}" for lo, hi in ranges if lo <= top) for name, ranges in classes.items()}
    return re.compile(pattern.format(**sets))


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict:
    """What encoder and decoder need of a tokenizer file of kind byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, split, added = said["model"], said["pre_tokenizer"], said["added_tokens"]
    plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and said["normalizer"] is None
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path} is no plain byte-level BPE")
    byte_of = _byte_of()
    ids = model["vocab"]
    tokens = [b""] * (1 + max([*ids.values(), *[t["id"] for t in added]]))
    for name, i in ids.items():
        tokens[i] = bytes(byte_of[c] for c in name)
    for t in added:
        tokens[t["id"]] = t["content"].encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    if len({m[2] for m in merges}) < len(merges) or any(c not in ids for c in byte_of):
        raise ValueError(f"{path}: each byte must be a token, each other token must have one merge")
    return {"tokens": tokens, "bytes": [ids[c] for c in byte_of], "merges": merges, "added": {t["content"]: t["id"] for t in added}, "classes": _classes()}


class Encoder:
    def __init__(self, known: dict):
        import ahocorasick

        self.tokens, size = known["tokens"], len(known["tokens"])
        self.length = [len(t) for t in self.tokens]
        self.rank, self.left, self.right, self.merged = [-1] * size, [-1] * size, [-1] * size, {}
        for rank, (a, b, t) in enumerate(known["merges"]):
            self.rank[t], self.left[t], self.right[t] = rank, a, b
            self.merged[a, b] = rank
        made = {self.tokens[t]: t for t in chain(known["bytes"], (m[2] for m in known["merges"]))}
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.automaton = ahocorasick.Automaton()
        for text, t in made.items():
            self.shorter[t] = next((made[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in made), -1)
            self.automaton.add_word(text[::-1].decode("latin-1"), t)
        self.automaton.make_automaton()
        self.pieces = _pattern(PATTERN, known["classes"]).findall
        self.latin = _pattern(PATTERN, known["classes"], 0xFF).findall  # small sets of characters are several times as fast
        self.border = _pattern("(?<=[^{S}])(?=[{S}])", known["classes"])
        self.added = known["added"]
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        self.fits: dict[int, bool] = {}
        self.memo = _Memo(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merges keep the border between tokens a and b.

        Walks back in time from the finished tokens: along the right edge of a and the left edge of b, undoing
        what was merged last. A merge across the border would have come first if its rank is below that of the merge that
        took in the left side, and at most that of the one that took in the right side (of equals the leftmost goes first).
        """
        key = a << 32 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        until_a = until_b = len(self.merged)
        fits = True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < until_a and across <= until_b:
                fits = False
                break
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                until_b, b = self.rank[b], self.left[b]
            else:
                break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece(self, data: bytes) -> list[int]:
        """Token ids of the bytes of one piece."""
        n, out = len(data), []
        longest = [-1] * n
        for end, t in self.automaton.iter(data[::-1].decode("latin-1")):
            if longest[n - 1 - end] < 0:  # at each place the longest is reported first
                longest[n - 1 - end] = t
        given_up = bytearray(n + 1)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        pos, t = 0, longest[0] if n else -1
        while pos < n:
            while t >= 0 and (given_up[pos + length[t]] or (out and not compatible(out[-1], t))):
                t = shorter[t]
            if t >= 0:
                out.append(t)
                pos += length[t]
                t = longest[pos] if pos < n else -1
            else:
                given_up[pos] = 1
                last = out.pop()
                pos -= length[last]
                t = shorter[last]
        return out

    def _cuts(self, text: str):
        at = 0
        while len(text) - at > CUT:
            border = self.border.search(text, at + CUT)
            if border is None:
                break
            yield text[at : border.start()]
            at = border.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.apart(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            for cut in self._cuts(part):
                pieces = self.latin if _is_latin(cut) else self.pieces
                out.append(b"".join(map(self.memo.__getitem__, pieces(cut))))
        return b"".join(out)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Memo(dict):
    """The packed ids of short pieces."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encoder.piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = packed
        return packed


def _with(batch, column):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "made"])


def _mapped(df: DataFrame, run, name: str, kind: T.DataType) -> DataFrame:
    """``df`` with the column that ``run`` makes, over one of this name."""
    made = map_rows(df, run, **{"made ": kind})
    kept = [c for c in df.columns if c != name]
    return made.select(*[column(c) for c in kept], column("made ").alias(name))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of a text column, packed as little-endian unsigned 32-bit integers (binary)."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        import pyarrow as pa

        known = sent.value
        if "encoder" not in known:  # the worker keeps what was broadcast, and this with it, from task to task
            known["encoder"] = Encoder(known)
        encoder = known["encoder"]
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            packed = [encoder.encode(t.as_py().decode("utf-8", "replace")) if t.is_valid else b"" for t in texts]
            yield _with(batch, pa.array(packed, pa.binary()))

    return _mapped(df, run, out, T.BinaryType())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of packed token ids."""
    tokens = vocabulary(path)["tokens"]
    sent = df.sparkSession.sparkContext.broadcast({"joined": b"".join(tokens), "offsets": np.cumsum([0, *map(len, tokens)])})

    def run(batches):
        import pyarrow as pa

        joined, offsets = np.frombuffer(sent.value["joined"], np.uint8), sent.value["offsets"]
        for batch in batches:
            data, ends = texts_of(batch.column(ids))
            done = []
            for lo, hi in chunks(ends):
                here = data[ends[lo] : ends[hi]].view("<u4").astype(np.int64)
                here[here >= len(offsets) - 1] = -1
                size = np.where(here >= 0, offsets[here + 1] - offsets[here], 0)
                after = np.cumsum(size)
                place = np.arange(after[-1] if len(after) else 0) + np.repeat(offsets[here] - after + size, size)
                text, after = joined[place].tobytes(), np.concatenate([[0], after])[(ends[lo : hi + 1] - ends[lo]) // 4].tolist()
                done += [text[a:b].decode("utf-8", "replace") for a, b in zip(after, after[1:])]
            yield _with(batch, pa.array(done, pa.string()))

    return _mapped(df, run, out, T.StringType())


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    done = decode(coded, path)
    digests = done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
    return Scratch(spark).save(digests, "digests")
